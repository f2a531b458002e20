"""Connected components of a graph given as edges, by rounds of least labels and a bounded rest in one task."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.llm.shared import written


#: Edges that one task takes when a round is written, and that are left to one task in the end: small graphs need no rounds.
TASK_EDGES = 100_000


def _least(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node of a bounded number of edges with the least node it reaches."""
    up: dict[int, int] = {}

    def end(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            x, y = end(x), end(y)
            up[max(x, y)] = min(x, y)
    yield pa.RecordBatch.from_arrays([pa.array(list(up), pa.int64()), pa.array([end(x) for x in list(up)], pa.int64())], names=["id", "component"])


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``id``, ``component`` (the least id reachable) of every node in ``edges`` (``a``, ``b`` long).

    In a round each node points to the least of itself and its neighbours, pointers
    are followed to their ends, edges are renamed by them and repeated ones and loops
    go. Each round is written to the shared folder. Least labels are pre-aggregated
    before the shuffle, so a node with very many edges is no burden; joins on nodes are
    ones that adaptive execution splits. Rounds go on while there are more edges than
    ``TASK_EDGES``; one task then joins what is left. A round is a dozen of jobs, and
    the driver's memory goes by jobs: rounds on a few edges would cost it most.
    """
    edges = written(edges.selectExpr("least(a, b) as a", "greatest(a, b) as b").where("a < b").distinct(), name)
    left = edges.count()
    tasks = 1 + left // TASK_EDGES

    def kept(rows: DataFrame) -> DataFrame:
        return written(rows.coalesce(tasks), name)

    labels = None
    while left > TASK_EDGES:
        if labels is None:
            edges = edges.coalesce(tasks)
            both = edges.select(F.col("a").alias("id")).unionByName(edges.select(F.col("b").alias("id"))).distinct()
            labels = both.select("id", F.col("id").alias("component"))
        ends = edges.select(F.col("b").alias("node"), F.col("a").alias("least")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("least")))
        to = kept(ends.groupBy("node").agg(F.min("least").alias("least")))
        while True:  # chains of least labels are followed to their ends, each step doubling: 9 -> 5, 5 -> 2 gives 9 -> 2
            hop = to.select(F.col("node").alias("least"), F.col("least").alias("next"))
            step = kept(to.join(hop, "least", "left").select("node", F.coalesce("next", "least").alias("least"), (F.col("next") < F.col("least")).alias("moved")))
            to = step.select("node", "least")
            if step.where("moved").isEmpty():
                break
        labels = kept(labels.join(to.withColumnRenamed("node", "component"), "component", "left").select("id", F.coalesce("least", "component").alias("component")))
        renamed = edges.join(to.select(F.col("node").alias("a"), F.col("least").alias("x")), "a").join(to.select(F.col("node").alias("b"), F.col("least").alias("y")), "b")
        edges = kept(renamed.selectExpr("least(x, y) as a", "greatest(x, y) as b").where("a < b").distinct())
        left = edges.count()
    rest = written(edges.coalesce(1).mapInArrow(_least, "id long, component long"), name)
    if labels is None:
        return rest
    return kept(labels.join(rest.select(F.col("id").alias("component"), F.col("component").alias("least")), "component", "left").select("id", F.coalesce("least", "component").alias("component")))
