"""Relations that several queries share, written once a session in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

#: Paths by application, relation and source.
_WRITTEN: dict[tuple[str, str, str], str] = {}


#: Fixed value: bytes in memory for a byte of a written relation. 5.7 million syntax nodes of 34 columns take 29 MB of Parquet.
COMPRESSION = 80.0


def sized(spark: SparkSession) -> None:
    """Let plans estimate relations by what they take in memory: by their files' size alone, repetitive ones of many gigabytes are broadcast."""
    key = "spark.sql.sources.fileCompressionFactor"
    if float(spark.conf.get(key)) == 1.0:  # a setting of the session's own holds
        spark.conf.set(key, str(COMPRESSION))


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; if unset a folder in the warehouse, or a temporary one in a session on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        local = spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster")
        base = "file://" + tempfile.mkdtemp(prefix="spark-shared-") if local else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/shared"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


#: Fixed value: files or projects of one cluster.
CLUSTER = 2000

#: Number of clusters and their keys for what is written now, innermost last.
_CLUSTERED: list[tuple[int, tuple[str, ...]]] = []
#: Settings inside: joins on more than the clusters' keys use them, too, and what lies in place needs no broadcast.
_INSIDE = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}


@contextmanager
def clustering(spark: SparkSession, n: int, *by: str) -> Iterator[None]:
    """What is written inside, if it has the columns ``by``, lies in ``n`` clusters by their hash.

    Joins, aggregates and windows by these columns, and more, of what is planned inside need no shuffle.
    """
    before = {k: spark.conf.get(k) for k in _INSIDE}
    for k, v in _INSIDE.items():
        spark.conf.set(k, v)
    _CLUSTERED.append((n, by))
    try:
        yield
    finally:
        _CLUSTERED.pop()
        for k, v in before.items():
            spark.conf.set(k, v)


def clusters(rows: DataFrame) -> int:
    """The number of clusters for so many rows."""
    return -(-rows.count() // CLUSTER) or 1


#: Fixed value: rows of a page of an ordered relation. What is filtered by its order reads few pages.
PAGE = 2000


def clustered(df: DataFrame, name: str, *order: str) -> DataFrame:
    """``df``, whose partitions are the clusters already, written and read again; rows of a cluster by ``order``."""
    spark, (n, by) = df.sparkSession, _CLUSTERED[-1]
    path, table = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", f"lintlake_{uuid.uuid4().hex}"
    sized(spark)
    writer = df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(n, *by)
    if order:
        writer = writer.option("parquet.page.row.count.limit", str(PAGE)).sortBy(*order)
    writer.saveAsTable(table)
    return spark.table(table)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: what several plans read is computed once."""
    n, by = _CLUSTERED[-1] if _CLUSTERED else (0, ())
    if n and set(by) <= set(df.columns):
        return clustered(df.repartition(n, *by), name)  # plans drop this exchange if the rows lie in their clusters
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    sized(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Fixed value: plans that the driver makes at once.
PLANNERS = 8


def together(spark: SparkSession, made: list[tuple[str, Callable[[], DataFrame]]]) -> list[DataFrame]:
    """Relations that don't read one another, each planned and written in a thread of the driver: planning many small jobs in a row takes longer than running them."""

    def one(name: str, make: Callable[[], DataFrame]) -> DataFrame:
        return written(make(), name)

    with ThreadPoolExecutor(PLANNERS) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(one), *m) for m in made]]


def is_written(spark: SparkSession, name: str, source: str) -> bool:
    """Whether a session has the relation already."""
    return (spark.sparkContext.applicationId, name, source) in _WRITTEN


def written_once(spark: SparkSession, name: str, source: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The relation ``name`` of the tables in ``source``: written as Parquet at its first use in a session, read after it.

    What reads it pushes its filters and columns to the files; a lost executor
    costs the tasks it ran and no second parse.
    """
    sized(spark)
    key = (spark.sparkContext.applicationId, name, source)
    if key not in _WRITTEN:
        path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        make().write.option("compression", "zstd").parquet(path)
        _WRITTEN[key] = path
    return spark.read.parquet(_WRITTEN[key])
