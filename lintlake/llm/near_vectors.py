"""Near-duplicate vectors by product quantisation.

A sample gives coarse centroids of the two halves of a vector and, for the
residuals, a codebook per subspace. A pair of half centroids is an inverted list, so
a bounded sample makes as many lists as the rows need. Every vector stands in the
list of its nearest pair, as codes with their error. It then probes the lists of its
nearest pairs: table look-ups give the distance to each member's codes, and members
whose distance allows the cosine are compared exactly in double precision. Lists and
their queries are cut into tiles of bounded size, so a list may hold any share of
the rows. Vectors of each length have an index of their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lintlake.llm.components import connected_components
from lintlake.llm.shared import worker_state, written

#: Vectors that all indexes are fitted on at most; members that a list should have.
SAMPLE, LIST_ROWS = 20_000, 256
#: Centroids of a half at most (their square is the number of lists); subspaces; codes of a subspace; lists that a vector
#: probes; nearest centroids of each half that are paired.
CENTROIDS, SUBSPACES, CODES, PROBES, PAIRED = 2_048, 16, 64, 12, 16
#: Lists whose tiles are broadcast at most.
BROADCAST_LISTS = 200_000
#: Members and queries of a tile at most (by hash, so about).
TILE_MEMBERS, TILE_QUERIES = 1_024, 4_096


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Lloyd's centroids of the rows; empty ones take a random row."""
    k = min(k, len(x))
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = (((centres**2).sum(1))[None, :] - 2 * x @ centres.T).argmin(1)
        counts = np.bincount(near, minlength=k)
        sums = np.stack([np.bincount(near, weights=x[:, d], minlength=k) for d in range(x.shape[1])], axis=1)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], x[rng.integers(0, len(x), k)])
    return centres


@dataclass
class VectorIndex:
    """Coarse centroids of both halves and the codebooks of residual subspaces."""

    halves: tuple[np.ndarray, np.ndarray]  # centroids x dimensions of the half
    books: list[np.ndarray]  # per subspace: codes x its dimensions
    cuts: list[int]

    @classmethod
    def fit(cls, sample: np.ndarray, rows: int, seed: int = 7) -> VectorIndex:
        """Fit on unit vectors; ``rows`` is the number of all vectors."""
        rng = np.random.default_rng(seed)
        k = max(1, min(CENTROIDS, math.ceil(math.sqrt(rows / LIST_ROWS)), len(sample)))
        cut = (sample.shape[1] + 1) // 2
        index = cls((kmeans(sample[:, :cut], k, 8, rng), kmeans(sample[:, cut:], k, 8, rng) if cut < sample.shape[1] else np.zeros((1, 0))), [], [])
        residual = sample - index.centres(index.probes(sample, 1)[:, 0])
        index.cuts = np.linspace(0, sample.shape[1], min(SUBSPACES, sample.shape[1]) + 1).astype(int).tolist()
        index.books = [kmeans(residual[:, x:y], CODES, 8, rng) for x, y in zip(index.cuts, index.cuts[1:])]
        return index

    def centres(self, lists: np.ndarray) -> np.ndarray:
        """The centroids of lists, both halves joined."""
        first, second = self.halves
        return np.hstack([first[lists // len(second)], second[lists % len(second)]])

    def probes(self, x: np.ndarray, n: int = PROBES) -> np.ndarray:
        """The ``n`` nearest lists of each row, the nearest first: the best pairs of each half's nearest centroids."""
        near, far, at = [], [], 0
        for c in self.halves:
            part = x[:, at : at + c.shape[1]]
            at += c.shape[1]
            distance = (c**2).sum(1)[None, :] - 2 * part @ c.T
            w = min(PAIRED, len(c))
            top = np.argpartition(distance, w - 1, axis=1)[:, :w]
            near.append(top)
            far.append(np.take_along_axis(distance, top, 1))
        pairs = (far[0][:, :, None] + far[1][:, None, :]).reshape(len(x), -1)
        n = min(n, pairs.shape[1])
        best = np.argpartition(pairs, n - 1, axis=1)[:, :n]
        best = np.take_along_axis(best, np.take_along_axis(pairs, best, 1).argsort(axis=1, kind="stable"), 1)
        w = near[1].shape[1]
        return np.take_along_axis(near[0], best // w, 1) * len(self.halves[1]) + np.take_along_axis(near[1], best % w, 1)

    def encode(self, x: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals to the rows' lists, and the length of what the codes miss."""
        residual = x - self.centres(lists)
        codes = np.empty((len(x), len(self.books)), np.uint8)
        missed = np.zeros(len(x))
        for m, book in enumerate(self.books):
            part = residual[:, self.cuts[m] : self.cuts[m + 1]]
            codes[:, m] = ((book**2).sum(1)[None, :] - 2 * part @ book.T).argmin(1)
            missed += ((part - book[codes[:, m]]) ** 2).sum(1)
        return codes, np.sqrt(missed)

    def distances(self, queries: np.ndarray, which: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances from each query to each coded member of one list, by table look-ups."""
        residual = queries - self.centres(np.array([which]))
        out = np.zeros((len(queries), len(codes)), np.float32)
        for m, book in enumerate(self.books):
            part = residual[:, self.cuts[m] : self.cuts[m + 1]]
            table = ((part[:, None, :] - book[None]) ** 2).sum(2).astype(np.float32)
            out += table[:, codes[:, m]]
        return out


def found_pairs(index: VectorIndex, which: int, queries: np.ndarray, members: np.ndarray, codes: np.ndarray, missed: np.ndarray, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query rows, member rows) of pairs at or over the cosine, in blocks of queries.

    A member lies within its codes' error of them, so a pair at the threshold can't
    be further than the sum: no pair of a probed list is lost before the exact check.
    """
    reach = (np.sqrt(2 - 2 * cosine) + missed + 1e-3) ** 2
    for at in range(0, len(queries), 256):
        block = queries[at : at + 256]
        q, m = np.nonzero(index.distances(block, which, codes) <= reach[None, :])
        if len(q) * 10 > len(block) * len(members):  # a dense tile: one product serves all its pairs
            good = (block @ members.T)[q, m] >= cosine
        else:
            good = np.concatenate([np.einsum("ij,ij->i", block[q[i : i + 50_000]], members[m[i : i + 50_000]]) for i in range(0, len(q), 50_000)] or [np.zeros(0)]) >= cosine
        yield q[good] + at, m[good]


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect the same nodes as the edges a-b: each node with the least one it reaches."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        np.minimum.at(new, x, label[y])
        np.minimum.at(new, y, label[x])
        new = new[new]
        if (new == label).all():
            break
        label = new
    return [(int(nodes[k]), int(nodes[v])) for v, k in enumerate(label) if k != v]


def usable_vectors(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """``id``, ``v`` (array<double>), ``h1``, ``h2`` of rows that can link: no nulls, finite, not zero."""
    v = F.col("v")
    rows = vectors.select(F.col(id_column).alias("id"), F.col(vector_column).cast("array<double>").alias("v")).where("v is not null and size(v) > 0")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return rows.where(good).withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), "v")})


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that no square over- or underflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _samples(distinct: DataFrame, rows: dict[int, int]) -> dict[int, np.ndarray]:
    """Of each length the vectors of the lowest hashes, ``SAMPLE`` in all at most."""
    each = max(2, SAMPLE // len(rows))
    # so few pass the hash that the sort takes little more than the sample
    share = F.create_map(*[F.lit(x) for n, k in rows.items() for x in (n, min(1.0, 1.5 * each / k + 0.001))])
    passed = distinct.where(F.pmod(F.col("h2"), F.lit(1 << 30)) < share[F.size("v")] * (1 << 30))
    place = F.row_number().over(Window.partitionBy(F.size("v")).orderBy("h2", "h1"))
    found: dict[int, list] = {n: [] for n in rows}
    for r in passed.withColumn("place", place).where(F.col("place") <= each).select("v").toLocalIterator():
        found[len(r["v"])].append(r["v"])
    return {n: np.array(v) for n, v in found.items() if v}


def near_duplicates(vectors: DataFrame, cosine: float = 0.95, id_column: str = "vec_id", vector_column: str = "embedding", probes: int = PROBES) -> DataFrame:
    """``id_column``, ``n_links``, ``component_id``, ``kept`` for every row.

    Vectors that are null or zero, or hold null or non-finite components, link with
    nothing. Rows without an id link as all others do, but name no component: theirs is
    null if no row of it has an id, and else they are not kept. Vectors of other
    lengths don't link with each other. Equal vectors are indexed once and count as
    often as they occur. Repeated rows, and rows of one id with other vectors, are
    vectors of their own. An empty table gives none.
    """
    spark = vectors.sparkSession
    usable = usable_vectors(vectors, id_column, vector_column)
    # a vector is known by its row in the written table, not by an id
    distinct = usable.groupBy("h1", "h2").agg(F.min("id").alias("least_id"), F.count(F.lit(1)).alias("weight"), F.first("v").alias("v"))
    distinct = written(distinct.withColumn("rep", F.monotonically_increasing_id()), "vectors")
    # lengths of vectors are few: one for each model that made them
    rows = {r["n"]: r["rows"] for r in distinct.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("rows")).collect()}
    kind = dict(vectors.dtypes)[id_column]
    if not rows:
        none = vectors.select(F.col(id_column), F.lit(0).cast("long").alias("n_links"), F.col(id_column).cast("long").alias("component_id"))
        return none.withColumn("kept", F.lit(True))
    shared = spark.sparkContext.broadcast({n: VectorIndex.fit(unit(sample), rows[n]) for n, sample in _samples(distinct, rows).items()})

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state(("vectors",), dict)
        names = ["rep", "weight", "dim", "x", "lists", "codes", "missed"]
        for b in batches:
            lengths = np.diff(b.column(2).offsets.to_numpy())
            for n in np.unique(lengths).tolist():
                at = pa.array(np.flatnonzero(lengths == n))
                x = unit(b.column(2).take(at).flatten().to_numpy(zero_copy_only=False).reshape(len(at), n))
                index = shared.value[n]
                lists = index.probes(x, probes)
                codes, missed = index.encode(x, lists[:, 0])
                arrays = [b.column(0).take(at), b.column(1).take(at), pa.array(np.full(len(at), n, np.int32)), pa.array(list(x.astype("<f8")), pa.list_(pa.float64())), pa.array(lists.tolist(), pa.list_(pa.int32())), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(missed)]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    rows_ = distinct.select("rep", "weight", "v").repartition("rep")
    indexed = written(rows_.mapInArrow(assign, "rep long, weight long, dim int, x array<double>, lists array<int>, codes binary, missed double"), "index")
    members = indexed.select("dim", F.col("lists")[0].alias("list"), "rep", "weight", "x", "lists", "codes", "missed")
    queries = indexed.select("dim", F.explode("lists").alias("list"), "rep", "weight", "x", "lists", "codes", "missed")
    in_list = members.groupBy("dim", "list").agg(F.count(F.lit(1)).alias("members"))
    asking = indexed.select("dim", F.explode("lists").alias("list")).groupBy("dim", "list").agg(F.count(F.lit(1)).alias("queries"))
    tiles = in_list.join(asking, ["dim", "list"]).select("dim", "list", F.ceil(F.col("members") / TILE_MEMBERS).cast("int").alias("across"), F.ceil(F.col("queries") / TILE_QUERIES).cast("int").alias("down"))
    tiles = written(tiles, "tiles")
    if tiles.count() <= BROADCAST_LISTS:  # small by count; else the sides are shuffled
        tiles = F.broadcast(tiles)
    part = F.xxhash64("rep")
    copies = [
        members.join(tiles, ["dim", "list"]).withColumns({"at_across": F.pmod(part, F.col("across")), "at_down": F.explode(F.sequence(F.lit(0).cast("long"), F.col("down").cast("long") - 1)), "asks": F.lit(False)}),
        queries.join(tiles, ["dim", "list"]).withColumns({"at_down": F.pmod(part, F.col("down")), "at_across": F.explode(F.sequence(F.lit(0).cast("long"), F.col("across").cast("long") - 1)), "asks": F.lit(True)}),
    ]
    columns = ["dim", "list", "at_across", "at_down", "asks", "rep", "weight", "x", "lists", "codes", "missed"]
    tiled = copies[0].select(columns).unionByName(copies[1].select(columns))

    def compare(key: tuple, rows_of: pd.DataFrame) -> pd.DataFrame:
        index, which = shared.value[int(key[0])], int(key[1])
        asks = rows_of["asks"].to_numpy()
        q, m = rows_of[asks], rows_of[~asks]
        out = {"rep": [], "links": [], "other": []}
        if len(q) and len(m):
            ids_q, ids_m = q["rep"].to_numpy(), m["rep"].to_numpy()
            weight_q, weight_m = q["weight"].to_numpy(), m["weight"].to_numpy()
            home, asked = np.stack(q["lists"].to_numpy())[:, 0], np.stack(m["lists"].to_numpy())
            codes = np.frombuffer(b"".join(m["codes"]), np.uint8).reshape(len(m), -1)
            links_q, links_m = np.zeros(len(q), np.int64), np.zeros(len(m), np.int64)
            edges: list[tuple[int, int]] = []
            for a, b in found_pairs(index, which, np.stack(q["x"].to_numpy()), np.stack(m["x"].to_numpy()), codes, m["missed"].to_numpy(), cosine):
                other = ids_q[a] != ids_m[b]
                a, b = a[other], b[other]
                np.add.at(links_q, a, weight_m[b])
                # a member that asks the query's list too counts the pair itself
                returns = np.concatenate([(asked[b[i : i + 100_000]] == home[a[i : i + 100_000], None]).any(1) for i in range(0, len(a), 100_000)] or [np.zeros(0, bool)])
                np.add.at(links_m, b[~returns], weight_q[a[~returns]])
                edges += _forest(ids_q[a], ids_m[b])
            if edges:
                edges = _forest(*np.array(edges).T)
            for ids, links in ((ids_q, links_q), (ids_m, links_m)):
                at = np.flatnonzero(links)
                out["rep"] += ids[at].tolist()
                out["links"] += links[at].tolist()
                out["other"] += [None] * len(at)
            for a, b in edges:
                out["rep"].append(b)
                out["links"].append(0)
                out["other"].append(a)
        return pd.DataFrame({"rep": pd.array(out["rep"], "Int64"), "links": pd.array(out["links"], "Int64"), "other": pd.array(out["other"], "Int64")})

    found = written(tiled.groupBy("dim", "list", "at_across", "at_down").applyInPandas(compare, "rep long, links long, other long"), "links")
    links = found.where("other is null").groupBy("rep").agg(F.sum("links").alias("links"))
    parts = connected_components(found.where("other is not null").selectExpr("other as a", "rep as b")).withColumnRenamed("id", "rep")
    reps = distinct.select("h1", "h2", "rep", "least_id", "weight").join(links, "rep", "left").join(parts, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    least = reps.groupBy("component").agg(F.min("least_id").alias("component_id"))
    reps = reps.join(least, "component").select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    mine = usable.select("id", "h1", "h2").join(reps, ["h1", "h2"])
    rest = vectors.select(F.col(id_column).alias("id"), F.col(vector_column).cast("array<double>").alias("v"))
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    rest = rest.where(~F.coalesce(good & (F.size("v") > 0), F.lit(False))).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = mine.select("id", "n_links", "component_id").unionByName(rest)
    return out.select(F.col("id").cast(kind).alias(id_column), F.col("n_links").cast("long").alias("n_links"), F.col("component_id").cast("long").alias("component_id"), F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
