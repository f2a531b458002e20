"""Exact Jaccard join of documents by word n-grams, as a blocked sparse product.

The incidence matrix of documents by n-grams is never multiplied whole. A link
needs an overlap that follows from the two sizes, so two linked sets share one of
the n-grams that come first in each set (its prefix) under any common order; rare
n-grams first keeps the shared columns short. The order comes from a sketch of
n-gram counts over all documents.

Short columns of the prefix matrix are multiplied as they are: overlap counts of
pairs, discarded below the bound of their sizes. In longer columns each document is
paired with the leading one. What remains is compared whole, best partners first;
longer columns that aren't in one component then are multiplied in blocks of bounded
size, and each block gives only edges that connect its components.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.llm.bpe import slices
from lintlake.llm.components import connected_components
from lintlake.llm.near_vectors import _forest
from lintlake.llm.shared import worker_state, written

#: Cells of the count sketch and of its parts: a fixed size, whatever the input. Collisions only change the order.
CELLS, PART = 1 << 22, 1 << 16
#: Documents of a block, and their n-grams (both at most, by hash, so about); n-grams multiplied at once; copies' keys that a task remembers.
BLOCK, BLOCK_GRAMS, COLUMNS, SEEN = 1_024, 2_000_000, 2_048, 500_000
#: Documents with an n-gram, by the sketch, from which on its entries are dealt over several tasks, so many to each.
HOT = 4_096
#: Sets in a column whose pairs are counted at most; longer columns are stars and blocks.
SHORT = 24
#: Candidates that are broadcast to the scan of texts at most.
BROADCAST_ROWS = 1_000_000

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_PLACE = _RNG.integers(0, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of the input."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def shingle_sets(texts: list[str], n: int = 5) -> list[np.ndarray]:
    """Sorted 64-bit hashes of each text's distinct runs of ``n`` words (of all its words, if fewer; none without words).

    Words are runs of bytes other than space and 09 to 0D, with A-Z lower-cased.
    """
    raw = [t.encode() + b" " for t in texts]
    data = np.frombuffer(b" " + b"".join(raw), np.uint8)
    starts = np.cumsum([1, *map(len, raw)])
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    begin = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    end = np.flatnonzero(~space[:-1] & space[1:])
    sums = np.cumsum(_BYTE[data] * _powers(_BASE, len(data)), dtype=np.uint64)
    words = _mix((sums[end] - sums[begin - 1]) * _powers(_INVERSE, len(data))[begin])
    first = np.searchsorted(begin, starts)  # each text's first word
    runs = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for k in range(n):
        runs += words[k : k + len(runs)] * _PLACE[k]
    runs = _mix(runs)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(runs[a : b - n + 1]))
        elif b > a:
            out.append(_mix((words[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _key(shingles: np.ndarray) -> int:
    """A set's identity: 64 bits of a digest."""
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def _cells(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - CELLS.bit_length() + 1)).astype(np.int64)


def least_overlap(a, b, percent: int):
    """The least number of common elements of two sets of these sizes that link."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_length(size: int, percent: int) -> int:
    """Elements that one set must show so that any set it links with has one of them in its own prefix."""
    return size - -(-percent * size // 100) + 1


def _described(n: int):
    """Per document its size and key; at the end of a task the counts of its n-grams by cell."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state(("jaccard",), dict)
        from pyspark import TaskContext

        names, task = ["id", "hash", "size", "key", "part", "counts", "task"], TaskContext.get().partitionId()
        counts = np.zeros(CELLS, np.int32)
        seen: set[int] = set()
        for b in batches:
            sizes, keys = [], []
            for texts in slices([t or "" for t in b.column(1).to_pylist()], 1_000_000):
                for s in shingle_sets(texts, n):
                    key = _key(s)
                    sizes.append(len(s))
                    keys.append(key)
                    if key not in seen:  # copies count once in a task
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(key)
                        np.add.at(counts, _cells(s), 1)
            none = pa.nulls(b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), none.cast(pa.int32()), none.cast(pa.binary()), none.cast(pa.int32())], names=names)
        few = np.minimum(counts, 255).astype(np.uint8).reshape(-1, PART)
        parts = [k for k in range(len(few)) if few[k].any()]
        none = pa.nulls(len(parts), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(parts, pa.int32()), pa.array([few[k].tobytes() for k in parts], pa.binary()), pa.array([task] * len(parts), pa.int32())], names=names)

    return run


def _sum_parts(kind: str):
    """A part's counts of several tasks, or of several sums of them, as one."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(PART, np.int64)
        for x in rows["counts"]:
            total += np.frombuffer(x, kind)
        return pd.DataFrame({"part": [key[0]], "counts": [np.minimum(total, 65_535).astype("<u2").tobytes()]})

    return run


def _prefixes(order, n: int, percent: int):
    """Per distinct set of a task the n-grams of its prefix, rare ones first."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state(("jaccard",), dict)
        common = order.value
        seen: set[int] = set()
        for b in batches:
            for texts in slices([t or "" for t in b.column(0).to_pylist()], 1_000_000):
                keys, parts, sizes, salts = [], [], [], []
                for s in shingle_sets(texts, n):
                    key = _key(s)
                    if not len(s) or key in seen:
                        continue
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(key)
                    # s is sorted, so equal counts go by hash
                    times = common[_cells(s)]
                    order_ = np.argsort(times, kind="stable")[: prefix_length(len(s), percent)]
                    p = s[order_]
                    # a frequent n-gram's sets go to several tasks, by their key; 0 is an n-gram that stays whole
                    dealt = times[order_].astype(np.int64) // HOT
                    salts.append(np.where(dealt > 0, 1 + key % (dealt + 1), 0).astype(np.int32))
                    keys.append(key)
                    parts.append(p)
                    sizes.append(len(s))
                lengths = [len(p) for p in parts]
                flat = np.concatenate(parts or [np.zeros(0, np.uint64)]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(np.repeat(np.array(keys, np.int64), lengths)), pa.array(np.repeat(np.array(sizes, np.int32), lengths)), pa.array(np.concatenate(salts or [np.zeros(0, np.int32)]))], names=["gram", "key", "size", "salt"])

    return run


def _columns(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of entries in the order of gram, salt and key: those of grams with two sets at least, and all of dealt grams; copies go.

    Entries stream through; a gram's entries are never held together.
    """
    waiting = last = None  # the first entry of a gram until a second set comes; the last entry's gram, key and salt
    for b in batches:
        g, k, n, t = (b.column(i).to_numpy() for i in range(4))
        if not len(g):
            continue
        out: list[tuple[int, int, int]] = []
        # within a batch only grams that repeat or are dealt need a look; single ones are most
        same = np.concatenate([[last is not None and g[0] == last[0]], g[1:] == g[:-1]])
        look = np.flatnonzero(same | np.concatenate([same[1:], [True]]) | (t > 0))
        for i in look.tolist():
            entry = (g[i], k[i], n[i])
            if last is None or g[i] != last[0] or t[i] != last[2]:
                waiting = None if t[i] else entry
                out += [entry] if t[i] else []
            elif k[i] != last[1]:
                out += [waiting] if waiting else []
                waiting = None
                out.append(entry)
            last = (g[i], k[i], t[i])
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.array(c, np.int64)) for c in zip(*out)], names=["gram", "key", "size"])


def _overlap(n: int, percent: int):
    """Pairs of texts whose sets link, compared whole."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = shingle_sets([x.as_py(), y.as_py()], n)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield b.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return run


def block_links(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of the sets link: overlap counts from the product of their incidence matrix, in runs of columns."""
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    values, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    useful = times > 1
    place = np.cumsum(useful) - 1
    keep = useful[column]
    row, column = row[keep], place[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    overlap = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, int(useful.sum()), COLUMNS):
        a, b = np.searchsorted(column, [at, at + COLUMNS])
        part = np.zeros((len(sets), COLUMNS), np.float32)
        part[row[a:b], column[a:b] - at] = 1
        overlap += part @ part.T
    return overlap >= least_overlap(sizes[:, None], sizes[None, :], percent)


def _tile(n: int, percent: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        ids = rows["key"].to_numpy()
        sets = [s for texts in slices(rows["text"].tolist(), 1_000_000) for s in shingle_sets(texts, n)]
        links = block_links(sets, percent)
        a, b = np.nonzero(np.triu(links, 1))
        edges = _forest(ids[a], ids[b]) if len(a) else []
        return pd.DataFrame(edges, columns=["a", "b"], dtype="int64")

    return run


def _own_texts(n: int):
    """Texts whose set has the key that is wanted: ids may repeat with other texts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [_key(s) for texts in slices([t or "" for t in b.column(1).to_pylist()], 1_000_000) for s in shingle_sets(texts, n)]
            yield b.filter(pa.array([k == w for k, w in zip(keys, b.column(0).to_pylist())], pa.bool_()))

    return run


def _all_links(docs: DataFrame, described: DataFrame, order, n: int, percent: int) -> DataFrame:
    """Components of set keys that have a link: ``id`` (key), ``component``."""
    entries = docs.select("text").mapInArrow(_prefixes(order, n, percent), "gram long, key long, size int, salt int")
    columns = entries.repartition("gram", "salt").sortWithinPartitions("gram", "salt", "key").mapInArrow(_columns, "gram long, key long, size long")
    columns = written(columns, "columns")
    # a task may meet a set of another task again, but never twice within a gram and salt: keys decide the salt
    sets_of = columns.groupBy("gram").agg(F.count(F.lit(1)).alias("sets"), F.min(F.struct("key", "size")).alias("head")).where("sets > 1")
    short = columns.join(sets_of.where(f"sets <= {SHORT}").select("gram"), "gram", "left_semi").select("gram", "key", "size")
    long = columns.join(sets_of.where(f"sets > {SHORT}").select("gram", F.col("head.key").alias("first"), F.col("head.size").alias("first_size")), "gram")
    # the product of the short columns: overlap counts of pairs, which their sizes' bound discards
    # where even all long columns of the smaller number couldn't add what is missing
    other = short.select("gram", F.col("key").alias("b"), F.col("size").alias("size_b"))
    near = f"100 * least(size, size_b) >= {percent} * greatest(size, size_b)"
    counted = short.join(other, "gram").where(f"key < b and {near}").groupBy(F.col("key").alias("a"), "b").agg(F.count(F.lit(1)).alias("n"), F.first("size").alias("size_a"), F.first("size_b").alias("size_b"))
    in_long = long.groupBy("key").agg(F.count(F.lit(1)).alias("more"))
    counted = counted.join(in_long.select(F.col("key").alias("a"), F.col("more").alias("more_a")), "a", "left").join(in_long.select(F.col("key").alias("b"), F.col("more").alias("more_b")), "b", "left")
    needed = f"ceil({percent} * (size_a + size_b) / {100 + percent})"
    hidden = f"greatest(ceil({percent} * size_a / 100), ceil({percent} * size_b / 100)) - 1"
    pairs = written(counted.where(f"n + least(coalesce(more_a, 0), coalesce(more_b, 0)) >= {needed} - ({hidden})").select("a", "b", "n"), "pairs")
    # stars of the long columns: each set with the leading one that it shares most of them with
    fits = long.where(f"key != first and 100 * least(size, first_size) >= {percent} * greatest(size, first_size)")
    stars = fits.groupBy("first", "key").agg(F.count(F.lit(1)).alias("n")).select(F.col("first").alias("a"), F.col("key").alias("b"), "n")
    # first each set with its best partner; the pairs that these leave apart come second
    ends = pairs.select("a", "b", "n").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "n")).unionByName(stars)
    best = ends.groupBy("b").agg(F.max_by("a", F.struct("n", "a")).alias("a")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    best = written(best, "best")
    wanted = ends.select(F.col("a").alias("key")).unionByName(ends.select(F.col("b").alias("key"))).unionByName(long.select("key")).distinct()
    # a text of each set, found by its row's id and the text's own hash: ids may be null or repeat
    one = written(described.groupBy("key").agg(F.min(F.struct("id", "hash")).alias("row")).join(wanted, "key", "left_semi").select("key", F.col("row.id").alias("one"), F.col("row.hash").alias("hash")), "wanted")
    if one.count() <= BROADCAST_ROWS:  # a small table by count; else both sides are shuffled
        one = F.broadcast(one)
    hashed = docs.where("text is not null").withColumn("hash", F.xxhash64("text"))
    texts = hashed.join(one, (hashed["hash"] == one["hash"]) & F.col("id").eqNullSafe(F.col("one"))).select("key", "text")
    texts = written(texts.mapInArrow(_own_texts(n), "key long, text string").dropDuplicates(["key"]), "texts")

    def linked(some: DataFrame) -> DataFrame:
        with_b = some.join(texts.select(F.col("key").alias("b"), F.col("text").alias("text_b")), "b")
        both = with_b.join(texts.select(F.col("key").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")
        return written(both.mapInArrow(_overlap(n, percent), "a long, b long"), "links")

    def labelled(rows: DataFrame, links: DataFrame, *names: str) -> DataFrame:
        known = connected_components(links)
        for name in names:
            rows = rows.join(known.select(F.col("id").alias(name), F.col("component").alias(f"of_{name}")), name, "left").withColumn(f"of_{name}", F.coalesce(f"of_{name}", name))
        return rows

    links = linked(best)
    apart = labelled(pairs.select("a", "b").join(best, ["a", "b"], "left_anti"), links, "a", "b").where("of_a != of_b").select("a", "b")
    links = links.unionByName(linked(apart))
    # long columns whose sets aren't in one component yet
    rest = written(labelled(long.select("gram", "key", "first"), links, "key"), "long")
    split = rest.groupBy("gram").agg(F.min("of_key").alias("low"), F.max("of_key").alias("high")).where("low != high").select("gram")
    rest = rest.join(split, "gram", "left_semi")
    groups = connected_components(rest.where("key != first").select(F.col("first").alias("a"), F.col("key").alias("b"))).select(F.col("id").alias("key"), F.col("component").alias("group_id"))
    # sets that link are in one band of sizes or in neighbouring ones; bands are a hair wider, for rounding
    band = F.floor(F.log("size") / math.log(100.01 / percent)).cast("int")
    sized = groups.join(long.groupBy("key").agg(F.max("size").alias("size")), "key").withColumn("band", band)
    counts = sized.groupBy("group_id", "band").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("size") / BLOCK_GRAMS)).alias("blocks"))
    placed = sized.join(counts, ["group_id", "band"]).withColumn("block", F.pmod(F.xxhash64("key"), "blocks")).select("group_id", "band", "blocks", "block", "key")
    # pairs of blocks of a band, and of one with the next, are tiles
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    inner = placed.withColumn("other", upto("blocks")).select("group_id", "band", F.lit(False).alias("across"), F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "key")
    beside = counts.select("group_id", F.col("band").alias("to"), F.col("blocks").alias("others"))
    lower = placed.join(beside.withColumn("band", F.col("to") - 1), ["group_id", "band"]).withColumn("other", upto("others")).select("group_id", "band", F.lit(True).alias("across"), F.col("block").alias("i"), F.col("other").alias("j"), "key")
    upper = placed.join(beside.withColumn("band", F.col("to") + 1), ["group_id", "band"]).withColumn("other", upto("others")).select("group_id", (F.col("band") - 1).alias("band"), F.lit(True).alias("across"), F.col("other").alias("i"), F.col("block").alias("j"), "key")
    tiles = inner.unionByName(lower).unionByName(upper).join(texts, "key")
    found = written(tiles.groupBy("group_id", "band", "across", "i", "j").applyInPandas(_tile(n, percent), "a long, b long"), "tiles")
    return connected_components(links.unionByName(found))


def _linked(docs: DataFrame, n: int, percent: int, id_column: str, text_column: str) -> tuple[DataFrame, DataFrame]:
    """Per row its id, set size and set key; per key that has a link its component."""
    mine = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    both = written(mine.withColumn("hash", F.xxhash64("text")).mapInArrow(_described(n), "id long, hash long, size long, key long, part int, counts binary, task int"), "described")
    described = both.where("part is null").select("id", "hash", "size", "key")
    counts = both.where("part is not null").select("part", "counts", "task")
    tasks = counts.agg(F.count_distinct("task")).first()[0]
    # in two steps, so that no group holds the counts of all tasks
    some = counts.withColumn("group", F.pmod("task", F.lit(math.isqrt(tasks) + 1))).groupBy("part", "group").applyInPandas(_sum_parts("u1"), "part int, counts binary")
    sums = some.groupBy("part").applyInPandas(_sum_parts("<u2"), "part int, counts binary")
    common = np.zeros(CELLS, np.uint16)
    for r in sums.collect():  # the sketch has a fixed size
        common[r["part"] * PART : (r["part"] + 1) * PART] = np.frombuffer(r["counts"], "<u2")
    parts = _all_links(mine, described.where("size > 0"), docs.sparkSession.sparkContext.broadcast(common), n, percent)
    return described, parts


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 75, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id_column``, ``n_shingles``, ``component_id`` for every document.

    Two documents link when their sets of ``n`` words have a Jaccard similarity of
    ``percent`` hundredths or more; a component is named by its least id. Texts that
    are null or without words have an empty set and link with nothing. Copies link,
    whatever their number: they are one set. Rows without an id take part, but name
    no component (alone, theirs is null). Repeated rows stay. An empty table gives none.
    """
    kind = dict(docs.dtypes)[id_column]
    described, parts = _linked(docs, n, percent, id_column, text_column)
    full = described.where("size > 0").join(parts.withColumnRenamed("id", "key"), "key", "left").select("id", "size", F.coalesce("component", "key").alias("component"))
    full = written(full, "linked")
    # written, so that the join's sides are plain and adaptive execution can split a large component
    least = written(full.groupBy("component").agg(F.min("id").alias("component_id")), "least")
    out = full.join(least, "component").select("id", "size", "component_id").unionByName(described.where("size = 0").select("id", "size", F.col("id").alias("component_id")))
    return out.select(F.col("id").cast(kind).alias(id_column), F.col("size").alias("n_shingles"), "component_id")


def _keyed(n: int):
    """Rows with the key of their set, which has a word at least; the text comes last."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [_key(s) for texts in slices(b.column(b.num_columns - 1).to_pylist(), 1_000_000) for s in shingle_sets(texts, n)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *b.columns], names=["set_key", *b.schema.names])

    return run


def one_of_each_component(docs: DataFrame, n: int = 5, percent: int = 75, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row of each component of ``jaccard_components``: the first by id (null last) and text. Texts without words all stay.

    It goes by rows: each has its own set's component, whatever its id.
    """
    _, parts = _linked(docs, n, percent, id_column, text_column)
    order = [id_column, text_column, *(c for c in docs.columns if c not in (id_column, text_column))]
    first = F.min(F.struct(F.col(id_column).isNull().alias("last"), *order)).alias("row")
    has_words = F.coalesce(F.col(text_column).rlike(r"[^ \x09-\x0D]"), F.lit(False))
    kinds = dict(docs.dtypes)
    names = [c for c in docs.columns if c != text_column] + [text_column]
    keyed = docs.where(has_words).select(*names).mapInArrow(_keyed(n), "set_key long, " + ", ".join(f"`{c}` {kinds[c]}" for c in names))
    # first copies of one set, wherever they are; then the sets that link
    sets = written(keyed.groupBy("set_key").agg(first).join(parts.withColumnRenamed("id", "set_key"), "set_key", "left").select("row", "component"), "sets")
    single = sets.where("component is null").select("row")
    linked = sets.where("component is not null").groupBy("component").agg(F.min("row").alias("row")).select("row")
    return single.unionByName(linked).select(*(F.col(f"row.{c}").alias(c) for c in docs.columns)).unionByName(docs.where(~has_words))
