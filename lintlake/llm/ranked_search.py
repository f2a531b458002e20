"""Ranked search over all documents: an index of compressed blocks of postings, searched by Block-Max MaxScore.

Documents are indexed where they are read: a task turns them into segments of bounded
size, and a segment keeps, for each of its terms, the places of the documents that hold
it and how often, in blocks of 128 postings of variable-length integers. A block's last
place, its end and the most that one of its postings can be worth stand beside it,
uncompressed. Segments never move; only postings of terms that are asked for are read.

A query's terms are ordered in each segment by the most they can add (weight times the
list's bound). The terms that together can't reach the worst score of a full heap are
non-essential: documents with no other term are never looked at. Candidates from the
essential lists are held against the block maxima of the non-essential ones, from the
strongest to the weakest, and blocks are decompressed only for those still in the race.
Tasks give the heaps of their segments, and Spark merges them.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lintlake.llm.shared import written

#: A term: letters and digits of ASCII, and whatever is not ASCII. As Java sees characters and as Python sees UTF-8.
TERM, TERM_BYTES = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.compile(rb"[0-9a-z\x80-\xff]+")
#: Postings of a block; documents and postings of a segment at most (one document more than fits); bytes of a text counted at once.
BLOCK, SEGMENT_DOCUMENTS, SEGMENT_POSTINGS, PIECE = 128, 8_192, 3_000_000, 1 << 20
#: Documents that one task searches, about; terms of the queries that are asked together; index rows sent to Spark at once.
TASK_DOCUMENTS, ASKED_TERMS, SENT = 16_384, 200_000, 20_000

INDEX = "segment long, term binary, rows int, top long, blocks binary, postings binary, documents binary"
#: What a segment knows of its documents, and of its blocks.
DOCUMENT, HEAD = np.dtype([("id", "<i8"), ("null", "?"), ("norm", "<i8")]), np.dtype([("last", "<i4"), ("end", "<i8"), ("top", "<i8")])


class Numbers(dict):
    """Numbers for keys in the order in which they are met."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def term_counts(text: bytes) -> Counter:
    """How often each term occurs. Long texts are counted in pieces that end between terms."""
    counts: Counter = Counter()
    at = 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            cut = re.compile(rb"[^0-9A-Za-z\x80-\xff]").search(text, end)
            end = cut.start() if cut else len(text)
        counts.update(TERM_BYTES.findall(text[at:end].lower()))
        at = end
    return counts


def varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values as variable-length integers, and where each ends."""
    values = values.astype(np.uint64)
    size = np.ones(len(values), np.int64)
    for k in range(1, 10):
        size += values >= np.uint64(1 << (7 * k))
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(int(size.max()) if len(size) else 0):
        some = size > k
        more = (size[some] > k + 1).astype(np.uint8) << 7
        out[ends[some] - size[some] + k] = ((values[some] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | more
    return out, ends


def integers(data: np.ndarray) -> np.ndarray:
    """The values of variable-length integers."""
    last = data < 128
    starts = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1])
    place = np.arange(len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
    return np.add.reduceat((data & 127).astype(np.int64) << (7 * place), starts)


def worth(tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """What occurrences of a term add to a document's score, before the term's weight."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * norm)


class Segment:
    """Documents of a task, until there are enough of them."""

    def __init__(self, number: int) -> None:
        self.number = number
        self.names: Numbers = Numbers()
        self.ids: list[int | None] = []
        self.norms: list[int] = []
        self.terms: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.postings = 0

    def add(self, id_: int | None, counts: Counter, norm: int) -> None:
        self.ids.append(id_)
        self.norms.append(norm)
        self.terms.append(np.fromiter(map(self.names.__getitem__, counts), np.int32, len(counts)))
        self.times.append(np.fromiter(counts.values(), np.int64, len(counts)))
        self.postings += len(counts)

    def full(self) -> bool:
        return len(self.ids) >= SEGMENT_DOCUMENTS or self.postings >= SEGMENT_POSTINGS

    def rows(self) -> Iterator[pa.RecordBatch]:
        """The segment's documents as one row, and a row for each of its terms."""
        schema = pa.schema([("segment", pa.int64()), ("term", pa.binary()), ("rows", pa.int32()), ("top", pa.int64()), ("blocks", pa.binary()), ("postings", pa.binary()), ("documents", pa.binary())])
        norms = np.array(self.norms, np.int64)
        known = np.array([(i or 0, i is None, m) for i, m in zip(self.ids, self.norms)], DOCUMENT)
        yield pa.RecordBatch.from_pylist([{"segment": self.number, "rows": len(known), "top": 0, "documents": known.tobytes()}], schema)
        if not self.postings:
            return
        places = np.repeat(np.arange(len(self.terms)), [len(t) for t in self.terms])
        terms, times = np.concatenate(self.terms), np.concatenate(self.times)
        order = np.argsort(terms, kind="stable")
        terms, times, places = terms[order], times[order], places[order]
        sizes = np.bincount(terms, minlength=len(self.names))
        starts = np.cumsum(sizes) - sizes
        values = worth(times, norms[places])
        first = (np.arange(len(terms)) - starts[terms]) % BLOCK == 0
        block_at = np.flatnonzero(first)
        block_end = np.append(block_at[1:], len(terms))
        gaps = np.where(first, places, places - np.concatenate([[0], places[:-1]]))
        data, ends = varints(np.stack([gaps, times], axis=1).ravel())
        ends = ends[1::2]  # of postings
        term_begin = np.concatenate([[0], ends])[starts]
        heads = np.empty(len(block_at), HEAD)
        heads["last"], heads["end"] = places[block_end - 1], ends[block_end - 1] - term_begin[terms[block_at]]
        heads["top"] = np.maximum.reduceat(values, block_at)
        tops = np.maximum.reduceat(values, starts)
        blocks = -(-sizes // BLOCK)

        def cut(data: bytes, ends: np.ndarray) -> pa.Array:
            offsets = np.concatenate([[0], ends]).astype(np.int32)
            return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data)])

        n = len(sizes)
        arrays = [pa.array(np.full(n, self.number)), pa.array(list(self.names), pa.binary()), pa.array(sizes.astype(np.int32)), pa.array(tops), cut(heads.tobytes(), np.cumsum(blocks) * heads.itemsize), cut(data.tobytes(), ends[starts + sizes - 1]), pa.nulls(n, pa.binary())]
        batch = pa.RecordBatch.from_arrays(arrays, schema=schema)
        for at in range(0, n, SENT):
            yield batch.slice(at, SENT)


@dataclass
class Index:
    """``rows``: documents and postings of all segments; ``documents`` with a term, and ``terms`` in them."""

    rows: DataFrame
    documents: int
    terms: int
    kind: str


def build(docs: DataFrame, id_column: str, text_column: str) -> Index:
    """The index of all documents, written to the shared folder without a shuffle.

    The documents are counted first, since what a posting is worth depends on the mean length.
    """
    n = F.coalesce(F.regexp_count(text_column, F.lit(TERM)), F.lit(0)).cast("long")
    documents, terms = docs.select(n.alias("n")).where("n > 0").agg(F.count("n"), F.coalesce(F.sum("n"), F.lit(0))).first()

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        segment = Segment(number)
        for b in batches:
            for id_, text in zip(b.column(0), b.column(1)):
                counts = term_counts(text.as_buffer().to_pybytes()) if text.is_valid else {}
                if not counts:
                    continue
                segment.add(id_.as_py(), counts, 100 - 75 + (75 * sum(counts.values()) * documents) // terms)
                if segment.full():
                    yield from segment.rows()
                    number += 1
                    segment = Segment(number)
        if segment.ids:
            yield from segment.rows()

    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    return Index(written(rows.mapInArrow(segments, INDEX), "postings"), documents, terms, dict(docs.dtypes)[id_column])


class Postings:
    """A term's list in a segment: heads of blocks at hand, postings decompressed when a block is needed."""

    def __init__(self, rows: int, top: int, blocks: bytes, postings: bytes) -> None:
        self.top = top
        self.last, self.end, self.tops = (np.ascontiguousarray(np.frombuffer(blocks, HEAD)[n]) for n in HEAD.names)
        self.data = np.frombuffer(postings, np.uint8)
        self.begin = np.concatenate([[0], self.end[:-1]])
        self.size = np.diff(np.append(np.arange(0, rows, BLOCK), rows))
        self.places = np.repeat(self.last, self.size)  # of blocks not read yet: their last place, so the order holds
        self.values = np.zeros(rows, np.int64)
        self.read = np.zeros(len(self.last), bool)

    def need(self, blocks: np.ndarray, norms: np.ndarray) -> None:
        """Decompress those of the blocks that are not yet."""
        new = blocks[~self.read[blocks]]
        if not len(new):
            return
        whole = len(new) == len(self.read)
        data = self.data if whole else np.concatenate([self.data[self.begin[b] : self.end[b]] for b in new])
        gaps, times = integers(data).reshape(-1, 2).T
        at = slice(None) if whole else np.concatenate([np.arange(b * BLOCK, b * BLOCK + self.size[b]) for b in new])
        starts = np.cumsum(self.size[new]) - self.size[new]
        run = np.cumsum(gaps)
        places = run - np.repeat(run[starts] - gaps[starts], self.size[new])
        self.places[at] = places
        self.values[at] = worth(times, norms[places])
        self.read[new] = True


class Heap:
    """The best documents of a query so far: scores and ids, equal scores by id, nulls last."""

    def __init__(self, k: int) -> None:
        self.k, self.scores, self.ids, self.null = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def least(self) -> int:
        """The score below which nothing enters."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def offer(self, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        scores, ids, null = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids]), np.concatenate([self.null, null])
        best = np.lexsort((ids, null, -scores))[: self.k]
        self.scores, self.ids, self.null = scores[best], ids[best], null[best]


def candidates(lists: list[tuple[int, Postings]], norms: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the documents that reach ``least``; ``lists`` are weights and postings of a query's terms."""
    lists = sorted(lists, key=lambda x: x[0] * x[1].top)
    most = np.concatenate([[0], np.cumsum([w * p.top for w, p in lists])])  # of the weakest lists together
    essential = int(np.searchsorted(most[1:], least))  # these and stronger ones; those before together stay below
    scores = np.zeros(len(norms), np.int64)
    for w, p in lists[essential:]:
        p.need(np.arange(len(p.read)), norms)
        scores[p.places] += w * p.values
    alive = np.flatnonzero((scores > 0) & (scores + most[essential] >= least))
    scores = scores[alive]
    for i in range(essential - 1, -1, -1):
        if not len(alive):
            break
        w, p = lists[i]
        block = np.searchsorted(p.last, alive)
        inside = block < len(p.last)
        bound = np.where(inside, w * p.tops[np.minimum(block, len(p.last) - 1)], 0)
        good = scores + bound + most[i] >= least  # the block's maximum, and the bounds of the lists still to come
        alive, scores, block, inside = alive[good], scores[good], block[good], inside[good]
        p.need(np.unique(block[inside]), norms)
        at = np.minimum(np.searchsorted(p.places, alive), len(p.places) - 1)
        scores += np.where(inside & (p.places[at] == alive), w * p.values[at], 0)
    good = scores >= least
    return alive[good], scores[good]


def search(index: Index, queries: DataFrame, k: int = 10, id_column: str = "item_id", text_column: str = "text", document_column: str = "doc_id") -> DataFrame:
    """``id_column``, ``rank``, ``document_column``, ``score``: each query's ``k`` best documents with a score above 0.

    Queries are asked in blocks with a bounded number of terms; a query's own length
    bounds what one of them takes.
    """
    kind = dict(queries.dtypes)[id_column]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, text in zip(b.column(0), b.column(1)):
                counts = term_counts(text.as_buffer().to_pybytes()) if text.is_valid else {}
                yield pa.RecordBatch.from_arrays([pa.array([number.as_py()] * len(counts), pa.int64()), pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["query", "term", "times"])

    asked = written(queries.select(F.col(id_column).alias("item"), F.col(text_column).cast("string").alias("text")).withColumn("query", F.monotonically_increasing_id()), "queries")
    terms = written(asked.select("query", "text").mapInArrow(split, "query long, term binary, times long"), "asked")
    blocks = max(1, math.ceil(terms.count() / ASKED_TERMS))
    groups = max(1, math.ceil(index.documents / TASK_DOCUMENTS))
    found = [_heaps(index, terms.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b), k, groups) for b in range(blocks)] if index.documents else []
    if not found:
        return asked.where(F.lit(False)).select(F.col("item").alias(id_column), F.lit(0).alias("rank"), F.lit(0).cast(index.kind).alias(document_column), F.lit(0).cast("long").alias("score"))
    heaps = found[0]
    for more in found[1:]:
        heaps = heaps.unionByName(more)
    heaps = written(heaps, "heaps")
    order = [F.col("score").desc(), F.col("doc").asc_nulls_last()]
    salts = math.isqrt(groups) + 1  # heaps are merged in two steps, so that no task gets those of all tasks
    heaps = heaps.withColumn("place", F.row_number().over(Window.partitionBy("query", F.pmod("task", F.lit(salts))).orderBy(*order))).where(F.col("place") <= k)
    best = heaps.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k)
    return best.join(asked.select("query", "item"), "query").select(F.col("item").cast(kind).alias(id_column), "rank", F.col("doc").cast(index.kind).alias(document_column), "score")


def _heaps(index: Index, terms: DataFrame, k: int, groups: int) -> DataFrame:
    """``query``, ``task``, ``doc``, ``score``: each task's heaps for a block of queries."""
    spark = index.rows.sparkSession
    names = written(terms.select("term").distinct(), "names")  # bounded by ASKED_TERMS and one query
    lists = index.rows.join(F.broadcast(names), "term", "left_semi")
    spread = lists.groupBy("term").agg(F.sum("rows").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * index.documents + 2) / (2 * F.col("df") + 1))).cast("long")
    of: dict[int, list[tuple[bytes, int]]] = {}
    for r in terms.join(spread.select("term", weight.alias("weight")), "term").where("weight > 0").select("query", "term", (F.col("weight") * F.col("times")).alias("weight")).collect():
        of.setdefault(r["query"], []).append((bytes(r["term"]), r["weight"]))
    shared = spark.sparkContext.broadcast(of)

    def searched(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        heaps = {q: Heap(k) for q in shared.value}
        for _, segment in rows.groupby("segment", sort=True):
            head = segment["documents"].notna()
            ids, null, norms = (np.ascontiguousarray(np.frombuffer(segment["documents"][head].iloc[0], DOCUMENT)[n]) for n in DOCUMENT.names)
            some = segment[~head]
            lists = {bytes(r.term): Postings(r.rows, r.top, r.blocks, r.postings) for r in some[["term", "rows", "top", "blocks", "postings"]].itertuples(index=False)}
            for query, words in shared.value.items():
                have = [(w, lists[t]) for t, w in words if t in lists]
                if have:
                    at, scores = candidates(have, norms, heaps[query].least())
                    heaps[query].offer(scores, ids[at], null[at])
        out = [(q, key[0], None if a else i, s) for q, h in heaps.items() for s, i, a in zip(h.scores.tolist(), h.ids.tolist(), h.null.tolist())]
        return pd.DataFrame({n: pd.array(v, "Int64") for n, v in zip(("query", "task", "doc", "score"), zip(*out) if out else [[]] * 4)})

    heads = index.rows.where("documents is not null")
    columns = ["segment", "term", "rows", "top", "blocks", "postings", "documents"]
    both = lists.select(columns).unionByName(heads.select(columns)).withColumn("task", F.pmod(F.xxhash64("segment"), F.lit(groups)))
    return both.groupBy("task").applyInPandas(searched, "query long, task long, doc long, score long")


def ranked(docs: DataFrame, queries: DataFrame, k: int = 10, id_column: str = "doc_id", text_column: str = "text", query_id_column: str = "item_id", query_text_column: str = "text") -> DataFrame:
    """``query_id_column``, ``rank`` (from 1), ``id_column``, ``score``: the ``k`` best documents of every query.

    Scores are whole numbers, equal ones by ascending id (null ids last). Documents with
    a null id can be found, repeated rows count and are found each for itself; texts
    that are null, empty or without a term are not in the statistics. A query without
    terms, or without a document that scores above 0, has no rows; queries of one id are
    queries of their own. Long texts are counted in pieces. Other columns don't matter.
    Empty tables give no rows.
    """
    return search(build(docs, id_column, text_column), queries, k, query_id_column, query_text_column, id_column)
