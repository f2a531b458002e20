"""Bulk-synchronous best-fit packing of token pieces into sequences of one capacity.

Pieces are range-sorted by length over all partitions, which gives each a rank.
Sizes are whole numbers up to the capacity, so the sorted pieces and the sorted
gaps are runs of equal size: at most ``capacity`` runs, however many pieces there
are. A round takes the longest run left, sweeps the gap runs from the run's
successor (the smallest gap that holds it) upwards, gives equal pieces to equal
gaps by rank (the i-th piece to the i-th gap), updates the gaps and repeats.
Pieces find their sequence and place from their rank alone, on the executors.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.llm.bpe import slices
from lintlake.llm.library_tokens import library_encoder
from lintlake.llm.shared import with_part, written

PLAN = "length int, first_rank long, end_rank long, first_bin long, per_bin long, base int"


def pieces_of(docs: DataFrame, vocabulary: str, end_id: int, capacity: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Cut each document's ids (with the end id) into pieces of ``capacity``; the last may be shorter.

    Returns ``id_column``, ``piece``, ``start``, ``length``, ``ids_crc32``. A null
    text is empty and gives the end id alone.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        enc, end = library_encoder(vocabulary), end_id.to_bytes(4, "little")
        for b in batches:
            at, rows = 0, []
            for texts in slices([t or "" for t in b.column(1).to_pylist()]):
                for ids in enc.encode(texts):
                    ids += end
                    for piece, start in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[start : start + 4 * capacity]
                        rows.append((at, piece, start // 4, len(part) // 4, zlib.crc32(part)))
                    at += 1
            which, *columns = zip(*rows) if rows else ((),) * 5
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64())
            arrays = [b.column(0).take(pa.array(which, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds))]
            yield pa.RecordBatch.from_arrays(arrays, names=[b.schema.names[0], "piece", "start", "length", "ids_crc32"])

    kind = dict(docs.dtypes)[id_column]
    return docs.select(id_column, text_column).mapInArrow(run, f"{id_column} {kind}, piece int, start long, length int, ids_crc32 long")


def match_runs(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rounds of best-fit over runs; ``counts`` has the number of pieces of each length.

    Gives segments (length, first rank, end rank, first bin, pieces per bin, offset
    in the bin): ranks from the first on go to bins from the first on, ``per_bin``
    to each. Ranks count pieces from the longest to the shortest.
    """
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap: runs of bins (first, number)
    sizes: list[int] = []  # the gaps that have bins, ascending
    out: list[tuple[int, int, int, int, int, int]] = []
    rank = bins = 0

    def give(length: int, number: int, first: int, per_bin: int, gap: int) -> None:
        """``number`` bins from ``first`` on, each with this gap, take ``per_bin`` pieces."""
        nonlocal rank
        out.append((length, rank, rank + number * per_bin, first, per_bin, capacity - gap))
        rank += number * per_bin
        if left := gap - per_bin * length:
            if left not in gaps or not gaps[left]:
                insort(sizes, left)
            gaps[left].append((first, number))

    for length in sorted(counts, reverse=True):
        todo = counts[length]
        while todo:
            at = bisect_left(sizes, length)
            if at == len(sizes):  # no gap holds it: new bins
                gap, first, number = capacity, bins, -(-todo // (capacity // length))
                bins += number
            else:
                gap = sizes[at]
                first, number = gaps[gap].pop()
                if not gaps[gap]:
                    sizes.pop(at)
            per_bin = gap // length
            full = min(number, todo // per_bin)
            if full:
                give(length, full, first, per_bin, gap)
                todo -= full * per_bin
            used = full
            if todo and full < number:
                give(length, 1, first + full, todo, gap)
                todo, used = 0, full + 1
            if used < number:
                if not gaps[gap]:
                    insort(sizes, gap)
                gaps[gap].append((first + used, number - used))
    return out


def pack(pieces: DataFrame, capacity: int, id_column: str = "doc_id") -> DataFrame:
    """Give each piece a sequence and a place in it: ``sequence_id``, ``offset`` are added.

    ``pieces`` has ``id_column``, ``piece``, ``length`` (1 to ``capacity``) and any
    other columns. Equal lengths go by id and piece. Repeated rows are packed each.
    The driver sees the number of pieces of each length (``capacity`` rows at most)
    and of each partition.
    """
    spark = pieces.sparkSession
    ranked, parts = with_part(pieces, "packing", F.col("length").desc(), F.col(id_column), F.col("piece"))
    counts = {r["length"]: r["count"] for r in ranked.groupBy("length").count().collect()}
    plan = spark.createDataFrame(match_runs(counts, capacity) or [], PLAN)
    first, offsets = 0, []
    for r in parts.orderBy("part").collect():
        offsets.append((r["part"], first))
        first += r["rows"]
    offsets = spark.createDataFrame(offsets, "part int, before long")
    rank = F.col("before") + F.col("pos")
    found = ranked.join(F.broadcast(offsets), "part").withColumn("rank", rank)
    p = F.broadcast(plan.withColumnRenamed("length", "run_length"))
    found = found.join(p, (F.col("length") == F.col("run_length")) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("end_rank")))
    within = F.col("rank") - F.col("first_rank")
    return found.select(
        *pieces.columns,
        (F.col("first_bin") + F.floor(within / F.col("per_bin"))).cast("long").alias("sequence_id"),
        (F.col("base") + (within % F.col("per_bin")) * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 1, capacity: int = 4096, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Tokenise, cut and pack all documents; one row per piece.

    Null texts are empty (one piece with the end id), null ids are kept, repeated
    rows are packed each, an empty table gives none.
    """
    pieces = written(pieces_of(docs, vocabulary, end_id, capacity, id_column, text_column), "pieces")
    return pack(pieces, capacity, id_column)
