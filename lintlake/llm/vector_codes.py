"""Vectors as one byte a part: integer codebooks refined over all rows, distances by dictionaries of values.

Components become integers. Vectors are packed into blocks, and a block keeps, for each
dimension, the distinct integers that occur in it (the dictionary) and each vector's
place in it (the dictionary codes). A codebook is tried on a block by tabulating, for
each dimension, the squared difference of every dictionary entry to every codebook
entry; the distance of a vector's part to all entries is then a gather of one table row
a dimension and their sum. Blocks are made once and serve every round. A round's sums
and counts are added up in each task, then by Spark; the driver holds one codebook.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lintlake.llm.shared import written

#: Vectors of a block; vectors whose distances are held at once.
BLOCK, STEP = 4_096, 1_024
#: A component's integer times the root of the vector's length has to stay below this: no sum of squares leaves 64 bits then.
LARGEST = 1 << 30
#: Rows among which the first vectors are looked for; ranges that ids are counted in until so few are left.
FIRST_ROWS, RANGES = 100_000, 1_024
#: Labels whose errors are broadcast at most; parts of a label beyond that.
BROADCAST_LABELS, SALTS = 100_000, 64


def cuts(dim: int, parts: int) -> list[int]:
    """Where the parts of a vector begin and end."""
    return [i * dim // parts for i in range(parts + 1)]


def usable(vectors: DataFrame, id_column: str, vector_column: str, label_column: str, scale: int) -> DataFrame:
    """``id``, ``label``, ``x`` (array<long>, the components' floors): rows without null or non-finite components."""
    v = F.col("v")
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(label_column).alias("label"), F.col(vector_column).cast("array<double>").alias("v"))
    limit = F.lit(float(LARGEST)) / F.sqrt(F.size(v))
    good = F.forall(v, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c * scale) < limit), F.lit(False)))
    return rows.where(v.isNotNull() & (F.size(v) > 0) & good).select("id", "label", F.transform(v, lambda c: F.floor(c * scale).cast("long")).alias("x"))


def first_vectors(rows: DataFrame, n: int) -> list[list[int]]:
    """The ``n`` vectors of the least ids (nulls last, then by components), whatever the number of rows.

    Ids are counted in ranges until few rows are below the last one that is needed, so
    no task gets a row of every partition.
    """
    at = rows
    while True:
        low, high, count = at.agg(F.min("id"), F.max("id"), F.count("id")).first()
        if count <= max(n, FIRST_ROWS) or low == high:
            break
        step = (high - low) // RANGES + 1
        counted = at.where("id is not null").groupBy(F.expr(f"cast((id - {low}L) div {step}L as int)").alias("range")).count().collect()
        have = 0
        for k, c in sorted((r["range"], r["count"]) for r in counted):
            have += c
            if have >= n:
                break
        edge = low + (k + 1) * step - 1
        at = at.where(F.col("id") <= edge)
        if edge >= high:
            break
    return [r["x"] for r in at.orderBy(F.col("id").asc_nulls_last(), "x").limit(n).collect()]


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of vectors of one length: ids, labels, dictionaries of all dimensions one after another, dictionary codes."""
    for b in batches:
        lengths = np.diff(b.column(2).offsets.to_numpy())
        for dim in np.unique(lengths).tolist():
            rows = np.flatnonzero(lengths == dim)
            for at in range(0, len(rows), BLOCK):
                take = pa.array(rows[at : at + BLOCK])
                x = b.column(2).take(take).flatten().to_numpy().reshape(len(take), dim)
                values, codes = zip(*(np.unique(x[:, j], return_inverse=True) for j in range(dim)))
                ends = pa.array([0, len(take)], pa.int32())
                arrays = [
                    pa.array([dim], pa.int32()),
                    pa.ListArray.from_arrays(ends, b.column(0).take(take)),
                    pa.ListArray.from_arrays(ends, b.column(1).take(take)),
                    pa.array([[len(v) for v in values]], pa.list_(pa.int32())),
                    pa.array([np.concatenate(values).astype("<i8").tobytes()], pa.binary()),
                    pa.array([np.stack(codes, axis=1).astype("<u2").tobytes()], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=["dim", "ids", "labels", "sizes", "values", "codes"])


def nearest(values: list[np.ndarray], codes: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Per vector and part the nearest entry (the lowest of equal ones) and its squared distance."""
    ends = cuts(codes.shape[1], len(books))
    best = np.empty((len(codes), len(books)), np.int64)
    far = np.zeros((len(codes), len(books)), np.int64)
    for p, book in enumerate(books):
        inside = range(ends[p], ends[p + 1])
        most = max((max(abs(int(values[j][0]) - int(book[:, j - ends[p]].max())), abs(int(values[j][-1]) - int(book[:, j - ends[p]].min()))) for j in inside), default=0)
        kind = np.int32 if most * most * max(1, len(inside)) < 1 << 31 else np.int64
        tables = [((values[j][:, None] - book[:, j - ends[p]][None, :]) ** 2).astype(kind) for j in inside]
        for at in range(0, len(codes), STEP):
            part = codes[at : at + STEP]
            total = np.zeros((len(part), len(book)), kind)
            for table, j in zip(tables, inside):
                total += table.take(part[:, j], axis=0)
            best[at : at + STEP, p] = total.argmin(1)
            far[at : at + STEP, p] = total.min(1)
    return best, far


def unpacked(b: pa.RecordBatch, row: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Dictionaries and dictionary codes of a block."""
    sizes = b.column("sizes")[row].as_py()
    values = np.frombuffer(b.column("values")[row].as_buffer(), "<i8")
    return np.split(values, np.cumsum(sizes)[:-1]), np.frombuffer(b.column("codes")[row].as_buffer(), "<u2").reshape(-1, len(sizes))


def refined(blocks: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one round: entries that are some part's nearest become the floor of those parts' means."""
    dim = sum(b.shape[1] for b in books)
    ends = cuts(dim, len(books))
    shared = blocks.sparkSession.sparkContext.broadcast(books)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        counts = np.zeros((len(books), max(map(len, books))), np.int64)
        totals = [np.zeros(b.shape, np.int64) for b in books]
        for b in batches:
            for row in range(b.num_rows):
                values, codes = unpacked(b, row)
                best, _ = nearest(values, codes, books)
                for p, total in enumerate(totals):
                    counts[p] += np.bincount(best[:, p], minlength=counts.shape[1])
                    for i, j in enumerate(range(ends[p], ends[p + 1])):
                        # sums of integers over entries, exact in 64 bits
                        np.add.at(total[:, i], best[:, p], values[j][codes[:, j]])
        for p, total in enumerate(totals):
            entry, place = np.nonzero(np.broadcast_to(counts[p, : len(total), None] > 0, total.shape))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(entry), p, np.int32)), pa.array(entry.astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(total[entry, place]), pa.array(counts[p, entry])], names=["part", "entry", "place", "total", "rows"])

    found = blocks.where(F.col("dim") == dim).mapInArrow(sums, "part int, entry int, place int, total long, rows long")
    new = [b.copy() for b in books]
    for r in found.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("rows").alias("rows")).collect():  # as many rows as a codebook has integers
        new[r["part"]][r["entry"], r["place"]] = r["total"] // r["rows"]
    shared.destroy()
    return new


def compress(vectors: DataFrame, scale: int = 1024, parts: int = 4, entries: int = 256, rounds: int = 4, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """``id_column``, ``code``, ``error``, ``label_error``, ``codebooks_sha256`` of the vectors that can be coded.

    Rows whose vector is null or empty, or holds null or non-finite components or ones
    so large that their squares would leave 64 bits (over 2^17 for 64 components), are
    not in the result.
    Vectors of each length have codebooks of their own, and a length that the number of
    parts doesn't divide is cut as evenly as can be. Null ids come last where the first
    vectors are taken, equal ids in the order of their components; repeated rows count
    as often as they occur. ``label_error`` adds up the errors of all rows of a label
    (nulls are one label). Other columns don't matter. An empty table gives no rows.
    """
    if not 1 <= entries <= 256:
        raise ValueError("an entry's number takes one byte")
    kind, label_kind = dict(vectors.dtypes)[id_column], vectors.schema[label_column].dataType
    rows = written(usable(vectors, id_column, vector_column, label_column, scale), "integers")
    blocks = written(rows.mapInArrow(pack, T.StructType([T.StructField("dim", T.IntegerType()), T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("labels", T.ArrayType(label_kind)), T.StructField("sizes", T.ArrayType(T.IntegerType())), T.StructField("values", T.BinaryType()), T.StructField("codes", T.BinaryType())])), "blocks")
    models: dict[int, tuple[list[np.ndarray], str]] = {}
    for dim in sorted(r["dim"] for r in blocks.select("dim").distinct().collect()):  # lengths of vectors are few: one for each model that made them
        first = np.array(first_vectors(rows.where(F.size("x") == dim), entries), np.int64)
        books = [first[:, a:b] for a, b in zip(cuts(dim, parts), cuts(dim, parts)[1:])]
        for _ in range(rounds):
            books = refined(blocks, books)
        models[dim] = books, hashlib.sha256(",".join(map(str, np.concatenate([b.ravel() for b in books]).tolist())).encode()).hexdigest()
    shared = rows.sparkSession.sparkContext.broadcast(models)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                books, digest = shared.value[b.column("dim")[row].as_py()]
                best, far = nearest(*unpacked(b, row), books)
                text = best.astype(np.uint8).tobytes().hex()
                wide = 2 * len(books)
                names = [text[i : i + wide] for i in range(0, len(text), wide)]
                yield pa.RecordBatch.from_arrays([b.column("ids")[row].values, b.column("labels")[row].values, pa.array(names), pa.array(far.sum(1)), pa.array([digest] * len(names))], names=["id", "label", "code", "error", "codebooks_sha256"])

    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("label", label_kind), T.StructField("code", T.StringType()), T.StructField("error", T.LongType()), T.StructField("codebooks_sha256", T.StringType())])
    coded = written(blocks.mapInArrow(code, schema), "codes")
    totals = written(coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of"), "errors")
    if totals.count() <= BROADCAST_LABELS:  # small by count; else labels are salted, so that a frequent one is split
        joined = coded.join(F.broadcast(totals), F.col("label").eqNullSafe(F.col("of")))
    else:
        salted = coded.withColumn("salt", F.pmod(F.xxhash64("id", "code"), F.lit(SALTS)))
        copies = totals.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        joined = salted.join(copies, F.col("label").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("copy")))
    return joined.select(F.col("id").cast(kind).alias(id_column), "code", "error", "label_error", "codebooks_sha256")
