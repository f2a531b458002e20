"""Token ids in ORC files in the order of document ids.

ORC keeps integers in run-length encoded stripes with a row index; the writer adds
Bloom filters on the document id. Every part file holds a range of ids in order,
so stripes can be read in parallel and a lookup of ids skips stripes and row
groups by their statistics and filters.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lintlake.llm.bpe import slices
from lintlake.llm.library_tokens import library_encoder
from lintlake.llm.shared import new_path, written


def file_schema(id_column: str = "doc_id", id_type: T.DataType | None = None) -> T.StructType:
    """Columns of the files: id, part (the file's number), start in the part, ids."""
    return T.StructType().add(id_column, id_type or T.LongType()).add("part", T.IntegerType()).add("part_start", T.LongType()).add("ids", T.ArrayType(T.IntegerType()))


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int, id_column: str = "doc_id", text_column: str = "text", stripe_bytes: int = 16 << 20, index_rows: int = 1_000) -> None:
    """Encode each text, append the end id and write ORC files in ascending order of ids.

    Null texts are empty; null ids come first; rows with one id are all written, in
    the order of their texts.
    """
    spark = docs.sparkSession
    schema = file_schema(id_column, docs.schema[id_column].dataType)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        import numpy as np
        from pyspark import TaskContext

        enc, end, part, before = library_encoder(vocabulary), end_id.to_bytes(4, "little"), TaskContext.get().partitionId(), 0
        for b in batches:
            at = 0
            for texts in slices([t or "" for t in b.column(1).to_pylist()]):
                ids = [x + end for x in enc.encode(texts)]
                n = len(ids)
                sizes = np.fromiter(map(len, ids), np.int64, n) // 4
                ends = np.cumsum(sizes)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(np.frombuffer(b"".join(ids), np.int32)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, n), pa.array(np.full(n, part, np.int32)), pa.array(before + ends - sizes), lists], names=schema.names)
                at += n
                before += int(ends[-1])

    ranged = docs.select(id_column, text_column).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), id_column).sortWithinPartitions(id_column, text_column)
    writer = ranged.mapInArrow(run, schema).write.option("compression", "zstd")
    options = {"orc.bloom.filter.columns": id_column, "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true", "orc.row.index.stride": str(index_rows), "orc.stripe.size": str(stripe_bytes), "orc.rows.between.memory.checks": str(index_rows)}
    for key, value in options.items():
        writer = writer.option(key, value)
    writer.orc(path)


def read_tokens(spark: SparkSession, path: str, id_column: str = "doc_id", id_type: T.DataType | None = None) -> DataFrame:
    """The files' rows; filters on the id reach the ORC reader and prune stripes and row groups."""
    return spark.read.schema(file_schema(id_column, id_type)).orc(path)


def token_spans(tokens: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Per row of ``read_tokens``: the id, ``start`` (ids of all rows before it), ``n_tokens``, ``ids_crc32``."""
    kind = dict(tokens.dtypes)[id_column]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        import numpy as np

        for b in batches:
            lists = b.column(3)
            ends = lists.offsets.to_numpy()
            values = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<i4")).cast("B")
            sums = [zlib.crc32(values[4 * x : 4 * y]) for x, y in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(np.diff(ends).astype(np.int64)), pa.array(sums, pa.int64())], names=[id_column, "part", "part_start", "n_tokens", "ids_crc32"])

    spans = written(tokens.mapInArrow(run, f"{id_column} {kind}, part int, part_start long, n_tokens long, ids_crc32 long"), "spans")
    # one row per part file, so a running sum over them needs no partitions
    totals, first = [], 0
    for r in spans.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect():
        totals.append((r["part"], first))
        first += r["n"]
    before = tokens.sparkSession.createDataFrame(totals, "part int, before long")
    return spans.join(F.broadcast(before), "part").select(id_column, (F.col("before") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32")


def tokens_by_files(docs: DataFrame, vocabulary: str, end_id: int = 2, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Write all documents' tokens to the shared folder and describe them from the files."""
    spark = docs.sparkSession
    path = new_path(spark, "tokens")
    write_tokens(docs, path, vocabulary, end_id, id_column, text_column)
    return token_spans(read_tokens(spark, path, id_column, docs.schema[id_column].dataType), id_column)
