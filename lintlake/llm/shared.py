"""What the operators of this subpackage share: the shared folder, written tables and Arrow helpers."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


_STATE: dict[tuple, object] = {}


def worker_state(key: tuple, make: Callable[[], object]):
    """What a Python worker keeps between tasks: one operator's caches or model; another operator's replace it.

    Workers serve one stage after another, so their memory is the largest of the
    stages' needs and not the sum: what the last operator held goes back to the
    system before the next one fills its own.
    """
    if key not in _STATE:
        _STATE.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # the C library's own free lists, where it has the call
            ctypes.CDLL(None).malloc_trim(0)
        _STATE[key] = make()
    return _STATE[key]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    If unset: a folder in the warehouse, which they share as well; only a session on
    one machine takes a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        local = spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster")
        base = "file://" + tempfile.mkdtemp(prefix="spark-shared-") if local else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/shared"
        spark.sparkContext.setCheckpointDir(base)
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again.

    It cuts the lineage: a lost executor costs the tasks it ran, and what comes
    later reads files instead of computing the rows again.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def crc32_text(id_column: str) -> Column:
    """crc32 of an id's decimal text; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary"))


def with_part(df: DataFrame, name: str, *order: str | Column) -> tuple[DataFrame, DataFrame]:
    """``df`` in the order of the columns, over all partitions, with ``part`` and ``pos``; and the rows per part.

    ``part`` is the number of a range of the order, ``pos`` the row's place in it
    from 0. The rows are written, so the numbers hold for every later read. The
    second table has one row per part: ``part``, ``rows``.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    fields = df.schema.fieldNames()

    def number(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        import numpy as np
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            n = b.num_rows
            extra = [pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n, dtype=np.int64))]
            yield pa.RecordBatch.from_arrays([*b.columns, *extra], names=[*b.schema.names, "part", "pos"])
            at += n

    schema = T.StructType([*df.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("pos", T.LongType())])
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    numbered = written(ranged.mapInArrow(number, schema), name)
    return numbered.select(*fields, "part", "pos"), numbered.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))
