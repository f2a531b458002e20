"""New-only findings of a stream of source versions.

Each micro-batch is parsed and checked with the same operators as a batch, and only
findings whose identity the table of known ones lacks are appended; their identities
become known with them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lintlake.operators.findings import hook_identity

KNOWN = "project string, identity string, batch long"


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in whatever store it names."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def stream_new_findings(units: DataFrame, rule: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Start a query that appends new findings of ``units`` (a stream) under ``out``.

    ``rule`` makes findings with ``project, rule_id, file_path, line, symbol, message``.
    A batch that is run again after a failure replaces its own partition, so findings
    are written once.
    """

    def append(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        found = rule(batch).withColumn("identity", hook_identity()).dropDuplicates(["project", "identity"]).withColumn("batch", F.lit(number).cast("long"))
        if _exists(spark, out):  # the first batch has no table yet
            known = spark.read.schema(KNOWN).parquet(out).where(F.col("batch") < number).select("project", "identity").distinct()
            found = found.join(known, ["project", "identity"], "left_anti")
        found.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(out)

    return units.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
