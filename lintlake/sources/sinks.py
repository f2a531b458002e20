"""Report sinks: findings as JSON lines, workflow annotations, SARIF results and Markdown rows.

Each is a column or a table of native expressions, written by Spark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.functions.grading import lookup

#: Levels of the two report formats.
ANNOTATION = {"error": "error", "warning": "warning", "advisory": "notice"}
SARIF_LEVEL = {"error": "error", "warning": "warning", "advisory": "note"}


def _escaped(text: Column, more: bool = False) -> Column:
    """Per cent, line ends and, for properties, separators as escapes."""
    out = text
    for raw, code in (("%", "%25"), ("\r", "%0D"), ("\n", "%0A"), *(((":", "%3A"), (",", "%2C")) if more else ())):
        out = F.replace(out, F.lit(raw), F.lit(code))
    return out


def annotation() -> Column:
    """A finding as a workflow command."""
    level = lookup(ANNOTATION, F.col("severity"))
    place = F.concat(F.lit("file="), _escaped(F.col("file_path"), True), F.coalesce(F.concat(F.lit(",line="), F.col("line").cast("string")), F.lit("")))
    return F.concat(F.lit("::"), level, F.lit(" "), place, F.lit(",title="), _escaped(F.col("rule_id"), True), F.lit("::"), _escaped(F.col("message")))


def sarif_result() -> Column:
    """A finding as the JSON of one SARIF 2.1.0 result."""
    region = F.when(F.col("line").isNotNull(), F.struct(F.col("line").alias("startLine")))
    location = F.struct(F.struct(F.struct(F.col("file_path").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    return F.to_json(F.struct(F.col("rule_id").alias("ruleId"), lookup(SARIF_LEVEL, F.col("severity")).alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(location).alias("locations"), F.struct(F.col("fingerprint").alias("primary/v1")).alias("partialFingerprints")))


def markdown_row() -> Column:
    """A finding as a row of a Markdown table."""
    place = F.concat_ws(":", "file_path", F.col("line").cast("string"))
    cell = lambda c: F.replace(c, F.lit("|"), F.lit("\\|"))
    return F.concat(F.lit("| "), F.concat_ws(" | ", "severity", "rule_id", cell(place), cell(F.col("message"))), F.lit(" |"))


def write_json(findings: DataFrame, path: str) -> None:
    """JSON lines, one folder, as many files as partitions."""
    findings.write.json(path)


def write_lines(findings: DataFrame, line: Column, path: str) -> None:
    """One text line per finding."""
    findings.select(line.alias("value")).write.text(path)


def read_baseline(spark, path: str) -> DataFrame:
    """Baseline entries of JSON lines, with an explicit schema."""
    return spark.read.schema("fingerprint string, rule_id string, file_path string, line int, symbol string, message string").json(path)
