"""Projects with the same files: what depends on a project's files alone is found for one of them and holds for all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _digest() -> Column:
    """Digest of a file's path, type and text; lengths keep their bounds apart."""
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c)), F.lit("-")) for c in ("path", "file_type", "source")]), 256)


def same_projects(units: DataFrame) -> DataFrame:
    """``project``, ``same``: the least name among the projects whose files have the same paths, types and texts.

    A project's digest is the sums of its files' digests, so neither a project of many
    files nor a content of many projects is a list in one task.
    """
    digits = units.select("project", _digest().alias("d"))
    sums = [F.sum(F.conv(F.substring("d", 1 + 16 * i, 16), 16, 10).cast("decimal(20,0)")).alias(f"d{i}") for i in range(4)]
    content = ["files", *(f"d{i}" for i in range(4))]
    projects = digits.groupBy("project").agg(F.count(F.lit(1)).alias("files"), *sums)
    least = projects.groupBy(*content).agg(F.min("project").alias("same"))
    return projects.join(least, content).select("project", "same")


def one_of_each(units: DataFrame, same: DataFrame) -> DataFrame:
    """The units of one project of each content."""
    return units.join(same.where("project = same").select("project"), "project", "left_semi")


def for_all(rows: DataFrame, same: DataFrame) -> DataFrame:
    """Rows of one project of each content, for every project that has it."""
    return rows.withColumnRenamed("project", "same").join(same, "same").select(*rows.columns)
