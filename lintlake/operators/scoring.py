"""Scores and summaries of findings: window, aggregates and small outer joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lintlake.functions.grading import (
    CC_BUCKETS,
    CORRELATED_RULES,
    FILE_FACTOR,
    PILLAR_FACTOR,
    PILLARS,
    SEVERITY_RANK,
    base_penalty,
    cc_bucket,
    clamped_score,
    grade,
    severity_rank,
)


def penalties(findings: DataFrame, *scope: str) -> DataFrame:
    """``penalty`` of each finding; findings of correlated rules on one symbol share the largest.

    The largest and the number per symbol come from an aggregate that is joined
    back, so a symbol with very many findings is pre-aggregated and its join can be
    split.
    """
    keys = [*scope, "file_path", "symbol"]
    priced = findings.withColumn("base", base_penalty())
    stacked = F.col("rule_id").isin(*CORRELATED_RULES) & F.col("line").isNotNull() & F.col("symbol").isNotNull()
    groups = priced.where(stacked).groupBy(*keys).agg(F.max("base").alias("most"), F.count(F.lit(1)).alias("n")).where("n >= 2")
    shared = priced.join(groups, keys, "left")
    return shared.withColumn("penalty", F.when(stacked & F.col("n").isNotNull(), F.col("most") / F.col("n")).otherwise(F.col("base"))).drop("base", "most", "n")


def pillar_scores(priced: DataFrame, *scope: str) -> DataFrame:
    """Score, grade and counts of each pillar; the fixed pillars are there without findings."""
    spark = priced.sparkSession
    count = lambda s: F.count_if(F.col("severity") == s).alias(s)
    found = priced.groupBy(*scope, "pillar").agg(F.sum("penalty").alias("penalty"), F.count(F.lit(1)).alias("findings"), *map(count, SEVERITY_RANK))
    fixed = spark.createDataFrame([(p,) for p in PILLARS], "pillar string")
    if scope:
        fixed = priced.select(*scope).distinct().crossJoin(F.broadcast(fixed))  # ten rows a scope
    out = found.join(fixed, [*scope, "pillar"], "full")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("penalty", "findings", *SEVERITY_RANK)}
    out = out.withColumns(zero)
    score = clamped_score(F.col("penalty"), PILLAR_FACTOR)
    return out.select(*scope, "pillar", score.alias("score"), grade(score).alias("grade"), "findings", *SEVERITY_RANK)


def composite(pillars: DataFrame, *scope: str) -> DataFrame:
    """Mean of the rounded pillar scores, rounded again."""
    score = F.round(F.avg("score"), 2)
    return pillars.groupBy(*scope).agg(score.alias("score")).withColumn("grade", grade(F.col("score")))


def file_scores(priced: DataFrame, *scope: str) -> DataFrame:
    """Score, grade, number of findings and worst measures of each file."""
    lines = F.max(F.when(F.col("rule_id").isin("size.function-length", "size.file-length"), F.col("measured")))
    cc = F.max(F.when(F.col("rule_id") == "complexity.cyclomatic", F.col("measured")))
    out = priced.groupBy(*scope, "file_path").agg(F.sum("penalty").alias("penalty"), F.count(F.lit(1)).alias("findings"), cc.alias("max_cyclomatic"), lines.alias("max_lines"))
    score = clamped_score(F.col("penalty"), FILE_FACTOR)
    return out.select(*scope, "file_path", score.alias("score"), grade(score).alias("grade"), "findings", "max_cyclomatic", "max_lines")


def top_offenders(files: DataFrame, n: int = 10) -> DataFrame:
    """The worst files: a top-k report."""
    return files.orderBy("score", F.desc("findings"), "file_path").limit(n)


def cc_histogram(findings: DataFrame) -> DataFrame:
    """Flagged functions by bucket of cyclomatic complexity, zeros included."""
    spark = findings.sparkSession
    buckets = spark.createDataFrame([(i, b) for i, b in enumerate([*(x for x, _ in CC_BUCKETS), "21+"])], "ord int, bucket string")
    counts = findings.where(F.col("rule_id") == "complexity.cyclomatic").groupBy(cc_bucket(F.col("measured")).alias("bucket")).agg(F.count(F.lit(1)).alias("functions"))
    return counts.join(F.broadcast(buckets), "bucket", "right").select("ord", "bucket", F.coalesce("functions", F.lit(0)).alias("functions"))


def counts_by_severity(findings: DataFrame) -> DataFrame:
    return findings.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITY_RANK])


def counts_by_rule(findings: DataFrame) -> DataFrame:
    """Findings, worst severity and the first finding's confidence of each rule."""
    first = F.struct("file_path", F.coalesce("line", F.lit(0)), "message", "confidence")
    out = findings.groupBy("rule_id").agg(F.count(F.lit(1)).alias("findings"), F.max(severity_rank()).alias("rank"), F.min_by("confidence", first).alias("confidence"))
    name = F.element_at(F.array(*[F.lit(s) for s in SEVERITY_RANK]), F.col("rank"))
    return out.select("rule_id", "findings", name.alias("worst"), "confidence")


def top_rules(findings: DataFrame, n: int = 5) -> DataFrame:
    """The most frequent rules: a top-k report; ties by first place in the order of findings."""
    place = F.min(F.struct("file_path", F.coalesce("line", F.lit(0)), "rule_id"))
    return findings.groupBy("rule_id").agg(F.count(F.lit(1)).alias("findings"), place.alias("place")).orderBy(F.desc("findings"), "place").limit(n).select("rule_id", "findings")


def pillar_summary(findings: DataFrame) -> DataFrame:
    return findings.groupBy("pillar").agg(F.count(F.lit(1)).alias("findings"), *[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITY_RANK])


def metric_summary(measures: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Minimum, interpolated percentiles, maximum and crossings of each metric.

    Equal values are counted before they are ordered, so what is ranked is the
    distinct values; ranks are running sums, and no task holds a metric's values.
    """
    crossing = F.when(F.col("below"), F.col("value") < F.col("threshold")).otherwise(F.col("value") > F.col("threshold"))
    counts = measures.groupBy("metric", "value").agg(F.count(F.lit(1)).alias("times"))
    counts = counts.join(thresholds.select("metric", "threshold", "below"), "metric").withColumn("crossed", F.when(crossing, F.col("times")).otherwise(0))
    order = Window.partitionBy("metric").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("upto", F.sum("times").over(order))
    totals = counts.groupBy("metric").agg(F.sum("times").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"), F.sum("crossed").alias("crossings"))

    def at(place: Column) -> Column:
        """The value of a rank: the first whose running count goes beyond it."""
        return F.min(F.when(F.col("upto") > place, F.col("value")))

    marks = {"p50": 0.5, "p90": 0.9, "p99": 0.99}
    ends = []
    for name, q in marks.items():
        place = F.lit(q) * (F.col("n") - 1)
        ends += [at(F.floor(place)).alias(f"{name}_low"), at(F.ceil(place)).alias(f"{name}_high")]
    found = ranked.join(totals.select("metric", "n"), "metric").groupBy("metric").agg(*ends).join(totals, "metric")
    between = lambda name, q: (F.col(f"{name}_low") + (F.col(f"{name}_high") - F.col(f"{name}_low")) * (F.lit(q) * (F.col("n") - 1) - F.floor(F.lit(q) * (F.col("n") - 1)))).alias(name)
    return found.select("metric", "n", "least", *[between(name, q) for name, q in marks.items()], "most", "crossings")


def metric_top(measures: DataFrame, thresholds: DataFrame, n: int = 10) -> DataFrame:
    """The worst functions of each metric: a top-k report, low values first where the metric says ``below``.

    Each threshold (as many as the library has) is an ordered limit over the measures, so a task keeps ``n``
    rows; a join with the thresholds and a window would shuffle and sort all values of a metric in one task.
    """
    order = ["bad", "file_path", "line", "symbol"]
    limits = thresholds.select("metric", "below").where("metric is not null").collect()
    worst = measures.withColumn("bad", F.col("value")).limit(0)
    for limit in limits:
        bad = F.col("value") if limit["below"] else -F.col("value")
        worst = worst.unionByName(measures.where(F.col("metric") == limit["metric"]).withColumn("bad", bad).orderBy(*order).limit(n))
    ranked = worst.withColumn("place", F.row_number().over(Window.partitionBy("metric").orderBy(*order)))
    return ranked.where(F.col("place") <= n).select("metric", "place", "file_path", "line", "symbol", "value")


def exit_code(findings: DataFrame, diagnostics: DataFrame, fail_on: str = "error") -> DataFrame:
    """2 with any diagnostic, else 1 with a finding of the severity or worse, else 0."""
    worst = findings.agg(F.coalesce(F.max(severity_rank()), F.lit(0)).alias("rank"))
    any_ = diagnostics.agg((F.count(F.lit(1)) > 0).alias("broken"))
    code = F.when(F.col("broken"), 2).when(F.col("rank") >= SEVERITY_RANK[fail_on], 1).otherwise(0)
    return worst.crossJoin(any_).select(code.alias("exit_code"))  # one row each
