from pyspark.sql import functions as F

from lintlake.operators import scoring
from lintlake.sources import settings


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_configuration_is_spread_before_it_is_read(spark):
    text = "schemaVersion: lintlake.config.v1\nrules:\n  a.b:\n    enabled: false\n"
    toml = '[tool.lintlake]\nschemaVersion = "x"\n'
    files = spark.range(0, 50, 1, 1).select(
        F.concat(F.lit("p"), "id").alias("project"),
        F.when(F.col("id") % 2 == 0, ".lintlake.yaml").otherwise("pyproject.toml").alias("path"),
        F.when(F.col("id") == 0, F.lit(None)).when(F.col("id") == 2, "- a").when(F.col("id") == 1, "[tool]").when(F.col("id") % 2 == 0, text).otherwise(toml).alias("source"),
    )
    out = settings.config_rows(files)
    assert "REPARTITION_BY_NUM" in plan(out)
    rows = {}
    for r in out.collect():
        rows.setdefault(r["project"], set()).add((".".join(r["keys"]), r["kind"], r["value"]))
    assert rows.pop("p0") == {("", "dict", "{}")}
    assert rows.pop("p2") == {("", "problem", '"the top level must be a mapping"')}
    assert "p1" not in rows and len(rows) == 47
    for project, found in rows.items():
        even = int(project[1:]) % 2 == 0
        assert found == ({("schemaVersion", "str", '"lintlake.config.v1"'), ("rules.a.b.enabled", "bool", "false")} if even else {("schemaVersion", "str", '"x"')})


def test_the_worst_functions_are_ordered_limits(spark):
    measures = spark.range(400).select(F.when(F.col("id") % 2 == 0, "low").otherwise("high").alias("metric"), F.lit("f").alias("file_path"), F.lit(1).alias("line"), F.col("id").cast("string").alias("symbol"), (F.col("id") % 50).cast("double").alias("value"))
    limits = spark.createDataFrame([("low", 1.0, True), ("high", 1.0, False), ("none", 1.0, False)], "metric string, threshold double, below boolean")
    out = scoring.metric_top(measures, limits, 5)
    assert plan(out).count("TakeOrderedAndProject") >= 2  # the optimizer drops the metric without rows
    got = {(r["metric"], r["place"]): (r["symbol"], r["value"]) for r in out.collect()}
    want = {}
    for metric, odd, sign in (("low", 0, 1), ("high", 1, -1)):
        worst = sorted((sign * (i % 50), str(i)) for i in range(odd, 400, 2))[:5]
        want |= {(metric, k): (s, float(sign * v)) for k, (v, s) in enumerate(worst, 1)}
    assert got == want
    assert scoring.metric_top(measures, limits.limit(0), 5).count() == 0
