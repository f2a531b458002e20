from lintlake.operators import code
from lintlake.plans.queries import QUERIES


def test_all_functions_are_measured(spark, sf_dir):
    rows = QUERIES["all_function_measures"](spark, sf_dir).collect()
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_size").collect()
    assert len(rows) == sum(3 + r["p_size"] % 14 + 1 for r in parts)
    deep = [r for r in rows if r["symbol"].startswith("_deep_")]
    assert max(r["nesting"] for r in deep) == 9 and all(r["cyclomatic"] == r["nesting"] + 1 for r in deep)


def test_large_rule_tables_are_shuffled(spark, sf_dir):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        plan = QUERIES["over_threshold"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, before)
    assert "Broadcast" not in plan and "SortMergeJoin" in plan


def test_texts_of_constants_and_keywords_are_whole():
    long = "x" * 500
    rows = code.flatten(f"f(key='{long}')")
    assert sum(long in str(v) for r in rows for v in r) == 2
