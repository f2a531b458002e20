"""Findings of the third review."""

from pyspark.sql import functions as F

from lintlake.operators import code
from lintlake.plans import queries
from lintlake.sources import changes
from lintlake.sources.store import written


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_markers_end_at_any_other_character(spark, tmp_path):
    texts = ["UND\u00d6EN \u00dcDE THE_ DE", "BUG TODO", None]
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["marker_densities"](spark, str(tmp_path)).collect()
    assert {r["path"]: r["markers"] for r in got} == {"tests/s/0.txt": 3, "tests/s/1.txt": 1, "tests/s/2.txt": 0}


def test_ignore_decisions_broadcast_no_paths_or_patterns(spark, sf_dir):
    """Paths and patterns are made by generators: their size is estimated as that of the few bytes they are made of."""
    assert "BroadcastExchange" not in _plan(queries.QUERIES["ignore_decisions"](spark, sf_dir))


def test_ignore_rules_are_not_broadcast(spark):
    paths = spark.createDataFrame([("p", "a.log")], "project string, path string")
    rules = changes.ignore_rules(spark.createDataFrame([("p", "", "*.log\n")], "project string, dir string, source string"))
    out = changes.ignored(paths, rules)
    assert "BroadcastExchange" not in _plan(out) and out.collect()[0]["ignored"]


def test_equal_texts_are_parsed_once(spark, monkeypatch):
    """Copies of a text get the same rows; runs are bounded by different texts."""
    texts = [f"x = {i % 3}\n" for i in range(1000)] + ["def f(:\n", "", "# only a comment\n"]
    assert list(code._runs(texts)) == [(0, 1003)]
    assert [b - a for a, b in code._runs([str(i) for i in range(450)])] == [200, 200, 50]
    units = spark.createDataFrame([("p", f"m{i}.py", "python", t) for i, t in enumerate(texts)], "project string, path string, file_type string, source string").coalesce(1)
    got = {r["path"]: r["n"] for r in code.nodes(units).groupBy("path").agg(F.count("*").alias("n")).collect()}
    assert got == {f"m{i}.py": len(code.flatten(t)) for i, t in enumerate(texts)}
    values = code.nodes(units).where("kind = 'Constant'").select("path", "text").collect()
    assert {r["path"]: r["text"] for r in values} == {f"m{i}.py": str(i % 3) for i in range(1000)}


def test_written_relations_are_not_estimated_by_their_files(spark):
    """A relation of repeated values takes far more memory than its file, and must not be broadcast for its file's size."""
    repeated = spark.range(200_000).selectExpr("xxhash64(id) as id", *[f"repeat('long text ', 20) as c{i}" for i in range(5)])
    one, other = written(repeated, "one"), written(repeated, "other")
    assert "BroadcastExchange" not in _plan(one.join(other.select("id", "c1"), "id"))
