from pyspark.sql import functions as F

from lintlake.operators import code
from lintlake.operators.same_projects import for_all, one_of_each, same_projects
from lintlake.plans import analysis
from lintlake.sources.store import _CLUSTERED, _INSIDE, clustered, clustering, clusters, together, written

UNITS = "project string, path string, file_type string, source string"


def test_projects_are_the_same_by_paths_types_and_texts(spark):
    a, b = ("a.py", "python", "x = 1\n"), ("b.py", "python", "y = 2\n")
    projects = {
        "p2": [a, b], "p1": [b, a], "p10": [a, b], "q": [a], "r": [b], "s": [a, a], "t": [("a.py", "text", "x = 1\n")], "u": [("b.py", *a[1:]), ("a.py", *b[1:])],
        "v": [("a.py", "python", None)], "w": [("a.py", "python", "")], "x": [("a.pyp", "ython", "x = 1\n")], "y": [("a.py", None, "-")], "z": [("a.py", None, "-")],
    }
    units = spark.createDataFrame([(p, *f) for p, files in projects.items() for f in files], UNITS)
    same = same_projects(units)
    got = {r["project"]: r["same"] for r in same.collect()}
    assert got == {p: p for p in projects} | {"p2": "p1", "p10": "p1", "z": "y"}
    kept = one_of_each(units, same)
    assert kept.select("project").distinct().count() == len(projects) - 3
    assert sorted(map(str, for_all(kept, same).collect())) == sorted(map(str, units.collect()))


def test_joins_inside_clusters_do_not_shuffle(spark):
    before = {k: spark.conf.get(k) for k in _INSIDE}
    units = spark.range(50).select(F.format_string("p%d", "id").alias("project"), F.lit("a.py").alias("path"), F.lit("python").alias("file_type"), F.lit("def f(a):\n    return g(a)\n").alias("source"))
    try:
        with clustering(spark, 3, "project", "path"):
            tree = clustered(code.nodes(units.repartition(3, "project", "path")), "nodes")
            up = tree.select("project", "path", F.col("node_id").alias("parent_id"), F.col("kind").alias("up"))
            joined = tree.join(up, ["project", "path", "parent_id"]).groupBy("project", "path", "up").count()
            assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
            again = written(joined, "again").join(tree, ["project", "path"])
            assert "Exchange" not in again._jdf.queryExecution().executedPlan().toString()
            assert tree.count() == code.nodes(units).count() and "project" not in written(joined.select("up"), "plain").columns
            raise KeyError
    except KeyError:
        pass
    assert {k: spark.conf.get(k) for k in _INSIDE} == before and not _CLUSTERED
    assert clusters(units) == clusters(units.limit(0)) == 1


def test_relations_made_together_keep_their_order(spark):
    made = together(spark, [(f"n{i}", lambda i=i: spark.range(i)) for i in range(12)])
    assert [m.count() for m in made] == list(range(12))


def test_projects_analysed_once_have_the_findings_of_each(spark):
    texts = ["class A:\n    def f(self, x):\n        pass\n", "import os\n\n\ndef run(c):\n    os.system(c)\n", "def quiet(x):  # lintlake: disable=waste.unused-parameter\n    return 1\n"]
    rows = [(f"p{i}", f"{d}.py", "python", texts[(i % 3 + d) % 3]) for i in range(9) for d in range(2)] + [("alone", "0.py", "python", texts[0])]
    units = spark.createDataFrame(rows, UNITS)
    tree = written(code.nodes(units), "plain-nodes")
    families = ("usage", "structure")
    plain = analysis.analyse(written(analysis.rule_findings(tree, families), "plain-found"), tree)
    got = analysis.analysed_projects(units, families)
    assert got.columns == plain.columns
    got, plain = sorted(map(str, got.collect())), sorted(map(str, plain.collect()))
    assert got == plain and len(got) > 9


def test_the_whole_query_analyses_one_project_of_each_content(spark, sf_dir, monkeypatch, tmp_path):
    from lintlake.plans import queries

    (tmp_path / "customer.parquet").symlink_to(f"{sf_dir}/customer.parquet")
    seen = []
    monkeypatch.setattr(analysis, "rule_findings", lambda tree, families, made=analysis.rule_findings: seen.append(tree.select("project").distinct().count()) or made(tree, families))
    found = queries.QUERIES["whole_findings"](spark, str(tmp_path))
    assert seen == [len(queries._EVERY)] and found.select("project").distinct().count() > seen[0]
