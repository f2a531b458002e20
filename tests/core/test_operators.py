import math

import pytest
from pyspark.sql import functions as F

from lintlake.functions.text import entropy, redacted
from lintlake.operators import code, code_rules, usage_rules, findings, scoring, text_rules
from lintlake.sources import corpus

KIND = "file_path string, rule_id string, pillar string, line int, symbol string, severity string, confidence string, measured int"


def made(spark, *rows):
    return spark.createDataFrame([tuple(r) for r in rows], KIND)


def stack(symbol="f", lines=(1, 1, 1, 1)):
    rules = ("size.function-length", "complexity.cyclomatic", "complexity.cognitive", "complexity.nesting-depth")
    return [("a.py", r, r.split(".")[0], n, symbol, "warning", "high", 30) for r, n in zip(rules, lines)]


def test_correlated_findings_share_the_largest_penalty(spark):
    priced = scoring.penalties(made(spark, *stack()))
    assert [r["penalty"] for r in priced.collect()] == [1.0] * 4
    file = scoring.file_scores(priced).collect()[0]
    assert (file["score"], file["grade"]) == (80.0, "B")
    pillars = scoring.pillar_scores(priced)
    assert {r["pillar"]: r["score"] for r in pillars.collect()} == {p: {"size": 96.0, "complexity": 88.0}.get(p, 100.0) for p in scoring.PILLARS}
    assert scoring.composite(pillars).collect()[0]["score"] == 98.4


def test_other_symbols_and_missing_ones_are_not_correlated(spark):
    rows = [stack("f")[0], stack("g")[1], stack(None)[2], stack(None)[3]]
    assert [r["penalty"] for r in scoring.penalties(made(spark, *rows)).collect()] == [4.0] * 4


def test_no_findings(spark):
    priced = scoring.penalties(made(spark))
    assert scoring.file_scores(priced).count() == 0
    assert {r["score"] for r in scoring.pillar_scores(priced).collect()} == {100.0}
    assert [r["functions"] for r in scoring.cc_histogram(made(spark)).collect()] == [0] * 5


def test_ranges(spark):
    ranges = spark.createDataFrame([("a", 1, 3), ("a", 4, 5), ("a", 5, 9), ("a", 11, 12), ("b", 2, 2)], "file_path string, start int, end int")
    assert sorted(tuple(r) for r in findings.merged_ranges(ranges, "file_path").collect()) == [("a", 1, 9), ("a", 11, 12), ("b", 2, 2)]


@pytest.mark.parametrize(
    "source, want",
    [
        ("def f(x):\n    pass", 1),
        ("def f(x):\n    if x and y or z:\n        pass\n    elif x:\n        pass", 5),
        ("def f(x):\n    return [a for a in x if a if b]", 4),
        ("def f(x):\n    match x:\n        case 1:\n            pass\n        case _:\n            pass", 2),
        ("def f(x):\n    try:\n        assert x\n    except E:\n        pass\n    while x:\n        pass", 4),
        ("def f(x):\n    def g():\n        if x:\n            pass\n    return 1 if x else 2", 2),
    ],
)
def test_cyclomatic(spark, source, want):
    units = spark.createDataFrame([("p", "a.py", "python", source)], "project string, path string, file_type string, source string")
    assert [r["cyclomatic"] for r in code.functions(code.nodes(units)).where("name = 'f'").collect()] == [want]


def units_of(spark, **files):
    return spark.createDataFrame([("p", k.replace("__", "/") + ".py", "python", v) for k, v in files.items()], "project string, path string, file_type string, source string")


def test_code_rules(spark):
    tree = code.nodes(
        units_of(
            spark,
            a="import os, sys as s\nfrom x import y\n\ndef run(self, tmp, str_name):\n    q = s\n    foo = 1\n    data2 = q\n    return foo\n    print(q)\n\nclass Thing:\n    def m(self, a):\n        return eval(a)\n",
            b="from a import run\nrun()\n",
            c="def broken(:\n",
        )
    ).cache()
    one = lambda rows: sorted((r["file_path"], r["line"], r["symbol"]) for r in rows.collect())
    assert one(code_rules.unused_imports(tree)) == [("a.py", 1, None), ("a.py", 2, None)]
    assert one(code_rules.unreachable(tree)) == [("a.py", 9, None)]
    assert one(code_rules.dangerous_calls(tree)) == [("a.py", 13, None)]
    assert one(code_rules.short_variables(tree)) == [("a.py", 5, "q")]
    assert one(code_rules.abbreviations(tree)) == [("a.py", 4, "tmp")]
    assert one(code_rules.hungarian(tree)) == [("a.py", 4, "str_name")]
    assert one(code_rules.poor_identifiers(tree)) == [("a.py", 6, "foo"), ("a.py", 7, "data2")]
    assert one(code_rules.generic_functions(code.functions(tree))) == [("a.py", 4, "run")]
    assert one(usage_rules.unreferenced(tree)) == [("a.py", 11, "Thing")]
    assert {r["parameters"] for r in code.functions(tree).where("symbol = 'Thing.m'").collect()} == {1}
    assert tree.where("kind = 'error'").count() == 1


def test_text_measures(spark):
    got = spark.createDataFrame([("aabb",), ("abcdefghijklmnop",)], "t string").select(entropy(F.col("t")), redacted(F.col("t"))).collect()
    assert math.isclose(got[0][0], 1.0) and math.isclose(got[1][0], 4.0)
    assert (got[0][1], got[1][1]) == ("... (redacted, 4 chars)", "abcd...mnop (redacted, 16 chars)")


def test_workflow_rules(spark):
    text = "permissions: write-all\n  - uses: owner/repo@v1\n  - uses: actions/checkout@v4\n  - uses: owner/repo@" + "a" * 40 + "\nrun: curl x | sudo bash\n"
    units = spark.createDataFrame([("p", ".github/workflows/a.yml", "text", text), ("p", "a.yml", "text", text)], "project string, path string, file_type string, source string")
    got = sorted((r["rule_id"].rsplit(".", 1)[1], r["line"]) for r in text_rules.workflow_findings(units).collect())
    assert got == [("github-actions-broad-permissions", 1), ("github-actions-remote-shell", 5), ("github-actions-unpinned-action", 2)]


def test_read_tree(spark, tmp_path):
    for name, text in {"a.py": "x = 1\r\ny = 2\n", "b.toml": "k = 1", "c.bin": "no", ".venv/d.py": "x", "pkg/e.py": "z", "poetry.lock": "x"}.items():
        f = tmp_path / name
        f.parent.mkdir(exist_ok=True)
        f.write_bytes(text.encode())
    got = {r["path"]: (r["file_type"], r["source"]) for r in corpus.read_tree(spark, str(tmp_path), "p").collect()}
    assert got == {"a.py": ("python", "x = 1\ny = 2\n"), "b.toml": ("text", "k = 1"), "pkg/e.py": ("python", "z")}
    assert set(r["path"] for r in corpus.read_tree(spark, str(tmp_path), "p", ("pkg", "*.toml"), include_ignored=True, hidden=(".venv",)).collect()) == {"a.py", ".venv/d.py"}
