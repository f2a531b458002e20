import ast
import tokenize
from pathlib import Path

import pytest

from lintlake.operators import code, code_rules, usage_rules
from lintlake.plans import queries
from lintlake.plans.queries import ORACLE_SQL, QUERIES
from lintlake.sources.store import is_written

PARTS = (code.MEASURES, code_rules.ABBREVIATED, code_rules.SHORT, code_rules.IMPORTS, code_rules.STATEMENTS, usage_rules.METHODS)
COLUMNS = [f.split(" ")[0] for f in code.NODES.split(", ")][2:]
UNCOUNTED = {"operators", "operand", "pre", "last"}


@pytest.mark.parametrize("part", PARTS, ids=lambda p: p.name)
def test_a_part_has_the_same_rows_as_the_whole(part):
    sources = [p.read_text() for p in Path(code.__file__).parents[1].rglob("*.py")] + [Path(m.__file__).read_text() for m in (ast, tokenize)]
    sources += ["def f(x):\n    try:\n        return f(x) if x else (lambda a=f(1): a)\n    finally:\n        pass  # noqa\n", "def broken(:\n    # why\n", ""]
    wanted = [i for i, c in enumerate(COLUMNS) if c not in UNCOUNTED and (not part.columns or c in part.columns)]
    kind, cog = COLUMNS.index("kind"), COLUMNS.index("cog")
    assert not part.columns or not UNCOUNTED & set(part.columns)
    for source in sources:
        asked = not part.like or not source.isascii() or part.like(source)
        whole = [r for r in code.flatten(source) if asked and ( r[kind] in part.kinds or (r[cog] or 0) > 0)]
        assert [[r[i] for i in wanted] for r in code.flatten(source, part)] == [[r[i] for i in wanted] for r in whole]


def test_texts_of_a_rules_names_are_kept(spark):
    rows = [("tmp_value = 1",), ("xTmp = 1",), ("HTTPTmp = 1",), ("TMP = 1",), ("ｔｍｐ = 1",), ("def f(cfg): pass",), ("MYTMP = 1",), ("template = 1",), ("q = 1",), ("x = 1",), ("eval('1')",), ("__import__(x)",), ("ｅｖａｌ('1')",), ("total = 1",)]
    units = spark.createDataFrame(rows, "source string").selectExpr("'p' as project", "concat('u', monotonically_increasing_id()) as path", "'python' as file_type", "source")
    tree = code.nodes(units).localCheckpoint()
    for part, rule, least in ((code_rules.ABBREVIATED, code_rules.abbreviations, 6), (code_rules.SHORT, code_rules.short_variables, 1), (code_rules.DANGEROUS, code_rules.dangerous_calls, 3)):
        some = code.nodes(units, part).localCheckpoint()
        found = sorted(map(str, rule(some).collect()))
        assert found == sorted(map(str, rule(tree).collect())) and len(found) >= least
        assert some.select("path").distinct().count() < len(rows)


def test_single_rules_do_not_write_the_whole_relation(spark, sf_dir, tmp_path):
    import duckdb

    (tmp_path / "part.parquet").symlink_to(f"{sf_dir}/part.parquet")
    con = duckdb.connect()
    con.execute(f"create view part as select * from '{sf_dir}/part.parquet'")
    for name in ("dangerous_calls", "all_function_measures", "unused_imports", "unreachable_code", "function_metric_summary", "abbreviations", "function_measures", "public_methods", "short_variables"):
        got = sorted(map(str, (tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect())))
        assert got == sorted(map(str, con.execute(ORACLE_SQL[name]).fetchall())), name
    assert not is_written(spark, "nodes-parts", str(tmp_path))
    whole = queries._tree(spark, str(tmp_path))
    assert whole.columns == queries._tree(spark, str(tmp_path), code.MEASURES).columns
