"""Rules over the node relation on small sources."""

import pytest

from lintlake.operators import code, code_rules, usage_rules
from lintlake.sources.snippets import ABOUT, COMMENTS, DECLARATIONS, SECURITY, TESTS

SOURCE = '''
from __future__ import annotations
import a
import b
import c  # noqa: F401
import d
import e
import pickle
__all__ = ["b"]


def f(x: "d.Thing", y=1 if 2 else 3, *rest):
    def inner():
        return x
    class Box:
        z = 1 if 2 else 3
    if x:
        return inner
    pickle.Unpickler(y).load()
    pickle.decode(y)
    return Box
'''


@pytest.fixture(scope="module")
def tree(spark):
    return code.nodes(spark.createDataFrame([("p", "app/m.py", "python", SOURCE), ("p", "app/broken.py", "python", "def (:  # noqa\n"), ("p", "app/empty.py", "python", ""), ("p", "app/none.py", "python", None)], "project string, path string, file_type string, source string")).cache()


def test_unused_imports(tree):
    assert {(r["line"], r["symbol"]) for r in code_rules.unused_imports(tree).collect()} == {(3, None), (7, None)}


def test_a_function_owns_its_body_only(tree):
    rows = {r["symbol"]: r for r in code.functions(tree).collect()}
    assert (rows["f"]["cyclomatic"], rows["f"]["parameters"], rows["f"]["cognitive"]) == (2, 3, 1)
    assert rows["f.inner"]["cyclomatic"] == 1


def test_pickles(tree):
    assert [r["line"] for r in code_rules.unsafe_pickles(tree).collect()] == [19]


def test_nested_reads_use_parameters(tree):
    assert {r["line"] for r in usage_rules.unused_parameters(tree).collect()} == set()


def test_units_that_do_not_parse_keep_their_comments(tree):
    assert sorted(r["kind"] for r in tree.where("path = 'app/broken.py'").collect()) == ["Comment", "error"]
    assert tree.where("path in ('app/empty.py', 'app/none.py')").count() == 2


def test_places_nest(tree):
    rows = {r["node_id"]: r for r in tree.where("path = 'app/m.py' and kind != 'Comment'").collect()}
    assert all(rows[r["parent_id"]]["pre"] < r["pre"] <= r["last"] <= rows[r["parent_id"]]["last"] for r in rows.values() if r["parent_id"] is not None)


def test_every_new_rule_has_a_planted_case():
    found = {rule for group in (SECURITY, TESTS, DECLARATIONS, COMMENTS) for s in group for rule, *_ in s.findings}
    assert found == set(ABOUT)
