"""Findings of the fourth review."""

from pathlib import Path

from pyspark.sql import functions as F

from lintlake.operators import code, declaration_rules, findings, usage_rules
from lintlake.plans import queries
from lintlake.sources.snippets import DECLARATIONS
from lintlake.sources.store import is_written


def test_ranges_without_a_start_open_none(spark):
    """They come behind the others, as in SQL; a key of nothing else keeps them."""
    rows = [("a", None, None), ("a", 1, 3), ("a", 4, 5), ("a", 8, 9), ("a", None, None), ("b", None, None), (None, 2, 3), (None, None, None)]
    got = findings.merged_ranges(spark.createDataFrame(rows, "file_path string, start int, end int"), "file_path").collect()
    assert {tuple(r) for r in got} == {("a", 1, 5), ("a", 8, 9), ("b", None, None), (None, 2, 3)} and len(got) == 4


ODD = """
__all__ = ("_shown", "b")
def _shown(): return 1
def _load_x(): return 1
def _x2(y): return getattr(y, "_x2"), getattr(y, f"_load_{y}")
def f(a, b):
    total = (lambda c: total)(a)
    result = a if a else b
    return result
def g(a, /, b, *c, **d) -> "bool": return h(a, b, **d)
def h(self, a, b): return go(a, b)
while __name__ == "__main__":
    sys.path.append("x")
y = sys.path.insert(0, "x") if "__main__" == __name__ and y else sys.path.append
class A(B):
    "Text."
    ...
    1
class C:
    _d: "list[bool]" = 1
    def e(self) -> (yield): self._f = self._g = self._g.h; return x
    def i(self, *, j, k: bool): total = f(a + b * c(d + e) % -f); return total
    async def _m(self): x.y = "s" "t"; return self._m
"""


def _units(spark, sources):
    rows = [("p", f"app/m{i}.py", "python", text) for i, text in enumerate(sources)]
    return spark.createDataFrame(rows, "project string, path string, file_type string, source string").repartition(4)


def test_the_rules_on_declarations_find_the_same_in_their_part(spark):
    sources = [s.source.replace("{k}", "7") for s in DECLARATIONS] + [p.read_text() for p in sorted(Path(code.__file__).parent.glob("*.py"))]
    units = _units(spark, [*sources, ODD])
    found = []
    for part in (None, declaration_rules.DECLARED):
        tree = code.nodes(units, part).localCheckpoint()
        found.append(sorted(map(str, declaration_rules.all_rules(tree, code.functions(tree)).collect())))
    assert found[0] == found[1] and len(found[0]) > 40
    assert len({r.split("rule_id='")[1].split("'")[0] for r in found[0]}) == 15


def test_declarations_are_found_with_few_shuffles(spark, sf_dir, monkeypatch):
    plans = []
    keep = queries.together
    monkeypatch.setattr(queries, "together", lambda spark, made: plans.extend(m[1]()._jdf.queryExecution().executedPlan().toString() for m in made) or keep(spark, made))
    queries.QUERIES["declaration_findings"](spark, sf_dir)
    # unions of two filters lie nowhere, and are small
    assert len(plans) == 15 and sum(p.count("Exchange") for p in plans) <= 4


def test_long_sums_are_looked_at_once(monkeypatch):
    calls = []
    makes = code._makes_text
    monkeypatch.setattr(code, "_makes_text", lambda node: calls.append(1) or makes(node))
    code.flatten("x = " + " + ".join("a" * 1 for _ in range(300)))
    assert len(calls) < 1500


USED = [
    "def f(x: 'Alpha') -> \"list[Beta]\": pass\nclass Alpha: pass\nclass Beta: pass\nclass Gamma: pass\n",
    "def one(): return getattr(x, 'two')\ndef two(): pass\ndef three(): pass\ngetattr(one, three)\n",
    "from a import four as five, six\nimport b.seven as eight, nine\ndef four(): six = 1\ndef six(): pass\ndef seven(): nine\n",
    "def ｇamma(): pass\nｇetattr(x, 'three')\n@app.route\ndef ten(): x.eleven\ndef eleven(): pass\nif x:\n    def twelve(): pass\n",
    "",
    "def broken(:\n",
]
TOLD = [
    "import a\n__all__ = ['a']\n",
    "__all__: list = []\nfrom a import b\n",
    "x: int = 1\n__all__ = []\n",
    '"""Text."""\nclass A(Protocol):\n    def f(self):\n        ...\n    def g(self):\n        """Text."""\n    def h(self):\n        pass\n        1\n    def i(self): return 1\n    def j(self):\n        self.k: int\n',
    "def f():\n    def g(): return g\n    if f:\n        def h(): return h\n    class B:\n        def m(self): return h\n    return g, h(h)\n",
    "async def f():\n    try:\n        pass\n    except E as e:\n        class A:\n            async def g(self): return 1\n    match f:\n        case 1:\n            class C: pass\n",
    "@overload\ndef f(): pass\nclass A:\n    @a.setter\n    def g(self): pass\n    def _h(self): pass\n    class B(Enum): pass\n    @x.dataclass\n    class C: pass\n",
]


def _same_in_part(spark, rule, part, sources):
    sources = [*sources, ODD, *(p.read_text() for p in sorted(Path(code.__file__).parents[1].rglob("*.py")))]
    units = _units(spark, sources)
    units = units.unionByName(units.withColumn("path", F.concat(F.regexp_extract("path", "(m.*)[.]", 1), F.lit("/__init__.py"))))
    whole, some = (code.nodes(units, p).localCheckpoint() for p in (None, part))
    want = sorted(map(str, rule(whole).collect()))
    assert sorted(map(str, rule(some).collect())) == want and len(want) > 40
    assert some.count() < whole.count() / 2
    light = [bool(code.flatten(t, part, False) != code.flatten(t, part)) for t in sources]
    assert any(light) and not all(light)


def test_missing_docstrings_reads_statements(spark):
    _same_in_part(spark, usage_rules.missing_docstrings, usage_rules.DOCSTRINGS, TOLD)


def test_missing_docstrings_is_found_without_the_whole_relation(spark, sf_dir, tmp_path):
    (tmp_path / "part.parquet").symlink_to(f"{sf_dir}/part.parquet")
    rows = queries.QUERIES["missing_docstrings"](spark, str(tmp_path)).count()
    assert not is_written(spark, "nodes-parts", str(tmp_path))
    whole = usage_rules.missing_docstrings(queries._tree(spark, str(tmp_path))).count()
    assert rows == whole == queries.QUERIES["missing_docstrings"](spark, str(tmp_path)).count()


def test_unreferenced_exports_reads_names_once(spark):
    _same_in_part(spark, usage_rules.unreferenced, usage_rules.USES, USED)


def test_unreferenced_exports_is_found_without_the_whole_relation(spark, sf_dir, tmp_path):
    (tmp_path / "part.parquet").symlink_to(f"{sf_dir}/part.parquet")
    rows = queries.QUERIES["unreferenced_exports"](spark, str(tmp_path)).count()
    assert not is_written(spark, "nodes-parts", str(tmp_path))
    assert rows == usage_rules.unreferenced(queries._tree(spark, str(tmp_path))).count()
