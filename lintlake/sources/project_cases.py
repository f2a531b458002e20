"""Planted cases of the rules on projects as wholes."""

from __future__ import annotations

from lintlake.sources.projects import Case

_STRICT, _FATAL, _COVER = (f"test-quality.pytest-{k}" for k in ("strict-config-missing", "deprecations-not-fatal", "coverage-source-missing"))
_README, _NAME = "docs.missing-readme", "naming.module-name-mismatch"
_SAYS = {
    _STRICT: "Pytest config missing strict flags (`--strict-config` or `--strict-markers`).", _FATAL: "Pytest config doesn't escalate DeprecationWarning to error.", _COVER: "Coverage `source` is empty or absent - coverage may be incomplete.",
    _README: "Project root has no README (README.md, README.rst, or README).",
}
_TESTS = {"README.md": "x\n", "tests/test_a.py": "def test_a():\n    assert f()\n", "tests/test_b.py": "def test_b():\n    assert f()\n"}
_INI = "[tool.pytest.ini_options]\n"


def _config(text: str, *rules: str, **more: str) -> Case:
    return Case({**_TESTS, "pyproject.toml": text, **more}, tuple(("README.md" if r == _README else "pyproject.toml", r, None, None, _SAYS[r]) for r in rules))


def _named(path: str, source: str, *found: tuple[int, str, str]) -> Case:
    return Case({"README.md": "x\n", path: source}, tuple((path, _NAME, line, name, f"Single-class module '{path.split('/')[-1]}' should be named ``{expected}.py`` to match the class '{name}'.") for line, name, expected in found))


PROJECTS = [
    _config(_INI, _STRICT, _FATAL, _COVER),
    _config(_INI + 'addopts = "-q --strict-markers"\nfilterwarnings = ["ignore::X", "error::DeprecationWarning"]\n[tool.coverage.run]\nsource = ["app"]\n'),
    _config(_INI + 'addopts = ["--strict-config"]\nfilterwarnings = "error"\n[tool.coverage.run]\nsource = []\n', _COVER),
    _config(_INI + 'addopts = "--strict-configuration"\nfilterwarnings = ["default::DeprecationWarning"]\n[tool.coverage.run]\nsource = "app"\n', _STRICT, _FATAL),
    _config("[tool.other]\nx = 1\n"),
    _config("not toml [\n"),
    Case({"README.rst": "x\n", "pyproject.toml": _INI, "app/main.py": "def f():\n    return 1\n"}),
    Case({"docs/README.md": "x\n", "app/main.py": "x = 1\n"}, (("README.md", _README, None, None, _SAYS[_README]),)),
    _named("app/thing.py", "class OrderBook:\n    x = 1\n", (1, "OrderBook", "order_book")),
    _named("app/order_book.py", "class OrderBook:\n    x = 1\n"),
    _named("app/order/book.py", "class OrderBook:\n    x = 1\n"),
    _named("src/order/main.py", "import x\n\n\nclass OrderService:\n    x = 1\n\n\ndef one():\n    return 1\n"),
    _named("app/main.py", "class OrderService:\n    x = 1\n\n\ndef one():\n    return 1\n\n\ndef two():\n    return 1\n"),
    _named("app/main.py", "@dataclasses.dataclass(frozen=True)\nclass Order:\n    x: int\n\n\ndef one():\n    return 1\n"),
    _named("app/main.py", "@dataclass\nclass Order:\n    x: int\n", (2, "Order", "order")),
    _named("app/main.py", "class Order:\n    x = 1\n\n\nclass Book:\n    x = 1\n"),
    _named("app/main.py", "class Order:\n    x = 1\n\n\nclass _Book:\n    x = 1\n", (1, "Order", "order")),
    _named("orders/types.py", "class OrdersKind:\n    x = 1\n"),
    _named("app/types.py", "class Kind:\n    x = 1\n", (1, "Kind", "kind")),
    _named("app/_main.py", "class Order:\n    x = 1\n"),
    _named("app/test_main.py", "class Order:\n    x = 1\n"),
    _named("app/main.py", "class XTree:\n    x = 1\n", (1, "XTree", "xtree")),
]

#: Severity, pillar and confidence of each rule.
ABOUT_PROJECTS = {**{r: ("advisory", "test-quality", "medium") for r in (_STRICT, _FATAL, _COVER)}, _README: ("advisory", "documentation", "medium"), _NAME: ("advisory", "naming", "medium")}
