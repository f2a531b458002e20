"""Small modules with the findings that each must give, dealt over the rows of ``customer``.

A customer's key chooses the module and stands in its names (``{k}``). Modules
without findings are there as well: what looks like a case and is none.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Snippet:
    """A module: its folder, its text, and (rule, line, symbol, message) of each finding."""

    source: str
    findings: tuple[tuple[str, int, str | None, str], ...] = ()
    path: str = "app/unit_{k}.py"


def dealt(customers: DataFrame, snippets: list[Snippet]) -> DataFrame:
    """The modules as source units: project, path, file_type, source."""
    k = F.col("c_custkey")
    place = (k % len(snippets)).cast("int") + 1

    def chosen(texts: list[str]):
        return F.replace(F.element_at(F.array(*map(F.lit, texts)), place), F.lit("{k}"), k.cast("string"))

    return customers.select(F.concat(F.lit("p"), (k % 5).cast("string")).alias("project"), chosen([s.path for s in snippets]).alias("path"), chosen(["python" if s.path.endswith(".py") else "text" for s in snippets]).alias("file_type"), chosen([s.source for s in snippets]).alias("source"))


def expected_sql(snippets: list[Snippet], about: dict[str, tuple[str, str, str]]) -> str:
    """DuckDB SQL of the findings that the dealt modules must give; ``about`` has severity, pillar and confidence of each rule."""

    def text(x: str | None) -> str:
        return "NULL" if x is None else "'" + x.replace("'", "''") + "'"

    rows = [f"({i}, {text(rule)}, {text(s.path)}, {line}, {text(symbol)}, {', '.join(map(text, about[rule]))}, {text(message)})" for i, s in enumerate(snippets) for rule, line, symbol, message in s.findings]
    named = lambda c: f"replace({c}, '{{k}}', CAST(c_custkey AS VARCHAR)) AS {c}"
    return (
        f"WITH expected(place, rule_id, file_path, line, symbol, severity, pillar, confidence, message) AS (VALUES {', '.join(rows)}) "
        f"SELECT 'p' || CAST(c_custkey % 5 AS VARCHAR) AS project, rule_id, {named('file_path')}, line::INTEGER AS line, {named('symbol')}, severity, pillar, confidence, {named('message')} FROM customer JOIN expected ON c_custkey % {len(snippets)} = place"
    )


_XXE = "parses XML without external-entity protections - XXE / billion-laughs risk."
_YAML = "can construct arbitrary Python objects from YAML input."
_PATHLIB = "a hardcoded world-writeable tmp path - symlink / race risk."

SECURITY = [
    Snippet("import hashlib\npassword_hash = hashlib.md5(data)\nplain = hashlib.md5(data)\n", (("security.weak-crypto", 2, None, "`hashlib.md5` used in a security-smelling context - prefer SHA-256+ or a password-hashing KDF."),)),
    Snippet("from hashlib import sha1, sha256\n\ndef sign(token):\n    x = sha1(token)\n    y = sha256(text)\n    return x, y\n\ndef check_password(x):\n    return sha256(x)\n", (("security.weak-crypto", 4, None, "`hashlib.sha1` used in a security-smelling context - prefer SHA-256+ or a password-hashing KDF."), ("security.weak-crypto", 9, None, "`hashlib.sha256` used in a security-smelling context - prefer SHA-256+ or a password-hashing KDF."))),
    Snippet("import random\nsession_id = random.randint(1, 9)\nroll = random.randint(1, 6)\n\ndef make_token():\n    return random.choice('abc')\n", (("security.insecure-random", 2, None, "`random.randint` used for a security-smelling value - `random` is not cryptographically secure."), ("security.insecure-random", 6, None, "`random.choice` used for a security-smelling value - `random` is not cryptographically secure."))),
    Snippet("import tempfile\nname = tempfile.mktemp()\nopen('/tmp/cache_{k}')\nopen('/tmpfile')\nprint('/tmp/x')\n", (("security.insecure-temp-file", 2, None, "`tempfile.mktemp()` returns a path without creating the file - TOCTOU race risk."), ("security.insecure-temp-file", 3, None, "`open('/tmp/cache_{k}'...)` uses " + _PATHLIB))),
    Snippet("app.run(host='0.0.0.0')\nsock.bind(('::', 80))\napp.run(host='127.0.0.1')\nsock.bind(address)\n", (("security.hardcoded-bind-all-interfaces", 1, None, "Server binding to wildcard address `0.0.0.0` - exposes the service on every network interface."), ("security.hardcoded-bind-all-interfaces", 2, None, "Server binding to wildcard address `::` - exposes the service on every network interface."))),
    Snippet("from flask import Flask\napp = Flask(__name__)\napp.config.update(DEBUG=True)\napp.run(debug=True)\napp.run(debug=False)\n", (("security.flask-debug-enabled", 3, None, "Flask debug mode enabled via `.config.update(DEBUG=True)` - exposes the Werkzeug debugger."), ("security.flask-debug-enabled", 4, None, "Flask debug mode enabled via `.run(debug=True)` - exposes the Werkzeug debugger."))),
    Snippet("import other\nother.run(debug=True)\n"),
    Snippet("import jinja2 as j\nenv = j.Environment()\nsafe = j.Environment(autoescape=True)\noff = j.Environment(autoescape=False)\nother = Environment()\n", (("security.jinja2-autoescape-off", 2, None, "Jinja2 `Environment(...)` without `autoescape=True` leaves rendered templates exposed to XSS."), ("security.jinja2-autoescape-off", 4, None, "Jinja2 `Environment(...)` without `autoescape=True` leaves rendered templates exposed to XSS."))),
    Snippet("import paramiko as ssh\nfrom paramiko import WarningPolicy as Warn\nclient.set_policy(ssh.AutoAddPolicy())\nclient.set_policy(Warn())\nclient.set_policy(ssh.RejectPolicy())\n", (("security.paramiko-no-host-key-check", 3, None, "`paramiko.AutoAddPolicy()` accepts unknown SSH host keys - MITM risk."), ("security.paramiko-no-host-key-check", 4, None, "`paramiko.WarningPolicy()` accepts unknown SSH host keys - MITM risk."))),
    Snippet("import xml.etree.ElementTree as tree\nfrom lxml import etree\ntree.parse(x)\netree.fromstring(x)\netree.tostring(x)\n", (("security.xxe", 3, None, "`xml.etree.ElementTree.parse(...)` " + _XXE), ("security.xxe", 4, None, "`lxml.etree.fromstring(...)` " + _XXE))),
    Snippet("import defusedxml.ElementTree\nimport xml.sax\nxml.sax.parse(x)\n"),
    Snippet("import yaml\nloader = yaml.SafeLoader\nyaml.load(x)\nyaml.load(x, Loader=loader)\nyaml.load(x, yaml.SafeLoader)\nyaml.load(x, Loader=yaml.Loader)\nloader = yaml.UnsafeLoader\nyaml.load(x, Loader=loader)\nyaml.unsafe_load(x)\nyaml.safe_load(x)\n", tuple(("security.unsafe-yaml-load", n, None, f"`yaml.{call}(...)` {_YAML}") for n, call in ((3, "load"), (6, "load"), (8, "load"), (9, "unsafe_load")))),
    Snippet("import requests\nrequests.get(url, verify=False)\nrequests.get(url, verify=True)\nurllib3.disable_warnings()\n", (("security.disabled-ssl-verification", 2, None, "`requests.get(verify=False)` disables TLS certificate verification."), ("security.disabled-ssl-verification", 4, None, "`urllib3.disable_warnings()` disables TLS certificate verification."))),
    Snippet("from django.utils.safestring import mark_safe\nmark_safe(text)\nmark_safe('<b>')\nmark_safe(escape(text))\n", (("security.django-mark-safe", 2, None, "`mark_safe(...)` applied to non-literal content - XSS risk if the value is user-controlled."),)),
    Snippet("import django\nItem.objects.raw('select ' + name)\nItem.objects.raw('select 1')\nRawSQL(f'select {name}', [])\n", (("security.django-raw-sql", 2, None, "`.raw(...)` receives a dynamic SQL string - use parameterised arguments instead."), ("security.django-raw-sql", 4, None, "`RawSQL(...)` receives a dynamic SQL string - use parameterised arguments instead."))),
    Snippet("import contextlib\nwith contextlib.suppress(Exception):\n    go()\nwith contextlib.suppress(KeyError):\n    go()\n", (("security.error-suppression", 2, None, "Wide-exception suppression: `contextlib.suppress(Exception)`."),)),
    Snippet("make(**request.json)\nmake(**self.request.form)\nmake(**options)\nmake(**request.user)\n", tuple(("security.extract-compact-user-input", n, None, "User-controlled dict splatted into a function's keyword arguments (`**request.<attr>`).") for n in (1, 2))),
    Snippet("from fastapi import Response\nresponse.headers[name] = value\nresponse.headers['X-A'] = value\n", (("security.header-injection", 2, None, "Response header key is dynamic - header injection risk."),)),
    Snippet("import importlib\nNAME = 'json'\nimportlib.import_module(name)\nimportlib.import_module(NAME)\nimportlib.import_module('os')\n__import__(f(x))\n", (("security.variable-import", 3, None, "`importlib.import_module(...)` with a non-literal module name."), ("security.variable-import", 6, None, "`__import__(...)` with a non-literal module name."))),
    Snippet("from flask_cors import CORS\nCORS(app, supports_credentials=True, origins='*')\nCORS(app, origins='*')\n", (("security.cors-wildcard-with-credentials", 2, None, "CORS allows any origin together with credentials."),)),
    Snippet("import flask\nSECRET_KEY = 'do-not-ship-{k}'\nOTHER_KEY = 'x'\n", (("security.hardcoded-framework-secret-key", 2, None, "Framework SECRET_KEY is hardcoded."),)),
]

#: Severity, pillar and confidence of each rule.
ABOUT = {
    **{f"security.{r}": ("warning", "security", "high") for r in ("weak-crypto", "django-raw-sql")},
    **{f"security.{r}": ("warning", "security", "medium") for r in ("insecure-random", "insecure-temp-file", "hardcoded-bind-all-interfaces", "django-mark-safe", "extract-compact-user-input", "header-injection", "variable-import")},
    **{f"security.{r}": ("error", "security", "high") for r in ("flask-debug-enabled", "jinja2-autoescape-off", "paramiko-no-host-key-check", "xxe", "unsafe-yaml-load", "disabled-ssl-verification", "cors-wildcard-with-credentials", "hardcoded-framework-secret-key")},
    "security.error-suppression": ("advisory", "security", "medium"),
    **{f"test-quality.{r}": ("advisory", "test-quality", "medium") for r in ("conditional-logic", "eager-test", "exception-type-only", "loop-assertion-without-message", "mock-without-expectation", "mystery-guest", "parametrize-annotation", "setup-bloat", "tautological-type-assertion", "test-longer-than-sut")},
    **{f"test-quality.{r}": ("warning", "test-quality", "high") for r in ("empty-parametrize", "extends-production-class", "skipped-without-reason", "unused-mock")},
    **{f"test-quality.{r}": ("warning", "test-quality", "medium") for r in ("excessive-mocking", "mock-only-test", "private-reflection")},
    "test-quality.test-function-too-long": ("error", "test-quality", "high"),
    "naming.test-naming-consistency": ("advisory", "naming", "medium"),
    "complexity.cognitive": ("error", "complexity", "high"),
    "complexity.halstead-volume": ("error", "complexity", "medium"),
    "complexity.maintainability-index": ("error", "maintainability", "medium"),
    "size.average-function-length": ("error", "size", "high"),
    "docs.missing-param-doc": ("advisory", "documentation", "medium"),
    "docs.missing-return-doc": ("advisory", "documentation", "medium"),
    "docs.missing-raises-doc": ("advisory", "documentation", "low"),
    "docs.stale-param-doc": ("warning", "documentation", "high"),
    "waste.empty-class": ("advisory", "dead-code", "high"),
    "waste.one-line-function": ("advisory", "dead-code", "medium"),
    "waste.redundant-variable": ("advisory", "dead-code", "high"),
    "dead-code.unused-private-attribute": ("warning", "dead-code", "medium"),
    "test-quality.trivial-snapshot": ("advisory", "test-quality", "medium"),
    "test-quality.naming-consistency": ("advisory", "test-quality", "medium"),
    "test-quality.multiple-aaa-cycles": ("advisory", "test-quality", "low"),
    "naming.boolean-prefix": ("advisory", "naming", "medium"),
    "dead-code.unused-private-function": ("warning", "dead-code", "medium"),
    "docs.ignore-directive-reason": ("warning", "documentation", "high"),
    "design.runtime-sys-path-mutation": ("advisory", "design", "high"),
}

_T = "tests/test_unit_{k}.py"
_LOGIC = "Test 'test_{k}' contains conditional logic - split into parametrised cases."

TESTS = [
    Snippet("def test_{k}(x):\n    if x:\n        y = 1\n    assert y\n\ndef test_guard(x):\n    if x:\n        return\n    assert x\n\ndef helper(x):\n    if x:\n        y = 1\n", (("test-quality.conditional-logic", 2, "test_{k}", _LOGIC),), _T),
    Snippet("class TestIt:\n    def test_{k}(self):\n" + "        assert x\n" * 5 + "        assert_that(x)\n\n    def check(self):\n" + "        assert x\n" * 7, (("test-quality.eager-test", 2, "TestIt.test_{k}", "Test 'TestIt.test_{k}' contains 6 assertions, above the threshold of 5."),), _T),
    Snippet("import pytest\n\n@pytest.mark.parametrize('x', [])\ndef test_{k}(x):\n    assert x\n\n@pytest.mark.parametrize('x', [1, 2, 3])\ndef test_b(x):\n    assert x\n\n@pytest.mark.parametrize('x', [1, 2, 3], ids=str)\ndef test_c(x):\n    assert x\n", (("test-quality.empty-parametrize", 3, "test_{k}", "Test 'test_{k}' has @parametrize with an empty cases list."), ("test-quality.parametrize-annotation", 7, "test_b", "Test 'test_b' has @parametrize with 3 cases but no `ids=` for human-readable case names.")), _T),
    Snippet("import pytest\n\ndef test_{k}():\n    with pytest.raises(Exception):\n        go()\n    with pytest.raises(Exception, match='x'):\n        go()\n    with pytest.raises(KeyError):\n        go()\n", (("test-quality.exception-type-only", 4, "test_{k}", "Test 'test_{k}' catches a wide exception without `match=`."),), _T),
    Snippet("from unittest.mock import Mock, patch\n\ndef test_{k}():\n    a = Mock()\n    b = Mock()\n    c = Mock()\n    d = Mock()\n    with patch('x') as e:\n        run(a, b, c, d)\n    a.assert_called_once()\n    assert a\n", (("test-quality.excessive-mocking", 3, "test_{k}", "Test 'test_{k}' creates 5 mocks, above the threshold of 4."), ("test-quality.unused-mock", 3, "test_{k}", "Test 'test_{k}' creates mock(s) never used afterwards: ['e']."), ("test-quality.mock-without-expectation", 3, "test_{k}", "Test 'test_{k}' has mocks with no .assert_* verification: ['b', 'c', 'd', 'e'].")), _T),
    Snippet("from unittest.mock import Mock\n\ndef test_{k}():\n    a = Mock()\n    a.go()\n    a.go.assert_called_once()\n\ndef test_real():\n    a = Mock()\n    use(a)\n    a.assert_called()\n", (("test-quality.mock-only-test", 3, "test_{k}", "Test 'test_{k}' only exercises mocks - no real code is called."),), _T),
    Snippet("class TestThing(Service):\n    def test_{k}(self):\n        assert x\n\nclass TestOther(BaseTestCase):\n    def test_b(self):\n        assert x\n", (("test-quality.extends-production-class", 1, "TestThing", "Test class 'TestThing' extends production class 'Service'."),), _T),
    Snippet("def test_{k}(rows):\n    for r in rows:\n        assert r\n    for r in rows:\n        assert r, 'message'\n", (("test-quality.loop-assertion-without-message", 3, "test_{k}", "Test 'test_{k}' has an assertion inside a loop with no message."),), _T),
    Snippet("import requests\n\ndef test_{k}():\n    assert requests.get('http://x')\n    open('x')\n\ndef test_b():\n    assert go()\n", (("test-quality.mystery-guest", 3, "test_{k}", "Test 'test_{k}' touches external state via `requests.get` - non-hermetic dependency."),), _T),
    Snippet("def test_{k}(x):\n    assert x._private\n    assert x.__class__\n\nclass TestIt:\n    def test_b(self):\n        assert self._own\n", (("test-quality.private-reflection", 2, "test_{k}", "Test 'test_{k}' reaches into private attribute '_private'."), ("test-quality.naming-consistency", 1, None, "File mixes test-naming conventions: ['TestPrefix', 'test_snake']. Pick one.")), _T),
    Snippet("import pytest\n\n@pytest.mark.skip\ndef test_{k}():\n    assert x\n\n@pytest.mark.skip(reason='slow')\ndef test_b():\n    assert x\n\n@pytest.mark.skipif(a, reason='')\ndef test_c():\n    assert x\n", (("test-quality.skipped-without-reason", 3, "test_{k}", "Test 'test_{k}' is skipped without a `reason`."), ("test-quality.skipped-without-reason", 11, "test_c", "Test 'test_c' is skipped without a `reason`.")), _T),
    Snippet("def test_{k}(x):\n    assert isinstance(x, type(x))\n    assert x.y == x.y\n    assert x == 1\n    assert x.y == x.z\n", tuple(("test-quality.tautological-type-assertion", n, "test_{k}", "Test 'test_{k}' asserts a tautological type relation - always true.") for n in (2, 3)), _T),
    Snippet("def test_{k}(x):\n" + "    x = go(x)\n" * 100 + "    assert x\n\ndef setup_function():\n" + "    x = go(1)\n" * 31, (("test-quality.test-function-too-long", 1, "test_{k}", "Test 'test_{k}' is 102 lines, above the error threshold of 100."), ("test-quality.setup-bloat", 104, "setup_function", "Setup 'setup_function' is 32 lines, above the threshold of 30.")), _T),
    Snippet("def work(x):\n" + "    x = go(x)\n" * 4 + "    return x\n\ndef test_work(x):\n" + "    x = go(x)\n" * 12 + "    assert x\n", (("test-quality.test-longer-than-sut", 8, "test_work", "Test 'test_work' is 14 lines for a 6-line SUT 'work' (ratio 2.3x)."),), _T),
    Snippet("def test_one():\n    assert x\n\ndef testTwo():\n    assert x\n", (("naming.test-naming-consistency", 1, None, "File mixes 1 snake_case test name(s) and 1 camelCase test name(s); pick one style."), ("test-quality.naming-consistency", 1, None, "File mixes test-naming conventions: ['testCamel', 'test_snake']. Pick one.")), _T),
    Snippet("import unittest\n\nclass Cases(unittest.TestCase):\n    def testThing{k}(self):\n        if x:\n            y = 1\n        self.assertEqual(x, 1)\n\n    def helper(self):\n        if x:\n            y = 1\n", (("test-quality.conditional-logic", 5, "Cases.testThing{k}", "Test 'Cases.testThing{k}' contains conditional logic - split into parametrised cases."),), _T),
    Snippet("def test_{k}():\n    assert go() == [1, 2, 3]\n    assert go() == [" + ", ".join(map(str, range(10))) + "]\n    assert go() == {" + ", ".join(f"{i}: 1" for i in range(12)) + "}\n", (("test-quality.trivial-snapshot", 3, "test_{k}", "Test 'test_{k}' asserts against a large literal - brittle snapshot."),), _T),
    Snippet("def test_{k}():\n    x = go()\n    assert x\n    y = x[0]\n    assert y\n    x = go()\n    assert x\n    x = go()\n    assert_that(x)\n\ndef test_two():\n    x = go()\n    assert x\n    x = go()\n    assert x\n", (("test-quality.multiple-aaa-cycles", 1, "test_{k}", "Test 'test_{k}' runs 3 Arrange-Act-Assert cycles."),), _T),
]

_DOC = '    """Do it.\n\n    Args:\n        a: one.\n        gone: two.\n    """\n'
_BRANCHES = "".join(f"{'    ' * (i + 1)}if x > {i}:\n" for i in range(7)) + "    " * 8 + "pass\n"

DECLARATIONS = [
    # seven nested branches: 1 + 2 + ... + 7, and seven comparisons of one name with seven numbers
    Snippet("def deep_{k}(x):\n" + _BRANCHES + "    for y in x:\n        go(y)\n    while x:\n        go(x)\n    return x if x else 1\n", (("complexity.cognitive", 1, "deep_{k}", "Function 'deep_{k}' has cognitive complexity 31, above the error threshold of 30."),)),
    # 41 additions and 42 operands of one operator and one name: 83 * log2(2)
    Snippet("def sum_{k}(a):\n    return " + " + ".join(["a"] * 202) + "\n", (("complexity.halstead-volume", 1, "sum_{k}", "Function 'sum_{k}' has Halstead volume 403, above the error threshold of 400."),)),
    Snippet("def calm_{k}(a):\n    b = a + 1\n    return b * 2\n"),
    # 171 - 5.2 ln(8) - 0.23 - 16.2 ln(403) with one sum of five tokens, two kinds: see the SQL's figure
    Snippet("def long_{k}(a):\n" + "    go(a)\n" * 801 + "    return a\n", (("complexity.maintainability-index", 1, "long_{k}", "Function 'long_{k}' has maintainability index 62.4, below the error threshold of 70."),)),
    Snippet("class Wide{k}:\n" + "".join(f"    def m{i}(self):\n" + "        go()\n" * 100 + "        go(1)\n" for i in range(3)), (("size.average-function-length", 1, "Wide{k}", "Class 'Wide{k}' averages 102.0 lines per method (over 3 methods), above the error threshold of 100."),)),
    Snippet("def f_{k}(a, b):\n" + _DOC + "    go(a, b)\n\ndef g(a, b, _c):\n    \"\"\"Do it.\"\"\"\n    go(a, b)\n\ndef _h(a):\n    \"\"\"Do it.\"\"\"\n    go(a, 1)\n", (("docs.missing-param-doc", 1, "f_{k}", "Function 'f_{k}' needs a docstring entry describing parameter 'b'."), ("docs.stale-param-doc", 1, "f_{k}", "Function 'f_{k}' docstring documents parameter 'gone', which is not in the signature."), ("docs.missing-param-doc", 10, "g", "Function 'g' needs docstring entries describing its 2 parameter(s)."), ("dead-code.unused-private-function", 14, "_h", "Private function '_h' is never called in its enclosing scope."))),
    Snippet("def f_{k}() -> int:\n    \"\"\"Do it.\"\"\"\n    raise KeyError\n\ndef g() -> None:\n    \"\"\"Do it.\n\n    Raises:\n        KeyError: never.\n    \"\"\"\n    raise KeyError\n\ndef h() -> int:\n    \"\"\"Do it.\n\n    :returns: one\n    \"\"\"\n    def inner():\n        raise KeyError\n    go(inner)\n", (("docs.missing-return-doc", 1, "f_{k}", "Function 'f_{k}' returns a non-None value and needs a Returns section in its docstring."), ("docs.missing-raises-doc", 1, "f_{k}", "Function 'f_{k}' raises exceptions and needs a Raises section in its docstring."))),
    Snippet("class Empty{k}:\n    \"\"\"Nothing.\"\"\"\n\nclass GoneError(Exception):\n    pass\n\nclass Shape(Protocol):\n    ...\n\nclass Full:\n    x = 1\n", (("waste.empty-class", 1, "Empty{k}", "Class 'Empty{k}' has an empty body."),)),
    Snippet("def wrap_{k}(a, b):\n    return go(a, b)\n\ndef swap(a, b):\n    return go(b, a)\n\n@property\ndef kept(a):\n    return go(a)\n\ndef other(a):\n    return go(a, 1)\n", (("waste.one-line-function", 1, "wrap_{k}", "Function 'wrap_{k}' is a thin wrapper that forwards its arguments to a single call with no other work."),)),
    Snippet("def f_{k}(a):\n    go(a)\n    out = a.b\n    return out\n\ndef g(a):\n    out = 1\n    go(out)\n    out = a.b\n    return out\n", (("waste.redundant-variable", 3, "f_{k}", "Function 'f_{k}': variable 'out' is assigned once and immediately returned; inline the expression."),)),
    Snippet("class Holder{k}:\n    def __init__(self):\n        self._unused = 1\n        self._used = 2\n        self._shown = 3\n        self.public = 4\n\n    @property\n    def shown(self):\n        return self._used\n", (("dead-code.unused-private-attribute", 3, "Holder{k}._unused", "Class 'Holder{k}' assigns '_unused' but never reads it."),)),
    Snippet("import sys\nsys.path.insert(0, 'x')\nsys.path.append('y')\nif __name__ == '__main__':\n    sys.path.append('z')\nelse:\n    sys.path.append('w')\n", (
        ("design.runtime-sys-path-mutation", 2, None, "`sys.path.insert(0, ...)` at runtime shadows every later top-level import for the whole process; one colliding filename in that directory breaks the host application. Imports need packaging, not path surgery."),
        *(("design.runtime-sys-path-mutation", n, None, "`sys.path.append(...)` at runtime makes imports depend on execution order; the import layout needs packaging (editable install or src layout) instead.") for n in (3, 7)),
    )),
    Snippet("import sys\nsys.path.insert(0, 'x')\n", (), "tests/conf_{k}.py"),
    Snippet("def ready_{k}() -> bool:\n    return go(1)\n\ndef is_{k}() -> bool:\n    return go(1)\n\ndef maybe() -> 'bool':\n    return go(1)\n\nclass Item(BaseModel):\n    done: bool = False\n\nclass Other:\n    done: Optional[bool] = None\n    LOUD: bool = True\n    is_on: bool = True\n", (
        ("naming.boolean-prefix", 1, "ready_{k}", "Function 'ready_{k}' returns / is bool but lacks a boolean-intent prefix (is_, has_, can_, should_, was_, did_, will_, must_, needs_)."), ("naming.boolean-prefix", 7, "maybe", "Function 'maybe' returns / is bool but lacks a boolean-intent prefix (is_, has_, can_, should_, was_, did_, will_, must_, needs_)."), ("naming.boolean-prefix", 14, "done", "Attribute 'done' returns / is bool but lacks a boolean-intent prefix (is_, has_, can_, should_, was_, did_, will_, must_, needs_)."),
    )),
    Snippet("def _alone_{k}(x):\n    return _alone_{k}(x, 1)\n\ndef _called():\n    return 1\n\nclass Box:\n    def _hidden(self):\n        return 1\n\n    def _used(self):\n        return 1\n\n    def _load_a(self):\n        return 1\n\n    def run(self, x):\n        return self._used, getattr(self, f'_load_{x}'), 2\n\n_hidden = _called\n", (
        ("dead-code.unused-private-function", 1, "_alone_{k}", "Private function '_alone_{k}' is never called in its enclosing scope."), ("dead-code.unused-private-function", 8, "Box._hidden", "Private function 'Box._hidden' is never called in its enclosing scope."),
    )),
]

_REASON = "Suppression directive '{}' is used {}."

COMMENTS = [
    Snippet("import a_{k}  # noqa\nimport b  # noqa: F401 - kept for plugin discovery\nimport c  # type: ignore[x] - because\n", (("docs.ignore-directive-reason", 1, None, _REASON.format("noqa", "without a reason")), ("docs.ignore-directive-reason", 3, None, _REASON.format("type: ignore[x]", "with a generic reason")))),
    Snippet("# lintlake: disable-file=security.xxe -- parser is sandboxed\nx = 1  # lintlake: disable=naming.short-variable, waste.unused-import\n# lintlake: disable-next=size.file-length\ny_{k} = '# lintlake: disable=not.a-comment'\n", (("docs.ignore-directive-reason", 2, None, _REASON.format("lintlake: disable=naming.short-variable, waste.unused-import", "without a reason")), ("docs.ignore-directive-reason", 3, None, _REASON.format("lintlake: disable-next=size.file-length", "without a reason")))),
    Snippet("a = 1  # lintlake: disable\nb = 2  # lintlake: enable=x.y\nc = 3  # lintlake: disable=x.y,,\nd = 4  # lintlake: disable=Bad_Id, made.up\n# plain comment {k}\n", (("docs.ignore-directive-reason", 4, None, _REASON.format("lintlake: disable=Bad_Id, made.up", "without a reason")),)),
]

#: Severity, pillar and confidence of the rules on project files.
ABOUT_PROJECT = {
    **{f"security.{r}": ("warning", "security", "high") for r in ("dependency-git-reference", "dependency-local-path", "dependency-url-reference")},
    "security.github-actions-pull-request-target": ("error", "security", "high"),
    "security.github-actions-secrets-in-pr": ("warning", "security", "medium"),
    "sensitive-data.gcp-service-account-key": ("error", "sensitive-data", "high"),
    "sensitive-data.hardcoded-env-value": ("warning", "sensitive-data", "medium"),
    "sensitive-data.url-credentials": ("error", "sensitive-data", "high"),
}
_URL = " is installed from a direct artifact URL. Registry packages with exact versions are easier to review and reproduce."

PROJECT = [
    Snippet("name: ci {k}\non:\n  pull_request_target:\njobs:\n  x: ${{ github.event.pull_request.head.sha }}\n", (("security.github-actions-pull-request-target", 3, None, "`pull_request_target` workflow checks out the PR head ref - it runs untrusted fork code with a write token and repository secrets in scope."),), ".github/workflows/ci_{k}.yml"),
    Snippet("on:\n  pull_request_target:\n", (), ".github/workflows/safe_{k}.yml"),
    Snippet("on: [pull_request]\nenv:\n  A: ${{ secrets.DEPLOY_KEY }}\n  B: ${{ secrets.GITHUB_TOKEN }}\n", (("security.github-actions-secrets-in-pr", 3, None, "Repository secret `DEPLOY_KEY` is used in a workflow that pull requests trigger."),), ".github/workflows/pr_{k}.yaml"),
    Snippet("-r base.txt\n# note\nrequests==1.0\nFoo_Bar{k} @ git+https://x/y\n-e ./local\nhttps://x/y.whl\nbar @ https://x/z.whl  # why\n", (
        ("security.dependency-git-reference", 4, None, "Dependency `foo-bar{k}` is installed from a Git reference. VCS dependencies bypass normal package release review and are easy to move accidentally."),
        ("security.dependency-local-path", 5, None, "Dependency declaration is installed from a local path. Local references depend on checkout layout and can hide code outside the reviewed package boundary."),
        ("security.dependency-url-reference", 6, None, "Dependency declaration" + _URL),
        ("security.dependency-url-reference", 7, None, "Dependency `bar`" + _URL),
    ), "deps/{k}/requirements-dev.txt"),
    Snippet('{\n"type": "service_account",\n"private_key": "' + "A" * 120 + '"}', (("sensitive-data.gcp-service-account-key", 2, None, "GCP service-account key JSON embeds private-key material."),), "keys/{k}.json"),
    Snippet('{"type": "service_account", "private_key": "short"}', (), "keys/fake_{k}.json"),
    Snippet("API_KEY=abcdefghijklmnop1234\nOTHER=abcdefghijklmnop1234\nAPP_TOKEN=changeme\nDB_PASSWORD=$PASS_FROM_SOMEWHERE\nMY_SECRET=aaaaaaaaaaaaaaaa\n", (("sensitive-data.hardcoded-env-value", 1, None, "`.env` value for `API_KEY` looks like a hard-coded secret."),), "env/{k}/.env.local"),
    Snippet("see https://bob:hunter22@host.example/x\nand https://bob:password@host and https://bob:$PASS@host\n", (("sensitive-data.url-credentials", 1, None, "URL with embedded credentials: hunt...er22 (redacted, 8 chars)"),), "docs/{k}.md"),
]

#: Modules for a whole analysis: what a suppression names is gone, and so is what the baseline knows.
ANALYSED = [
    Snippet("import random\nsession_id = random.randint(1, 9)\n", (("security.insecure-random", 2, None, "`random.randint` used for a security-smelling value - `random` is not cryptographically secure."),)),
    Snippet("import random\nsession_id = random.randint(1, 9)  # lintlake: disable=security.insecure-random -- ids of a game\n"),
    Snippet("# lintlake: disable-file=security.insecure-random -- ids of a game\nimport random\nsession_id = random.randint(1, 9)\n"),
    Snippet("import random\n# lintlake: disable-next=security.xxe -- names another rule\nsession_id = random.randint(1, 9)\n", (("security.insecure-random", 3, None, "`random.randint` used for a security-smelling value - `random` is not cryptographically secure."),)),
    Snippet("class Empty{k}:\n    pass\n"),  # known to the baseline
    Snippet("class Empty:\n    pass\n", (("waste.empty-class", 1, "Empty", "Class 'Empty' has an empty body."),)),
]
