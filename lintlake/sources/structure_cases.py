"""Planted cases of the rules on the shape of code."""

from __future__ import annotations

from lintlake.sources.projects import Case, one

_LOOP = "test-quality.loop-in-test"
_RESTATED = "test-quality.static-analysis-redundant-test"
_WORDS = "correctness.substring-vocabulary-match"
_REPEATED, _SINGLE, _NUMBER, _COMMENT = "test-quality.repeated-structure-missing-parametrize", "design.single-implementor-protocol", "correctness.unsafe-numeric-coercion", "waste.commented-out-code"


def _tests(source: str, *found: tuple[int, str, int]) -> Case:
    return one(source, *((_REPEATED, line, name, f"Test '{name}' shares a body shape with {others} other test(s) - candidate for @pytest.mark.parametrize.") for line, name, others in found), path="tests/test_main.py")


def _graph(files: dict[str, str], *found: tuple[str, int, str, str]) -> Case:
    return Case(files, tuple((path, _SINGLE, line, fqn, f"Protocol/ABC {fqn} has one implementor ({other}) and no external type-hint usage; consider depending on the class directly.") for path, line, fqn, other in found))


def _digits(source: str, *found: tuple[int, str, str]) -> Case:
    return one(source, *((_NUMBER, line, None, f'`int({name})` is guarded by `{name}.{guard}()`, which accepts characters int() rejects (e.g. "²") and still crashes; the conversion needs a try/except ValueError instead.') for line, name, guard in found))


def _floats(source: str, *found: tuple[int, str]) -> Case:
    return one(source, *((_NUMBER, line, None, f'`int({name})` converts a float from a dynamic source without a math.isfinite() gate; int(float("nan")) raises ValueError and int(float("inf")) raises OverflowError.') for line, name in found))


def _comments(source: str, *lines: int) -> Case:
    return one(source, *((_COMMENT, n, None, f"Commented-out code on line {n}.") for n in lines))


def _words(source: str, *found: tuple[int, str, str]) -> Case:
    return one(source, *((_WORDS, line, None, f'Substring scan of `{v}` over `{t}` matches inside words ("fee" routes "coffee", "form" routes "information"); the comparison needs word-boundary or token matching.') for line, v, t in found))


def _loops(source: str, *found: tuple[int, str]) -> Case:
    return one(source, *((_LOOP, line, test, f"Test '{test}' contains a loop - prefer `@pytest.mark.parametrize` for case enumeration.") for line, test in found), path="tests/test_main.py")


def _restated(source: str, *found: tuple[int, str, str, str, str]) -> Case:
    return one(source, *((_RESTATED, line, test, f"{test} contains a static-analysis-redundant candidate: {helper} asserts {evidence}, but {fact} is declared in the same parsed file.") for line, test, helper, evidence, fact in found), path="tests/test_main.py")


_SHAPE = "class Shape:\n    label = 'x'\n    code: int = 1\n    slug: str\n    _secret = 1\n    def render(self):\n        return self\n    @property\n    def size(self):\n        return 1\n    class Part:\n        def cut(self):\n            return 1\n"
_V = "WORDS = ('fee', 'form')\nMORE = frozenset({'a', 'b c'})\nPHRASES = ['a b', 'c d']\nMIXED = ['a', 1]\nNONE = ()\n"
_T = "from typing import Protocol\nclass Renderer(Protocol):\n    def render(self): ...\n"
_IMPL = "class Html(Renderer):\n    pass\n"
_HTML = ("src/api.py", 2, "src.api.Renderer", "src.api.Html")

STRUCTURE = [
    _tests("def test_a():\n    assert classify('a') == 'x'\n\ndef test_b():\n    assert classify('b') == 'y'\n\nasync def test_no():\n    assert classify('b') == 'y'\n\ndef test_c():\n    assert classify('c') == 'z'\n\ndef test_d():\n    assert classify('c') == 1\n\ndef test_e():\n    assert other('c') == 'z'\n\ndef helper():\n    assert classify('c') == 'z'\n", (1, "test_a", 2), (4, "test_b", 2), (10, "test_c", 2)),
    _tests("def test_a():\n    assert f(x) == 1\n\ndef test_b():\n    assert f(x) == 2\n", *()),
    _tests("@mark('x')\ndef test_a():\n    f(1)\n\n@plain\ndef test_b():\n    f(1)\n\n@plain\ndef test_c():\n    f(2)\n\n@plain\ndef test_d():\n    f(3)\n", (6, "test_b", 2), (10, "test_c", 2), (14, "test_d", 2)),
    _tests("def test_a():\n    s = '''a\nb'''\n    f(s)\n\ndef test_b():\n    s = '''a\nc'''\n    f(s)\n\ndef test_c():\n    s = '''a\nd'''\n    f(s)\n", *()),
    _tests("def test_a():\n    assert x.a + 1 > 2\n\ndef test_b():\n    assert x.a - 1 > 2\n\ndef test_c():\n    assert x.a + 1 < 2\n\ndef test_d():\n    assert x.b + 1 > 2\n", *()),
    _tests("class TestIt:\n    def test_a(self):\n        self.x = f(1)\n\n    def test_b(self, y):\n        self.x = f(2)\n\n    def test_c(self):\n        self.x = f(3)\n\n    def test_d(me):\n        self.x = f(4)\n", (2, "TestIt.test_a", 2), (8, "TestIt.test_c", 2), (11, "TestIt.test_d", 2)),
    # abstractions: over files of a project
    _graph({"src/contracts.py": _T, "src/html.py": "from .contracts import Renderer\nclass HtmlRenderer(Renderer):\n    pass\nREGISTRY = {'html': HtmlRenderer}\n", "tests/test_x.py": "from src import contracts\ncontracts.Renderer = Fake\n"}, ("src/contracts.py", 2, "src.contracts.Renderer", "src.html.HtmlRenderer")),
    _graph({"src/contracts.py": _T, "src/a.py": _IMPL, "src/b.py": "class Text(contracts.Renderer):\n    pass\n"}),
    _graph({"src/api.py": _T + _IMPL, "src/use.py": "def show(r: list[Renderer | None]) -> None:\n    pass\n"}),
    _graph({"src/api.py": _T + _IMPL, "src/use.py": "def show(r: 'Renderer'):\n    pass\n"}),
    _graph({"src/api.py": _T + _IMPL, "src/use.py": "x: api.Renderer = 1\n"}),
    _graph({"src/api.py": _T + _IMPL, "src/use.py": "def f(v):\n    return isinstance(v, (Renderer, str))\n"}),
    _graph({"src/api.py": _T + _IMPL, "src/use.py": "api.Renderer.register(int)\n"}),
    _graph({"src/api.py": _T + _IMPL, "src/use.py": "@Renderer\ndef f(a: Annotated[str, use(Renderer)]): pass\nRenderer: int\ny = 'Renderer'\n"}, _HTML),
    _graph({"src/api.py": _T + "class Html(Renderer):\n    def make(self, other: Renderer) -> Renderer:\n        return Renderer\n"}, _HTML),
    _graph({"src/api.py": _T + "class Wider(Renderer, Protocol):\n    pass\nclass Html(Wider):\n    pass\n"}, ("src/api.py", 4, "src.api.Wider", "src.api.Html")),
    _graph({"src/api.py": "import abc\nclass Base(abc.ABC):\n    class Inner(Protocol[T]): ...\nclass Many(Iterable, Protocol): ...\nclass One(Base, Many): ...\nclass Two(Base.Inner): ...\ndef f():\n    class Three(Base): ...\nif x:\n    class Four(Base): ...\n"}, ("src/api.py", 2, "src.api.Base", "src.api.One"), ("src/api.py", 3, "src.api.Base.Inner", "src.api.Two")),
    _graph({"src/__init__.py": _T, "src/html.py": _IMPL}, ("src/__init__.py", 2, "src.Renderer", "src.html.Html")),
    # numbers
    _digits("def parse(raw, other):\n    if raw.isnumeric():\n        return int(raw)\n    a = int(raw) if raw.isdigit() else 0\n    b = int(other) if raw.isdigit() else int(raw)\n    if raw.isdigit() and raw.isascii():\n        int(raw)\n    if x and not raw.isdigit():\n        int(raw)\n        int(raw, 10)\n        int(raw, base=2)\n        int(raw.strip())\n        def inner():\n            int(raw)\n        lambda: int(raw)\n    else:\n        int(raw)\n", (3, "raw", "isnumeric"), (4, "raw", "isdigit"), (9, "raw", "isdigit")),
    _digits("def parse(raw):\n    if not raw.isdigit():\n        raise ValueError\n    int(raw)\n    for x in y:\n        int(raw)\n    if not raw.isnumeric():\n        log()\n        return\n    print(int(raw))\n    raw = raw.strip()\n    int(raw)\n    if not raw.isdigit():\n        return\n    else:\n        pass\n    int(raw)\n    if not (raw.isdigit() and raw.isascii()):\n        return\n    int(raw)\n    if raw.isdigit():\n        return\n    int(raw)\n", (4, "raw", "isdigit"), (6, "raw", "isdigit"), (10, "raw", "isnumeric")),
    _digits("def parse(raw):\n    if not raw.isdigit():\n        raise ValueError\n    if raw.isdigit():\n        value = int(raw)\n", (5, "raw", "isdigit")),
    _digits("def parse(raw):\n    try:\n        if raw.isnumeric():\n            return int(raw)\n    except ValueError:\n        int(raw) if raw.isdigit() else 0\n    if raw.isdigit():\n        try:\n            int(raw)\n        except OverflowError:\n            pass\n        try:\n            int(raw)\n        except:\n            pass\n        try:\n            int(raw)\n        except (KeyError, builtins.Exception):\n            pass\n        try:\n            pass\n        except Exception:\n            pass\n        else:\n            int(raw)\n        finally:\n            int(raw)\n", (6, "raw", "isdigit"), (9, "raw", "isdigit"), (25, "raw", "isdigit"), (27, "raw", "isdigit")),
    _digits("def int(value):\n    return 0\n\ndef parse(raw):\n    if raw.isnumeric():\n        return int(raw)\n"),
    _digits("from x import y as int\nif raw.isnumeric():\n    int(raw)\n"),
    _digits("class C:\n    int = 1\n    if raw.isnumeric():\n        int(raw)\n", (4, "raw", "isnumeric")),
    _floats("def coerce(value, other: Any):\n    number = float(value)\n    int(number)\n    if math.isfinite(other):\n        pass\n    int(value)\n    a = b = float(value)\n    int(a)\n    c = float('1.5')\n    int(c)\n    d = float(other)\n    int(d)\n    e = float(value + 1)\n    if isfinite(e):\n        int(e)\n", (3, "number")),
    _floats("def coerce(value: str):\n    number = float(value)\n    int(number)\ndef none():\n    number = float(x)\n    int(number)\ndef method(self, value: typing.Any, *args: int, **kw: int):\n    number = float(value)\n    int(number)\nnumber = float(x)\nint(number)\n", (9, "number")),
    _floats("def outer(x):\n    def inner(y):\n        number = float(y)\n        return int(number)\n    return inner(x)\n", (4, "number")),
    _floats("def f(v):\n    n = float(v)\n    try:\n        int(n)\n    except ValueError:\n        pass\n    try:\n        int(n)\n    except (ValueError, ArithmeticError):\n        pass\n    try:\n        int(n)\n    except ValueError:\n        pass\n    except OverflowError:\n        pass\n", (4, "n")),
    # vocabularies
    _words(_V + "def f(message, kind, raw_text: str, body: list[str], title: Optional[List[str]], query: 'str | list'):\n    any(w in message for w in WORDS)\n    any(w in kind for w in WORDS)\n    any(w in raw_text for w in MORE)\n    any(w in body for w in WORDS)\n    any(w in title for w in WORDS)\n    any(w in query for w in WORDS)\n    any(w in message for w in PHRASES)\n    any(w in message for w in MIXED)\n    any(w in message for w in NONE)\n    any(w in message for w in OTHER)\n    all(w in message for w in WORDS)\n    any(w not in message for w in WORDS)\n    any(v in message for w in WORDS)\n    any(w in message for w in WORDS for x in y)\n    any([w in message for w in WORDS])\n    any(w in message.lower() for w in WORDS)\n", (7, "WORDS", "message"), (9, "MORE", "raw_text"), (12, "WORDS", "query")),
    _words(_V + "def f(message: str, x):\n    low = message.strip().lower()\n    for w in WORDS:\n        log(w)\n        if w in low:\n            return w\n        if w in message:\n            return w\n    words = message.split()\n    any(w in words for w in WORDS)\n    two = message\n    two = message.upper()\n    any(w in two for w in WORDS)\n    text = x\n    any(w in text for w in WORDS)\n    part = message.strip('x')\n    any(w in part for w in WORDS)\n    def g():\n        any(w in message for w in WORDS)\n    async for w in WORDS:\n        if w in message:\n            pass\n", (10, "WORDS", "low"), (20, "WORDS", "text")),
    _words(_V + "WORDS = make()\nWORDS = list(['x y'])\nWORDS = ['z']\ndef f(text, prompt, content: dict | None, input: typing.Sequence):\n    text = text.lower()\n    text = text.strip()\n    any(w in text for w in WORDS)\n    prompt = prompt.split()\n    any(w in prompt for w in WORDS)\n    any(w in content for w in WORDS)\n    any(w in input for w in WORDS)\nany(w in text for w in WORDS)\n", (12, "WORDS", "text")),
    # loops
    _loops("SAMPLES = [1]\nOTHER = [1]\ndef test_a():\n    for x in y:\n        f(x)\n    for z in y:\n        f(z)\ndef test_b():\n    for x in SAMPLES:\n        f(x)\n    for sample in [1, 2]:\n        assert f(sample), 'said'\n    for n, (path, q) in {1: 2}:\n        pass\ndef test_c():\n    for x in OTHER:\n        f(x)\ndef test_d():\n    for x in [1, 2]:\n        f(x)\ndef test_e():\n    while x:\n        f(x)\ndef test_f():\n    for x in SAMPLES:\n        assert x\ndef test_g():\n    for x in SAMPLES:\n        if x:\n            f(x)\ndef helper():\n    for x in y:\n        f(x)\n", (4, "test_a"), (13, "test_b"), (16, "test_c"), (19, "test_d"), (22, "test_e"), (25, "test_f"), (28, "test_g")),
    _loops("def test_a():\n    for x in sorted(list(root.glob('*'))):\n        f(x)\n    for x in Path('x').glob('*'):\n        f(x)\n    for x in a().b.rglob('*'):\n        f(x)\n    for x in tuple(FILES):\n        f(x)\n    for x in a().rglob('*'):\n        f(x)\nFILES: list = [1]\ndef test_b():\n    cases, fixtures = [1], [2]\n    paths = paths2 = (1,)\n    for x in paths2:\n        f(x)\n    def inner():\n        for x in y:\n            f(x)\n    async def more():\n        async for x in y:\n            f(x)\n    for x in sorted():\n        f(x)\nclass TestIt:\n    def test_c(self):\n        for x in [y for y in z]:\n            f(x)\n", (10, "test_a"), (24, "test_b"), (28, "TestIt.test_c")),
    # assertions that restate declarations
    _restated(
        _SHAPE + "def test_it():\n    assert inspect.isclass(Shape)\n    assert hasattr(Shape, 'render')\n    assert hasattr(Shape, 'label')\n    assert hasattr(Shape, 'code')\n    assert callable(getattr(Shape, 'render'))\n    assert callable(Shape.render)\n    assert inspect.isclass(Shape.Part)\n    assert callable(Shape.Part.cut)\n    assert hasattr(Shape, 'slug')\n    assert hasattr(Shape, '_secret')\n    assert hasattr(Shape, 'size')\n    assert hasattr(Shape, 'missing')\n    assert hasattr(Shape, name)\n    assert hasattr(shape, 'render')\n    assert callable(Shape.label)\n    assert not hasattr(Shape, 'render')\n    assert Shape().render() == 1\n    assert hasattr(Shape, 'render') and 1\n    assert hasattr(Other, 'render')\n    assert callable(getattr(Shape, 'render', None))\nclass TestIt(unittest.TestCase):\n    def test_a(self):\n        self.assertTrue(hasattr(Shape, 'label'))\n        self.assertFalse(hasattr(Shape, 'label'))\n        self.assertTrue(x, hasattr(Shape, 'label'))\ndef helper():\n    assert hasattr(Shape, 'label')\n",
        (15, "test_it", "inspect.isclass", "Shape", "class Shape"), (16, "test_it", "hasattr", "Shape.render", "method Shape.render()"), (17, "test_it", "hasattr", "Shape.label", "attribute Shape.label"), (18, "test_it", "hasattr", "Shape.code", "attribute Shape.code"), (19, "test_it", "callable", "Shape.render", "method Shape.render()"),
        (20, "test_it", "callable", "Shape.render", "method Shape.render()"), (21, "test_it", "inspect.isclass", "Shape.Part", "class Shape.Part"), (22, "test_it", "callable", "Shape.Part.cut", "method Shape.Part.cut()"), (37, "TestIt.test_a", "hasattr", "Shape.label", "attribute Shape.label"),
    ),
    _restated("class A:\n    x = 1\nclass B:\n    x = 1\nclass C:\n    x = 1\nclass D:\n    x = 1\n@deco\nclass E:\n    x = 1\nclass F(metaclass=M):\n    x = 1\nif y:\n    class G:\n        x = 1\nclass H:\n    x = 1\n    y = 1\nA = other\ndef B():\n    return 1\nif z:\n    import C\ndel D\nH.x = 2\nmatch y:\n    case I:\n        pass\nclass I:\n    x = 1\ndef test_it():\n    assert hasattr(A, 'x')\n    assert hasattr(B, 'x')\n    assert hasattr(C, 'x')\n    assert hasattr(D, 'x')\n    assert hasattr(E, 'x')\n    assert hasattr(F, 'x')\n    assert hasattr(G, 'x')\n    assert hasattr(H, 'x')\n    assert hasattr(H, 'y')\n    assert hasattr(I, 'x')\n", (41, "test_it", "hasattr", "H.y", "attribute H.y")),
    _restated("class A:\n    x = 1\n    x = 2\n    def y(self):\n        return 1\n    y = 1\n    if z:\n        w = 1\n    w = 2\n    v = 1\n    for v in z:\n        pass\n    import u\n    t = 1\n    del t\n    class P:\n        q = 1\n        r = 1\n    P.q = 2\n    class R:\n        s = 1\n    R = 1\ndef test_it(hasattr_=1):\n    assert hasattr(A, 'x')\n    assert hasattr(A, 'y')\n    assert hasattr(A, 'w')\n    assert hasattr(A, 'v')\n    assert hasattr(A, 'u')\n    assert hasattr(A, 't')\n    assert hasattr(A.P, 'q')\n    assert hasattr(A.P, 'r')\n    assert hasattr(A.R, 's')\ndef test_own(A):\n    assert hasattr(A, 'x')\ndef test_stored():\n    A.x = 1\n    assert hasattr(A, 'x')\ndef test_helper():\n    hasattr = None\n    assert hasattr(A, 'x')\ndef test_inner():\n    def f():\n        assert hasattr(A, 'x')\n    class K:\n        assert hasattr(A, 'x')\n", (24, "test_it", "hasattr", "A.x", "attribute A.x"), (31, "test_it", "hasattr", "A.P.r", "attribute A.P.r"), (45, "test_inner", "hasattr", "A.x", "attribute A.x")),
    _restated("from x import *\nclass A:\n    x = 1\ndef test_it():\n    assert hasattr(A, 'x')\n"),
    # comments
    _comments("# x = 1\n# x += call(y)\n# call(x)\n# call()\n# return x\n# if x:\n# for x in y:\n# import os\n# from x import y\n# from here on it is prose\n# x is the same as y\n# TODO x = 1\n# type: ignore\n# noqa\n#! /bin/sh\n#!/bin/sh\n# pass\n#    indented = 1\n# continue\n# if it rains\n# else:\n# try:\n# with x as y:\n# coding: x\ny = '''\n# x = 1\n'''  # z = 2\n# x == 1\n", 1, 2, 3, 4, 5, 6, 7, 8, 9, 17, 18, 19, 23, 27, 28),
    _comments("def broken(:\n    # x = 1\n    pass\n", 2),
]

#: Severity, pillar and confidence of each rule.
ABOUT_STRUCTURE = {_REPEATED: ("advisory", "test-quality", "medium"), _SINGLE: ("advisory", "design", "medium"), _NUMBER: ("advisory", "correctness", "high"), _COMMENT: ("advisory", "dead-code", "low"), _WORDS: ("advisory", "correctness", "medium"), _RESTATED: ("advisory", "test-quality", "high"), _LOOP: ("advisory", "test-quality", "medium")}
