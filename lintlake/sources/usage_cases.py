"""Planted cases of the rules on declarations, names and whole texts."""

from __future__ import annotations

from lintlake.sources.projects import Case, one

_PARAM, _SHELL, _EXPORT, _EMPTY = "waste.unused-parameter", "security.shell-injection", "dead-code.exported-but-unreferenced", "waste.empty-function"
_MODULE, _CLASS, _FUNCTION = (f"docs.missing-{k}-docstring" for k in ("module", "class", "function"))
_ATTRIBUTES, _METHODS, _LENGTH = "size.attribute-count", "size.public-method-count", "size.class-length"

#: A head and a use that keep the other rules of this table quiet.
_DOC = '"""Doc."""\n'


def _param(line: int, name: str, symbol: str) -> tuple[int, str, str]:
    return (_PARAM, line, symbol, f"Parameter '{name}' in '{symbol}' is never referenced.")


def _export(line: int, name: str, kind: str = "function") -> tuple[str, int, str, str]:
    return (_EXPORT, line, name, f"Public {kind} '{name}' has no reference beyond its definition, __all__ membership, and re-export imports in this full-project scan; it needs a caller, an entry-point registration, or removal.")


def _doc(line: int, symbol: str, kind: str = "Function") -> tuple[str, int, str, str]:
    return ({"Function": _FUNCTION, "Class": _CLASS}[kind], line, symbol, f"{kind} '{symbol}' needs a brief intent description in its docstring.")


def _empty(line: int, symbol: str) -> tuple[str, int, str, str]:
    return (_EMPTY, line, symbol, f"Function '{symbol}' has an empty body.")


def _shell(line: int, label: str) -> tuple[str, int, None, str]:
    return (_SHELL, line, None, f"`{label}` runs a non-literal command through a shell.")


_NO_MODULE = (_MODULE, 1, None, "Module needs a top-of-file docstring describing its purpose.")
_FIELDS = "".join(f"    f{i} = {i}\n" for i in range(9))
_SELF = "".join(f"        self.s{i} = {i}\n" for i in range(7))
_WIDE = "".join(f"    def m{i}(self):\n        '''d'''\n        return self\n" for i in range(11))

USAGE = [
    # reads count at any depth; leading self, underscores, frameworks and prescribed signatures don't
    one(_DOC + "def _f(a, b, c, *, d, _e, **g):\n    '''d'''\n    b = 1\n    def _g():\n        def _h():\n            def _i():\n                return lambda: c\n            return _i\n        return _h\n    return _g\ndef _k(self, cls, x=y):\n    return cls.x\n_f(_k(1), 2, 3)\n", _param(2, "a", "_f"), _param(2, "d", "_f"), _param(12, "x", "_k")),
    one(_DOC + "class _C(Base):\n    '''d'''\n    def _m(self, a):\n        return 1\n    @abstractmethod\n    def _n(self, a):\n        return 1\n    @app.route('/')\n    def _o(self, a):\n        return 1\n    @overload\n    def _p(self, a): ...\n    @other\n    def _q(cls, b, self):\n        return 1\nclass _D(BaseHTTPRequestHandler):\n    '''d'''\n    def _m(self, a):\n        return 1\nclass _E(typing.Protocol[T]):\n    '''d'''\n    def _m(self, a): ...\n_C(_D, _E)\n", _param(4, "a", "_C._m"), _param(15, "b", "_C._q"), _param(15, "self", "_C._q")),
    # shells
    one(_DOC + "subprocess.run('ls', shell=True)\nsubprocess.run(command, shell=True)\nsubprocess.run(command)\nsubprocess.run(shell=True)\nsubprocess.run(command, shell=flag)\nsubprocess.list2cmdline(command, shell=True)\nsubprocess.getoutput(f'ls {x}', shell=True)\nos.system('ls')\nos.system(command)\nos.popen(['ls'])\nos.system()\n", _shell(3, "subprocess.run(..., shell=True)"), _shell(8, "subprocess.getoutput(..., shell=True)"), _shell(10, "os.system(...)"), _shell(11, "os.popen(...)")),
    # exports, over the files of a project
    Case(
        {
            "src/a.py": _DOC + "".join(f"def {n}():\n    '''d'''\n    return 1\n" for n in ("unused", "called", "plainly_imported", "renamed", "by_attribute", "by_name", "_private", "noted", "listed")) + "@app.command()\ndef registered():\n    '''d'''\n    return 1\nclass Lone:\n    '''d'''\n__all__ = ['listed']\n",
            "src/b.py": _DOC + "from src.a import plainly_imported, unused\nfrom src.a import renamed as _r\nimport src.a\ncalled()\nsrc.a.by_attribute()\ngetattr(src.a, 'by_name')\nx: 'dict[str, a.noted]' = unused_elsewhere\nunused = 1\n",
            "tests/test_a.py": _DOC + "def test_it():\n    '''d'''\n    return 1\n",
            "src/c_test.py": _DOC + "def helper():\n    '''d'''\n    return 1\n",
        },
        tuple(("src/a.py", *_export(line, name, kind)) for line, name, kind in ((2, "unused", "function"), (8, "plainly_imported", "function"), (26, "listed", "function"), (33, "Lone", "class"))),
    ),
    # docstrings
    one("import x\n", _NO_MODULE),
    Case({"src/__init__.py": "import x\n__all__: list = ['x']\n", "app/__init__.py": "import x\ny = 1\n", "tests/x.py": "y = 1\n", "test_x.py": "y = 1\n", "app/test_x.py": "y = 1\n", "app/empty.py": ""}, (("app/__init__.py", *_NO_MODULE), ("app/test_x.py", *_NO_MODULE))),
    one(_DOC + "class A:\n    x = 1\nclass B(Enum):\n    X = 1\n@dataclasses.dataclass\nclass C:\n    x: int\nclass __D__:\n    x = 1\n@other\nclass _E(pydantic.BaseModel, F):\n    x: int\nclass _G(Model):\n    x: int\nA(B, C)\n", _doc(2, "A", "Class"), _doc(14, "_G", "Class")),
    one(_DOC + "class A:\n    '''d'''\n    def m(self):\n        return 1\n    def _p(self):\n        return 1\n    def __init__(self):\n        return 1\n    @m.setter\n    def n(self):\n        return 1\n    @abstractmethod\n    def o(self):\n        return 1\n    @setter\n    def q(self):\n        return 1\nclass B(Protocol):\n    '''d'''\n    def m(self): ...\n    def n(self):\n        return 1\ndef test_f():\n    def once():\n        return once\n    def twice():\n        return 1\n    twice()\n    return twice, once\nA(B(test_f))\n", _doc(4, "A.m"), _doc(17, "A.q"), _doc(22, "B.n"), _doc(24, "test_f"), _doc(27, "test_f.twice")),
    one(_DOC + "def test_f():\n    return 1\ndef helper():\n    return 1\n", _doc(4, "helper"), path="tests/test_f.py"),
    # empty bodies
    one(_DOC + "def _a():\n    pass\ndef _b():\n    '''d'''\n    ...\ndef _c():\n    '''d'''\n    return\n@cache\ndef _d():\n    pass\n@other\ndef _e():\n    pass\nclass _P(Protocol):\n    '''d'''\n    def _m(self): ...\nclass _Fake:\n    '''d'''\n    def _m(self): ...\n", _empty(2, "_a"), _empty(4, "_b"), _empty(14, "_e"), _empty(21, "_Fake._m")),
    one(_DOC + "class FakeClient:\n    '''d'''\n    def _m(self): ...\nclass Client:\n    '''d'''\n    def _m(self): ...\n", _empty(7, "Client._m"), path="app/test_it.py"),
    # width and length
    one(_DOC + f"class _A:\n    '''d'''\n{_FIELDS}    def __init__(self):\n        if self:\n    {_SELF.replace(chr(10), chr(10) + '    ').rstrip(' ')}        (self.t, [self.u]) = 1, [2]\n        self.f1 = other.v = 2\nclass _B(_A):\n    '''d'''\n{_FIELDS}    def __init__(self):\n        self.x: int = 1\nclass TestC:\n    '''d'''\n{_FIELDS}    def __init__(self):\n{_SELF}\n_A(_B(TestC))\n", (_ATTRIBUTES, 2, "_A", "Class '_A' declares 18 attributes, above the error threshold of 15.")),
    one(_DOC + f"class _A:\n    '''d'''\n{_WIDE}class _B(Enum):\n    '''d'''\n{_WIDE}@attrs.define\nclass _C:\n    '''d'''\n{_WIDE}class _D(unittest.TestCase):\n    '''d'''\n{_WIDE}_A(_B(_C(_D)))\n", (_METHODS, 2, "_A", "Class '_A' has 11 public methods, above the error threshold of 10.")),
    one(_DOC + "@other\nclass _A:\n    '''d'''\n" + "    # line\n" * 1000 + "    x = 1\nclass _B:\n    '''d'''\n" + "    # line\n" * 997 + "    x = 1\n_A(_B)\n", (_LENGTH, 2, "_A", "Class '_A' is 1004 lines, above the error threshold of 1000.")),
]

#: Severity, pillar and confidence of each rule.
ABOUT_USAGE = {
    _PARAM: ("advisory", "dead-code", "medium"), _SHELL: ("error", "security", "high"), _EXPORT: ("advisory", "dead-code", "medium"), _EMPTY: ("warning", "dead-code", "high"), _MODULE: ("advisory", "documentation", "medium"),
    _CLASS: ("warning", "documentation", "high"), _FUNCTION: ("warning", "documentation", "high"), _ATTRIBUTES: ("error", "size", "high"), _METHODS: ("error", "size", "high"), _LENGTH: ("error", "size", "high"),
}


def _at(rule: str, *lines: int) -> tuple[tuple[str, int, None, str], ...]:
    return tuple((rule, n, None, "") for n in lines)


_BODY = "MIIB" + "AbCd0123" * 15
_KEY, _PHI, _FLOW = "sensitive-data.private-key", "sensitive-data.phi-pattern", "security.github-actions-"
_YAML = ".github/workflows/ci.yml"

TEXTS = [
    one(f"first\n-----BEGIN RSA PRIVATE KEY-----\n{_BODY}\n-----END RSA PRIVATE KEY-----\n", *_at(_KEY, 2), path="keys/a.pem"),
    one("x\n-----BEGIN PRIVATE KEY-----\nplaceholder\nnot a key\n-----END PRIVATE KEY-----\n", path="keys/a.pem"),
    one(f"-----BEGIN PRIVATE KEY-----\nshort\n-----END PRIVATE KEY-----\n\n-----BEGIN EC PRIVATE KEY-----\n{_BODY[:60]}\n{_BODY[60:]}\n-----END EC PRIVATE KEY-----\n-----BEGIN OPENSSH PRIVATE KEY-----\nno end\n", *_at(_KEY, 5, 9), path="keys/a.pem"),
    one("MRN: 1234567\nMRN:\n  7654321\nMRN 123\nssn 219-09-9999\nssn 123-45-6789\n", *_at(_PHI, 1, 2, 5), path="notes/a.txt"),
    one("permissions: write-all\njobs:\n  a:\n    permissions: write-all\n    steps:\n      - uses: actions/checkout@v4\n      - uses: someone/thing@v1\n      - uses: someone/thing@0123456789abcdef0123456789abcdef01234567\n      - uses: ./local\n      - run: curl https://x | sudo bash\n      - run: curl https://x > y\n", *_at(_FLOW + "broad-permissions", 1, 4), *_at(_FLOW + "unpinned-action", 7), *_at(_FLOW + "remote-shell", 10), path=_YAML),
    one("permissions: write-all\n- run: wget x | sh\n", path="ci/ci.yml"),
]
ABOUT_TEXTS = {_KEY: ("error", "sensitive-data", "high"), _PHI: ("error", "sensitive-data", "medium"), **{_FLOW + k: ("warning", "security", "high") for k in ("broad-permissions", "unpinned-action", "remote-shell")}}


def _named(rule: str, *found: tuple[int, str]) -> tuple[tuple[str, int, str, str], ...]:
    return tuple((f"naming.{rule}", n, name, "") for n, name in found)


NAMES = [
    one("str_name = 1\nint_count = lst_x = 2\nname_str = 3\nstrange_name = 4\n", *_named("hungarian-notation", (1, "str_name"), (2, "int_count"), (2, "lst_x"))),
    one("foo = 1\ntemp_file = 2\ndata2 = 3\nresult_1 = 4\ndata = 5\ntodo = 6\nfood = 7\n", *_named("identifier-quality", (1, "foo"), (2, "temp_file"), (3, "data2"), (4, "result_1"), (6, "todo"))),
    one("def process():\n    pass\ndef process_order():\n    pass\nclass Job:\n    def run(self):\n        pass\n", *_named("generic-function", (1, "process"), (6, "Job.run"))),
]
ABOUT_NAMES = {"naming.hungarian-notation": ("warning", "naming", "high"), "naming.identifier-quality": ("warning", "naming", "high"), "naming.generic-function": ("advisory", "naming", "medium")}
