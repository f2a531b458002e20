"""Planted cases of the rules on the flow of values."""

from __future__ import annotations

from lintlake.sources.projects import Case, one

_PATH = "reads/writes a user-controlled path - path traversal risk."
_URL = "receives a user-controlled URL - SSRF risk via internal services, cloud metadata, or other reachable targets."
_SQL = "receives a dynamic SQL string - use parameterised arguments."
_SHAPE = "receives dynamic SQL structure - validate SQL fragments."
_QUOTED = "manually quotes a SQL placeholder while passing parameters - leave placeholders unquoted."


def _traversal(source: str, *found: tuple[int, str]) -> Case:
    return one(source, *(("security.path-traversal", line, None, f"`{call}(...)` {_PATH}") for line, call in found))


def _forgery(source: str, *found: tuple[int, str]) -> Case:
    return one(source, *(("security.ssrf", line, None, f"`{call}(...)` {_URL}") for line, call in found))


def _sql(source: str, *found: tuple[int, str, str]) -> Case:
    return one(source, *(("security.sql-concatenation", line, None, f"`{call}()` {text}") for line, call, text in found))


_FLASK = "from flask import request\n"

FLOW = [
    # sources, carriers, calls that clean
    _traversal(_FLASK + "def view():\n    name = request.args['f']\n    open(name)\n    open(name[0].stem)\n    open(f'/x/{name}')\n    open('/x/' + name)\n    open('%s' % name)\n    open('{}'.format(name))\n    open('{}'.format(n=name))\n    open(clean(name))\n    open(name - 1)\n    open(secure_filename(name))\n", *((n, "open") for n in (4, 5, 6, 7, 8, 9))),
    _traversal(_FLASK + "def view():\n    open(request.form['x'])\n    open(self.request.GET['x'])\n    open(request.user)\n    open(other.form['x'])\n    open('literal')\n    open(*request.args)\n    open(x[request.args])\n    open(a if request.args else b)\n    open(request.args if a else b)\n", *((n, "open") for n in (3, 4, 9, 11))),
    # assignments: rebinding cleans, unpacking binds all, augmented ones only add
    _traversal(_FLASK + "def view():\n    a = b = request.args\n    open(a)\n    a = 'x'\n    open(a)\n    open(b)\n    c, (d, *e) = request.form\n    open(c)\n    open(d)\n    open(e)\n    f: str = request.data\n    open(f)\n    f: str\n    open(f)\n    g = 'x'\n    g += request.args\n    g += 'y'\n    open(g)\n    h.x = request.args\n    open(h)\n", *((n, "open") for n in (4, 7, 9, 10, 13, 19))),
    # branches: both have to agree; a branch sees the state before it
    _traversal(_FLASK + "def view():\n    p = request.args\n    if x:\n        p = 'safe'\n        open(p)\n    else:\n        open(p)\n    open(p)\n    q = 'x'\n    if x:\n        q = request.args\n        open(q)\n    elif y:\n        q = request.form\n    else:\n        q = request.data\n    open(q)\n    if open(q):\n        q = 1\n    open(q)\n", (8, "open"), (13, "open"), (18, "open"), (19, "open")),
    _traversal(_FLASK + "def view():\n    p = request.args\n    for x in open(p):\n        open(p)\n        p = 'x'\n        open(p)\n    else:\n        open(p)\n    open(p)\n    r = request.args\n    while open(r):\n        open(r)\n    open(r)\n    s = 'x'\n    for y in z:\n        s = request.args\n        open(s)\n    else:\n        s = request.args\n    open(s)\n", *((n, "open") for n in (4, 5, 9, 12, 13, 14, 18))),
    _traversal(_FLASK + "def view():\n    p = request.args\n    q = r = s = p\n    try:\n        p = 'x'\n        s = 'x'\n        t = request.args\n    except A:\n        open(p)\n        q = 'x'\n    except B:\n        open(q)\n        t = request.form\n    else:\n        open(p)\n        open(t)\n        s = request.args\n    finally:\n        open(r)\n        open(s)\n    open(p)\n    open(q)\n    open(r)\n    open(s)\n    open(t)\n", *((n, "open") for n in (10, 13, 17, 20, 21, 24, 25))),
    _traversal(_FLASK + "def view():\n    p = request.args\n    if a:\n        if b:\n            if c:\n                p = 'x'\n        open(p)\n    open(p)\n    q = request.args\n    if a:\n        for x in y:\n            try:\n                z = 1\n            except E:\n                pass\n        open(q)\n    open(q)\n", (17, "open"), (18, "open")),
    # scopes: functions and classes begin clean; their names hide what was there; with bodies are seen with the state before
    _traversal(_FLASK + "name = request.args\nopen(name)\ndef f():\n    open(name)\n    def g(x):\n        open(name)\n    name = request.args\n    class C:\n        open(name)\n        k = request.form\n        open(k)\n    open(name)\n    def name():\n        pass\n    open(name)\nopen(name)\nwith x:\n    name = 'x'\n    open(name)\nopen(name)\nclass name:\n    pass\nopen(name)\n", *((n, "open") for n in (3, 12, 13, 17, 20, 21))),
    _traversal(_FLASK + "name = request.args\nasync def f(a=open(name)):\n    async for x in open(request.args):\n        [open(y) for y in request.args]\n        b = lambda: open(name)\n        x[open(request.args)] = 1\n        b = request.args\n        c = lambda: open(b)\n    match open(request.data):\n        case 1:\n            open(request.data)\n", (4, "open"), (9, "open"), (10, "open"), (12, "open")),
    # parameters that FastAPI fills
    _traversal("from fastapi import Query, Path as P\ndef f(a, b=Query(None), *, c: Query, d=fastapi.Form(), e=Depends(x)):\n    open(a)\n    open(b)\n    open(c)\n    open(d)\n    open(e)\ndef g(a: Annotated[str, Body()], b: Annotated[str, Depends()], c: list[File], d: Other = Header(), /, e=1):\n    open(a)\n    open(b)\n    open(c)\n    open(d)\n    open(e)\n    e = a\n    open(e)\n", *((n, "open") for n in (4, 5, 6, 9, 11, 12, 15))),
    # sinks
    _traversal("import os, shutil, django\nfrom pathlib import Path\nx = request.GET\nos.remove(x)\nos.unlink(x)\nother.remove(x)\nshutil.copyfile(x, y)\nshutil.copyfile(y, x)\nPath(x).read_text()\npathlib.PurePath(x).open()\nPath(x).exists()\nPath().open(x)\nPath(y).write_text(x)\nio.open(x)\nos.path.remove(x)\nopen(y, x)\n", (4, "os.remove"), (5, "os.unlink"), (7, "shutil.copyfile"), (9, "?"), (10, "?"), (15, "os.path.remove")),
    _traversal("x = request.args\nopen(x)\n"),
    _traversal("def f():\n    from flask import request\n    open(request.args)\n"),
    # requests to addresses
    _forgery("import requests\nimport httpx\nfrom urllib.request import urlopen\ndef f():\n    u = request.args['u']\n    requests.get(u)\n    requests.post(f'https://{u}')\n    requests.request('GET', u)\n    requests.request(u)\n    httpx.get(u)\n    urlopen(u)\n    requests.get('https://x')\n    requests.get(url=u)\n    requests.get(wrap(u))\n    anything.delete(u)\n    u = 'x'\n    requests.get(u)\n", (6, "requests.get"), (7, "requests.post"), (8, "requests.request"), (10, "httpx.get"), (11, "urlopen"), (15, "anything.delete")),
    _forgery("from requests import get\ndef f(u=Query()):\n    get(u)\n    if x:\n        u = 'x'\n    get(u)\n", (3, "get")),
    _forgery("import other\nrequests.get(request.args)\n"),
    _forgery("import urllib3\ndef f(u=Query()):\n    http.get(u)\n"),
    # SQL text
    _sql("c.execute(f'SELECT {x}')\nc.execute('SELECT {}'.format(x))\nc.execute('SELECT %s' % x)\nc.execute('SELECT ' + x)\nc.execute('SELECT 1')\nc.execute(f'run {x}')\nc.execute('SELECT ?', (x,))\nexecute('a' + 'b')\n", *((n, "c.execute", _SQL) for n in (1, 2, 3, 4))),
    _sql("TABLE = 'users'\nc.execute(f'SELECT * FROM {TABLE} WHERE id = ?', (x,))\nc.execute('SELECT ' + TABLE)\nc.execute('DELETE FROM %s' % TABLE)\nc.execute('DELETE FROM %s %s' % (TABLE, 'x'))\nc.execute('DROP {} {t}'.format(TABLE, t=TABLE))\nc.execute(f'DROP {TABLE!r}')\nc.execute(f'DROP {TABLE:>9}')\nc.execute('DROP {}'.format(*TABLE))\nc.execute('DROP ' + TABLE + x)\nc.execute('x' + TABLE + y)\n", *((n, "c.execute", _SQL) for n in (7, 8, 9, 10))),
    _sql("WORD = 'ECT'\nc.execute('SEL' + WORD + x)\nc.execute('SEL' + (x + WORD))\nc.execute(x + ('SEL' + WORD))\nc.execute('%s' % (x, 'SELECT'))\nc.execute('{}'.format(x, y='SELECT'))\nc.execute(f'{x}{\"SEL\" + WORD}')\n", *((n, "c.execute", _SQL) for n in (2, 4, 6, 7))),
    # constants that are bound again, anywhere, are none
    _sql("A = 'x'\nA = 'y'\nB = 'x'\nif z:\n    B = 'y'\nC = 'x'\ndef f():\n    global C\n    C = 1\nD = 'x'\ndel D\nE = F = 'x'\nfrom m import G\nG = 'x'\nH: str = 'x'\nI = 'x'\nfor I in y:\n    pass\nJ = 1\nk = 'x'\nc.execute(f'SELECT {A}')\nc.execute(f'SELECT {B}')\nc.execute(f'SELECT {C}')\nc.execute(f'SELECT {D}')\nc.execute(f'SELECT {E}')\nc.execute(f'SELECT {G}')\nc.execute(f'SELECT {H}')\nc.execute(f'SELECT {I}')\nc.execute(f'SELECT {J}')\nc.execute(f'SELECT {k}')\nK = 'x'\ndef g():\n    K = 'y'\nclass L:\n    K = 'z'\nc.execute(f'SELECT {K}')\n", *((n, "c.execute", _SQL) for n in range(21, 31))),
    _sql("c.executescript(a + 'x')\nc.executemany(f'{a}', b)\ntext(f'{a}')\nc.executemany(a)\nlabel.text(f'{a}')\n", (1, "c.executescript", _SQL), (2, "c.executemany", _SQL)),
    _sql("import sqlalchemy\ntext(f'{a}')\nsa.text('x')\n", (2, "text", _SQL)),
    _sql("c.execute(f'SELECT * FROM {t} WHERE id = ?', (x,))\nc.execute(f'SELECT * FROM {t} WHERE id = {x}', (y,))\nc.execute(f'SELECT {t}')\nc.execute('SELECT * FROM t WHERE n IN (' + f'x IN ({h})', params=y)\nc.execute(f'SELECT a ORDER BY {t}'.strip() + ' FROM x', y)\nc.execute(f'UPDATE x SET {t}', y)\nc.execute('SELECT {}'.format(f'FROM {t}'), y)\n", (1, "c.execute", _SHAPE), (2, "c.execute", _SQL), (3, "c.execute", _SQL), (4, "c.execute", _SHAPE), (5, "c.execute", _SHAPE), (6, "c.execute", _SQL), (7, "c.execute", _SHAPE)),
    _sql("c.execute(\"SELECT '?'\", (x,))\nc.execute(\"SELECT '%s'\", (x,))\nc.execute(\"SELECT '?'\")\nc.execute('SELECT ?', (x,))\nc.execute('SELECT \":name\"', parameters=x)\nc.execute(\"SELECT '%(id)s\\\"\", x)\n", (1, "c.execute", _QUOTED), (2, "c.execute", _QUOTED), (5, "c.execute", _QUOTED)),
]

#: Severity, pillar and confidence of each rule.
ABOUT_FLOW = {"security.path-traversal": ("error", "security", "high"), "security.ssrf": ("error", "security", "high"), "security.sql-concatenation": ("warning", "security", "medium")}
