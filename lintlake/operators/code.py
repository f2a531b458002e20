"""Parsed code as a relation of syntax nodes; one pass of the parser over the units."""

from __future__ import annotations

import ast
import gc
import io
import re
import tokenize
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODES = "project string, path string, node_id int, parent_id int, kind string, field string, ord int, name string, text string, n int, line int, end_line int, start_line int, fn_id int, class_id int, symbol string, nest int"
#: More of a node: the function around it (classes between or not), its part of cognitive complexity, decorators, bases,
#: names that it is assigned to (or its function's), whether it is a built string, a comparison with itself, a store; an
#: import's module; a function's parameters; what its docstring describes; operators, and the operand that a node is;
#: its place in the source's order and the last place below it.
NODES += ", test_id int, cog int, tags array<string>, bases array<string>, context string, dyn boolean, same boolean, store boolean, origin string, params array<string>, doc_params array<string>, doc_returns boolean, doc_raises boolean, operators array<string>, operand string, pre int, last int"

_SCOPES = (ast.FunctionDef, ast.AsyncFunctionDef, ast.Lambda)
_NESTING = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.Try, ast.TryStar, ast.Match, ast.With, ast.AsyncWith)


def _dotted(node: ast.AST) -> str | None:
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id, *reversed(parts)]) if isinstance(node, ast.Name) else None


def _body(node: ast.AST) -> tuple[str | None, str | None, int | None]:
    return getattr(node, "name", None), ast.get_docstring(node), len(node.body)


#: (name, text, number) of a node: what the rules ask of its kind, by type; others have none.
_DESCRIBED = {
    ast.FunctionDef: _body, ast.AsyncFunctionDef: _body, ast.ClassDef: _body, ast.Module: _body,
    ast.arg: lambda node: (node.arg, None, None),
    ast.Name: lambda node: (node.id, type(node.ctx).__name__, None),
    ast.Attribute: lambda node: (node.attr, _dotted(node), None),
    ast.Call: lambda node: (None, _dotted(node.func), len(node.args)),
    ast.keyword: lambda node: (node.arg, ast.unparse(node.value), None),
    ast.alias: lambda node: (node.asname or node.name.split(".")[0], node.name, None),
    ast.BoolOp: lambda node: (type(node.op).__name__, None, len(node.values)),
    ast.MatchAs: lambda node: (node.name, None, None),
    ast.MatchStar: lambda node: (node.name, None, None),
    ast.MatchMapping: lambda node: (node.rest, None, None),
    ast.BinOp: lambda node: (type(node.op).__name__, None, None),
    ast.UnaryOp: lambda node: (type(node.op).__name__, None, None),
    ast.AugAssign: lambda node: (type(node.op).__name__, None, None),
    ast.Compare: lambda node: (None, ",".join(type(o).__name__ for o in node.ops), None),
    ast.FormattedValue: lambda node: (None, None, node.conversion),
    ast.comprehension: lambda node: (None, None, len(node.ifs)),
    ast.match_case: lambda node: (None, None, int(not (isinstance(node.pattern, ast.MatchAs) and node.pattern.pattern is None and node.guard is None))),
    ast.Constant: lambda node: (type(node.value).__name__, str(node.value), None),
    ast.ExceptHandler: lambda node: (node.name, _dotted(node.type) if node.type else None, len(node.body)),
}


_LOOPS = (ast.For, ast.AsyncFor, ast.While)
_SECTION = re.compile(r"^\s*(args|arguments|parameters|params|returns?|yields?|raises|except|exceptions|attributes|examples?|notes?|warnings?|see also|references)\s*:?\s*$", re.I)


def docstring_parts(text: str) -> tuple[list[str], bool, bool]:
    """Parameters that a docstring describes (sections by name, underlined sections, fields), and whether it has returns and raises."""
    params = re.findall(r"^\s*:(?:param|parameter|arg|argument|key|keyword)\s+(?:[^:]*\s)?(\*{0,2}\w+)\s*:", text, re.M)
    returns, raises = bool(re.search(r"^\s*:(?:returns?|rtype)\b", text, re.M)), bool(re.search(r"^\s*:(?:raises?|except|exception)\b", text, re.M))
    section = indent = None
    for line in text.splitlines():
        head = _SECTION.match(line)
        if head:
            section, indent = head[1].lower(), None
            continue
        if not line.strip() or set(line.strip()) == {"-"}:
            continue
        depth = len(line) - len(line.lstrip())
        indent = depth if indent is None else indent
        if section in ("args", "arguments", "parameters", "params") and depth == indent:
            m = re.match(r"\s*(\*{0,2}\w+)\s*(?:\(.*?\))?\s*:", line) or re.match(r"\s*(\*{0,2}\w+)\s*$", line)
            params += [m[1]] if m else []
        returns = returns or section in ("return", "returns", "yield", "yields")
        raises = raises or section in ("raises", "except", "exceptions")
        if section and depth < (indent or 0):
            section = None
    return params, returns, raises


def _makes_text(node: ast.AST) -> bool:
    match node:
        case ast.Constant():
            return isinstance(node.value, str)
        case ast.JoinedStr():
            return True
        case ast.BinOp(op=ast.Add() | ast.Mod()):
            # a chain's operations each ask for what is below them: kept at the node
            known = node.__dict__.get("_text")
            if known is None:
                known = node._text = _makes_text(node.left) or _makes_text(node.right)
            return known
        case ast.Call(func=ast.Attribute(attr="format" | "join")):
            return True
    return False


def _built(node: ast.AST) -> bool:
    """Whether a string is put together at run time."""
    match node:
        case ast.JoinedStr():
            return any(isinstance(v, ast.FormattedValue) for v in node.values)
        case ast.BinOp(op=ast.Add()):
            return _makes_text(node.left) or _makes_text(node.right)
        case ast.BinOp(op=ast.Mod()):
            return _makes_text(node.left)
        case ast.Call(func=ast.Attribute(attr="format")):
            return True
    return False


def _path_of(node: ast.AST) -> str | None:
    """Source of names, attributes and calls without keywords; null for anything else."""
    match node:
        case ast.Name():
            return node.id
        case ast.Attribute():
            inner = _path_of(node.value)
            return inner and f"{inner}.{node.attr}"
        case ast.Call():
            parts = [_path_of(x) for x in (node.func, *node.args)]
            return f"{parts[0]}({','.join(parts[1:])})" if all(parts) else None
    return None


def _self_compared(node: ast.AST) -> bool:
    """Whether an expression compares a value, or its type, with itself."""
    match node:
        case ast.Compare(ops=[ast.Is() | ast.Eq()], left=a, comparators=[b]):
            return _path_of(a) is not None and _path_of(a) == _path_of(b)
        case ast.Call(func=ast.Name(id="isinstance"), args=[a, ast.Call(func=ast.Name(id="type"), args=[b])]):
            return _path_of(a) is not None and _path_of(a) == _path_of(b)
    return False


#: Types whose nodes are no rows: contexts and operators, one object of each a tree.
_MARKS = frozenset(t for base in (ast.expr_context, ast.operator, ast.unaryop, ast.cmpop, ast.boolop) for t in base.__subclasses__())
#: Types that measures look at; other nodes are passed over without a call.
_COGNITIVE = frozenset((ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.Match, ast.BoolOp, ast.Call))
_DEEPENING = frozenset((ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.match_case))
_OPERATING = frozenset((ast.BinOp, ast.UnaryOp, ast.BoolOp, ast.Compare, ast.AugAssign))
_OPERANDS = frozenset((ast.Name, ast.Constant, ast.Call, ast.Subscript, ast.Attribute))
_BUILDING = frozenset((ast.JoinedStr, ast.BinOp, ast.Call))
_COMPARING = frozenset((ast.Compare, ast.Call))
_STORED = frozenset((ast.Attribute, ast.Name, ast.Subscript))
_DEFINING = frozenset((ast.FunctionDef, ast.AsyncFunctionDef))
_OWNING = frozenset((*_SCOPES, ast.arguments, ast.arg, ast.ClassDef))
_EXPRESSIONS = frozenset(ast.expr.__subclasses__())
#: Types whose ``name`` opens a scope of names.
_NAMED = frozenset(t for t in vars(ast).values() if isinstance(t, type) and issubclass(t, ast.AST) and "name" in t._fields and t is not ast.alias)


@dataclass(frozen=True)
class Part:
    """What of the node relation some rules read: kinds of nodes, columns, and which texts can hold what they look for.

    Nodes that add to cognitive complexity are rows of any part. Numbers of nodes are those of the whole relation.
    Rows of other kinds are chosen one by one (``wanted``: node, field, place, the parent's entry, the class around), names and attributes
    by a unit's names that matter (``names``). ``placed`` parts have places, operators and operands, and the rows with them.

    ``light`` parts go over statements alone, without places; numbers of nodes are then those of what was gone over.
    With ``once``, what a module holds itself is gone over, and names that are read, attributes and imported names give
    one row a name, at the module. Units of which such rows can't tell all are gone over as wholes: those that ``light``
    refuses, by text or by a row, and, with ``once``, those with texts in annotations.
    """

    name: str
    kinds: frozenset[str] | None = None
    columns: tuple[str, ...] = ()
    like: Callable[[str], bool] | None = None
    wanted: Callable[[ast.AST, str, int, tuple, ast.ClassDef | None], bool] | None = None
    names: Callable[[Iterable[ast.AST]], set[str]] | None = None
    placed: bool = False
    light: Callable[[str | tuple], bool] | None = None
    once: bool = False

    def schema(self) -> str:
        return ", ".join(f for f in NODES.split(", ") if not self.columns or f.split(" ")[0] in ("project", "path", *self.columns))


@cache
def _fields(kind: type) -> tuple[str, ...]:
    """The fields of a type of node that can hold nodes."""
    types = getattr(kind, "_field_types", {})
    return tuple(f for f in kind._fields if f not in types or "ast." in repr(types[f]))


@cache
def _row_fields(kind: type) -> tuple[str, ...]:
    """The fields of a type of node that can hold nodes that are rows."""
    types = getattr(kind, "_field_types", {})
    marks = ("ast.expr_context", "ast.operator", "ast.unaryop", "ast.cmpop", "ast.boolop")
    return tuple(f for f in _fields(kind) if f not in types or not any(m in repr(types[f]) for m in marks))


def _children(node: ast.AST) -> list[tuple[str, int, ast.AST]]:
    """A node's children that are rows (field, place, child)."""
    rows, held = [], node.__dict__
    for key in _row_fields(type(node)):
        value = held.get(key)
        if value is None:
            continue
        if value.__class__ is list:
            if value:
                rows += [(key, i, child) for i, child in enumerate(value) if isinstance(child, ast.AST)]
        elif isinstance(value, ast.AST):
            rows.append((key, 0, value))
    return rows


def _shape(tree: ast.AST) -> tuple[dict[ast.AST, list[tuple[str, int, ast.AST]]], dict[ast.AST, tuple[int, int]]]:
    """Each node's children that are rows (field, place, child); its place in depth-first order and the last place below it."""
    order, above, stack = [], [], [(tree, 0)]
    children = {}
    while stack:
        node, up = stack.pop()
        at = len(order)
        order.append(node)
        above.append(up)
        rows = children[node] = _children(node)
        stack += [(child, at) for _, _, child in reversed(rows)]
    sizes = [1] * len(order)
    for k in range(len(order) - 1, 0, -1):
        sizes[above[k]] += sizes[k]
    return children, {node: (k, k + sizes[k] - 1) for k, node in enumerate(order)}


#: Fields by type that hold statements, or parts of them that statements are in.
_HOLDS = {t: tuple(f for f in ("body", "cases", "handlers", "orelse", "finalbody") if f in t._fields) for t in (ast.Module, ast.ExceptHandler, ast.match_case, *ast.stmt.__subclasses__())}
#: Expressions and names that a statement is known by.
_SHORT = {ast.Expr: ("value", ast.Constant), ast.AnnAssign: ("target", ast.Name)}


def _statements(node: ast.AST) -> list[tuple[str, int, ast.AST]]:
    """A statement's children that are statements (field, place, child), constants that are statements, imported names."""
    kind = type(node)
    rows = [(key, i, child) for key in _HOLDS.get(kind, ()) for i, child in enumerate(getattr(node, key))]
    if kind in _SHORT:
        key, wanted = _SHORT[kind]
        if isinstance(child := getattr(node, key), wanted):
            rows.append((key, 0, child))
    elif kind is ast.Import or kind is ast.ImportFrom:
        rows += [("names", i, child) for i, child in enumerate(node.names)]
    return rows


_DEFINITIONS = frozenset((*_DEFINING, ast.ClassDef))
_ANNOTATED = {ast.arg: "annotation", ast.AnnAssign: "annotation", ast.FunctionDef: "returns", ast.AsyncFunctionDef: "returns"}


def _defines(body: list[ast.stmt]) -> bool:
    """Whether a function or a class is among statements or below them."""
    stack = [body]
    while stack:
        for node in stack.pop():
            kind = node.__class__
            if kind in _DEFINITIONS:
                return True
            for key in _HOLDS[kind]:
                stack.append(getattr(node, key))
    return False


def _once(tree: ast.AST) -> dict[tuple[str, str, str | None, str | None], None] | None:
    """(kind, name, text, origin) of names that are read, attributes and imported names, each once; null if a text stands in an annotation."""
    out: dict[tuple[str, str, str | None, str | None], None] = {}
    stack = [tree]
    while stack:
        node = stack.pop()
        kind = node.__class__
        if kind is ast.Name:
            if node.ctx.__class__ is ast.Load:
                out["Name", node.id, "Load", None] = None
            continue
        if kind is ast.Constant:
            continue
        if kind is ast.Attribute:
            out["Attribute", node.attr, None, None] = None
            stack.append(node.value)
            continue
        if kind is ast.Import or kind is ast.ImportFrom:
            for imported in node.names:
                out["alias", *_DESCRIBED[ast.alias](imported)[:2], (node.module or "") if kind is ast.ImportFrom else None] = None
            continue
        if kind in _ANNOTATED:
            note = getattr(node, _ANNOTATED[kind])
            if note is not None and any(n.__class__ is ast.Constant and n.value.__class__ is str for n in ast.walk(note)):
                return None
        held = node.__dict__
        for key in _row_fields(kind):
            value = held.get(key)
            if value is None:
                continue
            if value.__class__ is list:
                stack.extend(filter(None, value))
            elif isinstance(value, ast.AST):
                stack.append(value)
    return out


def _operators(node: ast.AST) -> list[str] | None:
    """The operators of an expression or an augmented assignment."""
    match node:
        case ast.BinOp() | ast.UnaryOp() | ast.BoolOp():
            return [type(node.op).__name__]
        case ast.Compare():
            return [type(o).__name__ for o in node.ops]
        case ast.AugAssign():
            return [f"{type(node.op).__name__}Assign"]
    return None


def _operand(node: ast.AST) -> str | None:
    """What a node is as an operand: a name, a constant, or a call, subscript or attribute as a whole."""
    match node:
        case ast.Name():
            return node.id
        case ast.Constant():
            return repr(node.value)
        case ast.Call() | ast.Subscript() | ast.Attribute():
            return ast.unparse(node)
    return None


def _own_cognitive(node: ast.AST, depth: int, fn_name: str | None, elif_: bool) -> int:
    """What a node adds to its function's cognitive complexity."""
    match node:
        case ast.If():
            other = bool(node.orelse) and not (len(node.orelse) == 1 and isinstance(node.orelse[0], ast.If))
            return (1 if elif_ else 1 + depth) + other
        case ast.For() | ast.AsyncFor() | ast.While():
            return 1 + depth + bool(node.orelse)
        case ast.ExceptHandler() | ast.IfExp() | ast.Match():
            return 1 + depth
        case ast.BoolOp():
            return 1
        case ast.Call(func=ast.Name(id=name)):
            return int(name == fn_name)
    return 0


def _deeper(node: ast.AST, key: str, child: ast.AST) -> bool:
    """Whether a field's children are one level deeper for cognitive complexity."""
    if isinstance(node, ast.If):
        return key == "body" or key == "orelse" and not (len(node.orelse) == 1 and isinstance(child, ast.If))
    if isinstance(node, (*_LOOPS, ast.ExceptHandler, ast.IfExp)):
        return key != "type" and (isinstance(node, ast.IfExp) or key in ("body", "orelse"))
    return isinstance(node, ast.match_case) and key in ("body", "guard")


def flatten(source: str, part: Part | None = None, light: bool | None = None) -> list[tuple]:
    """Rows of a source's nodes in breadth-first order; a source that doesn't parse gives one row of kind ``error``.

    With the kinds of a ``part`` only their rows, whose places, operators and operands are null if it isn't placed.
    ``light`` is whether statements alone are gone over, if that isn't for the part to say.
    """
    if part and part.like and source.isascii() and not part.like(source):  # names in other letters may mean the same
        return []
    kinds = part.kinds if part else None
    if kinds is not None:
        asked = frozenset(t for k in kinds if (t := getattr(ast, k, None)))
        source_comments = comments if "Comment" in kinds else lambda source: ()
    else:
        asked, source_comments = None, comments
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError) as e:
        broken = [(0, None, "error", None, 0, None, str(e), None, getattr(e, "lineno", None), None, None, None, None, None, 0, *[None] * 15, 0, 0), *((k, None, "Comment", None, 0, None, text, None, line, line, line, None, None, None, 0, *[None] * 15, 0, 0) for k, (line, text) in enumerate(source_comments(source), 1))]
        return broken if kinds is None or "error" in kinds else broken[1:]
    rows: list[tuple] = []
    light = bool(part and part.light) and part.light(source) if light is None else light
    if light and part.once:
        seen = _once(tree)
        light = seen is not None
    placed = (asked is None or part.placed) and not light
    below_, places = _shape(tree) if placed else ({}, {})
    wanted, named = (part.wanted, part.names(below_ or ast.walk(tree)) if part.names and not light else ()) if asked is not None else (None, ())
    counting = part is None or not part.light
    step, single = _statements if light else _children, light and part.once
    building = asked is None or not part.columns or "dyn" in part.columns or "same" in part.columns
    # node, parent, field, place; the body's function and its name, the function around, the class; names, nesting, cognitive depth, context, elif; in an operation
    queue = [(tree, None, None, 0, None, None, None, None, (), 0, 0, None, False, False)]
    for at, (node, parent, field, place, fn, fn_name, around, cls, names, nest, depth, context, elif_, operated) in enumerate(queue):
        kind = type(node)
        if placed:
            children = below_[node]
        else:
            children = step(node) if not single or parent is None else ()
            if light and kind in _DEFINING and children and not _defines(node.body):
                children = [(key, i, child) for key, i, child in children if wanted(child, key, i, queue[at], None if cls is None else queue[cls][0])]
            if not children and kind not in asked and not wanted and not named:
                continue
        cog = _own_cognitive(node, depth, fn_name, elif_) if counting and fn is not None and kind in _COGNITIVE else 0
        # below a whole operand nothing counts; below an operation every operand does
        if not placed:
            operated = None
        operators = None if operated is None or kind not in _OPERATING else _operators(node)
        operand = _operand(node) if operated and kind in _OPERANDS else None
        below = None if operated is None or operand is not None else operated or operators is not None
        shown = asked is None or cog > 0 or kind in asked or operators is not None or operand is not None
        if not shown:
            shown = kind is ast.Name and node.id in named or kind is ast.Attribute and node.attr in named or wanted is not None and parent is not None and wanted(node, field, place, queue[parent], None if cls is None else queue[cls][0])
        describe = _DESCRIBED.get(kind) if shown else None
        name, text, n = describe(node) if describe else (None, None, None)
        line, end = getattr(node, "lineno", None), getattr(node, "end_lineno", None)
        start = line
        nest += kind in _NESTING
        inner, origin, tags, bases, params, doc = names, None, None, None, None, (None, None, None)
        if kind is ast.Lambda:
            inner = (*names, f"<lambda:{line}>")
        elif kind in _NAMED and isinstance(node.name, str):
            inner = (*names, node.name)
        defines = kind in _DEFINING
        if defines or kind is ast.ClassDef:
            tags = [_dotted(d.func if isinstance(d, ast.Call) else d) or "" for d in node.decorator_list]
            start = min([line, *(d.lineno for d in node.decorator_list)])
        elif kind in (ast.Global, ast.Nonlocal):
            tags = list(node.names)
        if kind is ast.ClassDef:
            bases = [_dotted(b.value if isinstance(b, ast.Subscript) else b.func if isinstance(b, ast.Call) else b) or "" for b in node.bases]
        if defines:
            args = node.args
            params = [a.arg for a in (*args.posonlyargs, *args.args, *filter(None, [args.vararg]), *args.kwonlyargs, *filter(None, [args.kwarg]))]
            doc = docstring_parts(text) if text else doc
        if kind is ast.alias:
            up = queue[parent][0]
            origin, n = (up.module or "") if isinstance(up, ast.ImportFrom) else None, int(queue[parent][1] == 0)
        store = isinstance(node.ctx, ast.Store) if kind in _STORED else None
        if kind is ast.Assign:
            context = "=" + ",".join(t.id for t in node.targets if isinstance(t, ast.Name))
        elif defines:
            context = node.name
        if shown:
            built, same = (kind in _BUILDING and _built(node), kind in _COMPARING and _self_compared(node)) if building and kind in _EXPRESSIONS else (None, None)
            rows.append((at, parent, kind.__name__, field, place, name, text, n, line, end, start, fn, cls, ".".join(inner) or "<module>", nest, around, cog, tags, bases, context, built, same, store, origin, params, *doc, operators, operand, *places.get(node, (None, None))))
            if light and not part.light(rows[-1]):
                return flatten(source, part, False)
        mine = kind in _SCOPES
        deepens = kind in _DEEPENING
        if kind not in _OWNING:
            for key, i, child in children:
                branch = kind is ast.If and key == "orelse" and len(node.orelse) == 1 and isinstance(child, ast.If)
                queue.append((child, at, key, i, fn, fn_name, around, cls, inner, nest, depth + _deeper(node, key, child) if deepens else depth, context, branch, below))
            continue
        for key, i, child in children:
            # a function owns its body and parameters; defaults, annotations, decorators and bases belong to what is around it
            owner, name_, scope, deep, level = fn, fn_name, around, depth, nest
            if mine and key in ("body", "args"):
                owner, name_, scope, deep, level = at, getattr(node, "name", None), at, 0, 0
            elif kind is ast.arguments and not isinstance(child, ast.arg) or kind is ast.arg:
                up = queue[parent] if kind is ast.arguments else queue[queue[parent][1]]
                owner, name_, scope, deep, level = up[4], up[5], up[6], up[10], up[9]
            elif kind is ast.ClassDef and key == "body":
                owner, name_, deep, level = None, None, 0, 0
            queue.append((child, at, key, i, owner, name_, scope, at if kind is ast.ClassDef else cls, inner, level, deep, context, False, below if not mine and kind is not ast.ClassDef else False if key == "body" else None))
    if light and part.once:
        rows += [(number, 0, kind, None, 0, name, text, *[None] * 7, 0, *[None] * 8, origin, *[None] * 8) for number, (kind, name, text, origin) in enumerate(seen, len(queue))]
    for number, (line, text) in enumerate(source_comments(source), len(queue)):
        rows.append((number, None, "Comment", None, 0, None, text, None, line, line, line, None, None, None, 0, *[None] * 15, 0, 0))
    return rows


def comments(source: str) -> list[tuple[int, str]]:
    """(line, text) of each comment, up to where the source can't be cut into tokens."""
    found: list[tuple[int, str]] = []
    if "#" in source:
        try:
            for t in tokenize.generate_tokens(io.StringIO(source).readline):
                if t.type == tokenize.COMMENT:
                    found.append((t.start[0], t.string))
        except (tokenize.TokenError, SyntaxError):
            pass
    return found


#: Fixed value: texts that are parsed, and units that are given out, at once.
SLICE = 200


def _runs(sources: list[str]) -> Iterator[tuple[int, int]]:
    """Bounds of runs with ``SLICE`` different texts at most."""
    start, seen = 0, set()
    for i, source in enumerate(sources):
        if source not in seen and len(seen) == SLICE:
            yield start, i
            start, seen = i, set()
        seen.add(source)
    if sources:
        yield start, len(sources)


def nodes(units: DataFrame, part: Part | None = None) -> DataFrame:
    """The node relation of all Python units, or a part of it, in the units' own partitions."""
    schema = part.schema() if part else NODES
    taken = [[f.split(" ")[0] for f in NODES.split(", ")].index(f.split(" ")[0]) - 2 for f in schema.split(", ")[2:]]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed, flag = pa.list_(pa.string()), pa.bool_()
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), *[pa.int32()] * 6, pa.string(), pa.int32()]
        kinds += [pa.int32(), pa.int32(), listed, listed, pa.string(), flag, flag, flag, pa.string(), listed, listed, flag, flag, listed, pa.string(), pa.int32(), pa.int32()]
        names = [f.split(" ")[0] for f in schema.split(", ")]
        for b in batches:
            sources = [source or "" for source in b.column(2).to_pylist()]
            for start, until in _runs(sources):
                # equal texts of a run are parsed once, and their rows taken for each
                texts = {t: i for i, t in enumerate(dict.fromkeys(sources[start:until]))}
                collecting = gc.isenabled()
                gc.disable()  # trees have no cycles, and a collection looks at all rows of the run
                try:
                    parsed = [flatten(t, part) for t in texts]
                finally:
                    if collecting:
                        gc.enable()
                sizes = np.array([len(rows) for rows in parsed])
                begins = np.cumsum(sizes) - sizes
                values = list(zip(*chain.from_iterable(parsed))) or [()] * len(kinds)
                columns = [pa.array(values[i], kinds[i]) for i in taken]
                del parsed, values
                for at in range(start, until, SLICE):
                    some = b.slice(at, min(SLICE, until - at))
                    which = np.array([texts[t] for t in sources[at : at + some.num_rows]])
                    n = sizes[which]
                    at_row = pa.array(np.repeat(np.arange(some.num_rows), n))
                    of = pa.array(np.arange(n.sum()) + np.repeat(begins[which] - (np.cumsum(n) - n), n))
                    yield pa.RecordBatch.from_arrays([some.column(0).take(at_row), some.column(1).take(at_row), *(c.take(of) for c in columns)], names=names)

    return units.where("file_type = 'python'").select("project", "path", "source").mapInArrow(run, schema)


#: What ``functions`` reads.
MEASURES = Part(
    "measures",
    frozenset(("FunctionDef", "AsyncFunctionDef", "Lambda", "arg", "If", "For", "AsyncFor", "While", "Try", "TryStar", "ExceptHandler", "IfExp", "Assert", "BoolOp", "comprehension", "Match", "match_case", "With", "AsyncWith")),
    ("node_id", "parent_id", "kind", "field", "ord", "name", "text", "n", "line", "end_line", "start_line", "fn_id", "class_id", "symbol", "nest", "test_id", "cog", "tags", "params", "doc_params", "doc_returns", "doc_raises"),
)


def functions(tree: DataFrame) -> DataFrame:
    """Functions with length, parameters, cyclomatic complexity and nesting: aggregates over the nodes that each owns."""
    key = ["project", "path"]
    cc = (
        F.when(F.col("kind").isin("If", "For", "AsyncFor", "While", "ExceptHandler", "IfExp", "Assert"), 1)
        .when(F.col("kind") == "BoolOp", F.col("n") - 1)
        .when(F.col("kind") == "comprehension", 1 + F.col("n"))
        .when(F.col("kind") == "match_case", F.col("n"))
        .otherwise(0)
    )
    own = tree.where("fn_id is not null").groupBy(*key, F.col("fn_id").alias("node_id")).agg(
        (1 + F.sum(cc)).cast("int").alias("cyclomatic"),
        F.max("nest").alias("nesting"),
        F.sum("cog").cast("int").alias("cognitive"),
        F.count_if(F.col("kind") == "arg").cast("int").alias("all_parameters"),
        F.max(F.when((F.col("kind") == "arg") & F.col("field").isin("args", "posonlyargs") & (F.col("ord") == 0), F.col("name"))).alias("first"),
    )
    defs = tree.where("kind in ('FunctionDef', 'AsyncFunctionDef', 'Lambda')")
    out = defs.join(own, [*key, "node_id"], "left")
    receiver = F.col("class_id").isNotNull() & F.col("first").isin("self", "cls")
    return out.select(
        *key, "node_id", "parent_id", "kind", "name", "symbol", "line", "end_line", "start_line", "class_id", "fn_id",
        F.col("text").alias("docstring"),
        (F.col("end_line") - F.col("start_line") + 1).alias("length"),
        (F.coalesce("all_parameters", F.lit(0)) - F.when(receiver, 1).otherwise(0)).alias("parameters"),
        F.coalesce("cyclomatic", F.lit(1)).alias("cyclomatic"),
        F.coalesce("nesting", F.lit(0)).alias("nesting"),
        F.coalesce("cognitive", F.lit(0)).alias("cognitive"),
        "tags", "params", "doc_params", "doc_returns", "doc_raises", "test_id",
    )
