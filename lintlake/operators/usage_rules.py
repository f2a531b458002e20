"""Rules on what declarations are for: unread parameters, unnamed exports, missing docstrings, empty bodies, wide classes, shell commands."""

from __future__ import annotations

import ast
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.operators import code_rules
from lintlake.operators.code import Part
from lintlake.operators.code_rules import KEY, _words, children
from lintlake.operators.declaration_rules import _last, framework_based, framework_decorated
from lintlake.operators.security_rules import found

#: Names that exempt declarations, and limits.
ABSTRACT = ("abstractmethod", "abstractclassmethod", "abstractstaticmethod", "abstractproperty")
DATACLASSES = ("dataclass", "define", "frozen", "attr", "attrs", "s")
SHAPED_BASES, TEST_DOUBLES = ("Rule", "SourceTextRule", "BaseHTTPRequestHandler"), ("dummy", "fake", "mock", "spy", "stub")
SHELL_CALLS = ("subprocess.run", "subprocess.call", "subprocess.check_call", "subprocess.check_output", "subprocess.Popen", "subprocess.getoutput", "subprocess.getstatusoutput")
SYSTEM_CALLS = ("os.system", "os.popen")
MAX_ATTRIBUTES, MAX_METHODS, MAX_CLASS = 15, 10, 1000
FUNCTION = "kind in ('FunctionDef', 'AsyncFunctionDef')"


def tagged(*names: str) -> Column:
    """Whether a decorator's last name is one of these."""
    return F.coalesce(F.exists("tags", lambda t: _last(t).isin(*names)), F.lit(False))


def test_class() -> Column:
    """Whether a class holds tests, by its name or a base's."""
    return F.col("name").startswith("Test") | F.coalesce(F.exists("bases", lambda b: b.endswith("TestCase")), F.lit(False))


def documented_as_test() -> Column:
    """Whether a path is of tests for the documentation rules."""
    path = F.lower(F.replace("path", F.lit("\\"), F.lit("/")))
    return path.startswith("tests/") | path.contains("/tests/") | path.rlike(r"^test_[^/]*\.py$")


def _classes_around(tree: DataFrame) -> DataFrame:
    """Per class what its functions ask of it: ``around_framework``, ``around_shaped``, ``around_name``."""
    shaped = F.coalesce(F.exists("bases", lambda b: _last(b).isin(*SHAPED_BASES)), F.lit(False))
    return tree.where("kind = 'ClassDef'").select(*KEY, F.col("node_id").alias("class_id"), framework_based().alias("around_framework"), shaped.alias("around_shaped"), F.col("name").alias("around_name"))


def empty_bodies(tree: DataFrame) -> DataFrame:
    """Functions of one ``pass`` or constant, after a docstring or alone."""
    return code_rules.empty_bodies(tree).where("n <= 2")


def unused_parameters(tree: DataFrame) -> DataFrame:
    """Parameters whose name nothing in the function's body mentions, at any depth; a leading ``self`` or ``cls`` and underscored ones aside.

    A name is in a body if it lies between the body's places, so that reads in
    functions below count, however deep. Abstract functions, overloads, functions with
    a framework's decorator and methods whose class prescribes signatures are left out.
    """
    functions = tree.where(FUNCTION).where(~framework_decorated() & ~tagged(*ABSTRACT, "overload")).join(_classes_around(tree), [*KEY, "class_id"], "left")
    functions = functions.where("not coalesce(around_framework or around_shaped, false)").select(*KEY, F.col("node_id").alias("fn_id"), "symbol", "end_line")
    bodies = tree.where("field = 'body'").groupBy(*KEY, F.col("parent_id").alias("fn_id")).agg(F.min("pre").alias("begin"), F.max("last").alias("until"))
    args = tree.where("kind = 'arg' and field in ('posonlyargs', 'args', 'kwonlyargs') and name not like '\\\\_%'")
    first = args.where("field in ('posonlyargs', 'args') and ord = 0").groupBy(*KEY, "fn_id").agg(F.min_by("name", F.when(F.col("field") == "posonlyargs", 0).otherwise(1)).alias("first"))
    params = args.join(first, [*KEY, "fn_id"], "left").where("not coalesce(name = first and name in ('self', 'cls'), false)").select(*KEY, "fn_id", "name", "line", F.col("node_id").alias("arg_id"))
    params = params.join(functions, [*KEY, "fn_id"]).join(bodies, [*KEY, "fn_id"])
    names = tree.where("kind = 'Name'").select(*KEY, "name", "pre")
    read = params.join(names, [*KEY, "name"]).where("pre between begin and until").select(*KEY, "arg_id").distinct()
    rows = params.join(read, [*KEY, "arg_id"], "left_anti")
    return found(rows, "waste.unused-parameter", "advisory", "medium", F.concat(F.lit("Parameter '"), "name", F.lit("' in '"), "symbol", F.lit("' is never referenced.")), "dead-code", F.col("symbol"))


def shell_calls(tree: DataFrame) -> DataFrame:
    """Commands that are no literals, run through a shell."""
    first = children(tree, "field = 'args' and ord = 0 and not (kind = 'Constant' and name = 'str')").select(*KEY, "node_id")
    calls = tree.where("kind = 'Call'").join(first, [*KEY, "node_id"], "left_semi")
    by_shell = calls.where(F.col("text").isin(*SHELL_CALLS)).join(children(tree, "kind = 'keyword' and name = 'shell' and text = 'True'"), [*KEY, "node_id"], "left_semi")
    rows = by_shell.withColumn("label", F.concat("text", F.lit("(..., shell=True)"))).unionByName(calls.where(F.col("text").isin(*SYSTEM_CALLS)).withColumn("label", F.concat("text", F.lit("(...)"))))
    return found(rows, "security.shell-injection", "error", "high", F.concat(F.lit("`"), "label", F.lit("` runs a non-literal command through a shell.")))


def unreferenced(tree: DataFrame, entry_points: tuple[str, ...] = (), allowed: DataFrame | None = None) -> DataFrame:
    """Public top-level functions and classes that nothing in their project uses; those of test files are none.

    Uses are names that are read, attributes, imports under another name, literals of
    ``getattr`` and names in quoted annotations. Those that a framework's decorator
    registers, that match an entry point pattern (``*``, ``?``) or that ``allowed``
    (project, name) lists are left out. It is meant for whole projects.
    """
    test_file = F.col("path").rlike(r"(^|/)tests/|(^|/)test_[^/]*$|_test\.py$|(^|/)conftest\.py$")
    patterns = ["^" + "".join({"*": ".*", "?": "."}.get(c, c if c.isalnum() or c == "_" else f"\\{c}") for c in p) + "$" for p in entry_points]
    entry = reduce(lambda a, b: a | b, [F.col("name").rlike(p) for p in patterns], F.lit(False))
    tops = tree.where("kind in ('FunctionDef', 'AsyncFunctionDef', 'ClassDef') and parent_id = 0 and name not like '\\\\_%'").where(~test_file & ~framework_decorated() & ~entry)
    read = tree.where("kind = 'Name' and text = 'Load' or kind = 'Attribute'").select("project", "name")
    renamed = tree.where("kind = 'alias' and (origin is not null and name != text or origin is null and name != split(text, '[.]')[0])").select("project", F.element_at(F.split("text", r"\."), -1).alias("name"))
    got = tree.where("kind = 'Constant' and name = 'str' and field = 'args' and ord = 1").join(tree.where("kind = 'Call' and text = 'getattr'").select(*KEY, F.col("node_id").alias("parent_id")), [*KEY, "parent_id"], "left_semi").select("project", F.col("text").alias("name"))
    # a text inside an annotation counts by the names in it
    notes = tree.where("field in ('annotation', 'returns')").select(*KEY, F.col("pre").alias("begin"), F.col("last").alias("until"))
    quoted = tree.where("kind = 'Constant' and name = 'str'").select(*KEY, "pre", "text").join(notes, list(KEY)).where("pre between begin and until").select("project", F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-z_][A-Za-z0-9_]*"), F.lit(0))).alias("name"))
    used = read.unionByName(renamed).unionByName(got).unionByName(quoted).distinct()
    rows = tops.join(used, ["project", "name"], "left_anti")
    rows = rows if allowed is None else rows.join(allowed, ["project", "name"], "left_anti")
    kind = F.when(F.col("kind") == "ClassDef", "class").otherwise("function")
    message = F.concat(F.lit("Public "), kind, F.lit(" '"), "name", F.lit("' has no reference beyond its definition, __all__ membership, and re-export imports in this full-project scan; it needs a caller, an entry-point registration, or removal."))
    return found(rows, "dead-code.exported-but-unreferenced", "advisory", "medium", message, "dead-code", F.col("name"))


def missing_docstrings(tree: DataFrame) -> DataFrame:
    """Modules, classes and public functions that say nothing of themselves, but for those whose meaning is elsewhere."""
    bare = tree.where("text is null")
    # a package file of nothing but imports and __all__
    plain = tree.where("field = 'body' and parent_id = 0 and kind not in ('Import', 'ImportFrom')").where("not (kind = 'Assign' and context = '=__all__')")
    noted = tree.where("kind = 'Name' and name = '__all__' and field = 'target'").select(*KEY, F.col("parent_id").alias("node_id"))
    shims = plain.join(noted, [*KEY, "node_id"], "left_anti").select(*KEY).distinct()
    modules = bare.where("kind = 'Module' and n > 0").where(~documented_as_test()).withColumns({"line": F.lit(1), "end_line": F.lit(None).cast("int")})
    modules = modules.where(~F.col("path").endswith("__init__.py")).unionByName(modules.where(F.col("path").endswith("__init__.py")).join(shims, list(KEY), "left_semi"))
    out = found(modules, "docs.missing-module-docstring", "advisory", "medium", "Module needs a top-of-file docstring describing its purpose.", "documentation")
    dunder = F.col("name").rlike("^__.*__$")
    needs = lambda what: F.concat(F.lit(f"{what} '"), "symbol", F.lit("' needs a brief intent description in its docstring."))
    classes = bare.where("kind = 'ClassDef'").where(~dunder & ~framework_based() & ~tagged(*DATACLASSES))
    out = out.unionByName(found(classes, "docs.missing-class-docstring", "warning", "high", needs("Class"), "documentation", F.col("symbol")))
    functions = bare.where(FUNCTION).where(~F.col("name").startswith("_") & ~(F.col("name").startswith("test_") & documented_as_test()))
    accessor = F.coalesce(F.exists("tags", lambda t: t.contains(".") & _last(t).isin("setter", "deleter")), F.lit(False))
    functions = functions.where(~tagged(*ABSTRACT, "overload") & ~accessor).join(_classes_around(tree), [*KEY, "class_id"], "left")
    stubs = empty_bodies(tree).select(*KEY, "node_id", F.lit(True).alias("empty"))
    functions = functions.join(stubs, [*KEY, "node_id"], "left").where("not coalesce(around_framework and empty, false)")
    # functions inside functions that are named once at most outside themselves
    inner = functions.where("test_id is not null").select(*KEY, "node_id", "name", F.col("test_id").alias("outer"), F.col("pre").alias("begin"), F.col("last").alias("until"))
    outer = tree.where(FUNCTION).select(*KEY, F.col("node_id").alias("outer"), F.col("pre").alias("outer_begin"), F.col("last").alias("outer_until"))
    uses = inner.join(outer, [*KEY, "outer"]).join(tree.where("kind = 'Name'").select(*KEY, "name", "pre"), [*KEY, "name"], "left")
    outside = (F.col("pre") > F.col("outer_begin")) & (F.col("pre") <= F.col("outer_until")) & ~F.col("pre").between(F.col("begin"), F.col("until"))
    single = uses.groupBy(*KEY, "node_id").agg(F.count_if(outside).alias("uses")).where("uses <= 1").select(*KEY, "node_id")
    functions = functions.join(single, [*KEY, "node_id"], "left_anti")
    return out.unionByName(found(functions, "docs.missing-function-docstring", "warning", "high", needs("Function"), "documentation", F.col("symbol")))


_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)


def _read_alone(read: str | tuple) -> bool:
    """Whether statements tell all of a unit: not if a function is in a function, whose mentions count."""
    return isinstance(read, str) or not (read[2] in ("FunctionDef", "AsyncFunctionDef") and read[15] is not None)


def _said(node: ast.AST, field: str, place: int, up: tuple, around: ast.ClassDef | None) -> bool:
    """Whether ``missing_docstrings`` reads a node for where it stands: what a module holds, and short bodies of methods of classes with bases."""
    parent = up[0]
    if field == "body":
        if isinstance(parent, ast.Module):
            return not isinstance(node, (ast.Import, ast.ImportFrom))
        return isinstance(parent, _FUNCTIONS) and around is not None and bool(around.bases) and len(parent.body) <= 2
    if field == "value":
        return isinstance(node, ast.Constant) and isinstance(parent, ast.Expr) and around is not None and bool(around.bases)
    return field == "target" and isinstance(node, ast.Name) and node.id == "__all__"


def _function_names(nodes: Iterable[ast.AST]) -> set[str]:
    return {node.name for node in nodes if isinstance(node, _FUNCTIONS)}


#: What ``missing_docstrings`` reads.
DOCSTRINGS = Part(
    "docstrings", frozenset(("Module", "ClassDef", "FunctionDef", "AsyncFunctionDef")),
    ("node_id", "parent_id", "kind", "field", "ord", "name", "text", "n", "line", "end_line", "class_id", "symbol", "test_id", "tags", "bases", "context", "pre", "last"),
    wanted=_said, names=_function_names, placed=True, light=_read_alone,
)


def _by_names(read: str | tuple) -> bool:
    """Whether a unit's names tell all that it uses: not with ``getattr``, which other letters may spell as well."""
    return not isinstance(read, str) or read.isascii() and "getattr" not in read


def _uses(node: ast.AST, field: str, place: int, up: tuple, around: ast.ClassDef | None) -> bool:
    """Whether ``unreferenced`` reads a node: what a module defines, names, attributes, texts, annotations, calls of ``getattr``."""
    match node:
        case ast.FunctionDef() | ast.AsyncFunctionDef() | ast.ClassDef():
            return isinstance(up[0], ast.Module)
        case ast.Name() | ast.Attribute():
            return True
        case ast.Constant(value=str()) | ast.Call(func=ast.Name(id="getattr")):
            return True
    return field in ("annotation", "returns")


#: What ``unreferenced`` reads.
USES = Part("uses", frozenset(("alias",)), ("node_id", "parent_id", "kind", "field", "ord", "name", "text", "line", "end_line", "tags", "origin", "pre", "last"), wanted=_uses, placed=True, light=_by_names, once=True)


def empty_functions(tree: DataFrame) -> DataFrame:
    """Functions of ``pass`` and constants only, but for abstract ones, overloads, stubs of protocols, framework hooks and methods of test doubles."""
    rows = empty_bodies(tree).where(~framework_decorated() & ~tagged(*ABSTRACT, "overload")).join(_classes_around(tree), [*KEY, "class_id"], "left").where("not coalesce(around_framework, false)")
    test_path = F.col("path").startswith("tests/") | F.col("path").contains("/tests/") | F.col("path").rlike(r"(^|/)test_[^/]*$")
    double = F.coalesce(F.arrays_overlap(_words("around_name"), F.array(*map(F.lit, TEST_DOUBLES))), F.lit(False))
    return found(rows.where(~(test_path & double)), "waste.empty-function", "warning", "high", F.concat(F.lit("Function '"), "symbol", F.lit("' has an empty body.")), "dead-code", F.col("symbol"))


def _wide(tree: DataFrame, counts: DataFrame, column: str, threshold: int, rule: str, text: str, what: str) -> DataFrame:
    """Classes that are no tests, schemas or data classes, with a count over the threshold."""
    rows = tree.where("kind = 'ClassDef'").where(~test_class() & ~framework_based() & ~tagged(*DATACLASSES)).join(counts.where(F.col(column) > threshold), [*KEY, "node_id"])
    message = F.concat(F.lit("Class '"), "symbol", F.lit(f"' {text} "), F.col(column).cast("string"), F.lit(f" {what}, above the error threshold of {threshold}."))
    return found(rows, rule, "error", "high", message, "size", F.col("symbol"))


def attribute_counts(tree: DataFrame, threshold: int = MAX_ATTRIBUTES) -> DataFrame:
    """Names that a class's body assigns and attributes of ``self`` that its ``__init__`` does, at any depth, each once."""
    top = tree.where("kind in ('Assign', 'AnnAssign') and field = 'body' and class_id = parent_id").select(*KEY, F.col("node_id").alias("parent_id"), "class_id")
    body = tree.where("kind = 'Name' and store and field in ('targets', 'target')").drop("class_id").join(top, [*KEY, "parent_id"]).select(*KEY, F.col("class_id").alias("node_id"), "name")
    inits = tree.where(FUNCTION).where("name = '__init__' and class_id = parent_id").select(*KEY, F.col("class_id").alias("of"), F.col("pre").alias("begin"), F.col("last").alias("until"))
    stored = tree.where("kind = 'Attribute' and store and text rlike '^self[.][^.]+$' and field in ('targets', 'target', 'elts')").select(*KEY, "name", "pre")
    own = stored.join(inits, list(KEY)).where("pre between begin and until").select(*KEY, F.col("of").alias("node_id"), "name")
    counts = body.unionByName(own).distinct().groupBy(*KEY, "node_id").agg(F.count(F.lit(1)).alias("attributes"))
    return _wide(tree, counts, "attributes", threshold, "size.attribute-count", "declares", "attributes")


def _many_functions(source: str) -> bool:
    return source.count("def") > MAX_METHODS


#: What a count of methods over the threshold reads: nothing of a module with no more functions than that.
METHODS = Part("methods", frozenset(("ClassDef", "FunctionDef", "AsyncFunctionDef")), like=_many_functions)


def public_methods(tree: DataFrame, threshold: int = MAX_METHODS) -> DataFrame:
    """Functions in a class's body whose names don't begin with an underscore."""
    counts = tree.where(FUNCTION).where("field = 'body' and class_id = parent_id and name not like '\\\\_%'").groupBy(*KEY, F.col("class_id").alias("node_id")).agg(F.count(F.lit(1)).alias("methods"))
    return _wide(tree, counts, "methods", threshold, "size.public-method-count", "has", "public methods")


def long_classes(tree: DataFrame, threshold: int = MAX_CLASS) -> DataFrame:
    n = F.col("end_line") - F.col("start_line") + 1
    rows = tree.where("kind = 'ClassDef'").where(n > threshold).withColumn("line", F.col("start_line"))
    return found(rows, "size.class-length", "error", "high", F.concat(F.lit("Class '"), "symbol", F.lit("' is "), n.cast("string"), F.lit(f" lines, above the error threshold of {threshold}.")), "size", F.col("symbol"))


RULES = (unused_parameters, shell_calls, unreferenced, missing_docstrings, empty_functions, attribute_counts, public_methods, long_classes)


def all_rules(tree: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [rule(tree) for rule in RULES])
