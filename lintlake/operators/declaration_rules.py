"""Rules on functions and classes as wholes: measures, docstrings against signatures, needless code, unread attributes."""

from __future__ import annotations

import ast
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.operators.code import MEASURES, NODES, Part, _dotted
from lintlake.operators.code_rules import KEY, _words, children
from lintlake.operators.security_rules import found

#: Names that exempt declarations, and limits.
FRAMEWORK_DECORATORS = (
    "fixture", "parametrize", "mark", "command", "group", "option", "argument", "route", "get", "post", "put", "delete", "patch", "head", "options", "websocket", "on_event", "before_request", "after_request",
    "teardown_request", "teardown_appcontext", "errorhandler", "context_processor", "register", "listens_for", "abstractmethod", "abstractclassmethod", "abstractstaticmethod", "abstractproperty", "overload",
    "override", "final", "property", "setter", "getter", "deleter", "dataclass", "attr", "attrs", "define", "cache", "lru_cache",
)
FRAMEWORK_BASES = ("Protocol", "ABC", "ABCMeta", "TypedDict", "NamedTuple", "Enum", "IntEnum", "StrEnum", "Flag", "BaseModel", "RootModel")
MARKER_BASES = ("BaseException", "Exception", "Rule", "SourceTextRule")
EXCEPTION_ENDS = ("Error", "Exception", "Warning")
COGNITIVE, LEAST_METHODS, AVERAGE_LENGTH, VOLUME, INDEX = 30, 3, 100, 400, 70


def _last(name: Column) -> Column:
    return F.element_at(F.split(name, r"\."), -1)


def framework_decorated() -> Column:
    """Whether a decorator's name, or a part of its dotted name, is a framework's."""
    return F.coalesce(F.exists("tags", lambda t: _last(t).isin(*FRAMEWORK_DECORATORS) | F.arrays_overlap(F.split(t, r"\."), F.array(F.lit("mark")))), F.lit(False))


def framework_based() -> Column:
    return F.coalesce(F.exists("bases", lambda b: _last(b).isin(*FRAMEWORK_BASES)), F.lit(False))


def _function(text: str, *more: Column | str) -> Column:
    return F.concat(F.lit("Function '"), "symbol", F.lit("'"), F.lit(text), *more)


def halstead(tree: DataFrame) -> DataFrame:
    """Per function its Halstead volume: operators and operands of operator expressions, counted and counted distinct.

    Operands of an operator are names and constants, and calls, attributes and
    subscripts as wholes; further operators below count on their own.
    """
    roots = tree.where("operators is not null and fn_id is not null").select(*KEY, "fn_id", F.explode("operators").alias("token"), F.lit("o").alias("role"))
    leaves = tree.where("operand is not null and fn_id is not null").select(*KEY, "fn_id", F.col("operand").alias("token"), F.lit("n").alias("role"))
    counts = roots.unionByName(leaves).groupBy(*KEY, F.col("fn_id").alias("node_id"), "role", "token").agg(F.count(F.lit(1)).alias("times"))
    sums = counts.groupBy(*KEY, "node_id").agg(F.sum("times").alias("length"), F.count(F.lit(1)).alias("vocabulary"))
    return sums.select(*KEY, "node_id", F.when(F.col("vocabulary") > 1, F.col("length") * F.log2(F.col("vocabulary"))).otherwise(0.0).alias("volume"))


def measured(functions: DataFrame, tree: DataFrame) -> DataFrame:
    """Functions with ``volume`` and ``maintainability`` (0 to 100)."""
    rows = functions.join(halstead(tree), [*KEY, "node_id"], "left").withColumn("volume", F.coalesce("volume", F.lit(0.0)))
    raw = 171 - 5.2 * F.when(F.col("volume") > 0, F.log("volume")).otherwise(0.0) - 0.23 * F.col("cyclomatic") - 16.2 * F.log(F.greatest("length", F.lit(1)))
    return rows.withColumn("maintainability", F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw)))


def cognitive(functions: DataFrame, threshold: int = COGNITIVE) -> DataFrame:
    rows = functions.where(F.col("cognitive") > threshold)
    return found(rows, "complexity.cognitive", "error", "high", _function(" has cognitive complexity ", F.col("cognitive").cast("string"), F.lit(f", above the error threshold of {threshold}.")), "complexity", F.col("symbol"))


def volumes(measures: DataFrame, threshold: int = VOLUME) -> DataFrame:
    rows = measures.where(F.col("volume") > threshold)
    return found(rows, "complexity.halstead-volume", "error", "medium", _function(" has Halstead volume ", F.format_string("%.0f", "volume"), F.lit(f", above the error threshold of {threshold}.")), "complexity", F.col("symbol"))


def hard_to_maintain(measures: DataFrame, threshold: int = INDEX) -> DataFrame:
    rows = measures.where(F.col("maintainability") < threshold)
    return found(rows, "complexity.maintainability-index", "error", "medium", _function(" has maintainability index ", F.format_string("%.1f", "maintainability"), F.lit(f", below the error threshold of {threshold}.")), "maintainability", F.col("symbol"))


def average_lengths(functions: DataFrame, tree: DataFrame, threshold: int = AVERAGE_LENGTH) -> DataFrame:
    own = functions.where("kind != 'Lambda' and class_id = parent_id").groupBy(*KEY, F.col("class_id").alias("node_id")).agg(F.avg("length").alias("mean"), F.count(F.lit(1)).alias("methods"))
    rows = tree.where("kind = 'ClassDef'").join(own.where((F.col("methods") >= LEAST_METHODS) & (F.col("mean") > threshold)), [*KEY, "node_id"])
    message = F.concat(F.lit("Class '"), "symbol", F.lit("' averages "), F.format_string("%.1f", "mean"), F.lit(" lines per method (over "), F.col("methods").cast("string"), F.lit(f" methods), above the error threshold of {threshold}."))
    return found(rows, "size.average-function-length", "error", "high", message, "size", F.col("symbol"))


# --- docstrings against signatures -----------------------------------------------------------------


def _documented(functions: DataFrame) -> DataFrame:
    """Public functions with a docstring, without overloads, setters and deleters."""
    exempt = F.exists("tags", lambda t: _last(t).isin("overload", "setter", "deleter"))
    return functions.where("kind != 'Lambda' and docstring is not null").where(~F.coalesce(exempt, F.lit(False)))


def _public(rows: DataFrame) -> DataFrame:
    return rows.where("name not like '\\\\_%'")


def _signature() -> Column:
    """Parameter names without a leading self or cls."""
    return F.when(F.try_element_at("params", F.lit(1)).isin("self", "cls"), F.slice("params", 2, F.greatest(F.size("params") - 1, F.lit(0)))).otherwise(F.col("params"))


def missing_param_docs(functions: DataFrame) -> DataFrame:
    """One finding if no parameter is described, else one for each that isn't; underscored ones aside."""
    described = F.transform("doc_params", lambda p: F.ltrim(p, F.lit("*")))
    missing = F.array_except(F.filter(_signature(), lambda p: ~p.startswith("_")), described)
    rows = _public(_documented(functions)).withColumn("missing", missing).where(F.size("missing") > 0)
    every = found(rows.where(F.size("doc_params") == 0), "docs.missing-param-doc", "advisory", "medium", _function(" needs docstring entries describing its ", F.size("missing").cast("string"), F.lit(" parameter(s).")), "documentation", F.col("symbol"))
    single = rows.where(F.size("doc_params") > 0).withColumn("param", F.explode("missing"))
    return every.unionByName(found(single, "docs.missing-param-doc", "advisory", "medium", _function(" needs a docstring entry describing parameter '", "param", F.lit("'.")), "documentation", F.col("symbol")))


def stale_param_docs(functions: DataFrame) -> DataFrame:
    rows = _documented(functions).withColumns({"described": F.explode("doc_params"), "names": _signature()}).where(~F.array_contains("names", F.ltrim("described", F.lit("*"))))
    return found(rows, "docs.stale-param-doc", "warning", "high", _function(" docstring documents parameter '", "described", F.lit("', which is not in the signature.")), "documentation", F.col("symbol"))


def missing_raises_docs(functions: DataFrame, tree: DataFrame) -> DataFrame:
    raising = tree.where("kind = 'Raise'").select(*KEY, F.col("test_id").alias("node_id")).distinct()
    rows = _public(_documented(functions)).where("not doc_raises").join(raising, [*KEY, "node_id"], "left_semi")
    return found(rows, "docs.missing-raises-doc", "advisory", "low", _function(" raises exceptions and needs a Raises section in its docstring."), "documentation", F.col("symbol"))


def missing_return_docs(functions: DataFrame, tree: DataFrame) -> DataFrame:
    returns = children(tree, "field = 'returns' and not (kind = 'Constant' and text = 'None')").select(*KEY, "node_id")
    rows = _public(_documented(functions)).where("not doc_returns").join(returns, [*KEY, "node_id"], "left_semi")
    return found(rows, "docs.missing-return-doc", "advisory", "medium", _function(" returns a non-None value and needs a Returns section in its docstring."), "documentation", F.col("symbol"))


# --- needless code --------------------------------------------------------------------------------


def empty_classes(tree: DataFrame) -> DataFrame:
    """Classes with nothing but ``pass`` and constants, unless their bases or decorators give them meaning."""
    constants = tree.where("kind = 'Expr'").join(children(tree, "kind = 'Constant' and field = 'value'"), [*KEY, "node_id"], "left_semi").select(*KEY, "node_id")
    statements = tree.where("field = 'body' and kind != 'Pass'").join(constants, [*KEY, "node_id"], "left_anti").select(*KEY, F.col("parent_id").alias("node_id"))
    marker = F.exists("bases", lambda b: b.isin(*MARKER_BASES) | reduce(lambda x, y: x | y, [b.endswith(e) for e in EXCEPTION_ENDS]) | _last(b).isin(*MARKER_BASES))
    rows = tree.where("kind = 'ClassDef'").join(statements, [*KEY, "node_id"], "left_anti").where(~framework_based() & ~marker & ~framework_decorated())
    return found(rows, "waste.empty-class", "advisory", "high", F.concat(F.lit("Class '"), "symbol", F.lit("' has an empty body.")), "dead-code", F.col("symbol"))


def pass_through_functions(functions: DataFrame, tree: DataFrame) -> DataFrame:
    """Functions whose only statement returns a call with just their own positional parameters, in order."""
    single = tree.where("kind = 'Return' and field = 'body' and ord = 0").select(*KEY, F.col("parent_id").alias("of"), F.col("node_id").alias("parent_id"))
    call = tree.where("kind = 'Call' and field = 'value'").select(*KEY, "parent_id", F.col("node_id").alias("call_id"), F.col("n").alias("given"))
    passed = tree.where("field = 'args' and kind = 'Name'").groupBy(*KEY, F.col("parent_id").alias("call_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda x: x["name"]).alias("names"))
    named = tree.where("kind = 'keyword'").select(*KEY, F.col("parent_id").alias("call_id")).distinct()
    shape = single.join(call, [*KEY, "parent_id"]).join(passed, [*KEY, "call_id"], "left").join(named, [*KEY, "call_id"], "left_anti").select(*KEY, F.col("of").alias("node_id"), "given", F.coalesce("names", F.array().cast("array<string>")).alias("names"))
    starred = tree.where("kind = 'arg' and field in ('vararg', 'kwonlyargs')").select(*KEY, F.col("fn_id").alias("node_id")).distinct()
    keyworded = tree.where("kind = 'arg' and field = 'kwarg'").select(*KEY, F.col("fn_id").alias("node_id"), F.col("name").alias("rest"))
    lengths = tree.where("kind in ('FunctionDef', 'AsyncFunctionDef') and n = 1").select(*KEY, "node_id")
    rows = functions.join(lengths, [*KEY, "node_id"], "left_semi").join(shape, [*KEY, "node_id"]).join(starred, [*KEY, "node_id"], "left_anti").join(keyworded, [*KEY, "node_id"], "left")
    positional = F.when(F.col("rest").isNull(), _signature()).otherwise(F.array_remove(_signature(), F.col("rest")))
    rows = rows.where(~framework_decorated()).where((F.col("given") == F.size("names")) & (F.col("names") == positional))
    return found(rows, "waste.one-line-function", "advisory", "medium", _function(" is a thin wrapper that forwards its arguments to a single call with no other work."), "dead-code", F.col("symbol"))


def redundant_variables(functions: DataFrame, tree: DataFrame) -> DataFrame:
    """A name that the last statement but one assigns and the last returns, and that no earlier statement mentions."""
    last = tree.where("kind in ('FunctionDef', 'AsyncFunctionDef') and n >= 2").select(*KEY, F.col("node_id").alias("parent_id"), "n")
    body = tree.where("field = 'body'").select(*KEY, "node_id", "parent_id", "kind", "ord", "line", "end_line", "context", "pre").join(last, [*KEY, "parent_id"])
    assigned = body.where("kind = 'Assign' and ord = n - 2 and context rlike '^=[^,]+$'").select(*KEY, F.col("parent_id").alias("of"), F.col("node_id").alias("at"), F.col("pre").alias("assigned_at"), "line", "end_line", F.expr("substring(context, 2)").alias("var"))
    one = tree.where("field = 'targets'").groupBy(*KEY, F.col("parent_id").alias("at")).agg(F.count(F.lit(1)).alias("targets"), F.max("kind").alias("target_kind")).where("targets = 1 and target_kind = 'Name'")
    returned = body.where("kind = 'Return' and ord = n - 1").select(*KEY, F.col("parent_id").alias("of"), F.col("node_id").alias("back"))
    value = tree.where("kind = 'Name' and field = 'value'").select(*KEY, F.col("parent_id").alias("back"), F.col("name").alias("var"))
    pairs = assigned.join(one.select(*KEY, "at"), [*KEY, "at"], "left_semi").join(returned.join(value, [*KEY, "back"]), [*KEY, "of", "var"])
    # any mention in the statements before the assignment, in the function or in functions within it
    mentions = tree.where("kind = 'Name' and test_id is not null").select(*KEY, F.col("name").alias("var"), F.col("pre").alias("named_at"))
    begins = tree.where("field = 'body' and ord = 0").select(*KEY, F.col("parent_id").alias("of"), F.col("pre").alias("begins"))
    cases = pairs.join(functions.where("kind != 'Lambda'").select(*KEY, F.col("node_id").alias("of"), "symbol"), [*KEY, "of"])
    used = cases.join(begins, [*KEY, "of"]).join(mentions, [*KEY, "var"]).where("named_at >= begins and named_at < assigned_at").select(*KEY, "of").distinct()
    rows = cases.join(used, [*KEY, "of"], "left_anti")
    return found(rows, "waste.redundant-variable", "advisory", "high", _function(": variable '", "var", F.lit("' is assigned once and immediately returned; inline the expression.")), "dead-code", F.col("symbol"))


def unread_private_attributes(tree: DataFrame) -> DataFrame:
    """``self._name`` that a class stores and never reads, by anti-join of its stores with its loads; properties aside."""
    classes = tree.where("kind = 'ClassDef'").where(~framework_based() & ~F.coalesce(F.exists("tags", lambda t: _last(t).isin("dataclass", "attrs", "define")), F.lit(False)))
    own = tree.where("kind = 'Attribute' and text rlike '^self[.][^.]+$' and class_id is not null").select(*KEY, "class_id", "name", "store", "line", "end_line", "node_id")
    loads = own.where("not store").select(*KEY, "class_id", "name").distinct()
    stores = own.where("store and name like '\\\\_%'").groupBy(*KEY, "class_id", "name").agg(F.min_by(F.struct("line", "end_line"), "node_id").alias("at"))
    properties = tree.where("kind in ('FunctionDef', 'AsyncFunctionDef')").where(F.exists("tags", lambda t: _last(t) == "property")).select(*KEY, "class_id", F.col("name").alias("plain"))
    rows = stores.join(loads, [*KEY, "class_id", "name"], "left_anti").withColumn("plain", F.ltrim("name", F.lit("_"))).join(properties, [*KEY, "class_id", "plain"], "left_anti")
    rows = rows.join(classes.select(*KEY, F.col("node_id").alias("class_id"), F.col("symbol").alias("of")), [*KEY, "class_id"]).select(*KEY, "name", "of", "at.line", "at.end_line")
    return found(rows, "dead-code.unused-private-attribute", "warning", "medium", F.concat(F.lit("Class '"), "of", F.lit("' assigns '"), "name", F.lit("' but never reads it.")), "dead-code", F.concat("of", F.lit("."), "name"))


#: What marks a name as that of a truth value.
BOOLEAN_PREFIXES = (
    "accepts", "allows", "are", "can", "check", "checks", "contains", "did", "do", "does", "expects", "has", "is", "looks", "matches", "must", "needs", "produces", "requires", "returns", "should", "supports",
    "uses", "validates", "was", "will",
)
BOOLEAN_VERBS = ("affirms", "declines", "matches")
BOOLEAN_ADJECTIVES = (
    "active", "applicable", "available", "default", "disabled", "empty", "enabled", "excluded", "frozen", "included", "interactive", "invalid", "optional", "present", "ready", "required", "valid", "verbose",
    "visible",
)
BOOLEAN_STARTS, BOOLEAN_ENDS = ("exclude_", "include_", "no_", "with_", "without_"), ("_bool", "_disabled", "_enabled", "_flag", "_optional", "_required")
ACCEPTED_BOOLEANS = ("all", "apply", "check", "dev", "enabled", "force", "fresh", "harness", "json", "ok", "verbose", "yes")
SCHEMA_BASES = ("BaseModel", "TypedDict", "NamedTuple", "Enum", "IntEnum", "StrEnum", "Flag", "IntFlag")


def _truthful() -> Column:
    """Whether a name says that it is a truth value, or has no word at all."""
    low = F.lower(F.ltrim("name", F.lit("_")))
    words = _words()
    ends = reduce(lambda a, b: a | b, [low.endswith(e) for e in BOOLEAN_ENDS])
    starts = reduce(lambda a, b: a | b, [low.startswith(e) for e in BOOLEAN_STARTS])
    first, last = F.try_element_at(words, F.lit(1)), F.try_element_at(words, F.lit(-1))
    known = low.isin(*ACCEPTED_BOOLEANS, *BOOLEAN_PREFIXES, *BOOLEAN_ADJECTIVES) | first.isin(*BOOLEAN_PREFIXES) | last.isin(*BOOLEAN_ADJECTIVES, *BOOLEAN_VERBS)
    return (F.size(words) > 0) & (known | starts | ends)


def unclear_booleans(tree: DataFrame) -> DataFrame:
    """Functions and attributes annotated with ``bool`` whose name doesn't say so; tests, constants, schema fields and overrides aside."""
    quoted = tree.where("kind = 'Constant' and text = 'bool' and field in ('annotation', 'returns')")
    named = tree.where("kind = 'Name' and name = 'bool'").select(*KEY, F.col("pre").alias("place")).unionByName(quoted.select(*KEY, F.col("pre").alias("place")))
    spots = tree.where("field in ('returns', 'annotation')").select(*KEY, F.col("parent_id").alias("node_id"), F.col("pre").alias("begins"), F.col("last").alias("ends"))
    boolean = spots.join(named, list(KEY)).where("place between begins and ends").select(*KEY, "node_id").distinct()
    dunder = "name like '\\_\\_%\\_\\_' and length(name) > 4"
    override = F.coalesce(F.exists("tags", lambda t: _last(t) == "override"), F.lit(False))
    functions = tree.where(f"kind in ('FunctionDef', 'AsyncFunctionDef') and not ({dunder})").where(~override).select(*KEY, "node_id", "name", "line", F.lit("Function").alias("what"))
    schemas = tree.where("kind = 'ClassDef'").where(F.exists("bases", lambda b: _last(b).isin(*SCHEMA_BASES)) | F.exists("tags", lambda t: _last(t).isin("dataclass", "attrs", "define"))).select(*KEY, F.col("node_id").alias("parent_id"))
    targets = tree.where("kind = 'Name' and field = 'target'").select(*KEY, F.col("parent_id").alias("node_id"), "name", "line")
    attributes = tree.where("kind = 'AnnAssign'").select(*KEY, "node_id", "parent_id", "fn_id").join(schemas, [*KEY, "parent_id"], "left_anti").join(targets, [*KEY, "node_id"])
    attributes = attributes.where(f"not ({dunder}) and not name rlike '^[A-Z][A-Z0-9_]*$'").select(*KEY, "node_id", "name", "line", F.lit("Attribute").alias("what"))
    tests = F.lower("path").rlike(r"(^|/)tests/|^test_[^/]*\.py$")
    rows = functions.unionByName(attributes).where(~tests & ~_truthful()).join(boolean, [*KEY, "node_id"], "left_semi").withColumn("end_line", F.col("line"))
    message = F.concat("what", F.lit(" '"), "name", F.lit("' returns / is bool but lacks a boolean-intent prefix (is_, has_, can_, should_, was_, did_, will_, must_, needs_)."))
    return found(rows, "naming.boolean-prefix", "advisory", "medium", message, "naming", F.col("name"))


def unused_private_functions(tree: DataFrame) -> DataFrame:
    """Private functions that nothing in their class, or module, names outside themselves: an interval anti-join by name."""
    classes = tree.where("kind = 'ClassDef'").select(*KEY, F.col("node_id").alias("class_id"), F.col("pre").alias("from_place"), F.col("last").alias("to_place"), framework_based().alias("framework"))
    lists = tree.where("kind = 'Assign' and context = '=__all__'").select(*KEY, F.col("node_id").alias("parent_id"))
    listed = tree.where("kind in ('List', 'Tuple') and field = 'value'").join(lists, [*KEY, "parent_id"], "left_semi").select(*KEY, F.col("node_id").alias("parent_id"))
    exported = tree.where("kind = 'Constant' and field = 'elts'").join(listed, [*KEY, "parent_id"], "left_semi").select(*KEY, F.col("text").alias("name"))
    defs = tree.where("kind in ('FunctionDef', 'AsyncFunctionDef') and name like '\\_%' and not (name like '\\_\\_%\\_\\_' and length(name) > 4)").where(~framework_decorated())
    rows = defs.join(classes, [*KEY, "class_id"], "left").where("not coalesce(framework, false)").join(exported, [*KEY, "name"], "left_anti")
    looked_up = tree.where("kind = 'Call' and text = 'getattr'").select(*KEY, F.col("node_id").alias("parent_id"))
    second = tree.where("field = 'args' and ord = 1").join(looked_up, [*KEY, "parent_id"], "left_semi")
    literal = second.where("kind = 'Constant' and name = 'str'").select(*KEY, F.col("text").alias("name"), F.col("pre").alias("place"))
    refs = tree.where("kind in ('Name', 'Attribute')").select(*KEY, "name", F.col("pre").alias("place")).unionByName(literal)
    outside = "place between coalesce(from_place, 0) and coalesce(to_place, place) and not place between pre and last"
    named = rows.join(refs, [*KEY, "name"]).where(outside).select(*KEY, "node_id").distinct()
    begins = tree.where("kind = 'Constant' and field = 'values' and ord = 0 and length(text) >= 3").select(*KEY, F.col("parent_id").alias("node_id"), F.col("text").alias("prefix"))
    built = second.where("kind = 'JoinedStr'").select(*KEY, "node_id", F.col("pre").alias("place")).join(begins, [*KEY, "node_id"]).select(*KEY, "prefix", "place")
    guessed = rows.join(built, list(KEY)).where("startswith(name, prefix)").where(outside).select(*KEY, "node_id").distinct()
    unused = rows.join(named, [*KEY, "node_id"], "left_anti").join(guessed, [*KEY, "node_id"], "left_anti")
    return found(unused, "dead-code.unused-private-function", "warning", "medium", F.concat(F.lit("Private function '"), "symbol", F.lit("' is never called in its enclosing scope.")), "dead-code", F.col("symbol"))


def path_mutations(tree: DataFrame) -> DataFrame:
    """Changes of ``sys.path`` outside tests and outside the body of a main guard (an interval anti-join within the file)."""
    rows = tree.where("kind = 'Call' and text in ('sys.path.insert', 'sys.path.append')").where("not path rlike '(^|/)tests/' and not path rlike '(^|/)conftest[.]py$'")
    names = children(tree, "kind = 'Name' and name = '__name__'").select(*KEY, "node_id")
    mains = children(tree, "kind = 'Constant' and text = '__main__'").select(*KEY, "node_id")
    tests = tree.where("kind = 'Compare'").join(names, [*KEY, "node_id"], "left_semi").join(mains, [*KEY, "node_id"], "left_semi")
    direct = tests.where("field = 'test'").select(*KEY, F.col("parent_id").alias("of"))
    joined = tree.where("kind = 'BoolOp' and field = 'test' and name = 'And'").join(tests.where("field = 'values'").select(*KEY, F.col("parent_id").alias("node_id")), [*KEY, "node_id"], "left_semi").select(*KEY, F.col("parent_id").alias("of"))
    body = tree.where("field = 'body'").select(*KEY, F.col("parent_id").alias("of"), F.col("pre").alias("begins"), F.col("last").alias("ends")).join(direct.unionByName(joined), [*KEY, "of"], "left_semi")
    outside = rows.join(body.select(*KEY, "begins", "ends"), (rows["project"] == body["project"]) & (rows["path"] == body["path"]) & (rows["pre"] >= body["begins"]) & (rows["pre"] <= body["ends"]), "left_anti")
    first = tree.where("kind = 'Constant' and name = 'int' and field = 'args' and ord = 0 and text = '0'").select(*KEY, F.col("parent_id").alias("node_id"), F.lit(True).alias("front"))
    shadows = "`sys.path.insert(0, ...)` at runtime shadows every later top-level import for the whole process; one colliding filename in that directory breaks the host application. Imports need packaging, not path surgery."
    other = F.concat(F.lit("`"), "text", F.lit("(...)` at runtime makes imports depend on execution order; the import layout needs packaging (editable install or src layout) instead."))
    return found(outside.join(first, [*KEY, "node_id"], "left"), "design.runtime-sys-path-mutation", "advisory", "high", F.when((F.col("text") == "sys.path.insert") & F.col("front"), shadows).otherwise(other), "design")


_LOOKED_UP = ("getattr", "sys.path.insert", "sys.path.append")


def _looks_up(node: ast.AST) -> bool:
    """Whether a node is a call of one of the functions whose arguments are read."""
    return isinstance(node, ast.Call) and _dotted(node.func) in _LOOKED_UP


def _wanted(node: ast.AST, field: str, place: int, up: tuple, around: ast.ClassDef | None) -> bool:
    """Whether a rule here reads a node for where it stands; ``up`` begins with its parent, and has the parent's field third."""
    parent = up[0]
    if field in ("returns", "annotation", "targets", "target"):
        return True
    if field == "body":
        return place == 0 or isinstance(parent, (ast.ClassDef, ast.If, ast.While, ast.IfExp))
    if field == "value" and isinstance(parent, (ast.Return, ast.Expr, ast.Assign)):
        if isinstance(parent, ast.Return):
            return True
        if isinstance(node, ast.Constant if isinstance(parent, ast.Expr) else (ast.List, ast.Tuple)):
            return True
    if isinstance(node, (ast.Constant, ast.JoinedStr)):
        if field == "elts" and up[2] == "value" or field == "values" and place == 0:
            return True
        return field == "args" and _looks_up(parent) or isinstance(node, ast.Constant) and node.value == "__main__"
    if isinstance(node, ast.Attribute):
        return isinstance(node.value, ast.Name) and node.value.id == "self"
    # arguments of a call that is a value itself
    return field in ("args", "keywords") and up[2] == "value" and isinstance(node, (ast.Name, ast.keyword)) or _looks_up(node)


def _named(nodes: Iterable[ast.AST]) -> set[str]:
    """Names whose mentions are read: those of private functions and those that are returned."""
    out = {"bool", "__name__"}
    for node in nodes:
        kind = type(node)
        if kind in (ast.FunctionDef, ast.AsyncFunctionDef):
            if node.name.startswith("_"):
                out.add(node.name)
        elif kind is ast.Return and isinstance(node.value, ast.Name):
            out.add(node.value.id)
    return out


#: What the rules here read.
DECLARED = Part(
    "declared", MEASURES.kinds | {"ClassDef", "Raise", "Return", "Assign", "AnnAssign", "Compare"}, tuple(c for f in NODES.split(", ")[2:] if (c := f.split(" ")[0]) not in ("dyn", "same", "origin")),
    wanted=_wanted, names=_named, placed=True,
)

#: Every rule here, of functions with their measures and the node relation.
RULES = {
    "cognitive": lambda functions, tree: cognitive(functions),
    "volumes": lambda functions, tree: volumes(functions),
    "hard-to-maintain": lambda functions, tree: hard_to_maintain(functions),
    "average-lengths": average_lengths,
    "missing-param-docs": lambda functions, tree: missing_param_docs(functions),
    "stale-param-docs": lambda functions, tree: stale_param_docs(functions),
    "missing-raises-docs": missing_raises_docs,
    "missing-return-docs": missing_return_docs,
    "empty-classes": lambda functions, tree: empty_classes(tree),
    "pass-through-functions": pass_through_functions,
    "redundant-variables": redundant_variables,
    "unread-private-attributes": lambda functions, tree: unread_private_attributes(tree),
    "path-mutations": lambda functions, tree: path_mutations(tree),
    "unclear-booleans": lambda functions, tree: unclear_booleans(tree),
    "unused-private-functions": lambda functions, tree: unused_private_functions(tree),
}


def all_rules(tree: DataFrame, functions: DataFrame) -> DataFrame:
    """The findings of every rule here, in one plan over one written relation."""
    measures = measured(functions, tree)
    return reduce(DataFrame.unionByName, [rule(measures, tree) for rule in RULES.values()])
