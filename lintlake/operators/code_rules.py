"""Rules on parsed code, as filters, aggregates and anti-joins over the node relation."""

from __future__ import annotations

import ast
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintlake.operators.code import Part

#: Word lists and thresholds of the rules.
THRESHOLDS = {"size.function-length": 100, "size.parameter-count": 10, "size.class-length": 1000, "size.public-method-count": 10, "complexity.cyclomatic": 20, "complexity.nesting-depth": 6}
ABBREVIATIONS = ("attr", "cfg", "ctx", "defn", "func", "idx", "lst", "mgr", "msg", "params", "pkg", "pwd", "req", "res", "tmp", "tok", "usr", "var")
HUNGARIAN = ("i", "s", "b", "f", "d", "p", "lp", "sz", "ch", "int", "str", "bool", "flt", "dbl", "arr", "lst", "dict", "tup", "obj", "ptr")
PLACEHOLDERS = ("temp", "foo", "bar", "baz", "qux", "thing", "stuff")
NUMBERED = ("result", "data", "value", "item", "var", "x")
SHORT_NAMES = ("i", "j", "k", "n", "m", "x", "y", "z", "e", "_", "f")
GENERIC_FUNCTIONS = ("process", "handle", "do", "run", "execute", "perform", "apply", "manage", "operate")
CONFUSING_CLASSES = ("Handler", "Processor", "Manager", "Util", "Utils", "Helper", "Helpers", "Data", "Info", "Service", "Stuff", "Thing", "Object", "Item")
DANGEROUS_CALLS = ("eval", "exec", "compile")
WORD = r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|[0-9]+"
KEY = ("project", "path")


#: Rules that point at a place have no symbol; naming rules carry the name itself.
NO_SYMBOL = "cast(null as string)"


def finding(rows: DataFrame, rule: str, severity: str, pillar: str, confidence: str = "high", measured: Column | None = None, symbol: str = "symbol") -> DataFrame:
    """Rows with ``line`` and ``symbol`` as findings of a rule."""
    return rows.select("project", F.lit(rule).alias("rule_id"), F.col("path").alias("file_path"), "line", F.expr(symbol).alias("symbol"), F.lit(severity).alias("severity"), F.lit(pillar).alias("pillar"), F.lit(confidence).alias("confidence"), (measured if measured is not None else F.lit(None)).cast("int").alias("measured"))


def measured_rules(functions: DataFrame, thresholds: dict[str, int] | None = None) -> DataFrame:
    """Length, parameters, complexity and nesting over their thresholds; one scan of the functions, unpivoted."""
    limits = THRESHOLDS | (thresholds or {})
    columns = {"size.function-length": "length", "size.parameter-count": "parameters", "complexity.cyclomatic": "cyclomatic", "complexity.nesting-depth": "nesting"}
    pairs = F.array(*[F.struct(F.lit(r).alias("rule_id"), F.col(c).alias("measured"), F.lit(limits[r]).alias("threshold"), F.lit(r.split(".")[0]).alias("pillar")) for r, c in columns.items()])
    rows = functions.select(*KEY, F.col("start_line").alias("line"), "symbol", F.explode(pairs).alias("m")).where("m.measured > m.threshold")
    return rows.select("project", "m.rule_id", F.col("path").alias("file_path"), "line", "symbol", F.lit("error").alias("severity"), "m.pillar", F.lit("high").alias("confidence"), "m.measured")


def classes(tree: DataFrame) -> DataFrame:
    return tree.where("kind = 'ClassDef'").select(*KEY, "node_id", "parent_id", "name", "symbol", "line", "end_line", "start_line", F.col("text").alias("docstring"))


def _words(name: str = "name") -> Column:
    return F.transform(F.regexp_extract_all(name, F.lit(WORD), F.lit(0)), F.lower)


def identifiers(tree: DataFrame) -> DataFrame:
    """Functions, parameters and assigned names, in the order of their nodes."""
    kind = (F.col("kind").isin("FunctionDef", "AsyncFunctionDef", "arg")) | ((F.col("kind") == "Name") & (F.col("text") == "Store"))
    return tree.where(kind & F.col("name").isNotNull())


#: Paths that naming rules pass over.
TEST_PATH = r"(^|/)tests?/|(^|/)test_[^/]*\.py$|_test\.py$"


def _abbreviated(source: str) -> bool:
    """Whether a text has one of the words where a name's word can begin and end."""
    lower = source.lower()
    return any(w in lower and re.search(f"(?<![a-z]){w}(?![a-z])|{w.capitalize()}(?![a-z])|(?<![A-Z]){w.upper()}(?![A-Z](?![a-z]))", source) for w in ABBREVIATIONS)


def _short(source: str) -> bool:
    """Whether a text has a letter on its own that is no customary name."""
    return any(c not in SHORT_NAMES for c in re.findall(r"(?<![A-Za-z0-9_])[A-Za-z_](?![A-Za-z0-9_])", source))


def _dangerous(source: str) -> bool:
    return any(name in source for name in (*DANGEROUS_CALLS, "__import__"))


#: What single rules read of the node relation.
ABBREVIATED = Part("abbreviated", frozenset(("FunctionDef", "AsyncFunctionDef", "arg", "Name")), ("node_id", "kind", "name", "text", "line"), _abbreviated)
SHORT = Part("short", frozenset(("Name", "Assign", "AnnAssign", "AugAssign", "NamedExpr")), ("node_id", "parent_id", "kind", "name", "text", "line"), _short)
IMPORTS = Part("imports", frozenset(("alias", "Name", "Assign", "List", "Tuple", "Constant", "Comment")), ("node_id", "parent_id", "kind", "field", "name", "text", "line", "context", "origin"))
STATEMENTS = Part("statements", frozenset(t.__name__ for t in ast.stmt.__subclasses__()), ("parent_id", "kind", "field", "ord", "line"))
DANGEROUS = Part("dangerous", like=_dangerous)


def abbreviations(tree: DataFrame) -> DataFrame:
    """The first place in a file of each name with an abbreviated word; test files aside."""
    bad = identifiers(tree).where(F.arrays_overlap(_words(), F.array(*map(F.lit, ABBREVIATIONS))) & ~F.col("path").rlike(TEST_PATH))
    first = bad.groupBy(*KEY, F.col("name").alias("symbol")).agg(F.min_by("line", "node_id").alias("line"))
    return finding(first, "naming.abbreviation", "advisory", "naming", "medium")


def short_variables(tree: DataFrame) -> DataFrame:
    """Assigned names of one letter that aren't customary, once a name and line; test files aside."""
    assigned = tree.where("kind = 'Name' and text = 'Store' and length(name) = 1").where(~F.col("name").isin(*SHORT_NAMES) & ~F.col("path").rlike(TEST_PATH))
    targets = assigned.join(tree.where("kind in ('Assign', 'AnnAssign', 'AugAssign', 'NamedExpr')").select(*KEY, F.col("node_id").alias("parent_id")), [*KEY, "parent_id"], "left_semi")
    return finding(targets.dropDuplicates([*KEY, "name", "line"]), "naming.short-variable", "advisory", "naming", "low", symbol="name")


def hungarian(tree: DataFrame) -> DataFrame:
    tagged = identifiers(tree).where(F.col("name").contains("_") & F.split("name", "_")[0].isin(*HUNGARIAN))
    return finding(tagged.dropDuplicates([*KEY, "name", "line"]), "naming.hungarian-notation", "warning", "naming", symbol="name")


def poor_identifiers(tree: DataFrame) -> DataFrame:
    """Placeholders, ``todo`` and numbered stock names."""
    words = _words()
    bad = F.element_at(words, 1).isin(*PLACEHOLDERS) | (F.lower("name") == "todo") | F.col("name").rlike(f"^({'|'.join(NUMBERED)})_?[0-9]+$")
    return finding(identifiers(tree).where((F.size(words) > 0) & bad).dropDuplicates([*KEY, "name", "line"]), "naming.identifier-quality", "warning", "naming", symbol="name")


def generic_functions(functions: DataFrame) -> DataFrame:
    words = _words()
    return finding(functions.where((F.size(words) == 1) & F.element_at(words, 1).isin(*GENERIC_FUNCTIONS)), "naming.generic-function", "advisory", "naming", "medium")


def unused_imports(tree: DataFrame) -> DataFrame:
    """Imported names that no expression of the file reads, by anti-join; package files are skipped.

    Names that ``__all__`` lists or that a string annotation mentions are read;
    imports from ``__future__`` and lines marked ``noqa`` are no findings.
    """
    names = tree.where("kind = 'alias' and name != '*' and coalesce(origin, '') != '__future__'").where(~F.col("path").endswith("__init__.py"))
    last = names.groupBy(*KEY, "name").agg(F.max_by("line", "node_id").alias("line"))
    used = tree.where("kind = 'Name' and text != 'Store'").select(*KEY, "name")
    lists = tree.where("kind = 'Assign' and context = '=__all__'").select(*KEY, F.col("node_id").alias("parent_id"))
    listed = tree.where("kind in ('List', 'Tuple') and field = 'value'").join(lists, [*KEY, "parent_id"], "left_semi").select(*KEY, F.col("node_id").alias("parent_id"))
    exported = tree.where("kind = 'Constant' and field = 'elts'").join(listed, [*KEY, "parent_id"], "left_semi").select(*KEY, F.col("text").alias("name"))
    quoted = tree.where("kind = 'Constant' and name = 'str' and field in ('annotation', 'returns')").select(*KEY, F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-z_][A-Za-z0-9_]*"), F.lit(0))).alias("name"))
    marked = tree.where("kind = 'Comment' and lower(text) rlike '#.*\\\\bnoqa\\\\b'").select(*KEY, "line").distinct()
    unread = last.join(used.unionByName(exported).unionByName(quoted).distinct(), [*KEY, "name"], "left_anti")
    return finding(unread.join(marked, [*KEY, "line"], "left_anti"), "waste.unused-import", "warning", "dead-code", symbol=NO_SYMBOL)


def unreachable(tree: DataFrame) -> DataFrame:
    """The first statement after a return, raise, continue or break of its block."""
    statements = tree.where(F.col("field").isin("body", "orelse", "finalbody"))
    leaves = F.col("kind").isin("Return", "Raise", "Continue", "Break")
    ends = statements.where(leaves).groupBy(*KEY, "parent_id", "field").agg(F.min("ord").alias("left_at"))
    after = statements.join(ends, [*KEY, "parent_id", "field"]).where(F.col("ord") == F.col("left_at") + 1)
    return finding(after, "waste.unreachable-code", "warning", "dead-code", symbol=NO_SYMBOL)


def dangerous_calls(tree: DataFrame) -> DataFrame:
    """Evaluation of text, and imports by a name that is no literal."""
    dynamic = children(tree, "field = 'args' and ord = 0 and not (kind = 'Constant' and name = 'str')").select(*KEY, "node_id")
    imports = tree.where("kind = 'Call' and text = '__import__'").join(dynamic, [*KEY, "node_id"], "left_semi")
    always = tree.where((F.col("kind") == "Call") & F.col("text").isin(*DANGEROUS_CALLS))
    return finding(always.unionByName(imports), "security.dangerous-function-call", "error", "security", symbol=NO_SYMBOL)


def first_per(rows: DataFrame, *key: str) -> DataFrame:
    """The first node of each key, in node order."""
    order = Window.partitionBy(*KEY, *key).orderBy("node_id")
    return rows.withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")


# --- rules on habits: self-joins of nodes with their children -------------------------------------

#: Names that the rules look for.
OLD_TLS = ("PROTOCOL_TLSv1", "PROTOCOL_TLSv1_1", "PROTOCOL_SSLv2", "PROTOCOL_SSLv3", "PROTOCOL_SSLv23")
WIDE_EXCEPTIONS = ("Exception", "BaseException")
UNSAFE_LOADS = ("pickle.loads", "pickle.load", "cPickle.loads", "cPickle.load", "dill.loads", "dill.load", "marshal.loads", "marshal.load", "shelve.open", "jsonpickle.decode")
UNPICKLERS = ("pickle.Unpickler", "cPickle.Unpickler", "dill.Unpickler")


def children(tree: DataFrame, where: str) -> DataFrame:
    """Nodes as children: the parent's key, and kind, name, text under the prefix ``child_``."""
    return tree.where(where).select(*KEY, F.col("parent_id").alias("node_id"), *[F.col(c).alias(f"child_{c}") for c in ("node_id", "kind", "name", "text", "ord")])


def tests(tree: DataFrame) -> DataFrame:
    """Test functions of test files."""
    return tree.where("kind in ('FunctionDef', 'AsyncFunctionDef') and name like 'test%'").where(F.col("path").rlike(r"(^|/)test_[^/]*\.py$|_test\.py$"))


def in_tests(tree: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows that a test function owns."""
    return rows.join(tests(tree).select(*KEY, F.col("node_id").alias("fn_id")), [*KEY, "fn_id"], "left_semi")


def sleeps_in_tests(tree: DataFrame) -> DataFrame:
    return finding(in_tests(tree, tree.where("kind = 'Call' and text like '%sleep'")), "test-quality.sleep-in-test", "warning", "test-quality")


def global_state_in_tests(tree: DataFrame) -> DataFrame:
    return finding(first_per(in_tests(tree, tree.where("kind = 'Global'")), "fn_id"), "test-quality.global-state-mutation", "warning", "test-quality", "medium")


def trivial_assertions(tree: DataFrame) -> DataFrame:
    """Assertions of a number or truth value, or of its negation; strings are left alone."""
    constant = "kind = 'Constant' and name in ('bool', 'int', 'float', 'complex')"
    asserts = in_tests(tree, tree.where("kind = 'Assert'"))
    direct = asserts.join(children(tree, f"{constant} and field = 'test'"), [*KEY, "node_id"], "left_semi")
    negated = tree.where("kind = 'UnaryOp' and field = 'test'").join(children(tree, f"{constant} and field = 'operand'"), [*KEY, "node_id"], "left_semi")
    inverse = asserts.join(negated.select(*KEY, F.col("parent_id").alias("node_id")), [*KEY, "node_id"], "left_semi")
    return finding(direct.unionByName(inverse), "test-quality.trivial-assertion", "warning", "test-quality")


def no_assertions(tree: DataFrame) -> DataFrame:
    """Tests that own no assertion and call nothing that asserts, by anti-join."""
    held = tree.where("kind = 'Assert' or (kind = 'Call' and (text like '%assert%' or text rlike '(^|[.])(raises|warns|fail)$'))").where("fn_id is not null")
    return finding(tests(tree).join(held.select(*KEY, F.col("fn_id").alias("node_id")), [*KEY, "node_id"], "left_anti"), "test-quality.no-assertions", "warning", "test-quality")


def format_calls(tree: DataFrame) -> DataFrame:
    """Literal texts that are formatted with arguments."""
    literal = tree.where("kind = 'Attribute' and name = 'format' and field = 'func'").join(children(tree, "kind = 'Constant' and name = 'str' and field = 'value'"), [*KEY, "node_id"], "left_semi")
    given = children(tree, "field in ('args', 'keywords')").select(*KEY, "node_id").distinct()
    calls = tree.where("kind = 'Call'").join(literal.select(*KEY, F.col("parent_id").alias("node_id")), [*KEY, "node_id"], "left_semi").join(given, [*KEY, "node_id"], "left_semi")
    return finding(calls, "modernisation.f-string-candidate", "advisory", "modernisation", "medium", symbol=NO_SYMBOL)


def silent_excepts(tree: DataFrame) -> DataFrame:
    """Handlers of everything whose only statement is ``pass`` or a constant."""
    typed = children(tree, "field = 'type'").select(*KEY, "node_id")
    handlers = tree.where("kind = 'ExceptHandler' and n = 1")
    wide = handlers.where(F.col("text").isin(*WIDE_EXCEPTIONS)).unionByName(handlers.join(typed, [*KEY, "node_id"], "left_anti"))
    constants = tree.where("kind = 'Expr' and field = 'body'").join(children(tree, "kind = 'Constant' and field = 'value'"), [*KEY, "node_id"], "left_semi")
    quiet = tree.where("kind = 'Pass' and field = 'body'").unionByName(constants).select(*KEY, F.col("parent_id").alias("node_id"))
    return finding(wide.join(quiet, [*KEY, "node_id"], "left_semi"), "security.silent-except", "advisory", "security", symbol=NO_SYMBOL)


def old_tls(tree: DataFrame) -> DataFrame:
    return finding(tree.where((F.col("kind") == "Attribute") & F.col("text").startswith("ssl.") & F.col("name").isin(*OLD_TLS)), "security.insecure-tls-protocol", "error", "security", symbol=NO_SYMBOL)


def unsafe_pickles(tree: DataFrame) -> DataFrame:
    """Loads of serialised objects from anything but a literal, and ``load`` of an unpickler made on the spot."""
    literal = children(tree, "field = 'args' and ord = 0 and kind = 'Constant' and name in ('bytes', 'str')")
    loads = tree.where((F.col("kind") == "Call") & F.col("text").isin(*UNSAFE_LOADS)).join(literal, [*KEY, "node_id"], "left_anti")
    made = tree.where((F.col("kind") == "Call") & (F.col("field") == "value") & F.col("text").isin(*UNPICKLERS)).select(*KEY, F.col("parent_id").alias("node_id"))
    method = tree.where("kind = 'Attribute' and name = 'load' and field = 'func'").join(made, [*KEY, "node_id"], "left_semi").select(*KEY, F.col("parent_id").alias("node_id"))
    on_the_spot = tree.where("kind = 'Call'").join(method, [*KEY, "node_id"], "left_semi")
    return finding(loads.unionByName(on_the_spot), "security.unsafe-pickle", "error", "security", symbol=NO_SYMBOL)


def empty_bodies(tree: DataFrame) -> DataFrame:
    """Functions whose body is nothing but ``pass`` and constants, by anti-join with any other statement."""
    constants = tree.where("kind = 'Expr'").join(children(tree, "kind = 'Constant' and field = 'value'"), [*KEY, "node_id"], "left_semi").select(*KEY, "node_id")
    statements = tree.where("field = 'body' and kind != 'Pass'").join(constants, [*KEY, "node_id"], "left_anti")
    defs = tree.where("kind in ('FunctionDef', 'AsyncFunctionDef')")
    return defs.join(statements.select(*KEY, F.col("parent_id").alias("node_id")), [*KEY, "node_id"], "left_anti")


def confusing_classes(tree: DataFrame, names: tuple[str, ...] = CONFUSING_CLASSES) -> DataFrame:
    return finding(tree.where((F.col("kind") == "ClassDef") & F.col("name").isin(*names)), "naming.confusing-name", "advisory", "naming", "medium")
