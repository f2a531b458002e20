"""Rules on the shape of code: repeated test bodies, abstractions with one implementor, guards that don't protect, code in comments."""

from __future__ import annotations

import ast
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintlake.operators import restated_rules, test_rules
from lintlake.operators.code_rules import KEY
from lintlake.operators.flow_rules import FUNCTIONS, in_regions
from lintlake.operators.security_rules import found, leaf
from lintlake.sources.store import written

#: Limits, names and shapes of the rules.
LEAST_GROUP, LONG_TEXT = 3, 80
FIXTURE_WORDS = ("case", "cases", "file", "files", "fixture", "fixtures", "path", "paths", "sample", "samples", "scenario", "scenarios")
ABSTRACT_BASES = ("ABC", "ABCMeta", "Protocol")
EXTERNAL_BASES = ("Sized", "Iterable", "Iterator", "Collection", "Container", "Sequence", "Mapping", "MutableMapping", "Callable", "ContextManager", "AsyncContextManager")
DIGIT_TESTS = ("isnumeric", "isdigit")
VALUE_CATCHERS, OVERFLOW_CATCHERS = ("ValueError", "Exception", "BaseException"), ("OverflowError", "ArithmeticError", "Exception", "BaseException")
FREE_TEXT = ("body", "comment", "content", "description", "input", "message", "msg", "prompt", "query", "question", "sentence", "text", "title", "transcript", "utterance")
CASE_METHODS, WRAPPERS = ("lower", "casefold", "strip", "lstrip", "rstrip", "upper"), ("frozenset", "list", "set", "tuple")
COLLECTION_TYPES = (
    "AbstractSet", "ChainMap", "Collection", "Container", "Counter", "DefaultDict", "Dict", "FrozenSet", "Iterable", "Iterator", "List", "Mapping", "MutableMapping", "MutableSequence", "MutableSet",
    "OrderedDict", "Sequence", "Set", "Tuple", "defaultdict", "dict", "frozenset", "list", "set", "tuple",
)
CODE_LIKE = r"(?U)^\s*#\s*(?:[A-Za-z_][\w.]*\s*[+\-*/%&|^]?=\s*\S|[A-Za-z_][\w.]*\(\S|(?:return|raise|yield|assert|if|elif|while|for|with|try|except|finally|break|continue|pass)\b|(?:import|from)\b)"
NO_CODE = r"(?iU)^\s*#\s*(?:(?:TODO|FIXME|XXX|HACK|NOTE|TBD)\b|type\s*:|pragma\s*:|noqa\b|pylint\b|coding[:=])|^\s*#!/"


# --- repeated test bodies -------------------------------------------------------------------------


def repeated_structures(tree: DataFrame, least: int = LEAST_GROUP) -> DataFrame:
    """Tests of a file whose nodes are the same in kinds, names and attributes, ``least`` of them at least; tests with decorators that are calls are left out.

    A test's shape is a digest of its nodes' labels in breadth-first order: constants
    count by type, long and many-line texts by what they say.
    """
    nodes = tree.where("kind != 'Comment'")
    called = nodes.where("kind = 'Call' and field = 'decorator_list'").select(*KEY, F.col("parent_id").alias("node_id"))
    tests = test_rules.tests(tree).join(called, [*KEY, "node_id"], "left_anti").select(*KEY, F.col("node_id").alias("of"), "symbol", "line", "end_line", F.col("pre").alias("begin"), F.col("last").alias("until"))
    text = (F.col("name") == "str") & (F.col("text").contains("\n") | (F.length("text") > LONG_TEXT))
    kept = F.when(F.col("kind") == "Constant", F.concat(F.lit("Const:"), F.col("name"), F.when(text, F.sha2("text", 256)).otherwise("")))
    label = kept.when(F.col("kind").isin("Name", "Attribute"), F.concat_ws(":", "kind", "name", F.when(F.col("store"), "=")))
    label = label.when(F.col("kind").isin("BinOp", "UnaryOp", "AugAssign", "BoolOp"), F.concat_ws(":", "kind", "name")).when(F.col("kind") == "Compare", F.concat_ws(":", "kind", "text")).otherwise(F.col("kind"))
    # a node is in a test if it lies between the test's places; places of other functions don't overlap those
    inside = nodes.select(*KEY, "pre", "node_id", label.alias("label")).join(tests.select(*KEY, "of", "begin", "until"), list(KEY)).where("pre between begin and until")
    shapes = inside.groupBy(*KEY, "of").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node_id", "label"))), lambda x: x["label"]), "|"), 256).alias("shape"))
    groups = shapes.groupBy(*KEY, "shape").agg(F.collect_list("of").alias("of")).where(F.size("of") >= least).select(*KEY, (F.size("of") - 1).alias("others"), F.explode("of").alias("of"))
    rows = tests.join(groups, [*KEY, "of"])
    message = F.concat(F.lit("Test '"), "symbol", F.lit("' shares a body shape with "), F.col("others").cast("string"), F.lit(" other test(s) - candidate for @pytest.mark.parametrize."))
    return found(rows, "test-quality.repeated-structure-missing-parametrize", "advisory", "medium", message, "test-quality", F.col("symbol"))


# --- loops in tests -------------------------------------------------------------------------------


def loops_in_tests(tree: DataFrame) -> DataFrame:
    """The first loop of a test that doesn't merely go over its fixtures.

    A loop over fixtures has no branch, asserts nothing or with messages, and goes over
    files, over a literal collection that a name of the test or the module holds, or
    over one with a loop variable, if that name says so; ``sorted`` and the like around
    it don't matter.
    """
    rows = tree.where("kind != 'Comment'").join(tree.where("kind in ('For', 'AsyncFor', 'While') and test_id is not null").select(*KEY).distinct(), list(KEY), "left_semi")
    up = rows.select(*KEY, F.col("node_id").alias("parent_id"), F.col("kind").alias("up"), F.col("text").alias("up_text"))
    rows = written(rows.join(up, [*KEY, "parent_id"], "left"), "loops")
    tests = test_rules.tests(rows).select(*KEY, F.col("node_id").alias("test_id"), F.col("symbol").alias("of_symbol"))
    loops = rows.where("kind in ('For', 'AsyncFor', 'While')").join(tests, [*KEY, "test_id"]).select(*KEY, "test_id", "of_symbol", "node_id", "kind", "pre", "line", "end_line")
    named = lambda c: F.exists(F.array(*map(F.lit, FIXTURE_WORDS)), lambda w: F.lower(c).contains(w))
    collection = F.col("kind").isin("List", "Tuple", "Set", "Dict")
    # names of the module and of the test that hold literal collections
    values = rows.where((F.col("field") == "value") & F.col("up").isin("Assign", "AnnAssign") & collection).select(*KEY, F.col("parent_id").alias("statement"))
    statements = rows.where("kind in ('Assign', 'AnnAssign') and field = 'body' and (up = 'Module' or parent_id = fn_id)").select(*KEY, F.col("node_id").alias("statement"), F.when(F.col("up") != "Module", F.col("parent_id")).alias("of"))
    aims = rows.where("kind = 'Name' and field in ('targets', 'target')").where(named("name")).select(*KEY, F.col("parent_id").alias("statement"), F.col("name").alias("iterable"))
    held = statements.join(values, [*KEY, "statement"], "left_semi").join(aims, [*KEY, "statement"]).select(*KEY, "of", "iterable").distinct()
    # what a loop goes over, inside calls that only order or copy it
    wraps = (F.col("up") == "Call") & (F.col("field") == "args") & (F.col("ord") == 0) & F.col("up_text").isin("list", "set", "sorted", "tuple")
    iters = rows.where("field = 'iter' and up in ('For', 'AsyncFor')").select(*KEY, F.col("node_id").alias("root"), F.col("parent_id").alias("loop"))
    inside = in_regions(rows, wraps).join(iters, [*KEY, "root"])
    deepest = inside.groupBy(*KEY, "loop").agg(F.max("pre").alias("pre"))
    over = inside.join(deepest, [*KEY, "loop", "pre"]).select(*KEY, "loop", "node_id", "kind", "name", "text")
    funcs = rows.where("kind = 'Attribute' and field = 'func'").select(*KEY, F.col("parent_id").alias("node_id"), F.col("name").alias("method"), F.col("node_id").alias("func"))
    deeper = rows.where("kind = 'Attribute' and up = 'Attribute' and field = 'value'").select(*KEY, F.col("parent_id").alias("func"), F.lit(True).alias("deeper"))
    over = over.join(funcs, [*KEY, "node_id"], "left").join(deeper, [*KEY, "func"], "left")
    files = F.when(F.col("text").isNotNull(), (F.col("text") == "glob") | F.col("text").rlike(r"\.(glob|rglob|iterdir)$")).otherwise((F.col("method") == "glob") | (F.col("method").isin("rglob", "iterdir") & F.col("deeper").isNotNull()))
    by_files = over.where((F.col("kind") == "Call") & F.coalesce(files, F.lit(False))).select(*KEY, F.col("loop").alias("node_id"))
    tuples = rows.where("kind in ('Tuple', 'List') and field = 'target'").select(*KEY, F.col("node_id").alias("parent_id"), F.col("parent_id").alias("loop"))
    single = rows.where("kind = 'Name' and field = 'target' and up in ('For', 'AsyncFor')").select(*KEY, F.col("parent_id").alias("loop"), "name")
    variables = single.unionByName(rows.where("kind = 'Name' and field = 'elts'").select(*KEY, "parent_id", "name").join(tuples, [*KEY, "parent_id"]).select(*KEY, "loop", "name")).where(named("name"))
    by_literal = over.where(collection).join(variables.select(*KEY, "loop"), [*KEY, "loop"], "left_semi").select(*KEY, F.col("loop").alias("node_id"))
    asked = over.where("kind = 'Name'").select(*KEY, F.col("loop").alias("node_id"), F.col("name").alias("iterable")).join(loops.select(*KEY, "node_id", "test_id"), [*KEY, "node_id"])
    by_name = asked.join(held, [*KEY, "iterable"]).where("of is null or of = test_id").select(*KEY, "node_id")
    fixtures = by_files.unionByName(by_literal).unionByName(by_name).distinct()
    # branches and bare assertions in a loop's body
    bodies = rows.where("field = 'body'").groupBy(*KEY, F.col("parent_id").alias("node_id")).agg(F.min("pre").alias("begin"), F.max("last").alias("until"))
    told = rows.where("up = 'Assert' and field = 'msg'").select(*KEY, F.col("parent_id").alias("node_id"))
    acts = rows.where("kind in ('If', 'Match')").select(*KEY, F.col("pre").alias("at")).unionByName(rows.where("kind = 'Assert'").join(told, [*KEY, "node_id"], "left_anti").select(*KEY, F.col("pre").alias("at")))
    working = bodies.join(acts, list(KEY)).where("at between begin and until").select(*KEY, "node_id").distinct()
    plain = loops.where("kind != 'While'").join(fixtures, [*KEY, "node_id"], "left_semi").join(working, [*KEY, "node_id"], "left_anti").select(*KEY, "node_id")
    first = loops.join(plain, [*KEY, "node_id"], "left_anti").groupBy(*KEY, "test_id", "of_symbol").agg(F.min_by(F.struct("line", "end_line"), "pre").alias("r")).select(*KEY, "of_symbol", "r.*")
    message = F.concat(F.lit("Test '"), "of_symbol", F.lit("' contains a loop - prefer `@pytest.mark.parametrize` for case enumeration."))
    return found(first, "test-quality.loop-in-test", "advisory", "medium", message, "test-quality", F.col("of_symbol"))


# --- abstractions with one implementor ------------------------------------------------------------


def module_name() -> Column:
    """The dotted name of a path's module."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace("path", r"\\", "/"), r"\.py$", ""), r"/__init__$", "")
    return F.when(bare == "__init__", "").otherwise(F.array_join(F.filter(F.split(bare, "/"), lambda p: p != ""), "."))


def _qualified(module: Column, name: Column) -> Column:
    return F.when(module == "", name).otherwise(F.concat_ws(".", module, name))


def declared_classes(tree: DataFrame) -> DataFrame:
    """Classes at a module's top level or in the bodies of such: ``fqn``, ``simple``, ``bases``."""
    before = Window.partitionBy(*KEY).orderBy("pre").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.max(F.when(~F.col("kind").isin("Module", "ClassDef"), F.col("last"))).over(before)
    rows = tree.where("kind != 'Comment'").withColumn("inside", F.coalesce(inside >= F.col("pre"), F.lit(False))).where("kind = 'ClassDef' and not inside")
    return rows.select(*KEY, "line", "end_line", _qualified(module_name(), F.col("symbol")).alias("fqn"), F.col("name").alias("simple"), F.filter("bases", lambda b: b != "").alias("bases"))


def type_references(tree: DataFrame) -> DataFrame:
    """Names that a project's code reads or annotates with: ``leaf`` (the name's last part), ``owner`` (class around the place).

    Base lists, decorators of functions and what is assigned to don't count.
    """
    rows = tree.where("kind != 'Comment'")
    up = rows.select(*KEY, F.col("node_id").alias("parent_id"), F.col("kind").alias("up"))
    rows = rows.join(up, [*KEY, "parent_id"], "left")
    note = ((F.col("up") == "arg") & (F.col("field") == "annotation")) | ((F.col("up") == "AnnAssign") & (F.col("field") == "annotation")) | (F.col("up").isin(*FUNCTIONS) & (F.col("field") == "returns"))
    unread = note | ((F.col("up") == "ClassDef") & F.col("field").isin("bases", "keywords", "type_params")) | (F.col("up").isin(*FUNCTIONS) & F.col("field").isin("decorator_list", "type_params")) | ((F.col("up") == "AnnAssign") & (F.col("field") == "target"))
    upto = Window.partitionBy(*KEY).orderBy("pre").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("unread", F.coalesce(F.max(F.when(unread, F.col("last"))).over(upto) >= F.col("pre"), F.lit(False)))
    joined = ((F.col("up") == "Subscript") & F.col("field").isin("value", "slice")) | ((F.col("up") == "BinOp") & F.col("field").isin("left", "right")) | (F.col("up").isin("Tuple", "List") & (F.col("field") == "elts"))
    rows = in_regions(rows.withColumn("note", F.coalesce(note, F.lit(False))), joined)
    roots = rows.where("note").select(*KEY, F.col("node_id").alias("root"))
    name = F.when(F.col("kind") == "Constant", F.col("text")).otherwise(F.col("name"))
    noted = rows.where("kind in ('Name', 'Attribute') or kind = 'Constant' and name = 'str'").join(roots, [*KEY, "root"], "left_semi")
    read = rows.where("not unread and kind in ('Name', 'Attribute') and not coalesce(store, false) and coalesce(text, '') != 'Del'")
    some = noted.select(*KEY, "class_id", name.alias("leaf")).unionByName(read.select(*KEY, "class_id", F.col("name").alias("leaf")))
    owners = rows.where("kind = 'ClassDef'").select(*KEY, F.col("node_id").alias("class_id"), _qualified(module_name(), F.col("symbol")).alias("owner"))
    return some.join(owners, [*KEY, "class_id"], "left").select("project", F.element_at(F.split("leaf", r"\."), -1).alias("leaf"), "owner")


def single_implementors(tree: DataFrame, external: tuple[str, ...] = EXTERNAL_BASES) -> DataFrame:
    """Protocols and abstract classes that one class of their project implements, and that nothing else names.

    Bases are resolved by name over the whole project: a class graph as a join of
    classes with what their bases are called.
    """
    classes = written(declared_classes(tree), "classes")
    leaves = F.transform("bases", lambda b: F.element_at(F.split(b, r"\."), -1))
    abstract = F.exists(leaves, lambda b: b.isin(*ABSTRACT_BASES)) & ~F.exists(leaves, lambda b: F.lower(b).isin(*[e.lower() for e in external]))
    classes = classes.withColumn("abstract", abstract)
    based = classes.select("project", "fqn", "abstract", F.explode(F.array_distinct(leaves)).alias("simple"))
    abstractions = classes.where("abstract")
    # an abstraction that another one extends is a building block
    extended = based.where("abstract").select("project", "simple").distinct()
    open_ = abstractions.join(extended, ["project", "simple"], "left_anti")
    having = based.where("not abstract").withColumnRenamed("fqn", "implementor").drop("abstract")
    single = open_.join(having, ["project", "simple"]).where("implementor != fqn").groupBy("project", "path", "line", "end_line", "fqn", "simple").agg(F.count(F.lit(1)).alias("times"), F.min("implementor").alias("implementor")).where("times = 1")
    single = written(single, "single")
    uses = type_references(tree.join(single.select("project").distinct(), "project", "left_semi")).withColumnRenamed("leaf", "simple")
    own = F.coalesce(F.col("owner").isin(F.col("fqn"), F.col("simple"), F.col("implementor"), F.element_at(F.split("implementor", r"\."), -1)), F.lit(False))
    used = single.join(uses, ["project", "simple"]).where(~own).select("project", "fqn").distinct()
    rows = single.join(used, ["project", "fqn"], "left_anti")
    message = F.concat(F.lit("Protocol/ABC "), "fqn", F.lit(" has one implementor ("), "implementor", F.lit(") and no external type-hint usage; consider depending on the class directly."))
    return found(rows, "design.single-implementor-protocol", "advisory", "medium", message, "design", F.col("fqn"))


# --- numeric conversions behind guards that don't protect -----------------------------------------


def _owner() -> tuple[Column, Column]:
    """A node's scope: its function and class, -1 for none."""
    return F.coalesce("fn_id", F.lit(-1)).alias("fn"), F.coalesce("class_id", F.lit(-1)).alias("cls")


def _conversions(tree: DataFrame) -> DataFrame:
    """``int(name)`` calls: ``name``, ``call``, ``at``, their scope and lines; files that bind ``int`` themselves are left out."""
    top = tree.where("kind = 'Module'").select(*KEY, F.col("node_id").alias("parent_id"))
    statements = tree.where(F.col("kind").isin(*FUNCTIONS, "ClassDef", "Assign", "AnnAssign")).join(top, [*KEY, "parent_id"], "left_semi")
    aims = tree.where("kind = 'Name' and store and name = 'int' and field in ('targets', 'target')").select(*KEY, F.col("parent_id").alias("node_id"))
    own = statements.where("name = 'int'").select(*KEY).unionByName(statements.where("kind in ('Assign', 'AnnAssign')").join(aims, [*KEY, "node_id"], "left_semi").select(*KEY)).unionByName(tree.where("kind = 'alias' and n = 1 and name = 'int'").select(*KEY))
    named = tree.where("kind = 'Name' and field = 'args' and ord = 0").select(*KEY, F.col("parent_id").alias("node_id"), F.col("name").alias("value"))
    worded = tree.where("kind = 'keyword'").select(*KEY, F.col("parent_id").alias("node_id"))
    calls = tree.where("kind = 'Call' and text = 'int' and n = 1").join(own.distinct(), list(KEY), "left_anti").join(worded, [*KEY, "node_id"], "left_anti").join(named, [*KEY, "node_id"])
    return calls.select(*KEY, F.col("value"), F.col("node_id").alias("call"), F.col("pre").alias("at"), *_owner(), "line", "end_line", F.col("test_id").alias("around"))


def _protected(tree: DataFrame, calls: DataFrame, *needed: tuple[str, ...]) -> DataFrame:
    """``call`` of those inside the body of a ``try`` of their function whose handlers catch one name of each list in ``needed``."""
    tries = tree.where("kind = 'Try'").select(*KEY, F.col("node_id").alias("try_id"), F.col("test_id").alias("try_around"))
    handlers = tree.where("kind = 'ExceptHandler'").select(*KEY, F.col("parent_id").alias("try_id"), F.col("node_id").alias("handler"))
    types = tree.where("field = 'type'").select(*KEY, F.col("parent_id").alias("handler"), F.col("pre").alias("begin"), F.col("last").alias("until"))
    typed = handlers.join(types, [*KEY, "handler"], "left")
    names = tree.where("kind in ('Name', 'Attribute')").select(*KEY, "pre", "name")
    caught = typed.where("begin is not null").join(names, list(KEY)).where("pre between begin and until").groupBy(*KEY, "try_id").agg(F.collect_set("name").alias("caught"))
    bare = typed.where("begin is null").select(*KEY, "try_id", F.lit(True).alias("bare")).distinct()
    covers = reduce(lambda a, b: a & b, [F.arrays_overlap(F.coalesce("caught", F.array().cast("array<string>")), F.array(*map(F.lit, n))) for n in needed])
    good = tries.join(caught, [*KEY, "try_id"], "left").join(bare, [*KEY, "try_id"], "left").where(F.col("bare").isNotNull() | covers)
    bodies = tree.where("field = 'body'").groupBy(*KEY, F.col("parent_id").alias("try_id")).agg(F.min("pre").alias("begin"), F.max("last").alias("until"))
    held = good.join(bodies, [*KEY, "try_id"]).select(*KEY, "begin", "until", "try_around")
    return calls.select(*KEY, "call", "at", "around").join(held, list(KEY)).where((F.col("at") >= F.col("begin")) & (F.col("at") <= F.col("until")) & F.col("around").eqNullSafe(F.col("try_around"))).select(*KEY, "call").distinct()


def _guards(tree: DataFrame) -> DataFrame:
    """Names that a condition tests for digits: ``owner`` (the if), ``value``, ``guard`` (the last test), ``ascii``, and the condition's own node."""
    tests = tree.where("field = 'test'").select(*KEY, F.col("parent_id").alias("owner"), F.col("node_id").alias("test"), F.col("kind").alias("test_kind"), F.col("name").alias("test_name"), F.col("pre").alias("begin"), F.col("last").alias("until"))
    parts = F.split("text", r"\.")
    asked = tree.where((F.col("kind") == "Call") & (F.size(parts) == 2) & parts[1].isin(*DIGIT_TESTS, "isascii")).select(*KEY, "pre", "node_id", parts[0].alias("value"), parts[1].alias("method"))
    pairs = asked.join(tests, list(KEY)).where("pre between begin and until")
    digits = F.col("method") != "isascii"
    return pairs.groupBy(*KEY, "owner", "test_kind", "test_name", "value").agg(F.max_by(F.when(digits, F.col("method")), F.when(digits, F.col("node_id"))).alias("guard"), F.max(~digits).alias("ascii")).where("guard is not null and not ascii").drop("ascii")


def numeric_coercions(tree: DataFrame) -> DataFrame:
    """``int()`` of a name that is only tested with ``isdigit`` or ``isnumeric``, or that holds an unchecked float.

    A guard dominates what lies between the places of its branch, in its own scope, and
    what follows an early exit in the same block until the name is bound again.
    """
    files = tree.where("kind = 'Call' and text = 'int'").select(*KEY).distinct()
    tree = written(tree.where("kind != 'Comment'").join(files, list(KEY), "left_semi"), "coercions")
    calls = written(_conversions(tree), "conversions")
    ifs = tree.where("kind in ('If', 'IfExp')").select(*KEY, F.col("node_id").alias("owner"), "kind", "parent_id", "field", "ord", "last", *_owner())
    guards = written(_guards(tree).join(ifs, [*KEY, "owner"]), "guards")
    # the branch that the condition opens
    bodies = tree.where("field = 'body'").groupBy(*KEY, F.col("parent_id").alias("owner")).agg(F.min("pre").alias("begin"), F.max("last").alias("until"))
    direct = calls.join(guards.join(bodies, [*KEY, "owner"]).select(*KEY, "fn", "cls", "value", "guard", "begin", "until"), [*KEY, "fn", "cls", "value"]).where("at between begin and until").select(*KEY, "call", "value", "guard")
    # what follows an early exit: statements of the same block, up to the name's next binding
    exits = tree.where("kind in ('Raise', 'Return', 'Continue', 'Break') and field = 'body'").select(*KEY, F.col("parent_id").alias("owner"), "ord")
    ends = tree.where("field = 'body'").groupBy(*KEY, F.col("parent_id").alias("owner")).agg(F.max("ord").alias("ord"))
    other = tree.where("field = 'orelse'").select(*KEY, F.col("parent_id").alias("owner"))
    leaving = ifs.where("kind = 'If'").join(exits.join(ends, [*KEY, "owner", "ord"], "left_semi"), [*KEY, "owner"], "left_semi").join(other, [*KEY, "owner"], "left_anti").select(*KEY, "owner")
    early = guards.where("kind = 'If' and test_kind = 'UnaryOp' and test_name = 'Not'").join(leaving, [*KEY, "owner"], "left_semi").select(*KEY, "parent_id", "field", F.col("ord").alias("after"), "fn", "cls", "value", "guard")
    statements = tree.where("field in ('body', 'orelse', 'finalbody')").where(~F.col("kind").isin(*FUNCTIONS, "ClassDef")).join(leaving.withColumnRenamed("owner", "node_id"), [*KEY, "node_id"], "left_anti")
    following = statements.select(*KEY, "parent_id", "field", F.col("ord").alias("place"), F.col("pre").alias("begin"), F.col("last").alias("until"))
    reached = calls.join(early, [*KEY, "fn", "cls", "value"]).join(following, [*KEY, "parent_id", "field"]).where("place > after and at between begin and until")
    assigned = tree.where("kind = 'Name' and store and field in ('targets', 'target')").select(*KEY, F.col("parent_id").alias("node_id"), F.col("name").alias("value"))
    imported = tree.where("kind = 'alias'").select(*KEY, F.col("parent_id").alias("node_id"), F.col("name").alias("value"))
    binding = tree.where("kind in ('Assign', 'AnnAssign', 'Import', 'ImportFrom')").join(assigned.unionByName(imported), [*KEY, "node_id"]).select(*KEY, "parent_id", "field", F.col("ord").alias("bound"), "value")
    binding = binding.unionByName(tree.where(F.col("kind").isin(*FUNCTIONS, "ClassDef")).select(*KEY, "parent_id", "field", F.col("ord").alias("bound"), F.col("name").alias("value")))
    lost = reached.join(binding, [*KEY, "parent_id", "field", "value"]).where("bound > after and bound < place").select(*KEY, "call", "parent_id", "field", "after")
    kept = reached.join(lost, [*KEY, "call", "parent_id", "field", "after"], "left_anti")
    late = kept.groupBy(*KEY, "call", "value", "parent_id", "field").agg(F.max_by("guard", "after").alias("guard")).select(*KEY, "call", "value", "guard")
    guarded = direct.unionByName(late).distinct().join(_protected(tree, calls, VALUE_CATCHERS), [*KEY, "call"], "left_anti")
    text = F.concat(F.lit("`int("), "value", F.lit(")` is guarded by `"), "value", F.lit("."), "guard", F.lit('()`, which accepts characters int() rejects (e.g. "²") and still crashes; the conversion needs a try/except ValueError instead.'))
    # floats of functions that take anything
    args = tree.where("kind = 'arg' and field in ('posonlyargs', 'args', 'kwonlyargs') and name not in ('self', 'cls')").select(*KEY, F.col("fn_id").alias("fn"), "node_id")
    noted = tree.where("field = 'annotation'").select(*KEY, F.col("parent_id").alias("node_id"), F.col("kind").isin("Name", "Attribute").alias("plain"), F.col("name").alias("type"))
    taking = args.join(noted, [*KEY, "node_id"], "left").groupBy(*KEY, "fn").agg(F.min(F.col("plain").isNull() | F.coalesce(F.col("plain") & F.col("type").isin("Any", "object"), F.lit(False))).alias("any")).where("any").select(*KEY, "fn")
    first = tree.where("field = 'args' and ord = 0 and kind != 'Constant'").select(*KEY, F.col("parent_id").alias("float"), F.col("pre").alias("begin"), F.col("last").alias("until"))
    floats = tree.where("kind = 'Call' and text = 'float' and field = 'value'").select(*KEY, F.col("node_id").alias("float"), F.col("parent_id").alias("node_id")).join(first, [*KEY, "float"])
    alone = tree.where("field = 'targets'").groupBy(*KEY, F.col("parent_id").alias("node_id")).agg(F.count(F.lit(1)).alias("targets"), F.first(F.when(F.col("kind") == "Name", F.col("name"))).alias("value")).where("targets = 1 and value is not null")
    made = tree.where("kind = 'Assign' and fn_id is not null").select(*KEY, "node_id", F.col("fn_id").alias("fn"), "pre").join(floats, [*KEY, "node_id"]).join(alone, [*KEY, "node_id"]).join(taking, [*KEY, "fn"], "left_semi")
    made = made.groupBy(*KEY, "fn", "value").agg(F.max_by(F.struct("begin", "until"), "pre").alias("of")).select(*KEY, "fn", "value", "of.*")
    tested = tree.where("field = 'func' and kind in ('Name', 'Attribute') and name = 'isfinite'").select(*KEY, F.col("parent_id").alias("node_id"))
    finite = tree.where("kind = 'Name' and field = 'args'").select(*KEY, F.col("parent_id").alias("node_id"), F.col("name").alias("checked"), F.col("fn_id").alias("fn")).join(tested, [*KEY, "node_id"], "left_semi").select(*KEY, "fn", "checked").distinct()
    names = tree.where("kind = 'Name'").select(*KEY, "pre", "name")
    sources = made.join(names, list(KEY)).where("pre between begin and until").select(*KEY, "fn", "value", F.col("name").alias("checked"))
    sure = sources.unionByName(made.select(*KEY, "fn", "value", F.col("value").alias("checked"))).join(finite, [*KEY, "fn", "checked"], "left_semi").select(*KEY, "fn", "value").distinct()
    loose = calls.where("fn != -1").join(made.select(*KEY, "fn", "value").join(sure, [*KEY, "fn", "value"], "left_anti"), [*KEY, "fn", "value"], "left_semi").join(_protected(tree, calls, VALUE_CATCHERS, OVERFLOW_CATCHERS), [*KEY, "call"], "left_anti")
    float_text = F.concat(F.lit("`int("), "value", F.lit(')` converts a float from a dynamic source without a math.isfinite() gate; int(float("nan")) raises ValueError and int(float("inf")) raises OverflowError.'))
    lines = calls.select(*KEY, "call", "line", "end_line")
    rows = guarded.select(*KEY, "call", text.alias("message")).unionByName(loose.select(*KEY, "call", float_text.alias("message"))).join(lines, [*KEY, "call"]).select(*KEY, "line", "end_line", "message").distinct()
    return found(rows, "correctness.unsafe-numeric-coercion", "advisory", "high", F.col("message"), "correctness")


# --- vocabularies matched inside words ------------------------------------------------------------


def _vocabularies(rows: DataFrame) -> DataFrame:
    """Module-level names of collections of string literals: ``vocabulary``; of several the last counts, if it isn't empty and not all of phrases."""
    top = rows.where("kind = 'Assign' and up = 'Module'").select(*KEY, "node_id")
    aims = rows.where("field = 'targets'").groupBy(*KEY, F.col("parent_id").alias("node_id")).agg(F.count(F.lit(1)).alias("targets"), F.first(F.when(F.col("kind") == "Name", F.col("name"))).alias("vocabulary")).where("targets = 1 and vocabulary is not null")
    values = rows.where("field = 'value' and up = 'Assign'").select(*KEY, F.col("parent_id").alias("assign"), F.col("node_id").alias("value"), "kind", "text", "n")
    worded = rows.where("kind = 'keyword'").select(*KEY, F.col("parent_id").alias("value"))
    wrapped = values.where((F.col("kind") == "Call") & F.col("text").isin(*WRAPPERS) & (F.col("n") == 1)).join(worded, [*KEY, "value"], "left_anti")
    inner = rows.where("field = 'args' and ord = 0").select(*KEY, F.col("parent_id").alias("value"), F.col("node_id").alias("items"), F.col("kind").alias("of_kind"))
    items = values.where("kind in ('List', 'Set', 'Tuple')").select(*KEY, "assign", F.col("value").alias("items")).unionByName(wrapped.join(inner, [*KEY, "value"]).where("of_kind in ('List', 'Set', 'Tuple')").select(*KEY, "assign", "items"))
    word = (F.col("kind") == "Constant") & (F.col("name") == "str")
    parts = rows.where("field = 'elts'").groupBy(*KEY, F.col("parent_id").alias("items")).agg(F.min(word).alias("words"), F.max(word & ~F.col("text").contains(" ")).alias("single"))
    lists = items.join(parts, [*KEY, "items"], "left").where("coalesce(words, true)").select(*KEY, F.col("assign").alias("node_id"), F.coalesce("single", F.lit(False)).alias("single"))
    named = lists.join(top, [*KEY, "node_id"], "left_semi").join(aims, [*KEY, "node_id"])
    return named.groupBy(*KEY, "vocabulary").agg(F.max_by("single", "node_id").alias("single")).where("single").select(*KEY, "vocabulary")


def _text_names(rows: DataFrame) -> DataFrame:
    """Names of a function that hold a parameter's text: ``fn``, ``text_name``, ``source_name``.

    Parameters that are annotated as collections are none; a local is one if it is bound
    once, to a parameter with at most its case and outer spaces changed.
    """
    args = rows.where("kind = 'arg' and field in ('posonlyargs', 'args', 'kwonlyargs')").select(*KEY, F.col("fn_id").alias("fn"), "node_id", "name")
    wide = rows.where("up = 'Subscript' and field = 'value' and kind in ('Name', 'Attribute') and name in ('Optional', 'Union')").select(*KEY, "parent_id", F.lit(True).alias("wide"))
    notes = rows.join(wide, [*KEY, "parent_id"], "left").withColumn("wide", F.coalesce("wide", F.lit(False)))
    heads = ((F.col("up") == "BinOp") & (F.col("up_name") == "BitOr")) | ((F.col("up") == "Tuple") & (F.col("field") == "elts")) | ((F.col("up") == "Subscript") & (F.col("field") == F.when(F.col("wide"), "slice").otherwise("value")))
    roots = rows.where("up = 'arg' and field = 'annotation'").select(*KEY, F.col("node_id").alias("root"), F.col("parent_id").alias("node_id"))
    held = in_regions(notes, heads).where(F.col("kind").isin("Name", "Attribute") & F.col("name").isin(*COLLECTION_TYPES)).select(*KEY, "root").distinct().join(roots, [*KEY, "root"]).select(*KEY, "node_id")
    params = args.join(held, [*KEY, "node_id"], "left_anti").select(*KEY, "fn", "name").distinct()
    # chains of calls without arguments down to a name
    worded = rows.where("kind = 'keyword'").select(*KEY, F.col("parent_id").alias("node_id"))
    plain = rows.where("kind = 'Call' and n = 0").join(worded, [*KEY, "node_id"], "left_anti").select(*KEY, F.col("node_id").alias("parent_id"), F.lit(True).alias("bare"))
    funcs = rows.where((F.col("kind") == "Attribute") & (F.col("field") == "func") & F.col("name").isin(*CASE_METHODS)).join(plain, [*KEY, "parent_id"], "left_semi").select(*KEY, "node_id")
    links = funcs.withColumn("link", F.lit(True))
    steps = links.select(*KEY, F.col("node_id").alias("parent_id"), F.col("link").alias("below"))
    chained = rows.join(links, [*KEY, "node_id"], "left").join(steps, [*KEY, "parent_id"], "left")
    names = in_regions(chained, F.col("link").isNotNull() | F.col("below").isNotNull()).where("kind = 'Name'").select(*KEY, F.col("root").alias("value"), F.col("name").alias("source_name"))
    values = rows.where("field = 'value' and up = 'Assign'").select(*KEY, F.col("parent_id").alias("node_id"), F.col("node_id").alias("value")).join(names, [*KEY, "value"], "left")
    aims = rows.where("field = 'targets'").groupBy(*KEY, F.col("parent_id").alias("node_id")).agg(F.count(F.lit(1)).alias("targets"), F.first(F.when(F.col("kind") == "Name", F.col("name"))).alias("text_name")).where("targets = 1 and text_name is not null")
    assigned = rows.where("kind = 'Assign' and fn_id is not null").select(*KEY, "node_id", "pre", F.col("fn_id").alias("fn")).join(aims, [*KEY, "node_id"]).join(values, [*KEY, "node_id"])
    of = assigned.join(params.withColumn("param", F.lit(True)).withColumnRenamed("name", "source_name"), [*KEY, "fn", "source_name"], "left")
    bound = of.groupBy(*KEY, "fn", "text_name").agg(F.count(F.lit(1)).alias("times"), F.min(F.col("param").isNotNull()).alias("pure"), F.max_by("source_name", "pre").alias("source_name"))
    own = params.select(*KEY, "fn", F.col("name").alias("text_name"), F.lit(True).alias("own"))
    both = bound.join(own, [*KEY, "fn", "text_name"], "full")
    return both.where("times is null or pure and (times = 1 or own)").select(*KEY, "fn", "text_name", F.coalesce("source_name", "text_name").alias("source_name"))


def vocabulary_matches(tree: DataFrame) -> DataFrame:
    """``any(term in text for term in WORDS)`` and loops like it over a parameter's free text, of a module's vocabulary: they match inside words."""
    files = tree.where("kind = 'Compare' and text = 'In'").select(*KEY).distinct()
    rows = tree.where("kind != 'Comment'").join(files, list(KEY), "left_semi")
    up = rows.select(*KEY, F.col("node_id").alias("parent_id"), F.col("kind").alias("up"), F.col("name").alias("up_name"))
    rows = written(rows.join(up, [*KEY, "parent_id"], "left"), "containments")

    def child(field: str, as_: str, kind: str = "Name") -> DataFrame:
        return rows.where((F.col("field") == field) & (F.col("ord") == 0) & (F.col("kind") == kind)).select(*KEY, F.col("parent_id").alias("node_id"), F.col("name" if kind == "Name" else "node_id").alias(as_))

    tests = rows.where("kind = 'Compare' and text = 'In'").select(*KEY, "node_id", "parent_id", "field").join(child("left", "term"), [*KEY, "node_id"]).join(child("comparators", "text_name"), [*KEY, "node_id"])
    # any() of a generator with one loop
    loops = rows.where("kind = 'comprehension' and up = 'GeneratorExp'")
    alone = loops.groupBy(*KEY, "parent_id").agg(F.count(F.lit(1)).alias("loops")).where("loops = 1")
    over = loops.join(alone, [*KEY, "parent_id"], "left_semi").select(*KEY, F.col("parent_id").alias("generator"), "node_id").join(child("target", "term"), [*KEY, "node_id"]).join(child("iter", "vocabulary"), [*KEY, "node_id"]).drop("node_id")
    calls = rows.where("kind = 'Call' and text = 'any' and n = 1").select(*KEY, "node_id", F.col("fn_id").alias("fn"), "line", "end_line").join(child("args", "generator", "GeneratorExp"), [*KEY, "node_id"]).drop("node_id")
    scans = calls.join(over, [*KEY, "generator"]).join(tests.where("field = 'elt'").select(*KEY, F.col("parent_id").alias("generator"), "term", "text_name"), [*KEY, "generator", "term"])
    # a loop whose first matching if is in its body
    fors = rows.where("kind = 'For'").select(*KEY, "node_id", F.col("fn_id").alias("fn")).join(child("target", "term"), [*KEY, "node_id"]).join(child("iter", "vocabulary"), [*KEY, "node_id"])
    ifs = rows.where("kind = 'If' and up = 'For' and field = 'body'").select(*KEY, F.col("parent_id").alias("node_id"), F.col("node_id").alias("if_id"), "ord", "line", "end_line")
    asked = fors.join(ifs, [*KEY, "node_id"]).join(tests.where("field = 'test'").select(*KEY, F.col("parent_id").alias("if_id"), "term", "text_name"), [*KEY, "if_id", "term"])
    first = asked.groupBy(*KEY, "node_id", "fn", "vocabulary").agg(F.min_by(F.struct("line", "end_line", "text_name"), "ord").alias("r")).select(*KEY, "fn", "vocabulary", "r.*")
    sites = scans.select(*KEY, "fn", "vocabulary", "line", "end_line", "text_name").unionByName(first).where("fn is not null")
    free = lambda c: F.exists(F.split(F.lower(c), "_"), lambda w: w.isin(*FREE_TEXT))
    hits = written(sites.join(_vocabularies(rows), [*KEY, "vocabulary"], "left_semi"), "scans").join(_text_names(rows), [*KEY, "fn", "text_name"]).where(free("text_name") | free("source_name"))
    message = F.concat(F.lit("Substring scan of `"), "vocabulary", F.lit("` over `"), "text_name", F.lit('` matches inside words ("fee" routes "coffee", "form" routes "information"); the comparison needs word-boundary or token matching.'))
    return found(hits, "correctness.substring-vocabulary-match", "advisory", "medium", message, "correctness")


# --- code in comments -----------------------------------------------------------------------------


def parses(text: str) -> bool:
    """Whether a line is Python by itself, in a function, or as the head of a block."""
    inner = [text, f"def probe():\n    {text}"]
    if text.rstrip().endswith(":"):
        inner += [f"{text}\n    pass", f"def probe():\n    {text}\n        pass"]
    for source in inner if text else []:
        try:
            ast.parse(f"{source}\n")
        except (SyntaxError, ValueError):
            continue
        return True
    return False


def commented_code(tree: DataFrame) -> DataFrame:
    """Comments that look like statements and parse as such: a second parse, of the few lines that pass the patterns."""
    text = F.regexp_replace(F.regexp_replace("text", r"^\s*#", ""), r"(?U)^\s+", "")
    rows = tree.where((F.col("kind") == "Comment") & F.col("text").rlike(CODE_LIKE) & ~F.col("text").rlike(NO_CODE)).select(*KEY, "line", text.alias("code"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([parses(t) for t in b.column(3).to_pylist()], pa.bool_()))

    rows = rows.mapInArrow(run, "project string, path string, line int, code string").withColumn("end_line", F.col("line"))
    return found(rows, "waste.commented-out-code", "advisory", "low", F.concat(F.lit("Commented-out code on line "), F.col("line").cast("string"), F.lit(".")), "dead-code")


RULES = (repeated_structures, loops_in_tests, single_implementors, numeric_coercions, vocabulary_matches, commented_code, restated_rules.restated_declarations)


def all_rules(tree: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [rule(tree) for rule in RULES])
