"""Assertions that restate a declaration of their own file: declared facts as a table, joined with what assertions claim."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.operators import test_rules
from lintlake.operators.code_rules import KEY
from lintlake.operators.flow_rules import FUNCTIONS
from lintlake.operators.security_rules import found
from lintlake.sources.store import written

#: Decorators of accessors, and statements whose bodies run in the scope around them.
DESCRIPTORS = ("property", "cached_property", "setter", "deleter", "getter")
COMPOUND = ("If", "For", "AsyncFor", "While", "With", "AsyncWith", "Try", "TryStar", "Match")
CAPTURES = ("MatchAs", "MatchStar", "MatchMapping")
BINDING = ("Assign", "AnnAssign", "AugAssign", "Delete")


def _union(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _targets(rows: DataFrame) -> DataFrame:
    """Names and attribute chains that assignments and deletions bind: their scope, the statement, ``name`` and ``chain``."""
    aims = rows.where(F.col("up").isin(*BINDING) & F.col("field").isin("targets", "target")).select(*KEY, F.col("pre").alias("begin"), F.col("last").alias("until"), F.col("parent_id").alias("statement"), F.col("up").alias("by"))
    names = rows.where("kind = 'Name' and (store or text = 'Del')").select(*KEY, "pre", "name", "fn_id", "class_id")
    named = names.join(aims, list(KEY)).where("pre between begin and until").select(*KEY, "fn_id", "class_id", "statement", "by", "name", F.lit(None).cast("string").alias("chain"))
    chains = rows.where(F.col("up").isin(*BINDING) & F.col("field").isin("targets", "target") & (F.col("kind") == "Attribute") & F.col("text").isNotNull())
    return named.unionByName(chains.select(*KEY, "fn_id", "class_id", F.col("parent_id").alias("statement"), F.col("up").alias("by"), F.lit(None).cast("string").alias("name"), F.col("text").alias("chain")))


def declared_facts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(classes, members) that a file's text alone makes sure: ``owner`` (dotted name), and ``member`` with its ``fact``.

    A name that is bound in two ways, in a branch, from outside its class or by another
    statement of the module is no fact, nor is what lies in a class of such a name.
    """
    targets = written(_targets(rows), "targets")
    module = "fn_id is null and class_id is null"
    meta = rows.where("kind = 'keyword' and name = 'metaclass' and up = 'ClassDef'").select(*KEY, F.col("parent_id").alias("node_id"), F.lit(True).alias("meta"))
    classes = rows.where("kind = 'ClassDef'").join(meta, [*KEY, "node_id"], "left").withColumn("dynamic", (F.size("tags") > 0) | F.col("meta").isNotNull())
    # names of the module that more than their class binds
    loose = _union(
        rows.where(f"{module} and kind in ('FunctionDef', 'AsyncFunctionDef', 'alias')").select(*KEY, "name"),
        rows.where(module).where(F.col("kind").isin(*CAPTURES) & F.col("name").isNotNull()).select(*KEY, "name"),
        targets.where(f"{module} and name is not null").select(*KEY, "name"),
        classes.where(f"{module} and dynamic").select(*KEY, "name"),
    ).distinct()
    stars = rows.where(f"{module} and kind = 'alias' and name = '*'").select(*KEY).distinct()
    # how the names of a class's body are bound
    direct = rows.where("field = 'body' and class_id = parent_id")
    kind = F.when(F.exists("tags", lambda t: F.element_at(F.split(t, r"\."), -1).isin(*DESCRIPTORS)), "descriptor").otherwise("method")
    simple = direct.select(*KEY, F.col("node_id").alias("statement"), "class_id", "kind")
    values = rows.where("up = 'AnnAssign' and field = 'value'").select(*KEY, F.col("parent_id").alias("statement"), F.lit(True).alias("valued"))
    bound = targets.where("name is not null").drop("class_id", "fn_id", "chain").join(simple.drop("kind"), [*KEY, "statement"]).join(values, [*KEY, "statement"], "left").where("by != 'AnnAssign' or valued")
    blocks = direct.where(F.col("kind").isin(*COMPOUND)).select(*KEY, "class_id", F.col("pre").alias("begin"), F.col("last").alias("until"))
    binds = (F.col("kind") == "Name") & (F.col("store") | (F.col("text") == "Del")) | F.col("kind").isin(*FUNCTIONS, "ClassDef", "alias", "ExceptHandler", *CAPTURES)
    inner = rows.where("fn_id is null and class_id is not null and name is not null").where(binds).select(*KEY, "class_id", "name", "pre").join(blocks, [*KEY, "class_id"]).where("pre between begin and until")
    bindings = _union(
        direct.where(F.col("kind").isin(*FUNCTIONS)).select(*KEY, "class_id", "name", kind.alias("how")),
        classes.where("field = 'body' and class_id = parent_id").select(*KEY, "class_id", "name", F.explode(F.when(F.col("dynamic"), F.array(F.lit("nested"), F.lit("dynamic"))).otherwise(F.array(F.lit("nested")))).alias("how")),
        rows.where("kind = 'alias'").select(*KEY, F.col("parent_id").alias("statement"), "name").join(simple.drop("kind"), [*KEY, "statement"]).select(*KEY, "class_id", "name", F.lit("import").alias("how")),
        bound.select(*KEY, "class_id", "name", F.when(F.col("by") == "Delete", "deleted").otherwise("attribute").alias("how")),
        inner.select(*KEY, "class_id", "name", F.lit("conditional").alias("how")),
    )
    owners = classes.select(*KEY, F.col("node_id").alias("class_id"), F.col("symbol").alias("owner"))
    # Class.member = ... at module level, Inner.member = ... in a class's body
    chains = targets.where("fn_id is null and chain like '%.%'").join(owners, [*KEY, "class_id"], "left").select(*KEY, F.concat_ws(".", "owner", "chain").alias("chain"))
    rebound = chains.select(*KEY, F.regexp_replace("chain", r"\.[^.]*$", "").alias("owner"), F.element_at(F.split("chain", r"\."), -1).alias("name")).distinct()
    kinds = bindings.groupBy(*KEY, "class_id", "name").agg(F.collect_set("how").alias("how")).join(owners, [*KEY, "class_id"])
    clear = kinds.where("size(how) = 1").join(rebound, [*KEY, "owner", "name"], "left_anti")
    # classes that can be named for sure, all the way from the module
    top = classes.where("parent_id = 0 and not dynamic").join(loose, [*KEY, "name"], "left_anti")
    nested = classes.where("field = 'body' and class_id = parent_id").join(clear.select(*KEY, "class_id", "name"), [*KEY, "class_id", "name"], "left_semi")
    sure = top.select(*KEY, "node_id").unionByName(nested.select(*KEY, "node_id"))
    bad = classes.join(sure, [*KEY, "node_id"], "left_anti").select(*KEY, F.col("pre").alias("begin"), F.col("last").alias("until"))
    lost = classes.select(*KEY, "node_id", "pre").join(bad, list(KEY)).where("pre between begin and until").select(*KEY, "node_id").distinct()
    good = classes.join(lost, [*KEY, "node_id"], "left_anti").join(stars, list(KEY), "left_anti")
    last = good.groupBy(*KEY, F.col("symbol").alias("owner")).agg(F.max("node_id").alias("class_id"))
    members = clear.where("how[0] in ('method', 'attribute') and name not like '\\\\_%'").join(last, [*KEY, "owner", "class_id"]).select(*KEY, "owner", F.col("name").alias("member"), F.col("how")[0].alias("fact"))
    return last.select(*KEY, "owner"), members


def _claims(rows: DataFrame, tests: DataFrame) -> DataFrame:
    """What tests assert of names: ``of`` (the test), lines, ``helper``, ``owner``, ``member`` (null for a class), ``wants``."""
    of = tests.select(*KEY, F.col("node_id").alias("test_id"), F.col("symbol").alias("of_symbol"))
    said = F.when(F.col("kind") == "Name", F.col("name")).when(F.col("kind") == "Attribute", F.col("text"))
    worded = rows.where("kind = 'keyword'").select(*KEY, F.col("parent_id").alias("call"))
    args = rows.where("up = 'Call' and field = 'args'").select(*KEY, F.col("parent_id").alias("call"), "ord", F.col("node_id").alias("argument"), F.col("kind").alias("arg_kind"), said.alias("said"), F.when((F.col("kind") == "Constant") & (F.col("name") == "str"), F.col("text")).alias("word"), F.col("text").alias("arg_text"), F.col("n").alias("arg_n"), F.col("name").alias("arg_name"))
    asserts = rows.where("kind = 'Assert'").join(of, [*KEY, "test_id"]).select(*KEY, "test_id", "of_symbol", F.col("node_id").alias("statement"), "line", "end_line")
    calls = rows.where("kind = 'Call' and text = 'self.assertTrue'").join(of, [*KEY, "test_id"]).select(*KEY, "test_id", "of_symbol", F.col("node_id").alias("statement"), "line", "end_line")
    tested = rows.where("up = 'Assert' and field = 'test' and kind = 'Call'").select(*KEY, F.col("parent_id").alias("statement"), F.col("node_id").alias("call"), F.col("text").alias("target"), "n")
    given = rows.where("up = 'Call' and field = 'args' and ord = 0 and kind = 'Call'").select(*KEY, F.col("parent_id").alias("statement"), F.col("node_id").alias("call"), F.col("text").alias("target"), "n")
    shapes = asserts.join(tested, [*KEY, "statement"]).unionByName(calls.join(given, [*KEY, "statement"])).where("target in ('inspect.isclass', 'hasattr', 'callable')").join(worded, [*KEY, "call"], "left_anti")
    one, two = args.where("ord = 0"), args.where("ord = 1").select(*KEY, "call", F.col("word").alias("member"))
    base = [*KEY, "test_id", "of_symbol", "line", "end_line", "statement", "target"]
    is_class = shapes.where("target = 'inspect.isclass' and n = 1").join(one, [*KEY, "call"]).select(*base, F.col("said").alias("owner"), F.lit(None).cast("string").alias("member"), F.lit("class").alias("wants"))
    has = shapes.where("target = 'hasattr' and n = 2").join(one, [*KEY, "call"]).join(two, [*KEY, "call"]).where("member is not null").select(*base, F.col("said").alias("owner"), "member", F.lit("any").alias("wants"))
    inner = shapes.where("target = 'callable' and n = 1").join(one, [*KEY, "call"])
    by_dot = inner.where("arg_kind = 'Attribute' and arg_text is not null").select(*base, F.regexp_replace("arg_text", r"\.[^.]*$", "").alias("owner"), F.col("arg_name").alias("member"), F.lit("method").alias("wants"))
    got = inner.where("arg_kind = 'Call' and arg_text = 'getattr' and arg_n = 2").select(*base, F.col("argument").alias("call")).join(worded, [*KEY, "call"], "left_anti")
    by_getattr = got.join(one, [*KEY, "call"]).join(two, [*KEY, "call"]).where("member is not null").select(*base, F.col("said").alias("owner"), "member", F.lit("method").alias("wants"))
    return _union(is_class, has, by_dot, by_getattr).where("owner is not null")


def restated_declarations(tree: DataFrame) -> DataFrame:
    """Assertions that a class of the file exists, or has a member that its text declares; names that the test binds itself say nothing."""
    asked = tree.where("kind = 'Call' and text in ('inspect.isclass', 'hasattr', 'callable')").select(*KEY).distinct()
    plain = tree.where("kind != 'Comment'").join(asked, list(KEY), "left_semi")
    up = plain.select(*KEY, F.col("node_id").alias("parent_id"), F.col("kind").alias("up"))
    rows = written(plain.join(up, [*KEY, "parent_id"], "left"), "restated")
    tests = test_rules.tests(rows)
    classes, members = declared_facts(rows)
    claims = written(_claims(rows, tests), "claims")
    own = rows.where("fn_id is not null")
    stored = own.where("kind = 'Attribute' and text is not null and (store or up = 'Delete')").select(*KEY, "fn_id", F.split("text", r"\.")[0].alias("name"))
    local = _union(own.where(F.col("kind").isin("arg", "alias", *FUNCTIONS, "ClassDef") | ((F.col("kind") == "Name") & F.col("store"))).select(*KEY, "fn_id", "name"), stored).withColumnRenamed("fn_id", "test_id").distinct()
    roots = claims.withColumn("name", F.explode(F.array_distinct(F.array(F.split("owner", r"\.")[0], F.split("target", r"\.")[0]))))
    shadowed = roots.join(local, [*KEY, "test_id", "name"], "left_semi").select(*KEY, "statement").distinct()
    kept = claims.join(shadowed, [*KEY, "statement"], "left_anti")
    of_class = kept.where("wants = 'class'").join(classes, [*KEY, "owner"], "left_semi").withColumns({"evidence": F.col("owner"), "fact": F.concat(F.lit("class "), "owner")})
    of_member = kept.where("wants != 'class'").join(members, [*KEY, "owner", "member"]).where("wants = 'any' or fact = 'method'")
    dotted = F.concat_ws(".", "owner", "member")
    of_member = of_member.withColumns({"evidence": dotted, "fact": F.when(F.col("fact") == "method", F.concat(F.lit("method "), dotted, F.lit("()"))).otherwise(F.concat(F.lit("attribute "), dotted))})
    columns = [*KEY, "line", "end_line", "of_symbol", "target", "evidence", "fact"]
    hits = of_class.select(columns).unionByName(of_member.select(columns))
    message = F.concat("of_symbol", F.lit(" contains a static-analysis-redundant candidate: "), "target", F.lit(" asserts "), "evidence", F.lit(", but "), "fact", F.lit(" is declared in the same parsed file."))
    return found(hits, "test-quality.static-analysis-redundant-test", "advisory", "high", message, "test-quality", F.col("of_symbol"))
