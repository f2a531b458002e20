"""Rules on test functions: which functions are tests, and joins of what their bodies hold with them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintlake.operators.code_rules import KEY, children
from lintlake.operators.security_rules import found, leaf

#: Names and limits of the rules.
UNITTEST_BASES = ("TestCase", "unittest.TestCase", "IsolatedAsyncioTestCase")
TESTING_BASES = ("object", "TestCase", "IsolatedAsyncioTestCase", "unittest.TestCase", "Protocol", "ABC", "Generic")
MOCK_FACTORIES = ("Mock", "MagicMock", "AsyncMock", "NonCallableMock", "NonCallableMagicMock", "PropertyMock", "create_autospec", "patch", "patch_object")
MYSTERY_ROOTS = ("requests", "urllib", "urllib3", "socket", "httpx", "aiohttp", "ftplib", "smtplib")
MYSTERY_CALLS = ("open", "popen")
SETUP_NAMES = ("setUp", "setUpClass", "setup_method", "setup_class", "setup_function", "setup")
SKIPS = ("skip", "skipif", "skipIf", "skipUnless")
MAX_ASSERTIONS, MAX_MOCKS, MAX_SETUP_LINES, MAX_LINES, MAX_CASES, SNAPSHOT, RATIO, LEAST_SUT, MAX_CYCLES = 5, 4, 30, 100, 2, 10, 2.0, 5, 2
PILLAR = "test-quality"


def tests(tree: DataFrame) -> DataFrame:
    """Test functions: bare ``test_`` ones, methods of ``Test`` classes and of unittest classes, and all of a conftest file.

    Functions inside functions are none. Adds ``scope``.
    """
    unittest = F.exists("bases", lambda b: b.isin(*UNITTEST_BASES) | b.endswith(".TestCase"))
    classes = tree.where("kind = 'ClassDef'").select(*KEY, F.col("node_id").alias("class_id"), F.col("name").alias("class_name"), unittest.alias("unittest"))
    defs = tree.where("kind in ('FunctionDef', 'AsyncFunctionDef') and test_id is null").join(classes, [*KEY, "class_id"], "left")
    scope = (
        F.when(F.col("path").endswith("conftest.py"), "conftest")
        .when(F.col("class_id").isNull(), F.when(F.col("name").startswith("test_"), "bare"))
        .when(F.col("unittest"), F.when(F.col("name").startswith("test"), "unittest"))
        .when(F.col("class_name").startswith("Test") & F.col("name").startswith("test_"), "pytest")
    )
    return defs.withColumn("scope", scope).where("scope is not null")


def _of(tree: DataFrame) -> DataFrame:
    """The key of each test, as what its nodes carry, with its symbol."""
    return tests(tree).select(*KEY, F.col("node_id").alias("test_id"), F.col("symbol").alias("test_symbol"), F.col("line").alias("test_line"), F.col("end_line").alias("test_end"))


def _held(tree: DataFrame, where: str) -> DataFrame:
    """Nodes in the bodies of tests (classes in them included, functions not)."""
    return tree.where(where).join(_of(tree), [*KEY, "test_id"])


def _first(rows: DataFrame) -> DataFrame:
    """The first node of each test, in the source's order."""
    columns = [c for c in rows.columns if c not in (*KEY, "test_id")]
    return rows.groupBy(*KEY, "test_id").agg(F.min_by(F.struct(*columns), "pre").alias("r")).select(*KEY, "test_id", "r.*")


def _test(text: str, *more: Column | str) -> Column:
    return F.concat(F.lit("Test '"), "test_symbol", F.lit("'"), F.lit(text), *more)


def _on_test(rows: DataFrame, rule: str, severity: str, confidence: str, message: Column) -> DataFrame:
    """Findings at the test itself."""
    at = rows.withColumns({"line": F.col("test_line"), "end_line": F.col("test_end")})
    return found(at, rule, severity, confidence, message, PILLAR, F.col("test_symbol"))


def _in_test(rows: DataFrame, rule: str, severity: str, confidence: str, message: Column) -> DataFrame:
    """Findings at nodes of a test."""
    return found(rows, rule, severity, confidence, message, PILLAR, F.col("test_symbol"))


def _is_assertion(prefix: str = "") -> Column:
    """Calls that assert: helpers by name, pytest's checks, warnings caught."""
    text = F.col(f"{prefix}text")
    last = F.element_at(F.split(text, r"\."), -1)
    method = text.contains(".") & (last.rlike("^assert([A-Z_]).*") | (last.isin("raises", "warns", "deprecated_call", "approx", "fail") & text.rlike(r"(^|\.)pytest\.[a-z_]+$")))
    return F.coalesce(method | (~text.contains(".") & text.startswith("assert_")) | (text == "warnings.catch_warnings"), F.lit(False))


def _is_mock() -> Column:
    return F.coalesce(leaf().isin(*MOCK_FACTORIES) | F.col("text").rlike(r"(^|\.)patch\."), F.lit(False))


def conditional_logic(tree: DataFrame) -> DataFrame:
    """The first branch of a test that is no guard: guards have no else and only leave or skip."""
    leaving = F.col("child_kind").isin("Return", "Raise", "Break", "Continue")
    skips = children(tree, "kind = 'Call' and field = 'value' and text in ('pytest.skip', 'pytest.xfail', 'pytest.fail', 'self.skipTest')").select(*KEY, F.col("node_id").alias("child_node_id"), F.lit(True).alias("skips"))
    body = children(tree, "field in ('body', 'orelse')").withColumn("branch", F.lit(True)).join(skips, [*KEY, "child_node_id"], "left")
    other = tree.where("field = 'orelse'").select(*KEY, F.col("parent_id").alias("node_id")).distinct()
    working = body.where(~(leaving | F.coalesce("skips", F.lit(False)))).select(*KEY, "node_id").unionByName(other).distinct()
    branches = _held(tree, "kind in ('If', 'Match')")
    acting = branches.where("kind = 'Match'").unionByName(branches.where("kind = 'If'").join(working, [*KEY, "node_id"], "left_semi"))
    return _in_test(_first(acting), "test-quality.conditional-logic", "advisory", "medium", _test(" contains conditional logic - split into parametrised cases."))


def eager_tests(tree: DataFrame) -> DataFrame:
    rows = _held(tree, "kind in ('Assert', 'Call')").where((F.col("kind") == "Assert") | _is_assertion())
    counts = rows.groupBy(*KEY, "test_symbol", "test_line", "test_end").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MAX_ASSERTIONS)
    return _on_test(counts, "test-quality.eager-test", "advisory", "medium", _test(" contains ", F.col("n").cast("string"), F.lit(f" assertions, above the threshold of {MAX_ASSERTIONS}.")))


def _parametrized(tree: DataFrame) -> DataFrame:
    """Parametrize decorators of tests with their cases: ``cases`` is the number of elements of a literal list or tuple."""
    decorators = tree.where("kind = 'Call' and field = 'decorator_list' and text like '%parametrize' and n >= 2")
    lists = tree.where("kind in ('List', 'Tuple') and field = 'args' and ord = 1").select(*KEY, F.col("parent_id").alias("at"), F.col("node_id").alias("cases_id"))
    elements = tree.where("field = 'elts'").groupBy(*KEY, F.col("parent_id").alias("cases_id")).agg(F.count(F.lit(1)).alias("cases"))
    counted = lists.join(elements, [*KEY, "cases_id"], "left").select(*KEY, F.col("at").alias("node_id"), F.coalesce("cases", F.lit(0)).alias("cases"))
    owners = tests(tree).select(*KEY, F.col("node_id").alias("parent_id"), F.col("symbol").alias("test_symbol"))
    return decorators.join(counted, [*KEY, "node_id"]).join(owners, [*KEY, "parent_id"])


def empty_parametrize(tree: DataFrame) -> DataFrame:
    return _in_test(_parametrized(tree).where("cases = 0"), "test-quality.empty-parametrize", "warning", "high", _test(" has @parametrize with an empty cases list."))


def parametrize_without_ids(tree: DataFrame) -> DataFrame:
    rows = _parametrized(tree).where(F.col("cases") > MAX_CASES).join(tree.where("kind = 'keyword' and name = 'ids'").select(*KEY, F.col("parent_id").alias("node_id")), [*KEY, "node_id"], "left_anti")
    return _in_test(rows, "test-quality.parametrize-annotation", "advisory", "medium", _test(" has @parametrize with ", F.col("cases").cast("string"), F.lit(" cases but no `ids=` for human-readable case names.")))


def exception_type_only(tree: DataFrame) -> DataFrame:
    wide = tree.where("kind in ('Name', 'Attribute') and field = 'args' and ord = 0 and name in ('Exception', 'BaseException')").select(*KEY, F.col("parent_id").alias("node_id"))
    matched = tree.where("kind = 'keyword' and name = 'match'").select(*KEY, F.col("parent_id").alias("node_id"))
    rows = _held(tree, "kind = 'Call'").where(leaf().isin("raises", "warns")).join(wide, [*KEY, "node_id"], "left_semi").join(matched, [*KEY, "node_id"], "left_anti")
    return _in_test(rows, "test-quality.exception-type-only", "advisory", "medium", _test(" catches a wide exception without `match=`."))


def mock_bindings(tree: DataFrame) -> DataFrame:
    """Names that a test binds to mocks: assigned ones and those of with items."""
    made = tree.where("kind = 'Call' and field in ('value', 'context_expr')").where(_is_mock()).select(*KEY, F.col("parent_id").alias("node_id"))
    holders = _held(tree, "kind in ('Assign', 'AnnAssign', 'withitem')").join(made, [*KEY, "node_id"], "left_semi").select(*KEY, "node_id", "test_id", "test_symbol", "test_line", "test_end")
    names = tree.where("kind = 'Name' and field in ('targets', 'target', 'optional_vars')").select(*KEY, F.col("parent_id").alias("node_id"), "name")
    return holders.join(names, [*KEY, "node_id"]).select(*KEY, "test_id", "test_symbol", "test_line", "test_end", "name").distinct()


_TEST = (*KEY, "test_id", "test_symbol", "test_line", "test_end")


def _listed(names: DataFrame) -> DataFrame:
    """Per test its names as a sorted list in brackets."""
    return names.groupBy(*_TEST).agg(F.concat(F.lit("['"), F.array_join(F.array_sort(F.collect_set("name")), "', '"), F.lit("']")).alias("names"))


def excessive_mocking(tree: DataFrame) -> DataFrame:
    counts = mock_bindings(tree).groupBy(*_TEST).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MAX_MOCKS)
    return _on_test(counts, "test-quality.excessive-mocking", "warning", "medium", _test(" creates ", F.col("n").cast("string"), F.lit(f" mocks, above the threshold of {MAX_MOCKS}.")))


def unused_mocks(tree: DataFrame) -> DataFrame:
    loads = tree.where("kind = 'Name' and text != 'Store'").select(*KEY, "test_id", "name").distinct()
    rows = _listed(mock_bindings(tree).join(loads, [*KEY, "test_id", "name"], "left_anti"))
    return _on_test(rows, "test-quality.unused-mock", "warning", "high", _test(" creates mock(s) never used afterwards: ", "names", F.lit(".")))


def unverified_mocks(tree: DataFrame) -> DataFrame:
    """Mocks that are never the root of an ``assert_`` call."""
    asserted = tree.where("kind = 'Call' and text rlike '[.]assert_[^.]*$'").select(*KEY, "test_id", F.split("text", r"\.")[0].alias("name")).distinct()
    rows = _listed(mock_bindings(tree).join(asserted, [*KEY, "test_id", "name"], "left_anti"))
    return _on_test(rows, "test-quality.mock-without-expectation", "advisory", "medium", _test(" has mocks with no .assert_* verification: ", "names", F.lit(".")))


def mock_only_tests(tree: DataFrame) -> DataFrame:
    """Tests with mocks that call nothing but mocks, their factories and assertions."""
    mocks = mock_bindings(tree)
    root = F.split("text", r"\.")[0]
    plain = _held(tree, "kind = 'Call'").where(~_is_assertion() & ~_is_mock()).select(*KEY, "test_id", root.alias("name"))
    real = plain.where(F.col("name").isNull() | ~F.col("name").isin("pytest", "unittest", "mock")).join(mocks.select(*KEY, "test_id", "name"), [*KEY, "test_id", "name"], "left_anti").select(*KEY, "test_id")
    rows = mocks.select(*_TEST).distinct().join(real, [*KEY, "test_id"], "left_anti")
    return _on_test(rows, "test-quality.mock-only-test", "warning", "medium", _test(" only exercises mocks - no real code is called."))


def production_bases(tree: DataFrame) -> DataFrame:
    """Test classes whose first base that is none of testing's is production code."""
    testing = lambda b: b.isin(*TESTING_BASES) | F.element_at(F.split(b, r"\."), -1).isin(*TESTING_BASES) | F.lower(F.replace(F.element_at(F.split(b, r"\."), -1), F.lit("_"), F.lit(""))).endswith("testcase")
    base = F.try_element_at(F.filter("bases", lambda b: (b != "") & ~testing(b)), F.lit(1))
    rows = tree.where("kind = 'ClassDef' and name like 'Test%' and lower(path) rlike '(^|/)tests/|^test_[^/]*[.]py$'").withColumn("base", base).where("base is not null")
    return found(rows, "test-quality.extends-production-class", "warning", "high", F.concat(F.lit("Test class '"), "name", F.lit("' extends production class '"), "base", F.lit("'.")), PILLAR, F.col("name"))


def _loops(tree: DataFrame) -> DataFrame:
    return _held(tree, "kind in ('For', 'AsyncFor', 'While')")


def loop_assertions(tree: DataFrame) -> DataFrame:
    """Loops of tests with an assertion without a message in them: an interval join within each test."""
    messages = children(tree, "field = 'msg'").select(*KEY, "node_id")
    bare = tree.where("kind = 'Assert'").join(messages, [*KEY, "node_id"], "left_anti").select(*KEY, "test_id", F.struct("line", "end_line").alias("at"), F.col("pre").alias("place"))
    pairs = _loops(tree).join(bare, [*KEY, "test_id"]).where("place between pre and last")
    rows = pairs.groupBy(*KEY, "node_id", "test_symbol").agg(F.min_by("at", "place").alias("r")).select(*KEY, "test_symbol", "r.*")
    return _in_test(rows, "test-quality.loop-assertion-without-message", "advisory", "medium", _test(" has an assertion inside a loop with no message."))


def mystery_guests(tree: DataFrame) -> DataFrame:
    rows = _first(_held(tree, "kind = 'Call'").where(F.col("text").isin(*MYSTERY_CALLS) | F.split("text", r"\.")[0].isin(*MYSTERY_ROOTS)))
    return _on_test(rows, "test-quality.mystery-guest", "advisory", "medium", _test(" touches external state via `", "text", F.lit("` - non-hermetic dependency.")))


def private_reflection(tree: DataFrame) -> DataFrame:
    own = tree.where("kind = 'Name' and field = 'value' and name in ('self', 'cls')").select(*KEY, F.col("parent_id").alias("node_id"))
    rows = _held(tree, "kind = 'Attribute' and name like '\\\\_%' and not (name like '\\\\_\\\\_%' and name like '%\\\\_\\\\_')").join(own, [*KEY, "node_id"], "left_anti")
    return _in_test(_first(rows), "test-quality.private-reflection", "warning", "medium", _test(" reaches into private attribute '", "name", F.lit("'.")))


def setup_bloat(functions: DataFrame, tree: DataFrame) -> DataFrame:
    fixtures = tree.where("kind = 'Call' and field = 'decorator_list'").where(leaf() == "fixture").select(*KEY, F.col("parent_id").alias("node_id")).distinct().withColumn("fixture", F.lit(True))
    rows = functions.where("kind != 'Lambda'").join(fixtures, [*KEY, "node_id"], "left").where((F.col("name").isin(*SETUP_NAMES) | F.col("fixture")) & (F.col("length") > MAX_SETUP_LINES))
    return found(rows, "test-quality.setup-bloat", "advisory", "medium", F.concat(F.lit("Setup '"), "symbol", F.lit("' is "), F.col("length").cast("string"), F.lit(f" lines, above the threshold of {MAX_SETUP_LINES}.")), PILLAR, F.col("symbol"))


def skipped_without_reason(tree: DataFrame) -> DataFrame:
    """The first skip decorator of a test without a reason: a bare one, or a call whose reason is missing or blank."""
    owners = tests(tree).select(*KEY, F.col("node_id").alias("parent_id"), F.col("node_id").alias("test_id_"), F.col("symbol").alias("test_symbol"))
    decorators = tree.where("field = 'decorator_list'").drop("test_id")
    bare = decorators.where("kind != 'Call'").where(F.element_at(F.split(F.coalesce(F.when(F.col("kind") == "Name", F.col("name")).otherwise(F.col("text")), F.lit("")), r"\."), -1) == "skip")
    named = tree.where("kind = 'keyword' and name = 'reason'").select(*KEY, F.col("parent_id").alias("node_id"), F.col("text").alias("reason"))
    first = children(tree, "field = 'args' and ord = 0").select(*KEY, "node_id", F.when((F.col("child_kind") == "Constant") & (F.col("child_name") == "str"), F.concat(F.lit("'"), "child_text", F.lit("'"))).otherwise("?").alias("given"))
    called = decorators.where("kind = 'Call'").where(leaf().isin(*SKIPS)).join(named, [*KEY, "node_id"], "left").join(first, [*KEY, "node_id"], "left")
    reason = F.coalesce("reason", F.when(leaf() == "skip", F.col("given")))
    silent = called.where(reason.isNull() | reason.rlike("""^(['"])\\s*\\1$""")).select(*decorators.columns)
    rows = bare.select(*decorators.columns).unionByName(silent).join(owners, [*KEY, "parent_id"]).withColumnRenamed("test_id_", "test_id")
    return _in_test(_first(rows), "test-quality.skipped-without-reason", "warning", "high", _test(" is skipped without a `reason`."))


def tautologies(tree: DataFrame) -> DataFrame:
    same = tree.where("same and field = 'test'").select(*KEY, F.col("parent_id").alias("node_id"))
    return _in_test(_held(tree, "kind = 'Assert'").join(same, [*KEY, "node_id"], "left_semi"), "test-quality.tautological-type-assertion", "advisory", "medium", _test(" asserts a tautological type relation - always true."))


def long_tests(tree: DataFrame) -> DataFrame:
    n = F.col("end_line") - F.col("start_line") + 1
    rows = tests(tree).where(n > MAX_LINES).withColumn("test_symbol", F.col("symbol"))
    return found(rows, "test-quality.test-function-too-long", "error", "high", _test(" is ", n.cast("string"), F.lit(f" lines, above the error threshold of {MAX_LINES}.")), PILLAR, F.col("symbol"))


def tests_longer_than_subject(tree: DataFrame) -> DataFrame:
    """Tests more than twice as long as the function of the same file that they are named after (the last of that name)."""
    n = F.col("end_line") - F.col("start_line") + 1
    defs = tree.where("kind in ('FunctionDef', 'AsyncFunctionDef') and name not like 'test\\\\_%'").groupBy(*KEY, F.col("name").alias("subject")).agg(F.max_by(n, "node_id").alias("subject_lines"))
    rows = tests(tree).where("name like 'test\\\\_%'").withColumns({"subject": F.expr("substring(name, 6)"), "lines": n, "test_symbol": F.col("symbol")}).join(defs, [*KEY, "subject"]).where((F.col("subject_lines") > LEAST_SUT) & (F.col("lines") > RATIO * F.col("subject_lines")))
    message = _test(" is ", F.col("lines").cast("string"), F.lit(" lines for a "), F.col("subject_lines").cast("string"), F.lit("-line SUT '"), "subject", F.lit("' (ratio "), F.format_number(F.col("lines") / F.col("subject_lines"), 1), F.lit("x)."))
    return found(rows, "test-quality.test-longer-than-sut", "advisory", "medium", message, PILLAR, F.col("symbol"))


def naming_mixtures(tree: DataFrame) -> DataFrame:
    """Test files that mix ``test_snake`` and ``testCamel`` names; at the file."""
    classes = tree.where("kind = 'ClassDef' and parent_id = 0 and name like 'Test%'").select(*KEY, F.col("node_id").alias("parent_id"))
    defs = tree.where("kind in ('FunctionDef', 'AsyncFunctionDef') and name like 'test%' and path rlike '(^|/)test_[^/]*[.]py$|(^|/)tests/'")
    rows = defs.where("parent_id = 0").unionByName(defs.join(classes, [*KEY, "parent_id"], "left_semi"))
    styles = rows.groupBy(*KEY).agg(F.count_if(F.col("name").rlike("^test(_[a-z0-9_]+)+$")).alias("snake"), F.count_if(F.col("name").rlike("^test[A-Z][A-Za-z0-9]*$")).alias("camel"))
    mixed = styles.where("snake > 0 and camel > 0").withColumns({"line": F.lit(1), "end_line": F.lit(1)})
    message = F.concat(F.lit("File mixes "), F.col("snake").cast("string"), F.lit(" snake_case test name(s) and "), F.col("camel").cast("string"), F.lit(" camelCase test name(s); pick one style."))
    return found(mixed, "naming.test-naming-consistency", "advisory", "medium", message, "naming")


def trivial_snapshots(tree: DataFrame) -> DataFrame:
    """The first assertion of a test whose expression holds a literal of ten elements or more."""
    elements = tree.where("field in ('elts', 'keys')").groupBy(*KEY, F.col("parent_id").alias("node_id")).agg(F.count(F.lit(1)).alias("n_elements")).where(F.col("n_elements") >= SNAPSHOT)
    large = tree.where("kind in ('List', 'Tuple', 'Set', 'Dict') and test_id is not null").join(elements, [*KEY, "node_id"], "left_semi").select(*KEY, "test_id", F.col("pre").alias("place"))
    tested = tree.where("field = 'test'").select(*KEY, F.col("parent_id").alias("node_id"), F.col("pre").alias("begins"), F.col("last").alias("ends"))
    rows = _held(tree, "kind = 'Assert'").join(tested, [*KEY, "node_id"])
    hit = rows.join(large, [*KEY, "test_id"]).where("place between begins and ends").select(*rows.columns).dropDuplicates([*KEY, "node_id"])
    return _in_test(_first(hit), "test-quality.trivial-snapshot", "advisory", "medium", _test(" asserts against a large literal - brittle snapshot."))


def repeated_cycles(tree: DataFrame) -> DataFrame:
    """Tests whose top-level statements go from assertions back to calls more than twice, the last assertions included.

    Runs of assertions are islands: a statement without a call neither ends nor begins one.
    """
    asserted = tree.where("kind = 'Call' and field = 'value'").where(_is_assertion()).select(*KEY, F.col("parent_id").alias("node_id"), F.lit(True).alias("asserts"))
    calling = tree.where("kind = 'Call' and fn_id is not null").select(*KEY, F.col("fn_id").alias("parent_id"), F.col("pre").alias("place"))
    body = tree.where("field = 'body'").select(*KEY, "node_id", "parent_id", "kind", "ord", "pre", "last").join(_of(tree).withColumnRenamed("test_id", "parent_id"), [*KEY, "parent_id"])
    body = body.join(asserted, [*KEY, "node_id"], "left").withColumn("is_assert", (F.col("kind") == "Assert") | ((F.col("kind") == "Expr") & F.coalesce("asserts", F.lit(False))))
    acts = body.where("not is_assert").join(calling, [*KEY, "parent_id"]).where("place between pre and last").select(*KEY, "node_id").distinct().withColumn("acts", F.lit(True))
    marked = body.join(acts, [*KEY, "node_id"], "left").where(F.col("is_assert") | F.col("acts"))
    follows = F.lead("is_assert").over(Window.partitionBy(*KEY, "parent_id").orderBy("ord"))
    ends = marked.withColumn("next", follows).where("is_assert and not coalesce(next, false)")
    cycles = ends.groupBy(*KEY, "test_symbol", "test_line", "test_end").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MAX_CYCLES)
    return _on_test(cycles, "test-quality.multiple-aaa-cycles", "advisory", "low", _test(" runs ", F.col("n").cast("string"), F.lit(" Arrange-Act-Assert cycles.")))


def naming_styles(tree: DataFrame) -> DataFrame:
    """Files with test in their path whose top-level tests are named in two styles or more; at the file."""
    style = (
        F.when(F.col("kind") != "ClassDef", F.when(F.col("name").startswith("test_"), "test_snake").when(F.col("name").rlike("^test[A-Z]"), "testCamel"))
        .when(F.col("name").startswith("Test"), "TestPrefix")
        .when(F.col("name").endswith("Test"), "SuffixTest")
    )
    rows = tree.where("kind in ('FunctionDef', 'AsyncFunctionDef', 'ClassDef') and parent_id = 0 and lower(path) like '%test%' and path like '%.py'").withColumn("style", style).where("style is not null")
    mixed = rows.groupBy(*KEY).agg(F.array_sort(F.collect_set("style")).alias("styles")).where(F.size("styles") >= 2).withColumns({"line": F.lit(1), "end_line": F.lit(None).cast("int")})
    message = F.concat(F.lit("File mixes test-naming conventions: ['"), F.array_join("styles", "', '"), F.lit("']. Pick one."))
    return found(mixed, "test-quality.naming-consistency", "advisory", "medium", message, PILLAR)


RULES = (
    conditional_logic, eager_tests, empty_parametrize, parametrize_without_ids, exception_type_only, excessive_mocking, unused_mocks, unverified_mocks, mock_only_tests, production_bases,
    loop_assertions, mystery_guests, private_reflection, skipped_without_reason, tautologies, long_tests, tests_longer_than_subject, naming_mixtures,
    trivial_snapshots, repeated_cycles, naming_styles,
)


def all_rules(tree: DataFrame, functions: DataFrame) -> DataFrame:
    """The findings of every rule here, in one plan over one written relation."""
    return reduce(DataFrame.unionByName, [rule(tree) for rule in RULES], setup_bloat(functions, tree))
