"""Rules on the flow of values: user input that reaches files and HTTP clients, and SQL text put together at run time.

An expression is cut into regions: nodes whose values make up one another's. A node
that is no part of its parent's value begins a region, and running sums over a file's
nodes in source order number the regions. What an expression carries is then an
aggregate over its region. Statements give events in source order, with markers where
branches begin and end; the state of a scope, a stack of sets of tainted names, is one
ordered fold over its events.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintlake.operators.code_rules import KEY
from lintlake.operators.security_rules import found, frameworks, leaf
from lintlake.sources.store import together, written

#: Names that the rules look for.
REQUEST_PARTS = ("json", "form", "args", "GET", "POST", "data", "query_params", "values")
PARAMETER_SOURCES = ("Query", "Body", "Path", "Form", "Header", "Cookie", "File")
COPIES, REMOVALS = ("copyfile", "copy", "copy2", "move", "rename"), ("remove", "unlink")
PATH_METHODS, PATH_TYPES = ("read_text", "read_bytes", "write_text", "write_bytes", "open"), ("Path", "PurePath", "PosixPath", "PurePosixPath")
HTTP_CLIENTS, HTTP_VERBS = ("requests", "httpx", "urllib", "urllib3"), ("get", "post", "put", "patch", "delete", "head", "options")
HTTP_WORDS = ("request", "urlopen", "httpx")
SQL_CALLS = ("execute", "executemany", "executescript", "text")
SQL_WORDS = r"(?i)\b(?:SELECT|INSERT|UPDATE|DELETE|ALTER|DROP|CREATE|REPLACE|TRUNCATE|FROM|WHERE)\b"
VALUE_BEFORE = r"(?i)(?:=|<>|!=|<=|>=|<|>|\bLIKE\b|\bILIKE\b)\s*['\"]?\s*$"
STRUCTURE_BEFORE = r"(?i)(?:\bFROM\b|\bJOIN\b|\bUPDATE\b|\bINTO\b|\bTABLE\b|\bSELECT\b|\bORDER\s+BY\b|\bGROUP\s+BY\b|\bIN)\s*\(?\s*$"
QUOTED_PLACEHOLDER = r"""(['"])\s*(?:%s|%\([A-Za-z_][A-Za-z0-9_]*\)s|\?|:\w+|\$\d+)\s*\1"""

FUNCTIONS, ASSIGNMENTS, LOOPS = ("FunctionDef", "AsyncFunctionDef"), ("Assign", "AnnAssign", "AugAssign"), ("For", "AsyncFor", "While")
#: Where statements are walked one by one; all else below a statement (``with`` and ``match`` bodies, too) is looked at with the state before it.
BODIES = {"Module": ("body",), "FunctionDef": ("body",), "AsyncFunctionDef": ("body",), "ClassDef": ("body",), "If": ("body", "orelse"), "For": ("body", "orelse"), "AsyncFor": ("body", "orelse"), "While": ("body", "orelse"), "Try": ("body", "handlers", "orelse", "finalbody"), "ExceptHandler": ("body",)}
#: Parts of a statement that are not looked at.
UNSEEN = {"Assign": ("targets",), "AnnAssign": ("target", "annotation"), "AugAssign": ("target",), "For": ("target",), "AsyncFor": ("target",), "ExceptHandler": ("type",)}
STATE = "struct<stack:array<array<string>>,hits:array<int>>"


def _among(pairs: dict[str, tuple[str, ...]]) -> Column:
    return reduce(lambda a, b: a | b, [(F.col("up") == kind) & F.col("field").isin(*fields) for kind, fields in pairs.items()])


def with_parents(tree: DataFrame) -> DataFrame:
    """The nodes (without comments) with their parent's kind ``up`` and name ``up_name``, and whether it is a ``format`` call."""
    rows = tree.where("kind != 'Comment'")
    up = rows.select(*KEY, F.col("node_id").alias("parent_id"), F.col("kind").alias("up"), F.col("name").alias("up_name"))
    formats = rows.where("kind = 'Attribute' and field = 'func' and name = 'format'").select(*KEY, "parent_id", F.lit(True).alias("formats"))
    return rows.join(up, [*KEY, "parent_id"], "left").join(formats, [*KEY, "parent_id"], "left").withColumn("formats", F.coalesce("formats", F.lit(False)))


def in_regions(rows: DataFrame, joined: Column) -> DataFrame:
    """The nodes with ``root``: the node that begins the region of which each is a part; ``joined`` says that a node is part of its parent's.

    A running sum over the begins and ends of regions gives each node's depth in them;
    of the beginnings at one depth, the last before a node is its own.
    """
    cut = rows.withColumn("begins", ~F.coalesce(joined, F.lit(False)))
    none = [F.lit(None).cast(t).alias(c) for c, t in cut.dtypes if c not in (*KEY, "pre")]
    ends = cut.where("begins").select(*KEY, (F.col("last") + 1).alias("pre"), *none, F.lit(-1).alias("step"))
    both = cut.withColumn("step", F.col("begins").cast("int")).unionByName(ends)
    order = Window.partitionBy(*KEY).orderBy("pre", "step").rowsBetween(Window.unboundedPreceding, 0)
    # at one place ends come first; nodes that begin nothing change nothing
    deep = both.withColumn("deep", F.sum("step").over(order)).where("node_id is not null")
    return deep.withColumn("root", F.last(F.when(F.col("begins"), F.col("node_id")), True).over(Window.partitionBy(*KEY, "deep").orderBy("pre").rowsBetween(Window.unboundedPreceding, 0))).drop("step", "deep", "begins")


def seen_statements(rows: DataFrame) -> DataFrame:
    """The nodes with ``live`` (walked as a statement), ``at`` (place of the statement they are looked at with; null if unseen) and ``target_of``.

    A node is inside another if that one began before it and ends with or after it, so
    running maxima of ends tell what a node is inside of.
    """
    before = Window.partitionBy(*KEY).orderBy("pre").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*KEY).orderBy("pre").rowsBetween(Window.unboundedPreceding, 0)
    inside = lambda c, w: F.coalesce(F.max(F.when(c, F.col("last"))).over(w) >= F.col("pre"), F.lit(False))
    walked = F.col("parent_id").isNull() | _among(BODIES)
    rows = rows.withColumn("walked", F.coalesce(walked, F.lit(False)))
    rows = rows.withColumn("up_live", ~inside(~F.col("walked"), before)).withColumn("live", F.col("walked") & F.col("up_live"))
    unseen = F.col("up_live") & F.coalesce(_among(UNSEEN) | (F.col("up").isin(*FUNCTIONS, "ClassDef") & (F.col("field") != "body")), F.lit(False))
    target = F.col("up_live") & F.coalesce(F.col("up").isin(*ASSIGNMENTS) & F.col("field").isin("targets", "target"), F.lit(False))
    rows = rows.withColumns({"unseen": inside(unseen, upto), "starred": inside(F.col("kind") == "Starred", upto), "statement": F.col("live") & ~F.col("kind").isin("Module", "ExceptHandler")})
    latest = F.last(F.when(F.col("statement"), F.col("pre")), True).over(upto)
    aim = F.last(F.when(target, F.struct(F.col("last").alias("end"), F.col("parent_id").alias("of"))), True).over(upto)
    rows = rows.withColumns({"at": F.when(~F.col("unseen"), latest), "aim": aim})
    return rows.withColumn("target_of", F.when(F.col("aim.end") >= F.col("pre"), F.col("aim.of"))).withColumn("scope", F.coalesce("fn_id", "class_id", F.lit(0))).drop("aim", "walked")


def _carries() -> Column:
    """Whether a node's value is part of its parent's: an input in the one is an input in the other."""
    joined = _among({"Attribute": ("value",), "Subscript": ("value", "slice"), "JoinedStr": ("values",), "FormattedValue": ("value",), "IfExp": ("body", "orelse")})
    return joined | ((F.col("up") == "BinOp") & F.col("up_name").isin("Add", "Mod")) | (F.col("formats") & F.col("field").isin("func", "args"))


def flow_nodes(tree: DataFrame) -> DataFrame:
    """The nodes of files that a rule of this module looks at, with parents, statements and regions; written, as all that follows reads them."""
    sql = tree.where((F.col("kind") == "Call") & leaf().isin(*SQL_CALLS) & (F.col("n") > 0)).select(*KEY)
    wanted = frameworks(tree, "flask", "django", "fastapi").unionByName(_http_files(tree)).unionByName(sql).distinct()
    return written(in_regions(seen_statements(with_parents(tree.join(wanted, list(KEY), "left_semi"))), _carries()), "flow")


def carried(rows: DataFrame) -> DataFrame:
    """What each region can carry: ``node_id`` of its beginning, ``names``, ``sourced`` (holds a part of the request)."""
    request = rows.where("name = 'request' and kind in ('Name', 'Attribute') and up = 'Attribute' and field = 'value'").select(*KEY, F.col("parent_id").alias("node_id"), F.lit(True).alias("of_request"))
    leaves = rows.where((F.col("kind") == "Name") | ((F.col("kind") == "Attribute") & F.col("name").isin(*REQUEST_PARTS))).join(request, [*KEY, "node_id"], "left")
    sourced = (F.col("kind") == "Attribute") & F.col("of_request").isNotNull()
    return leaves.groupBy(*KEY, F.col("root").alias("node_id")).agg(F.collect_set(F.when(F.col("kind") == "Name", F.col("name"))).alias("names"), F.max(sourced).alias("sourced"))


def parameter_sources(rows: DataFrame) -> DataFrame:
    """Parameters that a framework fills from the request, by annotation or default: ``node_id`` of the function, ``name``."""
    args = rows.where("kind = 'arg' and field in ('posonlyargs', 'args', 'kwonlyargs')").select(*KEY, "node_id", F.col("parent_id").alias("holder"), "field", "ord", "name", F.col("fn_id").alias("of"))
    source = ((F.col("kind") == "Name") & F.col("name").isin(*PARAMETER_SOURCES)) | ((F.col("kind") == "Call") & leaf().isin(*PARAMETER_SOURCES))
    notes = rows.where("up = 'arg' and field = 'annotation'")
    plain = notes.where((F.col("kind") == "Name") & F.col("name").isin(*PARAMETER_SOURCES)).select(*KEY, F.col("parent_id").alias("node_id"))
    # a subscript's slice, or the parts of its tuple
    slices = rows.where("up = 'Subscript' and field = 'slice'").select(*KEY, F.col("node_id").alias("slice"), F.col("parent_id").alias("subscript"), "kind", "name", "text")
    parts = rows.where("up = 'Tuple' and field = 'elts'").select(*KEY, F.col("parent_id").alias("slice"), "kind", "name", "text")
    inner = slices.where(source).select(*KEY, "subscript").unionByName(parts.where(source).join(slices.where("kind = 'Tuple'").select(*KEY, "slice", "subscript"), [*KEY, "slice"]).select(*KEY, "subscript"))
    noted = notes.where("kind = 'Subscript'").select(*KEY, F.col("node_id").alias("subscript"), F.col("parent_id").alias("node_id")).join(inner, [*KEY, "subscript"], "left_semi").select(*KEY, "node_id")
    by_note = args.join(plain.unionByName(noted).distinct(), [*KEY, "node_id"], "left_semi").select(*KEY, "of", "name")
    calls = rows.where((F.col("kind") == "Call") & leaf().isin(*PARAMETER_SOURCES) & (F.col("up") == "arguments"))
    given = rows.where("up = 'arguments'").groupBy(*KEY, F.col("parent_id").alias("holder")).agg(*[F.count_if(F.col("field") == f).cast("int").alias(f"n_{f}") for f in ("posonlyargs", "args", "defaults")])
    # defaults belong to the last positional parameters
    place = args.join(given, [*KEY, "holder"]).select(*KEY, "holder", "of", "name", F.when(F.col("field") == "kwonlyargs", "kw_defaults").otherwise("defaults").alias("field"), F.when(F.col("field") == "kwonlyargs", F.col("ord")).otherwise(F.col("ord") + F.when(F.col("field") == "args", F.col("n_posonlyargs")).otherwise(0) - F.col("n_posonlyargs") - F.col("n_args") + F.col("n_defaults")).alias("ord"))
    by_default = place.join(calls.select(*KEY, F.col("parent_id").alias("holder"), "field", "ord"), [*KEY, "holder", "field", "ord"]).select(*KEY, "of", "name")
    return by_note.unionByName(by_default).withColumnRenamed("of", "node_id")


def tainted(rows: DataFrame, sinks: DataFrame) -> DataFrame:
    """Of ``sinks`` (``node_id`` of expressions) those that user input reaches.

    ``rows`` are ``flow_nodes``. A branch starts with the state before it; after
    ``if`` a name is tainted if both branches leave it so, after a loop if it was
    before as well, after ``try`` if it is at the end of it and of every handler.
    Functions and classes begin with a state of their own. Calls give clean values, but
    for ``format`` of something tainted.
    """
    holds = written(carried(rows), "carried")
    live = rows.where("live")
    empty = F.array().cast("array<string>")

    def event(at: Column | str, phase: int, inner: Column | int, sub: int, op: str, names: Column | None = None, aims: Column | None = None, sourced: Column | None = None, n: Column | int = 0, m: Column | int = 0, node: Column | None = None) -> Column:
        number = lambda x: (F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)).cast("int")
        return F.struct(
            number(at).alias("at"), number(phase).alias("phase"), number(inner).alias("inner"), number(sub).alias("sub"), F.lit(op).alias("op"), (empty if names is None else F.coalesce(names, empty)).alias("names"),
            (empty if aims is None else F.coalesce(aims, empty)).alias("aims"), (F.lit(False) if sourced is None else F.coalesce(sourced, F.lit(False))).alias("sourced"), number(n).alias("n"), number(m).alias("m"), (F.lit(-1) if node is None else node).cast("int").alias("node"),
        )

    # looked-at sinks, in the scope of their statement
    scopes = live.where("statement").select(*KEY, F.col("pre").alias("at"), "scope")
    asked = rows.where("at is not null").drop("scope").join(sinks, [*KEY, "node_id"], "left_semi").join(holds, [*KEY, "node_id"]).join(scopes, [*KEY, "at"])
    asked = asked.select(*KEY, "scope", event("at", 1, 0, 0, "use", F.col("names"), None, F.col("sourced"), node=F.col("node_id")).alias("e"))
    asked = written(asked, "sinks")
    wanted = asked.select(*KEY, "scope").distinct()

    def of_scope(events: DataFrame) -> DataFrame:
        return events.join(wanted, [*KEY, "scope"], "left_semi").select(*KEY, "scope", "e")

    aims = rows.where("target_of is not null and kind = 'Name' and store and not starred").groupBy(*KEY, F.col("target_of").alias("node_id")).agg(F.collect_set("name").alias("aims"))
    values = rows.where((F.col("field") == "value") & F.col("up").isin(*ASSIGNMENTS)).select(*KEY, "node_id", "parent_id").join(holds, [*KEY, "node_id"]).select(*KEY, F.col("parent_id").alias("node_id"), "names", "sourced")
    assigned = live.where(F.col("kind").isin(*ASSIGNMENTS)).select(*KEY, "scope", "node_id", "kind", "pre").join(aims, [*KEY, "node_id"]).join(values, [*KEY, "node_id"], "left")
    sets = assigned.select(*KEY, "scope", F.when(F.col("kind") == "AugAssign", event("pre", 1, 0, 1, "add", F.col("names"), F.col("aims"), F.col("sourced"))).otherwise(event("pre", 1, 0, 1, "set", F.col("names"), F.col("aims"), F.col("sourced"))).alias("e"))
    drops = live.where(F.col("kind").isin(*FUNCTIONS, "ClassDef")).select(*KEY, "scope", event("pre", 1, 0, 1, "set", None, F.array("name")).alias("e"))
    seeds = parameter_sources(rows).groupBy(*KEY, F.col("node_id").alias("scope")).agg(F.collect_set("name").alias("aims")).select(*KEY, "scope", event(F.lit(-1), 0, 0, 0, "add", None, F.col("aims"), F.lit(True)).alias("e"))
    # markers: a copy of the state where a branch begins, the meeting of branches where the statement ends
    parts = live.where(F.col("up").isin("If", *LOOPS, "Try")).groupBy(*KEY, F.col("parent_id").alias("node_id")).agg(
        F.min(F.when(F.col("field") == "body", F.col("pre"))).alias("first"), F.max(F.when(F.col("field").isin("body", "handlers"), F.col("last"))).alias("turn"), F.array_sort(F.collect_list(F.when(F.col("field") == "handlers", F.col("pre")))).alias("handlers"))
    control = live.where(F.col("kind").isin("If", *LOOPS, "Try")).select(*KEY, "scope", "node_id", "kind", "pre", "last").join(parts, [*KEY, "node_id"])
    k, tries, inner = F.size("handlers"), F.col("kind") == "Try", -F.col("pre")
    marks = F.concat(
        F.array(
            event("first", 0, 0, 0, "copy", n=1),
            event("turn", 2, inner, 0, "copy", n=F.when(tries, k + 1).otherwise(2)),
            event("last", 2, inner, 1, "meet", n=F.when(tries, k + 3).otherwise(3), m=F.when(tries, k + 1).when(F.col("kind") == "If", 2).otherwise(3)),
        ),
        F.transform("handlers", lambda pre, i: event(pre, 0, 0, 0, "copy", n=i + 2)),
    )
    branches = control.select(*KEY, "scope", F.explode(marks).alias("e"))
    events = asked.unionByName(of_scope(sets)).unionByName(of_scope(drops)).unionByName(of_scope(seeds)).unionByName(of_scope(branches))

    def step(s: Column, e: Column) -> Column:
        stack, top = s["stack"], F.element_at(s["stack"], -1)
        hot = e["sourced"] | F.arrays_overlap(e["names"], top)
        rest = F.slice(stack, F.lit(1), F.size(stack) - 1)
        changed = F.when(hot, F.array_union(top, e["aims"])).when(e["op"] == "set", F.array_except(top, e["aims"])).otherwise(top)
        last = F.slice(stack, -e["m"], e["m"])
        met = F.aggregate(last, F.element_at(last, -1), lambda a, b: F.array_intersect(a, b))
        after = (
            F.when(e["op"] == "use", stack)
            .when(e["op"] == "copy", F.concat(stack, F.array(F.element_at(stack, -e["n"]))))
            .when(e["op"] == "meet", F.concat(F.slice(stack, F.lit(1), F.size(stack) - e["n"]), F.array(met)))
            .otherwise(F.concat(rest, F.array(changed)))
        )
        hits = F.when((e["op"] == "use") & hot, F.concat(s["hits"], F.array(e["node"]))).otherwise(s["hits"])
        return F.struct(after.alias("stack"), hits.alias("hits")).cast(STATE)

    start = F.struct(F.array(empty).alias("stack"), F.array().cast("array<int>").alias("hits")).cast(STATE)
    folded = events.groupBy(*KEY, "scope").agg(F.array_sort(F.collect_list("e")).alias("events"))
    return folded.select(*KEY, F.explode(F.aggregate("events", start, step, lambda s: s["hits"])).alias("node_id"))


def _arguments(rows: DataFrame, place: int = 0) -> DataFrame:
    """Positional arguments at a place: ``node_id``, ``call``."""
    return rows.where((F.col("up") == "Call") & (F.col("field") == "args") & (F.col("ord") == place)).select(*KEY, "node_id", F.col("parent_id").alias("call"))


def path_sinks(rows: DataFrame) -> DataFrame:
    """Arguments that name a file that is opened, copied or removed: ``node_id``, ``call``."""
    first = _arguments(rows)
    methods = rows.where((F.col("kind") == "Attribute") & (F.col("field") == "func") & F.col("name").isin(*PATH_METHODS)).select(*KEY, F.col("node_id").alias("func"), F.col("parent_id").alias("outer"))
    paths = rows.where((F.col("kind") == "Call") & (F.col("field") == "value") & (F.col("up") == "Attribute") & leaf().isin(*PATH_TYPES)).select(*KEY, F.col("node_id").alias("call"), F.col("parent_id").alias("func"))
    by_path = first.join(paths.join(methods, [*KEY, "func"]), [*KEY, "call"]).select(*KEY, "node_id", F.col("outer").alias("call"))
    head = F.split("text", r"\.")[0]
    named = (F.col("text") == "open") | (leaf().isin(*REMOVALS) & (head == "os")) | (leaf().isin(*COPIES) & (head == "shutil"))
    calls = rows.where((F.col("kind") == "Call") & named).select(*KEY, F.col("node_id").alias("call"))
    return by_path.unionByName(first.join(calls, [*KEY, "call"], "left_semi").select(*KEY, "node_id", "call"))


def _http_files(tree: DataFrame) -> DataFrame:
    """Files that import an HTTP client at their top level, and in which a word for requests occurs."""
    root = F.split(F.when(F.col("origin").isNotNull(), F.col("origin")).otherwise(F.col("text")), r"\.")[0]
    clients = tree.where((F.col("kind") == "alias") & (F.col("n") == 1) & root.isin(*HTTP_CLIENTS)).select(*KEY).distinct()
    words = reduce(lambda a, b: a | b, [F.coalesce(F.col(c).contains(w), F.lit(False)) for c in ("name", "text", "origin") for w in HTTP_WORDS])
    return clients.join(tree.where(words).select(*KEY), list(KEY), "left_semi")


def address_sinks(rows: DataFrame) -> DataFrame:
    """Arguments that are the address of an HTTP request: ``node_id``, ``call``."""
    calls = lambda *names: rows.where((F.col("kind") == "Call") & leaf().isin(*names)).select(*KEY, F.col("node_id").alias("call"))
    return _arguments(rows).join(calls(*HTTP_VERBS, "urlopen"), [*KEY, "call"], "left_semi").unionByName(_arguments(rows, 1).join(calls("request"), [*KEY, "call"], "left_semi"))


def reached_sinks(tree: DataFrame, rows: DataFrame) -> DataFrame:
    """Files opened by a path from the request in files that import a web framework, and requests to an address from it in files that import an HTTP client."""
    paths = path_sinks(rows).join(frameworks(tree, "flask", "django", "fastapi"), list(KEY), "left_semi").withColumn("what", F.lit("path"))
    addresses = address_sinks(rows).join(_http_files(tree), list(KEY), "left_semi").withColumn("what", F.lit("address"))
    sinks = written(paths.unionByName(addresses), "asked")
    hit = sinks.join(tainted(rows, sinks.select(*KEY, "node_id").distinct()), [*KEY, "node_id"], "left_semi").select(*KEY, F.col("call").alias("node_id"), "what").distinct()
    calls = written(rows.where("kind = 'Call'").join(hit, [*KEY, "node_id"]), "reached")
    path = F.concat(F.lit("`"), F.coalesce("text", F.lit("?")), F.lit("(...)` reads/writes a user-controlled path - path traversal risk."))
    address = F.concat(F.lit("`"), "text", F.lit("(...)` receives a user-controlled URL - SSRF risk via internal services, cloud metadata, or other reachable targets."))
    return found(calls.where("what = 'path'"), "security.path-traversal", "error", "high", path).unionByName(found(calls.where("what = 'address'"), "security.ssrf", "error", "high", address))


def module_constants(rows: DataFrame) -> DataFrame:
    """Module-level names in capitals that are bound once in their file, to a string: ``name``, ``value``.

    Any other binding of the name at module level, also in blocks, loops, imports and
    walrus expressions, a ``global`` of it or its deletion anywhere takes it out.
    """
    capitals = F.col("name").rlike("^[A-Z][A-Z0-9_]*$")
    module = F.col("fn_id").isNull() & F.col("class_id").isNull()
    stores = rows.where((F.col("kind") == "Name") & capitals & F.col("store") & module)
    imports = rows.where((F.col("kind") == "alias") & capitals & module)
    dropped = rows.where((F.col("kind") == "Name") & capitals & (F.col("text") == "Del") & (F.col("up") == "Delete"))
    globals_ = rows.where("kind = 'Global'").select(*KEY, F.explode("tags").alias("name"))
    key = [*KEY, "name"]
    bound = stores.select(*key).unionByName(imports.select(*key)).unionByName(dropped.select(*key)).unionByName(globals_.select(*key)).groupBy(*key).agg(F.count(F.lit(1)).alias("times")).where("times = 1")
    top = rows.where("up = 'Module' and kind = 'Assign'").select(*KEY, F.col("node_id").alias("parent_id"))
    texts = rows.where("kind = 'Constant' and name = 'str' and up = 'Assign' and field = 'value'").select(*KEY, "parent_id", F.col("text").alias("value"))
    several = rows.where("up = 'Assign' and field = 'targets' and ord = 1").select(*KEY, "parent_id")
    aimed = stores.where("up = 'Assign' and field = 'targets' and ord = 0").select(*key, "parent_id").join(several, [*KEY, "parent_id"], "left_anti")
    return aimed.join(bound, key, "left_semi").join(top, [*KEY, "parent_id"], "left_semi").join(texts, [*KEY, "parent_id"]).select(*key, "value")


def fixed_texts(rows: DataFrame, constants: DataFrame, roots: DataFrame) -> DataFrame:
    """Of each expression in ``roots`` (``node_id``): ``fixed`` (whether it is known before the program runs) and ``fragments``, its known texts.

    Bottom-up evaluation without a walk: a node is fixed if no node of its region that
    is below it is unknown, and its text is what the leaves below it hold, in order.
    """
    method = rows.where("kind = 'Attribute' and name = 'format' and field = 'func'").select(*KEY, F.col("node_id").alias("parent_id"), F.lit(True).alias("format_func"))
    shaped = rows.where("up = 'FormattedValue' and field = 'format_spec'").select(*KEY, F.col("parent_id").alias("node_id"), F.lit(True).alias("shaped"))
    values = constants.select(*KEY, "name", F.lit("Name").alias("kind"), F.col("value").alias("held"))
    all_ = rows.join(method, [*KEY, "parent_id"], "left").join(shaped, [*KEY, "node_id"], "left").join(values, [*KEY, "kind", "name"], "left")
    joined = _among({"JoinedStr": ("values",), "FormattedValue": ("value",), "BinOp": ("left", "right"), "Tuple": ("elts",)}) | (F.col("formats") & F.col("field").isin("func", "args", "keywords")) | ((F.col("up") == "keyword") & (F.col("field") == "value")) | F.col("format_func")
    of = in_regions(all_, joined).join(roots.select(*KEY, F.col("node_id").alias("root")), [*KEY, "root"], "left_semi")
    kind, is_text = F.col("kind"), (F.col("kind") == "Constant") & (F.col("name") == "str")
    holds_format = F.col("fmt").isNotNull()
    fmt = rows.where("formats and field = 'func'").select(*KEY, F.col("parent_id").alias("node_id"), F.lit(True).alias("fmt"))
    of = of.join(fmt, [*KEY, "node_id"], "left")
    known = (
        F.when(is_text | (kind == "JoinedStr"), True)
        .when(kind == "Name", F.col("held").isNotNull())
        .when(kind == "FormattedValue", (F.col("n") == -1) & F.col("shaped").isNull())
        .when(kind == "BinOp", F.col("name").isin("Add", "Mod"))
        .when(kind == "Tuple", (F.col("up") == "BinOp") & (F.col("up_name") == "Mod") & (F.col("field") == "right"))
        .when(kind == "Call", holds_format)
        .when(kind == "Attribute", (F.col("field") == "func") & F.col("formats"))
        .when(kind == "keyword", F.col("name").isNotNull())
        .otherwise(False)
    )
    node = F.struct("pre", "last", "kind", "node_id", F.coalesce(known, F.lit(False)).alias("known"), F.when(is_text, F.col("text")).otherwise(F.col("held")).alias("held"))
    regions = of.groupBy(*KEY, F.col("root")).agg(F.array_sort(F.collect_list(node)).alias("nodes"))
    under = lambda x, y: (y["pre"] >= x["pre"]) & (y["pre"] <= x["last"])
    # what is fixed by itself: parts that stand for a text; what is in a fixed part, or in a tuple, isn't one of its own
    units = F.filter("nodes", lambda x: x["kind"].isin("Constant", "Name", "JoinedStr", "BinOp", "Call") & ~F.exists("nodes", lambda y: under(x, y) & ~y["known"]))
    regions = regions.withColumn("units", units)
    covers = lambda x, y: (y["pre"] < x["pre"]) & (x["pre"] <= y["last"])
    outer = F.filter("units", lambda x: ~F.exists("units", lambda y: covers(x, y)) & ~F.exists("nodes", lambda y: (y["kind"] == "Tuple") & covers(x, y)))
    texts = F.transform("outer", lambda x: F.array_join(F.transform(F.filter("nodes", lambda y: under(x, y) & y["held"].isNotNull()), lambda y: y["held"]), ""))
    regions = regions.withColumn("outer", outer)
    return regions.select(*KEY, F.col("root").alias("node_id"), F.exists("outer", lambda x: x["node_id"] == F.col("root")).alias("fixed"), texts.alias("fragments"))


def contexts(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """Of each expression in ``roots`` the fixed text before every value that its f-strings put in: ``node_id``, ``before``."""
    methods = rows.where("kind = 'Attribute' and field = 'func' and up = 'Call'")
    parts_of = methods.select(*KEY, "parent_id", F.lit(True).alias("in_method"))
    receivers = methods.select(*KEY, F.col("node_id").alias("parent_id"), F.lit(True).alias("in_func"))
    all_ = rows.join(parts_of, [*KEY, "parent_id"], "left").join(receivers, [*KEY, "parent_id"], "left").join(roots.select(*KEY, "node_id", F.lit(True).alias("asked")), [*KEY, "node_id"], "left")
    joined = _among({"BinOp": ("left", "right"), "keyword": ("value",)}) | (F.col("in_method") & F.col("field").isin("func", "args", "keywords")) | F.col("in_func")
    texts = in_regions(all_, F.col("asked").isNull() & joined).where("kind = 'JoinedStr'").select(*KEY, "root", F.col("node_id").alias("text_id"))
    part = F.struct("ord", "kind", F.when((F.col("kind") == "Constant") & (F.col("name") == "str"), F.col("text")).otherwise("").alias("text"))
    parts = rows.where("up = 'JoinedStr' and field = 'values'").groupBy(*KEY, F.col("parent_id").alias("text_id")).agg(F.array_sort(F.collect_list(part)).alias("parts"))
    before = F.transform(F.filter("parts", lambda x: x["kind"] == "FormattedValue"), lambda x: F.array_join(F.transform(F.filter("parts", lambda y: y["ord"] < x["ord"]), lambda y: y["text"]), ""))
    return texts.join(parts, [*KEY, "text_id"]).groupBy(*KEY, F.col("root").alias("node_id")).agg(F.flatten(F.collect_list(before)).alias("before"))


def sql_concatenation(tree: DataFrame, rows: DataFrame) -> DataFrame:
    """SQL calls whose text is built at run time, or that quote a placeholder beside parameters."""
    rows = rows.drop("root")
    sql = frameworks(tree, "sqlalchemy").withColumn("sqlalchemy", F.lit(True))
    calls = rows.where((F.col("kind") == "Call") & leaf().isin(*SQL_CALLS)).join(sql, list(KEY), "left").where((leaf() != "text") | F.col("sqlalchemy").isNotNull())
    named = rows.where("kind = 'keyword' and name in ('parameters', 'params')").select(*KEY, F.col("parent_id").alias("node_id"), F.lit(True).alias("named")).distinct()
    arguments = rows.where("up = 'Call' and field = 'args' and ord = 0").select(*KEY, F.col("parent_id").alias("node_id"), F.col("node_id").alias("argument"), F.col("kind").alias("of_kind"), F.col("name").alias("of_name"), F.col("text").alias("of_text"), F.col("dyn").alias("built"))
    calls = calls.join(arguments, [*KEY, "node_id"]).join(named, [*KEY, "node_id"], "left").withColumn("given", (F.col("n") > 1) | F.col("named").isNotNull())
    calls = written(calls, "calls")
    roots = calls.where("built").select(*KEY, F.col("argument").alias("node_id")).distinct()
    rows = written(rows.join(roots.select(*KEY).distinct(), list(KEY), "left_semi"), "sql")
    known = written(fixed_texts(rows, module_constants(rows), roots).withColumnRenamed("node_id", "argument"), "known")
    values = written(contexts(rows, roots).withColumnRenamed("node_id", "argument"), "contexts")
    dynamic = calls.where("built").join(known, [*KEY, "argument"], "left").join(values, [*KEY, "argument"], "left")
    dynamic = dynamic.where(~F.coalesce("fixed", F.lit(False)) & ((leaf() != "execute") | F.coalesce(F.exists("fragments", lambda t: t.rlike(SQL_WORDS)), F.lit(False))))
    some = lambda pattern: F.coalesce(F.exists("before", lambda t: t.rlike(pattern)), F.lit(False))
    structure = F.col("given") & some(STRUCTURE_BEFORE) & ~some(VALUE_BEFORE)
    message = F.concat(F.lit("`"), "text", F.when(structure, "()` receives dynamic SQL structure - validate SQL fragments.").otherwise("()` receives a dynamic SQL string - use parameterised arguments."))
    quoted = calls.where((F.col("of_kind") == "Constant") & (F.col("of_name") == "str") & F.col("given") & F.col("of_text").rlike(QUOTED_PLACEHOLDER))
    one = found(dynamic, "security.sql-concatenation", "warning", "medium", message)
    return one.unionByName(found(quoted, "security.sql-concatenation", "warning", "medium", F.concat(F.lit("`"), "text", F.lit("()` manually quotes a SQL placeholder while passing parameters - leave placeholders unquoted."))))


def all_rules(tree: DataFrame) -> DataFrame:
    rows = flow_nodes(tree)
    one, two = together(tree.sparkSession, [("findings-reached", lambda: reached_sinks(tree, rows)), ("findings-sql", lambda: sql_concatenation(tree, rows))])
    return one.unionByName(two)
