"""Security rules without data flow: filters, joins with children and with imports over the node relation.

Every rule gives the findings relation; the symbol is null, as these rules point at
a place and not at a declaration.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.operators.code_rules import KEY, children

#: Names that the rules look for.
SMELLS = ("password", "passwd", "secret", "token", "api_key", "apikey", "auth", "credential", "private_key", "session", "signature", "digest", "hmac", "otp", "nonce", "salt")
PASSWORD_SMELLS = ("password", "passwd", "passphrase", "secret", "token", "credential", "credentials", "api_key", "apikey", "private_key")
RANDOM_METHODS = ("random", "randint", "choice", "choices", "sample", "randbytes", "getrandbits", "uniform", "randrange")
MKTEMP = ("tempfile.mktemp", "mktemp")
TEMP_PREFIXES = ("/tmp/", "/var/tmp/")
FILE_APIS = ("open", "copyfile", "copy", "copy2", "move", "remove", "unlink", "rename", "Path", "PurePath", "PosixPath", "PurePosixPath")
WILDCARDS = ("0.0.0.0", "::")
FRAMEWORKS = {"flask": "flask", "fastapi": "fastapi", "starlette": "fastapi", "django": "django", "rest_framework": "django", "quart": "flask", "sqlalchemy": "sqlalchemy"}
MARK_SAFE, ESCAPES = ("mark_safe", "SafeString", "SafeText", "format_html"), ("escape", "conditional_escape")
REQUEST_PARTS = ("json", "form", "args", "GET", "POST", "data", "query_params", "values")
UNSAFE_POLICIES = ("AutoAddPolicy", "WarningPolicy")
XML_PARSERS = (
    "xml.etree.ElementTree.parse", "xml.etree.ElementTree.fromstring", "xml.etree.ElementTree.iterparse", "xml.etree.ElementTree.XMLParser", "xml.sax.parse", "xml.sax.parseString", "xml.sax.make_parser",
    "xml.dom.minidom.parse", "xml.dom.minidom.parseString", "xml.dom.pulldom.parse", "xml.dom.pulldom.parseString", "lxml.etree.parse", "lxml.etree.fromstring",
)
SAFE_LOADERS = ("yaml.SafeLoader", "yaml.CSafeLoader")
REQUESTS_METHODS = ("get", "post", "put", "delete", "patch", "head", "options", "request")
VARIABLE_IMPORTS = ("importlib.import_module", "__import__", "import_module")
WIDE = ("Exception", "BaseException")


def found(rows: DataFrame, rule: str, severity: str, confidence: str, message: Column | str, pillar: str = "security", symbol: Column | None = None) -> DataFrame:
    """Rows of nodes as findings of a rule."""
    text = F.lit(message) if isinstance(message, str) else message
    return rows.select(
        "project", F.lit(rule).alias("rule_id"), F.col("path").alias("file_path"), "line", "end_line", (F.lit(None).cast("string") if symbol is None else symbol).alias("symbol"),
        F.lit(severity).alias("severity"), F.lit(pillar).alias("pillar"), F.lit(confidence).alias("confidence"), text.alias("message"),
    )


def _any(column: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.lower(column).contains(w) for w in words])


def leaf(column: str = "text") -> Column:
    return F.element_at(F.split(column, r"\."), -1)


def calls(tree: DataFrame) -> DataFrame:
    return tree.where("kind = 'Call'")


def keyword(tree: DataFrame, name: str, value: str | None = None) -> DataFrame:
    """Calls (their keys) with a keyword, of a value in source form if one is given."""
    rows = tree.where((F.col("kind") == "keyword") & (F.col("name") == name))
    return (rows if value is None else rows.where(F.col("text") == value)).select(*KEY, F.col("parent_id").alias("node_id")).distinct()


def argument(tree: DataFrame, place: int = 0) -> DataFrame:
    """Positional arguments at a place, as children of their calls."""
    return children(tree.withColumn("child_dyn", F.col("dyn")), f"field = 'args' and ord = {place}")


def frameworks(tree: DataFrame, *names: str) -> DataFrame:
    """Files that import a framework at their top level."""
    roots = [k for k, v in FRAMEWORKS.items() if v in names]
    root = F.split(F.coalesce("origin", "text"), r"\.")[0]
    return tree.where((F.col("kind") == "alias") & (F.col("n") == 1) & root.isin(*roots)).select(*KEY).distinct()


def resolved(tree: DataFrame) -> DataFrame:
    """Calls with ``full``: their dotted name with its head replaced by what the file's top-level imports bind it to."""
    bound = tree.where("kind = 'alias' and n = 1 and name != '*'")
    # ``import a.b`` binds a to itself; with a new name, or from a module, the name stands for the whole
    full = F.when(F.col("origin").isNotNull(), F.concat_ws(".", "origin", "text")).when(F.col("name") != F.split("text", r"\.")[0], F.col("text")).otherwise(F.col("name"))
    names = bound.groupBy(*KEY, F.col("name").alias("head")).agg(F.max_by(full, "node_id").alias("stands_for"))
    head = F.split("text", r"\.")[0]
    rows = calls(tree).where("text is not null").withColumn("head", head).join(names, [*KEY, "head"], "left")
    return rows.withColumn("full", F.when(F.col("stands_for").isNull(), F.col("text")).otherwise(F.concat("stands_for", F.expr("substring(text, length(head) + 1)"))))


def _smelly_context(words: tuple[str, ...]) -> Column:
    return _any(F.coalesce("context", F.lit("")), words)


def weak_crypto(tree: DataFrame) -> DataFrame:
    """Weak digests where an argument, the assigned name or the function's name smells of security; fast ones near passwords."""
    names = tree.where("kind in ('Name', 'Attribute') and field = 'args'").groupBy(*KEY, F.col("parent_id").alias("node_id")).agg(F.concat_ws(",", F.collect_list("name")).alias("given"))
    near = F.concat_ws(",", F.coalesce("context", F.lit("")), F.coalesce("given", F.lit("")))
    rows = calls(tree).where(leaf().isin("md5", "sha1", "sha256", "sha512") & F.col("text").rlike(r"^(hashlib\.)?[a-z0-9]+$")).join(names, [*KEY, "node_id"], "left")
    weak = leaf().isin("md5", "sha1") & _any(near, SMELLS)
    fast = leaf().isin("sha256", "sha512") & _any(near, PASSWORD_SMELLS)
    message = F.concat(F.lit("`hashlib."), leaf(), F.lit("` used in a security-smelling context - prefer SHA-256+ or a password-hashing KDF."))
    return found(rows.where(weak | fast), "security.weak-crypto", "warning", "high", message)


def insecure_random(tree: DataFrame) -> DataFrame:
    rows = calls(tree).where(F.col("text").startswith("random.") & F.expr("substring(text, 8)").isin(*RANDOM_METHODS) & _smelly_context(SMELLS))
    return found(rows, "security.insecure-random", "warning", "medium", F.concat(F.lit("`"), "text", F.lit("` used for a security-smelling value - `random` is not cryptographically secure.")))


def insecure_temp_files(tree: DataFrame) -> DataFrame:
    made = calls(tree).where(F.col("text").isin(*MKTEMP))
    one = found(made, "security.insecure-temp-file", "warning", "medium", "`tempfile.mktemp()` returns a path without creating the file - TOCTOU race risk.")
    literal = children(tree, "field = 'args' and kind = 'Constant' and name = 'str'").where(F.col("child_text").startswith(TEMP_PREFIXES[0]) | F.col("child_text").startswith(TEMP_PREFIXES[1]))
    first = literal.groupBy(*KEY, "node_id").agg(F.min_by("child_text", "child_ord").alias("place"))
    named = calls(tree).where(leaf().isin(*FILE_APIS) & ~F.col("text").isin(*MKTEMP)).join(first, [*KEY, "node_id"])
    message = F.concat(F.lit("`"), leaf(), F.lit("('"), "place", F.lit("'...)` uses a hardcoded world-writeable tmp path - symlink / race risk."))
    return one.unionByName(found(named, "security.insecure-temp-file", "warning", "medium", message))


def wildcard_binds(tree: DataFrame) -> DataFrame:
    """Servers that listen on every interface: a host keyword of ``run``, or the address tuple of ``bind``."""
    methods = children(tree, "kind = 'Attribute' and field = 'func' and name in ('run', 'bind')").select(*KEY, "node_id", F.col("child_name").alias("method"))
    hosts = tree.where("kind = 'keyword' and name = 'host'").select(*KEY, F.col("node_id").alias("at"), F.col("parent_id").alias("node_id")).join(tree.where("kind = 'Constant' and name = 'str'").select(*KEY, F.col("parent_id").alias("at"), F.col("text").alias("address")), [*KEY, "at"])
    tuples = tree.where("kind = 'Tuple' and field = 'args' and ord = 0").select(*KEY, F.col("node_id").alias("at"), F.col("parent_id").alias("node_id")).join(tree.where("kind = 'Constant' and name = 'str' and field = 'elts' and ord = 0").select(*KEY, F.col("parent_id").alias("at"), F.col("text").alias("address")), [*KEY, "at"])
    named = calls(tree).join(methods, [*KEY, "node_id"])
    rows = named.where("method = 'run'").join(hosts, [*KEY, "node_id"]).unionByName(named.where("method = 'bind'").join(tuples, [*KEY, "node_id"])).where(F.col("address").isin(*WILDCARDS))
    return found(rows, "security.hardcoded-bind-all-interfaces", "warning", "medium", F.concat(F.lit("Server binding to wildcard address `"), "address", F.lit("` - exposes the service on every network interface.")))


def flask_debug(tree: DataFrame) -> DataFrame:
    """``run(debug=True)`` and ``config.update(DEBUG=True)`` in files that import flask."""
    run = children(tree, "kind = 'Attribute' and field = 'func' and name = 'run'").select(*KEY, "node_id")
    update = tree.where("kind = 'Call' and text rlike '(^|[.])config[.]update$'").select(*KEY, "node_id")
    a = calls(tree).join(run, [*KEY, "node_id"], "left_semi").join(keyword(tree, "debug", "True"), [*KEY, "node_id"], "left_semi").withColumn("label", F.lit(".run(debug=True)"))
    b = calls(tree).join(update, [*KEY, "node_id"], "left_semi").join(keyword(tree, "DEBUG", "True"), [*KEY, "node_id"], "left_semi").withColumn("label", F.lit(".config.update(DEBUG=True)"))
    rows = a.unionByName(b).join(frameworks(tree, "flask"), list(KEY), "left_semi")
    return found(rows, "security.flask-debug-enabled", "error", "high", F.concat(F.lit("Flask debug mode enabled via `"), "label", F.lit("` - exposes the Werkzeug debugger.")))


def autoescape_off(tree: DataFrame) -> DataFrame:
    rows = resolved(tree).where("full = 'jinja2.Environment'").join(tree.where("kind = 'keyword' and name = 'autoescape' and text != 'False'").select(*KEY, F.col("parent_id").alias("node_id")), [*KEY, "node_id"], "left_anti")
    return found(rows, "security.jinja2-autoescape-off", "error", "high", "Jinja2 `Environment(...)` without `autoescape=True` leaves rendered templates exposed to XSS.")


def host_keys_unchecked(tree: DataFrame) -> DataFrame:
    rows = resolved(tree).where(F.col("full").startswith("paramiko.") & leaf("full").isin(*UNSAFE_POLICIES))
    return found(rows, "security.paramiko-no-host-key-check", "error", "high", F.concat(F.lit("`paramiko."), leaf("full"), F.lit("()` accepts unknown SSH host keys - MITM risk.")))


def unsafe_xml(tree: DataFrame) -> DataFrame:
    """Calls of parsers that resolve external entities, unless the file imports defusedxml."""
    safe = tree.where((F.col("kind") == "alias") & (F.col("n") == 1) & (F.split(F.coalesce("origin", "text"), r"\.")[0] == "defusedxml")).select(*KEY).distinct()
    rows = resolved(tree).where(F.col("full").isin(*XML_PARSERS)).join(safe, list(KEY), "left_anti")
    return found(rows, "security.xxe", "error", "high", F.concat(F.lit("`"), "full", F.lit("(...)` parses XML without external-entity protections - XXE / billion-laughs risk.")))


def unsafe_yaml(tree: DataFrame) -> DataFrame:
    """``yaml.unsafe_load``, and ``yaml.load`` without a loader that is known as safe.

    A loader that is a name stands for the last top-level assignment above the call:
    an as-of join of calls with assignments by file and name.
    """
    rows = resolved(tree).where(F.col("full").isin("yaml.load", "yaml.unsafe_load"))
    given = tree.where("kind = 'keyword' and name = 'Loader'").select(*KEY, F.col("parent_id").alias("node_id"), F.col("text").alias("loader"))
    second = children(tree, "field = 'args' and ord = 1").select(*KEY, "node_id", F.coalesce("child_text", "child_name").alias("second"), (F.col("child_kind") == "Name").alias("is_name"), F.col("child_name").alias("second_name"))
    targets = tree.where("kind = 'Assign' and parent_id = 0").select(*KEY, F.col("node_id").alias("at"), F.col("line").alias("assigned_at"), F.expr("substring(context, 2)").alias("loader"))
    values = tree.where("kind in ('Attribute', 'Name') and field = 'value'").select(*KEY, F.col("parent_id").alias("at"), F.when(F.col("kind") == "Name", F.col("name")).otherwise(F.col("text")).alias("value"))
    assigned = targets.join(values, [*KEY, "at"]).select(*KEY, "loader", "assigned_at", "value")
    with_loader = rows.join(given, [*KEY, "node_id"], "left").join(second, [*KEY, "node_id"], "left")
    with_loader = with_loader.withColumn("loader", F.coalesce("loader", F.when(F.col("is_name"), F.col("second_name")).otherwise(F.col("second"))))
    as_of = with_loader.select(*KEY, "node_id", "line", "loader").join(assigned, [*KEY, "loader"]).where("assigned_at < line").groupBy(*KEY, "node_id").agg(F.max_by("value", "assigned_at").alias("stands"))
    with_loader = with_loader.join(as_of, [*KEY, "node_id"], "left").withColumn("loader", F.coalesce("stands", "loader"))
    with_loader = with_loader.withColumn("loader", F.when(F.col("loader").contains("."), F.col("loader")).otherwise(F.concat(F.lit("yaml."), "loader")))
    bad = (F.col("full") == "yaml.unsafe_load") | F.col("loader").isNull() | ~F.col("loader").isin(*SAFE_LOADERS)
    return found(with_loader.where(bad), "security.unsafe-yaml-load", "error", "high", F.concat(F.lit("`"), "full", F.lit("(...)` can construct arbitrary Python objects from YAML input.")))


def unverified_tls(tree: DataFrame) -> DataFrame:
    """``verify=False`` of requests, an unverified context, warnings turned off."""
    requests = calls(tree).where(F.col("text").startswith("requests.") & leaf().isin(*REQUESTS_METHODS)).join(keyword(tree, "verify", "False").unionByName(keyword(tree, "verify", "0")), [*KEY, "node_id"], "left_semi")
    rows = requests.unionByName(calls(tree).where("text in ('ssl._create_unverified_context', 'urllib3.disable_warnings')"))
    message = F.concat(F.lit("`"), "text", F.when(F.col("text").startswith("requests."), "(verify=False)").otherwise("()"), F.lit("` disables TLS certificate verification."))
    return found(rows, "security.disabled-ssl-verification", "error", "high", message)


def mark_safe(tree: DataFrame) -> DataFrame:
    first = argument(tree).where(~((F.col("child_kind") == "Constant") & (F.col("child_name") == "str")) & ~((F.col("child_kind") == "Call") & F.coalesce(leaf("child_text").isin(*ESCAPES), F.lit(False)))).select(*KEY, "node_id")
    rows = calls(tree).where(leaf().isin(*MARK_SAFE)).join(first, [*KEY, "node_id"], "left_semi").join(frameworks(tree, "django"), list(KEY), "left_semi")
    return found(rows, "security.django-mark-safe", "warning", "medium", F.concat(F.lit("`"), leaf(), F.lit("(...)` applied to non-literal content - XSS risk if the value is user-controlled.")))


def raw_sql(tree: DataFrame) -> DataFrame:
    built = tree.where("dyn and field = 'args' and ord = 0").select(*KEY, F.col("parent_id").alias("node_id"))
    raw = children(tree, "kind = 'Attribute' and field = 'func' and name = 'raw'").select(*KEY, "node_id").withColumn("label", F.lit(".raw"))
    named = calls(tree).where(leaf() == "RawSQL").select(*KEY, "node_id", F.lit("RawSQL").alias("label"))
    rows = calls(tree).join(raw.unionByName(named), [*KEY, "node_id"]).join(built, [*KEY, "node_id"], "left_semi").join(frameworks(tree, "django"), list(KEY), "left_semi")
    return found(rows, "security.django-raw-sql", "warning", "high", F.concat(F.lit("`"), "label", F.lit("(...)` receives a dynamic SQL string - use parameterised arguments instead.")))


def suppressed_errors(tree: DataFrame) -> DataFrame:
    """``suppress`` of everything in a with statement, and handlers of tuples that hold everything."""
    wide = children(tree, "kind = 'Name' and field = 'args'").where(F.col("child_name").isin(*WIDE)).groupBy(*KEY, "node_id").agg(F.min_by("child_name", "child_ord").alias("caught"))
    held = calls(tree).where((leaf() == "suppress") & (F.col("field") == "context_expr")).join(wide, [*KEY, "node_id"]).select(*KEY, F.col("parent_id").alias("item"), F.concat("text", F.lit("("), "caught", F.lit(")")).alias("label"))
    items = tree.where("kind = 'withitem'").select(*KEY, F.col("node_id").alias("item"), F.col("parent_id").alias("node_id"))
    a = tree.where("kind = 'With'").join(held.join(items, [*KEY, "item"]), [*KEY, "node_id"])
    parts = children(tree, "kind = 'Name' and field = 'elts'").where(F.col("child_name").isin(*WIDE)).select(*KEY, "node_id").distinct()
    tuples = tree.where("kind = 'Tuple' and field = 'type'").join(parts, [*KEY, "node_id"], "left_semi").select(*KEY, F.col("parent_id").alias("node_id"))
    b = tree.where("kind = 'ExceptHandler'").join(tuples, [*KEY, "node_id"], "left_semi").withColumn("label", F.lit("except (..., Exception)"))
    columns = [*KEY, "line", "end_line", "label"]
    return found(a.select(columns).unionByName(b.select(columns)), "security.error-suppression", "advisory", "medium", F.concat(F.lit("Wide-exception suppression: `"), "label", F.lit("`.")))


def spread_requests(tree: DataFrame) -> DataFrame:
    spread = tree.where("kind = 'keyword' and name is null").where(F.col("text").rlike(r"(^|\.)request\.(" + "|".join(REQUEST_PARTS) + ")$")).select(*KEY, F.col("parent_id").alias("node_id"))
    return found(calls(tree).join(spread, [*KEY, "node_id"], "left_semi"), "security.extract-compact-user-input", "warning", "medium", "User-controlled dict splatted into a function's keyword arguments (`**request.<attr>`).")


def dynamic_headers(tree: DataFrame) -> DataFrame:
    of_headers = children(tree, "kind = 'Attribute' and name = 'headers' and field = 'value'").select(*KEY, "node_id")
    literal = children(tree, "kind = 'Constant' and name = 'str' and field = 'slice'").select(*KEY, "node_id")
    stored = tree.where("kind = 'Subscript' and field = 'targets'").join(of_headers, [*KEY, "node_id"], "left_semi").join(literal, [*KEY, "node_id"], "left_anti").select(*KEY, F.col("parent_id").alias("node_id"))
    rows = tree.where("kind = 'Assign'").join(stored, [*KEY, "node_id"], "left_semi").join(frameworks(tree, "flask", "fastapi", "django"), list(KEY), "left_semi")
    return found(rows, "security.header-injection", "warning", "medium", "Response header key is dynamic - header injection risk.")


def variable_imports(tree: DataFrame) -> DataFrame:
    """Imports by a name that is neither a literal nor a constant of the module (an upper-case name assigned once, to a literal)."""
    first = argument(tree).where("not (child_kind = 'Constant' and child_name = 'str')").select(*KEY, "node_id", F.when(F.col("child_kind") == "Name", F.col("child_name")).alias("given"))
    stores = tree.where("kind = 'Name' and text = 'Store'").groupBy(*KEY, F.col("name").alias("given")).agg(F.count(F.lit(1)).alias("times"))
    literal = tree.where("kind = 'Assign' and parent_id = 0").join(children(tree, "kind = 'Constant' and name = 'str' and field = 'value'").select(*KEY, "node_id"), [*KEY, "node_id"], "left_semi").select(*KEY, F.expr("substring(context, 2)").alias("given")).where(F.col("given").rlike("^_?[A-Z][A-Z0-9_]*$"))
    constants = literal.join(stores.where("times = 1"), [*KEY, "given"], "left_semi").distinct()
    rows = calls(tree).where(F.col("text").isin(*VARIABLE_IMPORTS)).join(first, [*KEY, "node_id"]).join(constants, [*KEY, "given"], "left_anti")
    return found(rows, "security.variable-import", "warning", "medium", F.concat(F.lit("`"), "text", F.lit("(...)` with a non-literal module name.")))


def wildcard_cors(tree: DataFrame) -> DataFrame:
    """Cross-origin access for any origin together with credentials (known from documentation only)."""
    rows = calls(tree).where(leaf() == "CORS").join(keyword(tree, "supports_credentials", "True"), [*KEY, "node_id"], "left_semi").join(keyword(tree, "origins", "'*'"), [*KEY, "node_id"], "left_semi")
    return found(rows, "security.cors-wildcard-with-credentials", "error", "high", "CORS allows any origin together with credentials.")


def framework_secret_keys(tree: DataFrame) -> DataFrame:
    """``SECRET_KEY`` given as a literal in a module of a framework (known from documentation only)."""
    literal = children(tree, "kind = 'Constant' and name = 'str' and field = 'value'").where("length(child_text) > 0").select(*KEY, "node_id")
    rows = tree.where("kind = 'Assign' and context = '=SECRET_KEY'").join(literal, [*KEY, "node_id"], "left_semi").join(frameworks(tree, "flask", "django"), list(KEY), "left_semi")
    return found(rows, "security.hardcoded-framework-secret-key", "error", "high", "Framework SECRET_KEY is hardcoded.")


RULES = (
    weak_crypto, insecure_random, insecure_temp_files, wildcard_binds, flask_debug, autoescape_off, host_keys_unchecked, unsafe_xml, unsafe_yaml, unverified_tls, mark_safe, raw_sql,
    suppressed_errors, spread_requests, dynamic_headers, variable_imports, wildcard_cors, framework_secret_keys,
)


def all_rules(tree: DataFrame) -> DataFrame:
    """The findings of every rule here, in one plan over one written relation."""
    return reduce(DataFrame.unionByName, [rule(tree) for rule in RULES])
