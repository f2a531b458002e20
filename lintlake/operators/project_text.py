"""Rules on project files that are no code: workflows, requirement files, environment files, keys and addresses in text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.functions.text import entropy, redacted
from lintlake.operators.text_rules import WORKFLOW, lines

#: Options of requirement files, shapes of declarations, keys and placeholders.
OPTIONS = ("-c", "--constraint", "-f", "--find-links", "-i", "--index-url", "--extra-index-url", "--no-binary", "--no-index", "--only-binary", "--prefer-binary", "--pre", "-r", "--requirement", "--trusted-host", "-U", "--upgrade")
DIRECT = r"^\s*([A-Za-z0-9][A-Za-z0-9_.-]*)(?:\[[^\]]+\])?\s*@\s*(\S+)"
NAMED = r"^\s*([A-Za-z0-9][A-Za-z0-9_.-]*)(?:\[[^\]]+\])?"
REQUIREMENTS = r"(^|/)requirements[^/]*\.(txt|in)$"
HEAD_CHECKOUT = r"github\.event\.pull_request\.head\.(?:sha|ref)\b"
SECRET_USE = r"\$\{\{\s*secrets\.([A-Za-z_][A-Za-z0-9_]*)\s*\}\}"
PR_TRIGGER = r"(?m)^\s*(?:on:\s*\[?[^\n]*)?\bpull_request\b"
ENV_KEY = r"^([A-Z][A-Z0-9_]*(?:KEY|SECRET|TOKEN|PASSWORD|PASSWD|API_KEY|AUTH|CREDENTIAL|SIGNATURE|PRIVATE))\s*=\s*(.+?)\s*$"
ENV_PLACEHOLDERS = ("changeme", "your_secret_here", "TODO", "REPLACE_ME", "xxx", "***", "")
ENV_LENGTH, ENV_BITS, KEY_BODY = 12, 3.0, 100
SERVICE_ACCOUNT = r'"type"\s*:\s*"service_account"'
KEY_FIELD = r'"private_key"\s*:\s*"((?:\\.|[^"\\])*)"'
PEM_BLOCK = r"(?s)-----BEGIN[^-]*PRIVATE KEY-----.*?-----END[^-]*PRIVATE KEY-----"
USER_URL = r"https?://[^\s:/@\"']+:([^\s@/\"']+)@[A-Za-z0-9.-]+"
PASSWORDS = ("password", "passwd", "pass", "secret", "changeme", "xxx", "***", "<password>", "your_password", "example", "dummy", "redacted")


def found(rows: DataFrame, rule: Column | str, severity: str, confidence: str, message: Column | str, pillar: str = "security") -> DataFrame:
    """Rows with a line as findings of a rule."""
    return rows.select(
        "project", (F.lit(rule) if isinstance(rule, str) else rule).alias("rule_id"), F.col("path").alias("file_path"), F.col("line").cast("int").alias("line"), F.lit(None).cast("int").alias("end_line"), F.lit(None).cast("string").alias("symbol"),
        F.lit(severity).alias("severity"), F.lit(pillar).alias("pillar"), F.lit(confidence).alias("confidence"), (F.lit(message) if isinstance(message, str) else message).alias("message"),
    )


def first_line(units: DataFrame, pattern: str) -> DataFrame:
    """Units whose source matches, with the line of the first match."""
    before = F.expr("substring(source, 1, at - 1)")
    hit = units.withColumn("at", F.regexp_instr("source", F.lit(pattern))).where("at > 0")
    return hit.withColumn("line", F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1)


def untrusted_checkouts(units: DataFrame) -> DataFrame:
    rows = first_line(units.where(F.col("path").rlike(WORKFLOW) & F.col("source").rlike(HEAD_CHECKOUT)), r"\bpull_request_target\b")
    return found(rows, "security.github-actions-pull-request-target", "error", "high", "`pull_request_target` workflow checks out the PR head ref - it runs untrusted fork code with a write token and repository secrets in scope.")


def secrets_in_pull_requests(units: DataFrame) -> DataFrame:
    """Repository secrets in workflows that pull requests start (known from documentation only)."""
    flows = units.where(F.col("path").rlike(WORKFLOW) & F.col("source").rlike(PR_TRIGGER))
    rows = lines(flows).where(F.col("text").rlike(SECRET_USE)).withColumn("name", F.regexp_extract("text", SECRET_USE, 1)).where("name != 'GITHUB_TOKEN'")
    return found(rows, "security.github-actions-secrets-in-pr", "warning", "medium", F.concat(F.lit("Repository secret `"), "name", F.lit("` is used in a workflow that pull requests trigger.")))


def declarations(units: DataFrame) -> DataFrame:
    """Dependencies of requirement files: ``project, path, line, raw``; comments, options and editable marks are cut."""
    rows = lines(units.where(F.lower("path").rlike(REQUIREMENTS))).withColumn("raw", F.trim(F.regexp_replace("text", r"(^|\s)#.*$", "")))
    rows = rows.withColumn("raw", F.trim(F.regexp_replace("raw", r"^(-e|--editable)\s+", ""))).where("raw != ''")
    option = reduce(lambda a, b: a | b, [(F.col("raw") == o) | F.col("raw").startswith(f"{o} ") | F.col("raw").startswith(f"{o}=") for o in OPTIONS])
    return rows.where(~option).select("project", "path", "line", "raw")


def _kinds(rows: DataFrame) -> DataFrame:
    """Declarations with ``kind``: git, local or url, in this order of precedence, and the dependency's name."""
    low, direct = F.lower("raw"), F.regexp_extract("raw", DIRECT, 2)
    ref = F.when(direct != "", direct).otherwise(F.col("raw"))
    git = low.startswith("git+") | low.contains(" @ git+") | low.startswith("git@")
    named = F.col("raw").rlike(r"^[A-Za-z0-9][A-Za-z0-9_.-]*(\[[^\]]+\])?\s*([<>=!~;@ ]|$)")
    local = F.lower(ref).startswith("file:") | ref.rlike(r"^(\./|\.\./|/|~/)") | ref.rlike(r"^[A-Za-z]:[/\\]") | (~named & ref.contains("/") & ~ref.contains("://")) | low.startswith("path:")
    kind = F.when(git, "git").when(local, "local").when(F.lower(ref).rlike("^https?://"), "url")
    egg = F.regexp_extract("raw", r"[#&]egg=([A-Za-z0-9_.-]+)", 1)
    name = F.when(direct != "", F.regexp_extract("raw", DIRECT, 1)).when(egg != "", egg).when(~F.col("raw").rlike(r"[/:]"), F.regexp_extract("raw", NAMED, 1))
    # generated once a row: a projection would be written out again wherever its columns are used
    made = F.array(F.struct(kind.alias("kind"), F.regexp_replace(F.lower(name), r"[-_.]+", "-").alias("name")))
    return rows.select("project", "path", "line", F.explode(made).alias("r")).select("project", "path", "line", "r.*")


#: Per kind of reference: its rule, and what is wrong with it.
REFERENCES = {
    "git": ("security.dependency-git-reference", " is installed from a Git reference. VCS dependencies bypass normal package release review and are easy to move accidentally."),
    "local": ("security.dependency-local-path", " is installed from a local path. Local references depend on checkout layout and can hide code outside the reviewed package boundary."),
    "url": ("security.dependency-url-reference", " is installed from a direct artifact URL. Registry packages with exact versions are easier to review and reproduce."),
}


def dependency_references(units: DataFrame) -> DataFrame:
    """Dependencies from Git, local paths and artifact addresses: three rules in one pass, by a join with their texts."""
    rows = _kinds(declarations(units)).where("kind is not null")
    texts = rows.sparkSession.createDataFrame([(k, rule, text) for k, (rule, text) in REFERENCES.items()], "kind string, rule string, text string")
    label = F.coalesce(F.concat(F.lit("Dependency `"), "name", F.lit("`")), F.lit("Dependency declaration"))
    return found(rows.join(texts, "kind"), F.col("rule"), "warning", "high", F.concat(label, "text"))


def service_account_keys(units: DataFrame) -> DataFrame:
    """Service accounts with a real private key: at least a hundred characters of it."""
    field = F.regexp_extract("source", KEY_FIELD, 1)
    value = F.when(field != "", field).otherwise(F.regexp_extract("source", PEM_BLOCK, 0))
    body = F.regexp_replace(F.regexp_replace(value, "-----[^-]*-----", ""), "[^A-Za-z0-9+/=]", "")
    files = units.where(F.col("source").contains("service_account")).where(F.length(body) >= KEY_BODY)
    return found(lines(files).where(F.col("text").rlike(SERVICE_ACCOUNT)), "sensitive-data.gcp-service-account-key", "error", "high", "GCP service-account key JSON embeds private-key material.", "sensitive-data")


def environment_values(units: DataFrame) -> DataFrame:
    rows = lines(units.where(F.col("path").rlike(r"(^|/)\.env(\.[^/]*)?$"))).where(F.col("text").rlike(ENV_KEY))
    value = F.regexp_replace(F.trim(F.regexp_extract("text", ENV_KEY, 2)), "^[\"']+|[\"']+$", "")
    rows = rows.withColumns({"key": F.regexp_extract("text", ENV_KEY, 1), "value": value})
    rows = rows.where(~F.col("value").isin(*ENV_PLACEHOLDERS) & (F.length("value") >= ENV_LENGTH) & ~F.col("value").startswith("$") & (entropy(F.col("value")) >= ENV_BITS))
    return found(rows, "sensitive-data.hardcoded-env-value", "warning", "medium", F.concat(F.lit("`.env` value for `"), "key", F.lit("` looks like a hard-coded secret.")), "sensitive-data")


def credential_addresses(units: DataFrame) -> DataFrame:
    """Web addresses with a user and a password that is no placeholder (known from documentation only)."""
    rows = lines(units.where(F.col("source").rlike(USER_URL))).withColumn("password", F.explode(F.regexp_extract_all("text", F.lit(USER_URL), F.lit(1))))
    rows = rows.where(~F.lower("password").isin(*PASSWORDS) & ~F.col("password").rlike(r"^[$<{]"))
    return found(rows, "sensitive-data.url-credentials", "error", "high", F.concat(F.lit("URL with embedded credentials: "), redacted(F.col("password"))), "sensitive-data")


RULES = (untrusted_checkouts, secrets_in_pull_requests, dependency_references, service_account_keys, environment_values, credential_addresses)


def all_rules(units: DataFrame) -> DataFrame:
    """The findings of every rule here."""
    return reduce(DataFrame.unionByName, [rule(units) for rule in RULES])
