"""Directives in comments: suppressions as a relation, their diagnostics, and directives without a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.operators.security_rules import found

#: Shapes of directives of common tools, and words that explain nothing.
DIRECTIVES = (
    r"noqa(?:\s*:\s*[A-Z0-9]+(?:[,\s]+[A-Z0-9]+)*)?",
    r"type:\s*ignore(?:\[[^\]]+\])?",
    r"pyright:\s*ignore(?:\[[^\]]+\])?",
    r"pragma:\s*no\s+cover",
)
ENDS = r"(?=\s*(?:#|--|-|:|$))"
GENERIC_REASONS = ("because", "fix", "ignore", "needed", "silence", "temporary", "todo", "works")
RULE_ID = r"^[a-z0-9]+(?:-[a-z0-9]+)*\.[a-z0-9]+(?:-[a-z0-9]+)*$"
VALID = ("disable", "disable-next", "disable-file")


def _comments(tree: DataFrame) -> DataFrame:
    return tree.where("kind = 'Comment'").select("project", "path", "line", "text")


def _parsed(tree: DataFrame, tool: str) -> DataFrame:
    """Comments that speak to the tool, with their directive and the list of ids (null if malformed)."""
    marker = rf"(?i)#\s*{tool}\s*:\s*(.*)$"
    rows = _comments(tree).where(F.col("text").rlike(marker)).withColumn("body", F.regexp_replace(F.regexp_extract("text", marker, 1), r"\s+--\s.*$", ""))
    shape = r"^\s*([A-Za-z-]+)\s*=\s*(.*?)\s*$"
    good = F.col("body").rlike(shape)
    ids = F.transform(F.split(F.regexp_extract("body", shape, 2), ","), lambda x: F.trim(x))
    return rows.select("project", "path", "line", F.when(good, F.lower(F.regexp_extract("body", shape, 1))).alias("directive"), F.when(good, ids).alias("ids"))


def suppressions(tree: DataFrame, rules: DataFrame | None = None, tool: str = "lintlake") -> DataFrame:
    """``project, path, line, rule_id`` of every accepted id: the comment's line, the next one, or null for the file.

    ``rules`` has the known ids (``rule_id``); others suppress nothing.
    """
    rows = _accepted(_parsed(tree, tool))
    line = F.when(F.col("directive") == "disable", F.col("line")).when(F.col("directive") == "disable-next", F.col("line") + 1)
    out = rows.where(F.col("rule_id").rlike(RULE_ID)).select("project", "path", line.alias("line"), "rule_id").distinct()
    return out if rules is None else out.join(rules.select("rule_id").distinct(), "rule_id", "left_semi").select("project", "path", "line", "rule_id")


def _whole() -> Column:
    """A known directive with ids, none of them empty."""
    return F.col("directive").isin(*VALID) & ~F.exists("ids", lambda x: x == "")


def _accepted(rows: DataFrame) -> DataFrame:
    return rows.where(_whole()).select("project", "path", "line", "directive", F.explode("ids").alias("rule_id"))


def suppression_diagnostics(tree: DataFrame, rules: DataFrame, tool: str = "lintlake") -> DataFrame:
    """What is wrong with suppressions: ``project, path, line, type, message``."""
    rows = _parsed(tree, tool)
    message = (
        F.when(F.col("directive").isNull(), F.lit("Malformed suppression comment."))
        .when(~F.col("directive").isin(*VALID), F.concat(F.lit('Unknown suppression directive "'), "directive", F.lit('".')))
        .when(F.exists("ids", lambda x: x == ""), F.lit("Suppression must name at least one explicit rule id."))
    )
    broken = rows.withColumn("message", message).where("message is not null").withColumn("type", F.lit("suppression-parse-error"))
    ids = _accepted(rows)
    invalid = ids.where(~F.col("rule_id").rlike(RULE_ID)).withColumns({"message": F.concat(F.lit('Invalid rule id "'), "rule_id", F.lit('".')), "type": F.lit("suppression-parse-error")})
    unknown = ids.where(F.col("rule_id").rlike(RULE_ID)).join(rules.select("rule_id").distinct(), "rule_id", "left_anti").withColumns({"message": F.concat(F.lit('Unknown rule id "'), "rule_id", F.lit('".')), "type": F.lit("suppression-unknown-rule")})
    columns = ["project", "path", "line", "type", "message"]
    return broken.select(columns).unionByName(invalid.select(columns)).unionByName(unknown.select(columns))


def unexplained(tree: DataFrame, tool: str = "lintlake") -> DataFrame:
    """Directives whose reason has fewer than two words that say something."""
    own = rf"{tool}:\s*disable(?:-next|-file)?\s*=\s*[A-Za-z0-9_.-]+(?:\s*,\s*[A-Za-z0-9_.-]+)*"
    body = F.regexp_replace("text", r"^#+\s*", "")
    shapes = [rf"(?i)({d}){ENDS}" for d in (*DIRECTIVES, own)]
    # the first shape that is in the comment decides
    which = F.coalesce(*[F.when(body.rlike(s), F.regexp_extract(body, s, 1)) for s in shapes])
    rows = _comments(tree).withColumn("body", body).withColumn("directive", F.trim(which)).where("directive is not null")
    tail = F.trim(F.expr("substring(body, instr(body, directive) + length(directive))"))
    reason = F.when(tail.contains("#"), F.expr("substring(tail, instr(tail, '#') + 1)")).when(tail.startswith("--"), F.expr("substring(tail, 3)")).when(tail.rlike("^[-:]"), F.expr("substring(tail, 2)")).otherwise(F.col("tail"))
    rows = rows.withColumn("tail", tail).withColumn("reason", F.trim(reason))
    words = F.transform(F.regexp_extract_all("reason", F.lit(r"[A-Za-z][A-Za-z0-9_-]*"), F.lit(0)), F.lower)
    telling = F.size(F.filter(words, lambda w: ~w.isin(*GENERIC_REASONS)))
    bare = rows.where(telling < 2).withColumn("end_line", F.col("line"))
    message = F.concat(F.lit("Suppression directive '"), "directive", F.lit("' is used "), F.when(F.col("reason") == "", F.lit("without a reason")).otherwise(F.lit("with a generic reason")), F.lit("."))
    return found(bare, "docs.ignore-directive-reason", "warning", "high", message, "documentation")
