"""Operators over the findings table: distinct, suppression, baseline, changed regions, hook.

A path names a file within its project only, so every key begins with the project, and
what findings are held against has a project as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintlake.functions.grading import severity_rank
from lintlake.functions.identity import fingerprint, stable_identity

#: What makes two findings the same.
DISTINCT_KEY = ("project", "rule_id", "file_path", "line", "end_line", "column", "symbol", "message", "metadata_json")


def distinct_findings(findings: DataFrame) -> DataFrame:
    """One finding of each key; the others' fields follow from the key."""
    return findings.dropDuplicates(list(DISTINCT_KEY))


def ordered(findings: DataFrame) -> DataFrame:
    """By project, file, line (null as 0), rule and message; remaining columns break ties."""
    return findings.orderBy("project", "file_path", F.coalesce("line", F.lit(0)), "rule_id", "message", "column", "symbol")


def with_identities(findings: DataFrame) -> DataFrame:
    return findings.withColumns({"fingerprint": fingerprint(), "stable_identity": stable_identity()})


def select_rules(rules: DataFrame, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> DataFrame:
    """Enabled rules that an include names by id, pillar or tier (all without includes) and no exclude names."""

    def named(names: tuple[str, ...]) -> Column:
        return F.col("rule_id").isin(*names) | F.col("pillar").isin(*names) | F.col("tier").isin(*names)

    out = rules.where("enabled")
    out = out.where(named(include)) if include else out
    return out.where(~named(exclude)) if exclude else out


def over_threshold(measures: DataFrame, rules: DataFrame) -> DataFrame:
    """Measures beyond their rule's threshold: over it, or under it where the rule says ``below``. Spark broadcasts the rules only if they are small."""
    beyond = F.when(F.col("below"), F.col("value") < F.col("threshold")).otherwise(F.col("value") > F.col("threshold"))
    return measures.join(rules.select("rule_id", "threshold", "below", "severity"), "rule_id").where(beyond)


def unsuppressed(findings: DataFrame, suppressions: DataFrame) -> DataFrame:
    """Without findings that a suppression of their file (null line) or of their very line names.

    Two equi anti-joins, so neither is a nested loop.
    """
    key = ["project", "file_path", "rule_id"]
    whole = suppressions.where("line is null").select(*key)
    single = suppressions.where("line is not null").select(*key, "line")
    return findings.join(whole, key, "left_anti").join(single, [*key, "line"], "left_anti")


def without_allowed(findings: DataFrame, previews: DataFrame) -> DataFrame:
    """Without sensitive-data findings whose preview is allowed: in their project, or in all if ``previews`` has no projects."""
    where = ["project"] if "project" in previews.columns else []
    allowed = previews.select(*[F.col(c).alias(f"in_{c}") for c in where], F.col("preview").alias("allowed")).distinct()
    same = (F.col("pillar") == "sensitive-data") & (F.get_json_object("metadata_json", "$.preview") == F.col("allowed"))
    return findings.join(allowed, same & (F.col("project") == F.col("in_project")) if where else same, "left_anti")


def apply_baseline(findings: DataFrame, baseline: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new findings, findings that the baseline knows, stale baseline entries) by project, fingerprint, rule and file."""
    key = ["project", "fingerprint", "rule_id", "file_path"]
    known = baseline.select(*key).distinct()
    return findings.join(known, key, "left_anti"), findings.join(known, key, "left_semi"), baseline.join(findings.select(*key).distinct(), key, "left_anti")


def as_baseline(findings: DataFrame) -> DataFrame:
    """Baseline entries of findings."""
    return findings.select("project", "fingerprint", "rule_id", "file_path", "line", "symbol", "message")


def merged_ranges(regions: DataFrame, *key: str) -> DataFrame:
    """Overlapping and adjacent ranges (``start``, ``end``) of each key as one: a running end parts islands.

    Ranges without a start come last: they are part of the island before them.
    """
    order = Window.partitionBy(*key).orderBy(F.asc_nulls_last("start"), F.asc_nulls_last("end"))
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(before.isNull() | (F.col("start") > before + 1), 1).otherwise(0)
    islands = regions.select(*key, "start", "end").withColumn("opens", opens).withColumn("island", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*key, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def in_changed_lines(findings: DataFrame, regions: DataFrame, anchor_only: tuple[str, ...] = ()) -> DataFrame:
    """Findings whose lines overlap a changed range of their file; without a line, whose file changed.

    ``anchor_only`` rules are held to their first line. Equi on the file first.
    """
    last = F.when(F.col("rule_id").isin(*anchor_only), F.col("line")).otherwise(F.coalesce("end_line", "line")) if anchor_only else F.coalesce("end_line", "line")
    r = regions.select(F.col("project").alias("r_project"), F.col("file_path").alias("r_file"), F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    overlap = (F.col("r_start") <= last) & (F.col("line") <= F.col("r_end"))
    return findings.join(r, (F.col("project") == F.col("r_project")) & (F.col("file_path") == F.col("r_file")) & (F.col("line").isNull() | overlap), "left_semi")


def enclosing_declaration(findings: DataFrame, declarations: DataFrame) -> DataFrame:
    """Each finding with the declaration around its line: its own symbol's first, then the shortest, then the first."""
    d = declarations.select(F.col("project").alias("d_project"), F.col("file_path").alias("d_file"), F.col("symbol").alias("declared"), F.col("start").alias("d_start"), F.col("end").alias("d_end"))
    inside = (F.col("project") == F.col("d_project")) & (F.col("file_path") == F.col("d_file")) & (F.col("line") >= F.col("d_start")) & (F.col("line") <= F.col("d_end"))
    best = F.min_by(
        F.struct("declared", "d_start", "d_end"),
        F.struct(F.when(F.col("declared").eqNullSafe(F.col("symbol")), 0).otherwise(1), F.col("d_end") - F.col("d_start"), F.col("d_start"), F.col("declared")),
    )
    return findings.join(d, inside).groupBy("finding_id", "project", "file_path", "line").agg(best.alias("d")).select("finding_id", "project", "file_path", "line", "d.declared", "d.d_start", "d.d_end")


def in_changed_symbols(findings: DataFrame, declarations: DataFrame, regions: DataFrame) -> DataFrame:
    """Findings that overlap a changed range, or whose enclosing declaration does."""
    direct = in_changed_lines(findings, regions).select("finding_id")
    around = enclosing_declaration(findings, declarations).select("finding_id", "project", "file_path", F.col("d_start").alias("line"), F.col("d_end").alias("end_line"), F.lit("").alias("rule_id"))
    near = in_changed_lines(around, regions).select("finding_id")
    return findings.join(direct.unionByName(near).distinct(), "finding_id", "left_semi")


def displayed(findings: DataFrame, least_severity: str = "advisory", include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> DataFrame:
    """What a report shows: a least severity, and pillars or rules to include and exclude."""
    from lintlake.functions.grading import SEVERITY_RANK

    out = findings.where(severity_rank() >= SEVERITY_RANK[least_severity])
    names = lambda xs: F.col("pillar").isin(*xs) | F.col("rule_id").isin(*xs)
    out = out.where(names(include)) if include else out
    return out.where(~names(exclude)) if exclude else out


def hook_scope() -> Column:
    """What a finding is about: the project, a file, a symbol or a line."""
    return F.when(F.col("file_path").isNull(), "project").when(F.col("line").isNull(), "file").when(F.col("symbol").isNotNull(), "symbol").otherwise("line")


def hook_identity() -> Column:
    """Identity in the hook's comparison: symbol, else the scope for project and file findings, else the message."""
    scope = hook_scope()
    tail = F.when(F.col("symbol").isNotNull(), F.col("symbol")).when(scope.isin("project", "file"), scope).otherwise(F.col("message"))
    return F.concat_ws("|", "rule_id", F.coalesce("file_path", F.lit("")), tail)


def new_only(head: DataFrame, base: DataFrame) -> DataFrame:
    """Head findings whose hook identity the base snapshot of their project lacks; ``hook_order`` sorts them."""
    seen = base.select("project", hook_identity().alias("identity")).distinct()
    return head.withColumns({"identity": hook_identity(), "scope": hook_scope()}).join(seen, ["project", "identity"], "left_anti")


def hook_order(findings: DataFrame) -> DataFrame:
    """Errors first, then by file, line (null as 0) and rule."""
    return findings.orderBy(F.desc(severity_rank()), "file_path", F.coalesce("line", F.lit(0)), "rule_id")


#: Metadata keys whose measure is in lines, a count or a score.
LINE_KEYS = ("lines", "averageLines")
COUNT_KEYS = ("assertions", "attributes", "cycles", "fieldCount", "groupSize", "markers", "methodCount", "mocks", "parameters", "publicMethods")
SCORE_KEYS = ("complexity", "cognitive", "maintainabilityIndex")


def hook_metadata(findings: DataFrame) -> DataFrame:
    """Of findings with a threshold in their metadata: ``measured``, ``direction`` (above unless stated) and ``unit``; else null."""
    value = lambda k: F.get_json_object("metadata_json", f"$.{k}")
    has = lambda keys: F.coalesce(*[value(k) for k in keys]).isNotNull()
    unit = (
        F.when(has(LINE_KEYS), "lines")
        .when(has(("densityPer1000",)), "per_1000_lines")
        .when(has(("halsteadVolume",)), "volume")
        .when(has(SCORE_KEYS), "score")
        .when(has(COUNT_KEYS) | F.col("rule_id").startswith("size."), "count")
        .otherwise("value")
    )
    bounded = value("threshold").isNotNull()
    return findings.withColumns({
        "measured": F.when(bounded, F.coalesce(value("measured"), value("measuredValue"), *[value(k) for k in (*LINE_KEYS, *COUNT_KEYS)])),
        "direction": F.when(bounded, F.coalesce(value("direction"), value("thresholdDirection"), F.lit("above"))),
        "unit": F.when(bounded, F.coalesce(value("unit"), unit)),
    })


def unknown_suppressions(suppressions: DataFrame, rules: DataFrame) -> DataFrame:
    """Suppressions that name no rule."""
    return suppressions.join(rules.select("rule_id"), "rule_id", "left_anti")
