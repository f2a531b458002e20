"""One analysis: rules of every family, selection by project, distinct findings, suppressions, baseline, changed lines, scores."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.functions.taxonomy import with_taxonomy
from lintlake.operators import code, declaration_rules, directives, findings as ops, flow_rules, scoring, security_rules, structure_rules, test_rules, usage_rules
from lintlake.operators.same_projects import for_all, one_of_each, same_projects
from lintlake.sources import settings
from lintlake.sources.store import clustered, clustering, clusters, together, written

#: Columns of the findings relation that rules leave to defaults.
DEFAULTS = {"column": "cast(null as int)", "tier": "'standard'", "metadata_json": "'{}'"}

#: Rule families: each makes findings of the node relation and its functions.
FAMILIES: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {
    "security": lambda tree, functions: security_rules.all_rules(tree),
    "flow": lambda tree, functions: flow_rules.all_rules(tree),
    "tests": test_rules.all_rules,
    "declarations": declaration_rules.all_rules,
    "usage": lambda tree, functions: usage_rules.all_rules(tree),
    "structure": lambda tree, functions: structure_rules.all_rules(tree),
    "directives": lambda tree, functions: directives.unexplained(tree),
}


#: Rules that aren't where their name's first part says.
MOVED = {
    "flow": ("security.path-traversal", "security.ssrf", "security.sql-concatenation"),
    "tests": ("naming.test-naming-consistency",),
    "structure": ("test-quality.repeated-structure-missing-parametrize", "design.single-implementor-protocol", "correctness.unsafe-numeric-coercion", "correctness.substring-vocabulary-match", "waste.commented-out-code", "test-quality.static-analysis-redundant-test", "test-quality.loop-in-test"),
    "usage": (
        "waste.unused-parameter", "security.shell-injection", "dead-code.exported-but-unreferenced", "waste.empty-function", "docs.missing-module-docstring", "docs.missing-class-docstring", "docs.missing-function-docstring",
        "size.attribute-count", "size.public-method-count", "size.class-length",
    ),
    "directives": ("docs.ignore-directive-reason",),
}


def families_of(rules: list[str]) -> tuple[str, ...]:
    """The families that have one of these rules: others needn't be planned."""
    moved = {r: family for family, some in MOVED.items() for r in some}
    first = {"security": "security", "test-quality": "tests"}
    wanted = {moved.get(r) or first.get(r.split(".")[0], "declarations") for r in rules}
    return tuple(f for f in FAMILIES if f in wanted)


#: Families whose rules share nothing: each rule is planned by itself.
APART = {"usage": usage_rules.RULES, "structure": structure_rules.RULES}


def rule_findings(tree: DataFrame, families: tuple[str, ...] = tuple(FAMILIES)) -> DataFrame:
    """Findings of the families' rules over the node relation, with the whole schema; each family, or rule of it, is a job of its own, written once."""
    functions = code.functions(tree)
    apart = [(f"findings-{rule.__name__}", lambda rule=rule: rule(tree)) for f in families for rule in reversed(APART.get(f, ()))]
    whole = [(f"findings-{f}", lambda f=f: FAMILIES[f](tree, functions)) for f in families if f not in APART]
    rows = reduce(DataFrame.unionByName, together(tree.sparkSession, whole + apart))
    return with_taxonomy(rows.selectExpr("*", *(f"{v} as `{k}`" for k, v in DEFAULTS.items())))


def of_running_rules(found: DataFrame, settings: DataFrame) -> DataFrame:
    """Findings of rules that run in their project; projects without settings of their own run all."""
    own = settings.select("project").distinct()
    running = settings.select("project", "rule_id")
    return found.join(own, "project", "left_anti").unionByName(found.join(own, "project", "left_semi").join(running, ["project", "rule_id"], "left_semi"))


def running_rules(files: DataFrame, known: DataFrame) -> DataFrame:
    """``project``, ``rule_id`` of the rules that run in each configured project; ``files`` are configuration files, ``known`` the rules' own settings.

    Projects whose configuration is the same are resolved once.
    """
    spark = files.sparkSession
    same = written(same_projects(files.withColumn("file_type", F.lit(None).cast("string"))), "same-settings")
    with clustering(spark, clusters(same.where("project = same")), "project"):
        rows = written(settings.config_rows(one_of_each(files, same)), "selections")
        found = written(settings.problems(rows, known), "problems")
        running = written(settings.selected(settings.resolved(rows, found, known), rows, found).select("project", "rule_id"), "running")
    return written(for_all(running, same), "running-all")


def of_each_content(units: DataFrame, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``make`` finds in the node relation of ``units``, for projects with the same files found once.

    It may look at nothing but a project's own files. Nodes lie in clusters by file, so
    that joins of nodes with nodes don't shuffle them.
    """
    same = written(same_projects(units), "same-projects")
    units = written(one_of_each(units, same), "units")
    n = clusters(units)
    with clustering(units.sparkSession, n, "project", "path"):
        tree = clustered(code.nodes(units.repartition(n, "project", "path")), "nodes")
        found = written(make(tree), "of-contents")
    return for_all(found, same)


def project_findings(units: DataFrame, *families: str) -> DataFrame:
    """Findings of all rules of the families in the projects of ``units``."""
    return of_each_content(units, lambda tree: rule_findings(tree, families))


def analysed_projects(units: DataFrame, families: tuple[str, ...] = tuple(FAMILIES)) -> DataFrame:
    """Findings of all rules of the families in the projects of ``units``, distinct and without suppressed ones."""
    return of_each_content(units, lambda tree: analyse(written(rule_findings(tree, families), "found"), tree))


def scored(found: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pillars, projects, files) with scores and grades, of an analysis' findings."""
    priced = written(scoring.penalties(found.withColumn("measured", F.lit(None).cast("double")), "project"), "priced")
    pillars = scoring.pillar_scores(priced, "project")
    return pillars, scoring.composite(pillars, "project"), scoring.file_scores(priced, "project")


def analyse(found: DataFrame, tree: DataFrame, rules: DataFrame | None = None, baseline: DataFrame | None = None, regions: DataFrame | None = None) -> DataFrame:
    """The findings that remain, in the order in which the steps mean something: distinct, suppressed, known, unchanged ones go.

    ``found`` has the rules' findings (best written, as several steps read them) and
    ``tree`` the comments.
    """
    found = ops.distinct_findings(found)
    muted = directives.suppressions(tree, rules).withColumnRenamed("path", "file_path")
    whole, single = muted.where("line is null").drop("line"), muted.where("line is not null")
    found = found.join(whole, ["project", "file_path", "rule_id"], "left_anti").join(single, ["project", "file_path", "rule_id", "line"], "left_anti")
    found = ops.with_identities(found)
    if baseline is not None:
        found = ops.apply_baseline(found, baseline)[0]
    return found if regions is None else ops.in_changed_lines(found, regions)


def pillar_counts(found: DataFrame) -> DataFrame:
    """Findings of each project and pillar by severity."""
    return found.groupBy("project", "pillar").agg(F.count(F.lit(1)).alias("findings"), *[F.count_if(F.col("severity") == s).alias(s) for s in ("advisory", "warning", "error")])
