"""What changed, and what is ignored: unified diffs and ignore files as relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintlake.sources.corpus import IGNORED_FOLDERS, LOCK_FILES

from lintlake.operators.findings import merged_ranges

HUNK = r"^@@ -[0-9]+(?:,[0-9]+)? \+([0-9]+)(?:,([0-9]+))? @@"


def _header_path(text: Column) -> Column:
    """The path of a file header: without its prefix and what follows a tab; null for the null device. Quotes and their escapes go."""
    bare = F.trim(F.split(text, "\t")[0])
    plain = F.when(bare.startswith('"'), F.regexp_replace(F.regexp_replace(bare, '^"|"$', ""), r'\\(["\\])', "$1")).otherwise(bare)
    return F.when(plain == "/dev/null", None).otherwise(F.regexp_replace(plain, "^[ab]/", ""))


def changed_regions(patches: DataFrame, key: str = "project", patch: str = "patch") -> DataFrame:
    """Regions of unified diffs: ``key, file_path, start, end, whole``.

    Headers hold until the next one: the last value of each is carried down the
    lines of a patch. New files are whole; a hunk that only deletes stands for the
    line where it was; ranges that touch are one. Files without hunks have one row
    without a range.
    """
    rows = patches.select(key, F.posexplode(F.split(patch, "\r?\n")).alias("n", "text"))
    starts = F.col("text").startswith("diff --git ")
    old, new, hunk = F.col("text").startswith("--- "), F.col("text").startswith("+++ "), F.col("text").rlike(HUNK)
    rows = rows.where(starts | old | new | hunk | F.col("text").startswith("new file mode"))
    order = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    file = F.sum(F.when(starts | (old & ~F.coalesce(F.lag("text").over(Window.partitionBy(key).orderBy("n")).rlike("^(diff --git |new file mode)"), F.lit(False))), 1).otherwise(0)).over(order)
    rows = rows.withColumn("file", file)
    within = Window.partitionBy(key, "file").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    rest = F.expr("substring(text, 5)")
    git_path = F.regexp_replace(F.element_at(F.split("text", " "), -1), "^[ab]/", "")
    rows = rows.withColumn("rest", rest).withColumn("named", F.when(new, F.coalesce(_header_path(F.col("rest")), F.lit("")))).withColumn("was", F.when(old, F.coalesce(_header_path(F.col("rest")), F.lit(""))))
    rows = rows.withColumn("git", F.when(starts, git_path))
    carried = lambda c: F.last(c, ignorenulls=True).over(within)
    rows = rows.withColumns({"new_path": carried("named"), "old_path": carried("was"), "git_path": carried("git"), "made": F.max(F.when(F.col("text").startswith("new file mode"), 1).otherwise(0)).over(within)})
    path = F.coalesce(F.nullif("new_path", F.lit("")), F.col("git_path"), F.nullif("old_path", F.lit("")))
    whole = F.coalesce((F.col("old_path") == ""), F.col("made") == 1)
    rows = rows.withColumns({"file_path": path, "whole": F.when(F.col("old_path").isNotNull(), F.col("old_path") == "").otherwise(whole)}).where("file_path is not null")
    first, count = F.regexp_extract("text", HUNK, 1).cast("int"), F.coalesce(F.nullif(F.regexp_extract("text", HUNK, 2), F.lit("")).cast("int"), F.lit(1))
    hunks = rows.where(hunk & ~F.col("whole")).select(key, "file_path", F.when(count > 0, first).otherwise(F.greatest(first, F.lit(1))).alias("start"), F.when(count > 0, first + count - 1).otherwise(F.greatest(first, F.lit(1))).alias("end"))
    merged = merged_ranges(hunks, key, "file_path").withColumn("whole", F.lit(False))
    files = rows.where(new | hunk).groupBy(key, "file_path").agg(F.max("whole").alias("whole"))
    bare = files.join(merged.select(key, "file_path").distinct(), [key, "file_path"], "left_anti").select(key, "file_path", F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"), "whole")
    return merged.select(key, "file_path", "start", "end", "whole").unionByName(bare)


def in_changed_files(units: DataFrame, regions: DataFrame) -> DataFrame:
    """Source units whose file changed: a semi-join before anything is parsed."""
    return units.join(regions.select("project", F.col("file_path").alias("path")).distinct(), ["project", "path"], "left_semi")


def ignore_rules(files: DataFrame) -> DataFrame:
    """Patterns of ignore files (``project, dir, source``): ``project, dir, ordinal, regex, negated, only_dirs``."""
    rows = files.select("project", "dir", F.posexplode(F.split("source", "\r?\n")).alias("ordinal", "raw")).withColumn("raw", F.regexp_replace("raw", r"(?<!\\)\s+$", ""))
    rows = rows.where("raw != '' and raw not like '#%'").withColumn("negated", F.col("raw").startswith("!")).withColumn("body", F.regexp_replace("raw", r"^!|^\\(?=[#!])", ""))
    rows = rows.withColumn("only_dirs", F.col("body").endswith("/")).withColumn("body", F.regexp_replace("body", "/+$", "")).where("body != ''")
    anchored = F.expr("instr(body, '/') > 0")
    plain = F.regexp_replace(F.regexp_replace("body", "^/", ""), r"([.+^$(){}|])", r"\\$1")
    steps = plain
    for shape, mark in ((r"^\*\*/", "\u0001"), (r"/\*\*/", "\u0002"), (r"/\*\*$", "\u0003"), (r"\*+", "[^/]*"), (r"\?", "[^/]"), ("\u0001", "(?:.*/)?"), ("\u0002", "/(?:.*/)?"), ("\u0003", "/.+"), (r"\[!", "[^")):
        steps = F.regexp_replace(steps, shape, mark)
    regex = F.concat(F.lit("^"), F.when(anchored, F.lit("")).otherwise(F.lit("(?:.*/)?")), steps, F.lit("$"))
    return rows.select("project", "dir", "ordinal", regex.alias("regex"), "negated", "only_dirs")


def glob_regex(pattern: Column) -> Column:
    """A configured pattern as a regular expression: ``**`` crosses folders, ``*`` and ``?`` don't; a plain path also covers what is below it."""
    out = F.regexp_replace(pattern, r"([.+()\[\]{}^$|\\])", r"\\$1")
    for shape, mark in ((r"\*\*/", "\u0001"), (r"\*\*", "\u0002"), (r"\*", "[^/]*"), (r"\?", "[^/]"), ("\u0001", "(.*/)?"), ("\u0002", ".*")):
        out = F.regexp_replace(out, shape, mark)
    return F.concat(F.lit("^"), out, F.when(pattern.rlike(r"[*?]"), F.lit("$")).otherwise(F.lit("(/.*)?$")))


def ignore_decisions(paths: DataFrame, configured: DataFrame, rules: DataFrame, include_ignored: bool = False) -> DataFrame:
    """``project``, ``path``, ``source``, ``pattern`` of every path that is left out: the first reason of configuration, default folders, ignore files and lock files.

    ``configured`` has ``project, ordinal, pattern`` (the first that matches is named), ``rules`` are ``ignore_rules``.
    With ``include_ignored`` only configuration and lock files count.
    """
    files = paths.select("project", "path").distinct()
    # paths and patterns both grow with the projects, and what a generator makes is estimated too small to broadcast safely
    asked = files.join(configured.select("project", "ordinal", "pattern", glob_regex(F.col("pattern")).alias("regex")).hint("merge"), "project").where(F.rlike("path", "regex"))
    reasons = asked.select("project", "path", F.lit(1).alias("level"), F.lit("config").alias("source"), "ordinal", "pattern")
    name, nothing = F.element_at(F.split("path", "/"), -1), F.lit(None).cast("string")
    if not include_ignored:
        hidden = ignored(files, rules).where("ignored").select("project", "path", F.lit(3), F.lit("gitignore"), F.lit(0), nothing)
        # of several folders the first of the list counts
        folders = F.filter(F.array(*map(F.lit, IGNORED_FOLDERS)), lambda f: F.array_contains(F.split("path", "/"), f))
        by_folder = files.where(F.size(folders) > 0).select("project", "path", F.lit(2), F.lit("default"), F.lit(0), F.get(folders, 0))
        reasons = reasons.union(hidden).union(by_folder)
    locks = files.where(name.isin(*LOCK_FILES)).select("project", "path", F.lit(4), F.lit("generated"), F.lit(0), name)
    first = reasons.union(locks).groupBy("project", "path").agg(F.min_by(F.struct("source", "pattern"), F.struct("level", "ordinal")).alias("r"))
    return first.select("project", "path", "r.*")


def ignored(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """``project, path, ignored`` of every path: the last pattern that matches decides, deeper files over outer ones.

    A path below an ignored folder is ignored whatever names it, so every folder of a
    path is tested as well; patterns are those of the project, of folders around the path.
    """
    parts = F.split("path", "/")
    steps = paths.select("project", "path").distinct().withColumn("depth", F.explode(F.sequence(F.lit(1), F.size(parts))))
    steps = steps.withColumns({"step": F.array_join(F.slice(parts, F.lit(1), F.col("depth")), "/"), "is_dir": F.col("depth") < F.size(parts)})
    asked = steps.select("project", "step", "is_dir").distinct()  # folders are shared by their files
    applies = (F.col("dir") == "") | F.col("step").startswith(F.concat("dir", F.lit("/")))
    inside = F.when(F.col("dir") == "", F.col("step")).otherwise(F.expr("substring(step, length(dir) + 2)"))
    matched = asked.join(rules.hint("merge"), "project").where(applies).where((F.col("is_dir") | ~F.col("only_dirs")) & F.rlike(inside, F.col("regex")))
    last = matched.groupBy("project", "step", "is_dir").agg(F.max_by("negated", F.struct(F.length("dir"), "ordinal")).alias("negated"))
    bad = steps.join(last.where("not negated").hint("merge"), ["project", "step", "is_dir"], "left_semi").select("project", "path").distinct().withColumn("ignored", F.lit(True))
    return paths.select("project", "path").distinct().join(bad.hint("merge"), ["project", "path"], "left").select("project", "path", F.coalesce("ignored", F.lit(False)).alias("ignored"))
