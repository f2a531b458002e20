"""Rules on projects as wholes: the test configuration, the README, names of modules."""

from __future__ import annotations

import tomllib
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.operators import test_rules
from lintlake.operators.code_rules import KEY, _words
from lintlake.operators.security_rules import found
from lintlake.sources.settings import leaves

#: Names that the rules look for.
READMES = ("README.md", "README.rst", "README.txt", "README")
ROLES = ("adapter", "error", "matcher", "protocol", "provider", "repository", "service", "type")
CONVENTIONAL = ("constants", "exceptions", "helpers", "protocols", "types")
ENVELOPES = ("Enum", "Flag", "IntEnum", "IntFlag", "NamedTuple", "ReprEnum", "StrEnum", "TypedDict")
PYTEST, COVERAGE = ("tool", "pytest", "ini_options"), ("tool", "coverage", "run")


def project_files(units: DataFrame) -> DataFrame:
    """The leaves of each project's ``pyproject.toml``: ``project``, ``keys``, ``kind``, ``value`` (JSON); unreadable files have none."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for project, source in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    out += [(project, list(k), kind, value) for k, kind, value in leaves(tomllib.loads(source or ""))]
                except tomllib.TOMLDecodeError:
                    continue
            kinds = (pa.string(), pa.list_(pa.string()), pa.string(), pa.string())
            columns = zip(*out) if out else ((),) * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["project", "keys", "kind", "value"])

    return units.where("path = 'pyproject.toml'").select("project", "source").mapInArrow(run, "project string, keys array<string>, kind string, value string")


def _texts(rows: DataFrame, section: tuple[str, ...], key: str, words: bool = False) -> DataFrame:
    """The items of a setting that is a list or a text (a text in words, if asked)."""
    at = rows.where(F.array_join("keys", "\u0001") == "\u0001".join((*section, key)))
    text = F.get_json_object(F.concat(F.lit('{"v":'), "value", F.lit("}")), "$.v")
    one = F.filter(F.split(text, r"\s+"), lambda w: w != "") if words else F.array(text)
    items = F.when(F.col("kind").startswith("list"), F.from_json("value", "array<string>")).when(F.col("kind") == "str", one)
    return at.select("project", F.explode(items).alias("item"))


def _at_project(projects: DataFrame, rule: str, file: str, message: str, pillar: str) -> DataFrame:
    nothing = F.lit(None).cast("int")
    return found(projects.select("project", F.lit(file).alias("path"), nothing.alias("line"), nothing.alias("end_line")), rule, "advisory", "medium", message, pillar)


def test_configuration(units: DataFrame, tree: DataFrame) -> DataFrame:
    """Projects with tests whose test configuration is not strict, lets deprecations pass, or measures no source."""
    rows = project_files(units)
    begins = F.array_join(F.slice("keys", 1, 3), "\u0001") == "\u0001".join(PYTEST)
    # a table, with or without anything in it
    configured = rows.where(begins & ((F.size("keys") > 3) | (F.col("kind") == "dict"))).select("project").distinct()
    tested = configured.join(test_rules.tests(tree).select("project").distinct(), "project", "left_semi")
    strict = _texts(rows, PYTEST, "addopts", words=True).where("item in ('--strict-config', '--strict-markers')").select("project")
    fatal = _texts(rows, PYTEST, "filterwarnings").where("item like 'error%DeprecationWarning%' or trim(item) = 'error'").select("project")
    measured = _texts(rows, COVERAGE, "source").select("project")
    lacking = lambda good: tested.join(good.distinct(), "project", "left_anti")
    out = [
        _at_project(lacking(strict), "test-quality.pytest-strict-config-missing", "pyproject.toml", "Pytest config missing strict flags (`--strict-config` or `--strict-markers`).", "test-quality"),
        _at_project(lacking(fatal), "test-quality.pytest-deprecations-not-fatal", "pyproject.toml", "Pytest config doesn't escalate DeprecationWarning to error.", "test-quality"),
        _at_project(lacking(measured), "test-quality.pytest-coverage-source-missing", "pyproject.toml", "Coverage `source` is empty or absent - coverage may be incomplete.", "test-quality"),
    ]
    return reduce(DataFrame.unionByName, out)


def missing_readmes(files: DataFrame) -> DataFrame:
    """Projects without a README at their root; ``files`` has ``project``, ``path`` of all their files."""
    projects = files.select("project").distinct().join(files.where(F.col("path").isin(*READMES)).select("project"), "project", "left_anti")
    return _at_project(projects, "docs.missing-readme", "README.md", "Project root has no README (README.md, README.rst, or README).", "documentation")


def _joined_initials(words: Column) -> Column:
    """Words with each single letter put before the next word."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("held"))
    step = lambda s, w: (
        F.when(s["held"] != "", F.struct(F.concat(s["out"], F.array(F.concat(s["held"], w))).alias("out"), F.lit("").alias("held")))
        .when(F.length(w) == 1, F.struct(s["out"].alias("out"), w.alias("held")))
        .otherwise(F.struct(F.concat(s["out"], F.array(w)).alias("out"), F.lit("").alias("held")))
    )
    return F.aggregate(words, start, step, lambda s: F.when(s["held"] != "", F.concat(s["out"], F.array(s["held"]))).otherwise(s["out"]))


def module_names(tree: DataFrame, conventional: tuple[str, ...] = CONVENTIONAL) -> DataFrame:
    """Modules of one public class that are called neither like it nor by a convention, and don't lie in folders that say its name."""
    file = F.element_at(F.split("path", "/"), -1)
    stem = F.regexp_replace(file, r"\.py$", "")
    tops = tree.where("parent_id = 0 and field = 'body' and name not like '\\\\_%'").where(file.endswith(".py") & ~file.startswith("_") & ~file.startswith("test_") & ~file.endswith("_test.py"))
    functions = tops.where("kind in ('FunctionDef', 'AsyncFunctionDef')").groupBy(*KEY).agg(F.count(F.lit(1)).alias("functions"))
    classes = tops.where("kind = 'ClassDef'")
    single = classes.groupBy(*KEY).agg(F.count(F.lit(1)).alias("classes")).where("classes = 1")
    last = lambda c: F.element_at(F.split(c, r"\."), -1)
    envelope = F.exists("tags", lambda t: last(t) == "dataclass") | F.exists("bases", lambda b: last(b).isin(*ENVELOPES))
    rows = classes.join(single, list(KEY), "left_semi").join(functions, list(KEY), "left").withColumn("functions", F.coalesce("functions", F.lit(0)))
    rows = rows.where(F.col("functions") < 2).where((F.col("functions") == 0) | ~envelope).withColumns({"words": _words(), "file": file, "stem": stem})
    trimmed = F.when((F.size("words") > 1) & F.element_at("words", -1).isin(*ROLES), F.slice("words", F.lit(1), F.size("words") - 1)).otherwise(F.col("words"))
    rows = rows.where(F.size("words") > 0).withColumn("variants", F.array(_joined_initials(F.col("words")), F.col("words"), _joined_initials(trimmed), trimmed)).withColumn("expected", F.array_join(F.col("variants")[0], "_")).where("expected != stem")
    folders = F.filter(F.split(F.regexp_replace("path", r"\.[^./]*$", ""), "/"), lambda p: ~p.isin("", ".", "src", "__init__"))
    rows = rows.withColumn("path_words", F.transform(F.regexp_extract_all(F.array_join(folders, "/"), F.lit(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|[0-9]+"), F.lit(0)), F.lower))
    inside = F.exists("variants", lambda v: F.size(F.array_except(v, F.col("path_words"))) == 0)
    custom = F.col("stem").isin(*conventional) & F.exists("variants", lambda v: F.arrays_overlap(v, F.col("path_words")))
    message = F.concat(F.lit("Single-class module '"), "file", F.lit("' should be named ``"), "expected", F.lit(".py`` to match the class '"), "name", F.lit("'."))
    return found(rows.where(~inside & ~custom), "naming.module-name-mismatch", "advisory", "medium", message, "naming", F.col("name"))


def all_rules(units: DataFrame, tree: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [test_configuration(units, tree), missing_readmes(units), module_names(tree)])
