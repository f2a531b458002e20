"""Configuration as relations: each project's settings, resolved by precedence, and what is wrong with them.

A configuration file becomes rows, one for each of its leaves (a key path, a kind, a
value as JSON); all that follows are joins and aggregates over those rows: which file
of a project counts, which keys are unknown, what a rule's settings are.
"""

from __future__ import annotations

import json
import tomllib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

try:  # configuration in YAML needs the parser; without it such a file is a problem row
    import yaml
except ImportError:
    yaml = None

#: Keys of a configuration file.
TOP_KEYS = ("schemaVersion", "minimumPythonVersion", "minimumSeverity", "outputVolumeHintThreshold", "paths", "allowlists", "selection", "rules")
RULE_KEYS = ("enabled", "threshold", "severity", "thresholds", "options")
SELECTION_KEYS = ("tiers", "pillars", "rules", "excludePillars", "excludeRules")
ALLOWLISTS = ("acceptedAbbreviations", "secretPreviews", "deadCode")
RULE_SEVERITIES = ("warning", "error")
ROWS = "project string, path string, level int, keys array<string>, kind string, value string"


@dataclass(frozen=True)
class Names:
    """What configuration is called: files by precedence, the tables of a project file, the schema's version."""

    files: tuple[str, ...] = (".lintlake.yaml", ".lintlake.yml")
    tables: tuple[str, ...] = ("lintlake",)
    version: str = "lintlake.config.v1"


def kind_of(value: object) -> str:
    """``list:str`` for a list of texts only; else the type's name."""
    return "list:str" if isinstance(value, list) and all(isinstance(x, str) for x in value) else type(value).__name__


def leaves(value: object, keys: tuple[str, ...] = ()) -> Iterator[tuple[tuple[str, ...], str, str]]:
    """(keys, kind, JSON) of a document's leaves; tables that are empty are leaves, too."""
    if isinstance(value, dict) and value:
        for k, v in value.items():
            yield from leaves(v, (*keys, str(k)))
    else:
        yield keys, kind_of(value), json.dumps(value, default=str)


def document(path: str, text: str, names: Names) -> dict | str | None:
    """The settings that a file holds; a text says what is wrong with it, None that it holds none."""
    try:
        if path.endswith(".toml"):
            tool = tomllib.loads(text).get("tool", {})
            if not isinstance(tool, dict):
                return "tool must be a table"
            return next((tool[t] for t in names.tables if t in tool), None)
        if yaml is None:
            return "no YAML parser is installed"
        found = yaml.safe_load(text)
        return found if isinstance(found, dict) else {} if found is None else "the top level must be a mapping"
    except (tomllib.TOMLDecodeError, *((yaml.YAMLError,) if yaml else ())) as e:
        return f"not readable: {type(e).__name__}"


def config_rows(files: DataFrame, names: Names = Names(), explicit: DataFrame | None = None) -> DataFrame:
    """The leaves of the file that counts in each project; ``files`` has ``project, path, source``.

    A file that ``explicit`` (project, path) names comes first, then the named files of
    the project's root in their order, then the project file if it has a table. An
    explicit file that isn't there, or holds no table, is a problem.
    """
    order = {p: i for i, p in enumerate((*names.files, "pyproject.toml"), 1)}
    level = F.coalesce(*[F.when(F.col("path") == p, i) for p, i in order.items()])
    asked = explicit.select("project", "path", F.lit(0).alias("first")) if explicit is not None else None
    rows = files if asked is None else files.join(asked, ["project", "path"], "left")
    rows = rows.withColumn("level", level if asked is None else F.coalesce("first", level)).where("level is not null").select("project", "path", "level", "source")

    def said(toml: bool, named: bool, source: str) -> list[tuple[list[str], str, str]]:
        found = document(".toml" if toml else "", source, names)
        if found is None and named:
            found = "there is no table of settings"
        if isinstance(found, str) or found is not None and not isinstance(found, dict):
            return [([], "problem", json.dumps(found if isinstance(found, str) else "settings must be a table"))]
        return [] if found is None else [(list(k), kind, value) for k, kind, value in (leaves(found) if found else [((), "dict", "{}")])]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.list_(pa.string()), pa.string(), pa.string())
        for b in batches:
            # equal texts of a batch are read once, and their leaves taken for each
            texts: dict[tuple[bool, bool, str], int] = {}
            which = np.array([texts.setdefault((path.endswith(".toml"), level == 0, source or ""), len(texts)) for path, level, source in zip(*(c.to_pylist() for c in b.columns[1:]))], "int64")
            parsed = [said(*t) for t in texts]
            sizes = np.array([len(x) for x in parsed], "int64")
            begins, n = np.cumsum(sizes) - sizes, sizes[which]
            columns = [pa.array([x[i] for y in parsed for x in y], k) for i, k in enumerate(kinds)]
            at_row = pa.array(np.repeat(np.arange(b.num_rows), n))
            of = pa.array(np.arange(n.sum()) + np.repeat(begins[which] - (np.cumsum(n) - n), n))
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(at_row) for i in range(3)), *(c.take(of) for c in columns)], names=[f.split(" ")[0] for f in ROWS.split(", ")])

    # a small file of many projects is one task: spread the texts before they are read
    rows = rows.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "project", "path")
    all_ = rows.mapInArrow(run, ROWS)
    if asked is not None:
        absent = asked.join(files.select("project", "path"), ["project", "path"], "left_anti")
        all_ = all_.unionByName(absent.select("project", "path", F.lit(0).alias("level"), F.array().cast("array<string>").alias("keys"), F.lit("problem").alias("kind"), F.lit('"the file does not exist"').alias("value")))
    best = all_.groupBy("project").agg(F.min("level").alias("level"))
    return all_.join(best, ["project", "level"], "left_semi")


def _key(i: int) -> Column:
    return F.get("keys", i)


def _number(kind: Column) -> Column:
    return kind.isin("int", "float")


def problems(rows: DataFrame, defaults: DataFrame, names: Names = Names()) -> DataFrame:
    """``project, path, level`` (``error`` or ``warning``), ``message``: what a configuration says that can't be used.

    An error takes the whole file out, a warning the key it names.
    ``defaults`` has ``rule_id, pillar, tier, threshold`` (null without one), ``thresholds`` (a map).
    """
    dotted = F.array_join("keys", ".")
    size, kind = F.size("keys"), F.col("kind")

    def said(some: DataFrame, level: str, message: Column) -> DataFrame:
        return some.select("project", "path", F.lit(level).alias("level"), message.alias("message"))

    text = lambda s: F.concat(F.lit(s), F.lit(" '"), dotted, F.lit("'"))
    full = rows.where(size > 0)
    version = full.where(_key(0) == "schemaVersion").select("project", F.get_json_object(F.concat(F.lit('{"v":'), "value", F.lit("}")), "$.v").alias("version"))
    filled = full.select("project", "path").distinct().join(version, "project", "left")
    plain = ("minimumPythonVersion", "outputVolumeHintThreshold", "schemaVersion")
    rules = full.where(_key(0) == "rules").where(size > 1).withColumn("rule_id", _key(1)).join(defaults.select("rule_id", F.lit(True).alias("known"), F.col("threshold").isNotNull().alias("single"), F.map_keys("thresholds").alias("knobs")), "rule_id", "left")
    mine = rules.where("known")
    has = mine.groupBy("project", "path", "rule_id").agg(F.max(_key(2) == "threshold").alias("threshold"), F.max((_key(2) == "thresholds") & F.coalesce(F.array_contains("knobs", _key(3)), F.lit(False))).alias("thresholds"), F.max(_key(2) == "severity").alias("severity"), F.max("single").alias("single"))
    lists = full.where((_key(0).isin("selection") & (size == 2) & _key(1).isin(*SELECTION_KEYS)) | ((_key(0) == "paths") & (_key(1) == "ignore")) | ((_key(0) == "allowlists") & _key(1).isin(*ALLOWLISTS[:2])) | ((_key(0) == "allowlists") & (_key(1) == "deadCode") & (size == 3)))
    chosen = full.where((_key(0) == "selection") & (kind == "list:str")).select("project", "path", _key(1).alias("of"), F.explode(F.from_json("value", "array<string>")).alias("name"))
    values = defaults.select(F.lit("rules").alias("what"), F.col("rule_id").alias("name")).unionByName(defaults.select(F.lit("pillars").alias("what"), F.col("pillar").alias("name"))).unionByName(defaults.select(F.lit("tiers").alias("what"), F.col("tier").alias("name"))).distinct()
    what = F.lower(F.regexp_replace("of", "^exclude", ""))
    strange = chosen.where(F.col("of").isin(*SELECTION_KEYS)).withColumn("what", what).join(values, ["what", "name"], "left_anti")
    errors = [
        rows.where("kind = 'problem'").select("project", "path", F.lit("error").alias("level"), F.get_json_object(F.concat(F.lit('{"v":'), "value", F.lit("}")), "$.v").alias("message")),
        said(full.where(~_key(0).isin(*TOP_KEYS)), "error", F.concat(F.lit("unknown key '"), _key(0), F.lit("'"))),
        said(filled.where(F.col("version").isNull()), "error", F.lit("schemaVersion is missing")),
        said(filled.where(F.col("version") != names.version), "error", F.concat(F.lit("schemaVersion is '"), "version", F.lit(f"', not '{names.version}'"))),
        said(full.where((size == 1) & ~_key(0).isin(*plain) & (kind != "dict")), "error", text("not a table:")),
        said(full.where((_key(0) == "outputVolumeHintThreshold") & ((kind != "int") | F.col("value").startswith("-"))), "error", text("not a number of 0 or more:")),
        said(lists.where(kind != "list:str"), "error", text("not a list of texts:")),
        said(full.where(((_key(0) == "selection") & ~_key(1).isin(*SELECTION_KEYS)) | ((_key(0) == "paths") & (_key(1) != "ignore")) | ((_key(0) == "allowlists") & ~_key(1).isin(*ALLOWLISTS))), "error", text("unknown key")),
        said(strange, "error", F.concat(F.lit("unknown value '"), "name", F.lit("' of 'selection."), "of", F.lit("'"))),
        said(rules.where((size == 2) & (kind != "dict")), "error", text("not a table:")),
        said(mine.where((_key(2) == "enabled") & (kind != "bool")), "error", text("not a truth value:")),
        said(mine.where((_key(2) == "thresholds") & (size == 4) & F.array_contains("knobs", _key(3)) & ~_number(kind)), "error", text("not a number:")),
        said(mine.where((_key(2) == "threshold") & F.col("single") & ~_number(kind)), "error", text("not a number:")),
        said(mine.where((_key(2) == "severity") & F.col("single") & ~F.col("value").isin(*(f'"{s}"' for s in RULE_SEVERITIES))).join(has.where("threshold").select("project", "rule_id"), ["project", "rule_id"], "left_semi"), "error", text("neither warning nor error:")),
        said(has.where("single and threshold and not severity"), "error", F.concat(F.lit("threshold without severity: 'rules."), "rule_id", F.lit("'"))),
        said(has.where("single and threshold and thresholds"), "error", F.concat(F.lit("both threshold and thresholds: 'rules."), "rule_id", F.lit("'"))),
    ]
    warnings = [
        said(rules.where("known is null"), "warning", F.concat(F.lit("unknown rule '"), "rule_id", F.lit("'"))),
        said(mine.where((size > 2) & ~_key(2).isin(*RULE_KEYS)), "warning", F.concat(F.lit("unknown key 'rules."), "rule_id", F.lit("."), _key(2), F.lit("'"))),
        said(mine.where((_key(2) == "thresholds") & (size > 3) & ~F.array_contains("knobs", _key(3))), "warning", text("unknown threshold")),
        said(has.where("threshold and not single"), "warning", F.concat(F.lit("no single threshold: 'rules."), "rule_id", F.lit("'"))),
        said(has.where("severity and not threshold"), "warning", F.concat(F.lit("severity without threshold: 'rules."), "rule_id", F.lit("'"))),
    ]
    out = errors[0]
    for more in [*errors[1:], *warnings]:
        out = out.unionByName(more)
    return out.distinct()


def resolved(rows: DataFrame, found: DataFrame, defaults: DataFrame) -> DataFrame:
    """Each configured project's settings of every rule: ``project``, ``rule_id``, ``enabled``, ``threshold``, ``severity``, ``thresholds``, ``options``.

    Projects whose file has an error keep the defaults. ``found`` are the ``problems``,
    ``defaults`` has the rules' own settings (``options`` a map of JSON texts).
    """
    wrong = found.where("level = 'error'").select("project").distinct()
    good = rows.where("kind != 'problem'")
    projects = good.select("project").distinct().join(wrong, "project", "left_anti")
    mine = good.where((_key(0) == "rules") & (F.size("keys") > 2)).join(wrong, "project", "left_anti").select("project", _key(1).alias("rule_id"), _key(2).alias("key"), _key(3).alias("name"), F.array_join(F.slice("keys", 4, 100), ".").alias("option"), "kind", "value")
    value = lambda k: F.max(F.when(F.col("key") == k, F.col("value")))
    pairs = lambda k, name, v: F.map_from_entries(F.collect_set(F.when((F.col("key") == k) & F.col(name).isNotNull(), F.struct(F.col(name).alias("key"), v.alias("value")))))
    own = mine.groupBy("project", "rule_id").agg(value("enabled").alias("own_enabled"), value("threshold").cast("double").alias("own_threshold"), F.regexp_replace(value("severity"), '"', "").alias("own_severity"), pairs("thresholds", "name", F.expr("try_cast(value as double)")).alias("own_thresholds"), pairs("options", "option", F.col("value")).alias("own_options"))
    # defaults are the rules of the library, so their number is fixed
    every = projects.withColumn("of", F.lit(1)).join(F.broadcast(defaults.withColumn("of", F.lit(1))), "of").drop("of").join(own, ["project", "rule_id"], "left")
    single = F.col("threshold").isNotNull() & F.col("own_threshold").isNotNull()
    knobs = F.transform_values("thresholds", lambda k, v: F.coalesce(F.element_at("own_thresholds", k), v))
    options = F.map_concat(F.map_filter("options", lambda k, v: ~F.map_contains_key("own_options", k)), "own_options")
    return every.select(
        "project", "rule_id", F.coalesce(F.col("own_enabled") == "true", F.col("enabled")).alias("enabled"), F.when(single, F.col("own_threshold")).otherwise(F.col("threshold")).alias("threshold"), F.when(single, F.col("own_severity")).otherwise(F.col("severity")).alias("severity"),
        F.when(F.col("own_thresholds").isNull() | single, F.col("thresholds")).otherwise(knobs).alias("thresholds"), F.when(F.col("own_options").isNull(), F.col("options")).otherwise(options).alias("options"), "pillar", "tier",
    )


def listed(rows: DataFrame, found: DataFrame, *keys: str) -> DataFrame:
    """The texts of a list in each project: ``project``, ``name`` (``allowlists, secretPreviews`` or ``paths, ignore``, say)."""
    wrong = found.where("level = 'error'").select("project").distinct()
    at = rows.where((F.array_join("keys", ".") == ".".join(keys)) & (F.col("kind") == "list:str")).join(wrong, "project", "left_anti")
    return at.select("project", F.explode(F.from_json("value", "array<string>")).alias("name")).distinct()


def selected(settings: DataFrame, rows: DataFrame, found: DataFrame) -> DataFrame:
    """The settings of the rules that run in each project: enabled ones that its selection takes in and doesn't take out."""
    choice = {k: listed(rows, found, "selection", k) for k in SELECTION_KEYS}
    asked = choice["tiers"].withColumn("of", F.lit("tier")).unionByName(choice["pillars"].withColumn("of", F.lit("pillar"))).unionByName(choice["rules"].withColumn("of", F.lit("rule_id")))
    of = F.array(*[F.struct(F.lit(c).alias("of"), F.col(c).alias("name")) for c in ("tier", "pillar", "rule_id")])
    named = settings.select("project", "rule_id", F.explode(of).alias("n")).select("project", "rule_id", "n.*")
    inside = named.join(asked, ["project", "of", "name"], "left_semi").select("project", "rule_id").distinct()
    choosing = asked.select("project").distinct()
    outside = choice["excludePillars"].withColumn("of", F.lit("pillar")).unionByName(choice["excludeRules"].withColumn("of", F.lit("rule_id")))
    out = named.join(outside, ["project", "of", "name"], "left_semi").select("project", "rule_id").distinct()
    on = settings.where("enabled")
    kept = on.join(choosing, "project", "left_anti").unionByName(on.join(choosing, "project", "left_semi").join(inside, ["project", "rule_id"], "left_semi"))
    return kept.join(out, ["project", "rule_id"], "left_anti")


def over_limits(measures: DataFrame, settings: DataFrame, defaults: DataFrame, configured: DataFrame) -> DataFrame:
    """Measures (``project, rule_id, value``) beyond their project's limit, with ``limit`` and ``severity``.

    ``settings`` are the rules that run in the projects of ``configured``; other
    projects have the defaults. Rules whose ``below`` is set look for low values.
    """
    fixed = defaults.select("rule_id", "below", F.col("threshold").alias("standard"), F.col("severity").alias("standard_severity"), F.col("enabled").alias("standard_enabled"))
    own = settings.select("project", "rule_id", F.col("threshold").alias("own"), F.col("severity").alias("own_severity"))
    has = configured.select("project", F.lit(True).alias("configured")).distinct()
    rows = measures.join(F.broadcast(fixed), "rule_id").join(has, "project", "left").join(own, ["project", "rule_id"], "left")
    rows = rows.where("case when configured then own is not null else standard_enabled end").withColumns({"limit": F.coalesce("own", "standard"), "severity": F.coalesce("own_severity", "standard_severity")})
    return rows.where(F.when(F.col("below"), F.col("value") < F.col("limit")).otherwise(F.col("value") > F.col("limit"))).select(*measures.columns, "limit", "severity")
