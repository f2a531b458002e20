"""Settings that rules have unless a project's configuration changes them."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

#: Rules with one limit: pillar, limit, whether values below it count.
LIMITS = {
    "size.function-length": ("size", 100, False), "size.parameter-count": ("size", 10, False), "size.class-length": ("size", 1000, False), "size.public-method-count": ("size", 10, False), "size.attribute-count": ("size", 15, False),
    "size.average-function-length": ("size", 100, False), "complexity.cyclomatic": ("complexity", 20, False), "complexity.cognitive": ("complexity", 30, False), "complexity.nesting-depth": ("complexity", 6, False),
    "complexity.halstead-volume": ("complexity", 400, False), "complexity.maintainability-index": ("maintainability", 70, True),
}
#: Rules with named limits and options.
KNOBS = {
    "test-quality.repeated-structure-missing-parametrize": ("test-quality", "advisory", {"minGroupSize": 3.0}, {}),
    "test-quality.eager-test": ("test-quality", "advisory", {"maxAssertions": 5.0}, {}),
    "test-quality.excessive-mocking": ("test-quality", "warning", {"maxMocks": 4.0}, {}),
    "docs.missing-class-docstring": ("documentation", "warning", {}, {"class_dataclass_exempt": True}),
    "dead-code.exported-but-unreferenced": ("dead-code", "advisory", {}, {"entryPointPatterns": []}),
    "naming.abbreviation": ("naming", "advisory", {}, {}),
}
SCHEMA = "rule_id string, pillar string, tier string, enabled boolean, threshold double, below boolean, severity string, thresholds map<string,double>, options map<string,string>"


def defaults(spark: SparkSession, more: dict[str, tuple[str, str, str]] | None = None) -> DataFrame:
    """A row for each rule; its number is the library's, whatever the input. ``more`` has severity and pillar of rules without settings."""
    rows = [(r, pillar, "v01", True, float(limit), below, "error", {}, {}) for r, (pillar, limit, below) in LIMITS.items()]
    rows += [(r, pillar, "v01", True, None, False, severity, knobs, {k: json.dumps(v) for k, v in options.items()}) for r, (pillar, severity, knobs, options) in KNOBS.items()]
    rows += [(r, pillar, "v01", True, None, False, severity, {}, {}) for r, (severity, pillar, _) in (more or {}).items() if r not in LIMITS and r not in KNOBS]
    return spark.createDataFrame(rows, SCHEMA)
