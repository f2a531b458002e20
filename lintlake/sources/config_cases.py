"""Planted configuration files: what each project's settings, problems and findings have to be."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from lintlake.sources.rule_defaults import KNOBS, LIMITS

_HEAD = "schemaVersion: lintlake.config.v1\n"
_TOML = '[tool.lintlake]\nschemaVersion = "lintlake.config.v1"\n'

#: A module whose functions have 5 and 12 parameters and a complexity of 26.
CODE = "def five(a, b, c, d, e):\n    return a\n\n\ndef twelve(a, b, c, d, e, f, g, h, i, j, k, m):\n    return a\n\n\ndef branchy(x):\n" + "".join(f"    if x == {i}:\n        return {i}\n" for i in range(25))


@dataclass(frozen=True)
class Configured:
    """Files by path; rules' settings that differ from the defaults (None: the project has none of its own); problems; (function, limit, severity) of findings."""

    files: dict[str, str]
    changes: dict[str, dict[str, object]] | None
    problems: tuple[tuple[str, str], ...] = ()
    findings: tuple[tuple[str, int, str], ...] = (("twelve", 10, "error"), ("branchy", 20, "error"))
    allowed: tuple[str, ...] = field(default=())


_RULES = _HEAD + "rules:\n  size.parameter-count:\n    threshold: 3\n    severity: warning\n  complexity.cyclomatic:\n    enabled: false\n  test-quality.repeated-structure-missing-parametrize:\n    thresholds:\n      minGroupSize: 5\n  dead-code.exported-but-unreferenced:\n    options:\n      entryPointPatterns: [main]\n      other: 1\n"
_CHANGED = {"size.parameter-count": {"threshold": 3.0, "severity": "warning"}, "complexity.cyclomatic": {"enabled": False}, "test-quality.repeated-structure-missing-parametrize": {"thresholds": {"minGroupSize": 5.0}}, "dead-code.exported-but-unreferenced": {"options": {"entryPointPatterns": '["main"]', "other": "1"}}}
_STRICT = (("five", 3, "warning"), ("twelve", 3, "warning"))

CONFIGURED = [
    Configured({}, None),
    Configured({".lintlake.yaml": _RULES}, _CHANGED, findings=_STRICT),
    Configured({".lintlake.yaml": _RULES, ".lintlake.yml": _HEAD, "pyproject.toml": _TOML + '[tool.lintlake.rules."size.parameter-count"]\nthreshold = 1\nseverity = "error"\n', "sub/.lintlake.yaml": _HEAD}, _CHANGED, findings=_STRICT),
    Configured({"pyproject.toml": '[project]\nname = "x"\n' + _TOML + '[tool.lintlake.rules."size.parameter-count"]\nthreshold = 20\nseverity = "error"\n'}, {"size.parameter-count": {"threshold": 20.0}}, findings=(("branchy", 20, "error"),)),
    Configured({"pyproject.toml": '[tool.other]\nname = "x"\n'}, None),
    Configured({".lintlake.yml": "", "pyproject.toml": _TOML}, {}),
    Configured(
        {".lintlake.yaml": "schemaVersion: lintlake.config.v0\nextra: {a: 1}\nselection: {pillars: [size, unknown], other: [x]}\npaths: {ignore: build}\noutputVolumeHintThreshold: -1\nrules:\n  size.parameter-count: {enabled: 'no', threshold: 3}\n  size.class-length: 7\n  complexity.cyclomatic: {threshold: many, severity: fatal}\n"},
        None,
        (
            ("error", "unknown key 'extra'"), ("error", "schemaVersion is 'lintlake.config.v0', not 'lintlake.config.v1'"), ("error", "unknown value 'unknown' of 'selection.pillars'"), ("error", "unknown key 'selection.other'"), ("error", "not a list of texts: 'paths.ignore'"), ("error", "not a number of 0 or more: 'outputVolumeHintThreshold'"),
            ("error", "not a truth value: 'rules.size.parameter-count.enabled'"), ("error", "threshold without severity: 'rules.size.parameter-count'"), ("error", "not a table: 'rules.size.class-length'"), ("error", "not a number: 'rules.complexity.cyclomatic.threshold'"), ("error", "neither warning nor error: 'rules.complexity.cyclomatic.severity'"),
        ),
    ),
    Configured(
        {".lintlake.yaml": _HEAD + "rules:\n  made.up: {enabled: false}\n  size.parameter-count: {enabled: true, limit: 3, severity: error}\n  naming.abbreviation: {threshold: 3, severity: error}\n  test-quality.eager-test: {thresholds: {maxAssertions: 7, other: 1}}\n"},
        {"test-quality.eager-test": {"thresholds": {"maxAssertions": 7.0}}},
        (("warning", "unknown rule 'made.up'"), ("warning", "unknown key 'rules.size.parameter-count.limit'"), ("warning", "severity without threshold: 'rules.size.parameter-count'"), ("warning", "no single threshold: 'rules.naming.abbreviation'"), ("warning", "unknown threshold 'rules.test-quality.eager-test.thresholds.other'")),
    ),
    Configured({".lintlake.yaml": "a: [1\n", "pyproject.toml": _TOML}, None, (("error", "not readable: ParserError"),)),
    Configured({".lintlake.yaml": "rules: {}\n"}, None, (("error", "schemaVersion is missing"),)),
    Configured({".lintlake.yaml": _HEAD + "selection:\n  pillars: [size]\n  excludeRules: [size.function-length]\nallowlists:\n  secretPreviews: [p1, p2]\n"}, {}, findings=(("twelve", 10, "error"),), allowed=("p1", "p2")),
    Configured({".lintlake.yaml": _HEAD + "selection: {excludePillars: [size]}\n"}, {}, findings=(("branchy", 20, "error"),)),
    Configured({"conf/own.toml": _TOML + "[tool.lintlake.allowlists]\nsecretPreviews = ['p3']\n", ".lintlake.yaml": _RULES, "explicit": "conf/own.toml"}, {}, allowed=("p3",)),
    Configured({"explicit": "conf/none.yaml", ".lintlake.yaml": _RULES}, None, (("error", "the file does not exist"),)),
]

_LINES = {"five": (1, 5), "twelve": (5, 12), "branchy": (9, 26)}


def _text(x: object) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, (int, float)) else "'" + str(x).replace("'", "''") + "'"


def _sql(columns: str, rows: list[tuple]) -> str:
    values = ", ".join("(" + ", ".join(map(_text, r)) + ")" for r in rows)
    return f"SELECT 'p' || CAST(c_custkey AS VARCHAR) AS project, {columns} FROM customer JOIN (VALUES {values}) e(place, {', '.join(c.split('::')[0].split(' ')[0] for c in columns.split(', '))}) ON c_custkey % {len(CONFIGURED)} = place"


def settings_sql() -> str:
    """Every rule's settings in every project that has a usable file."""
    base = {r: {"enabled": True, "threshold": float(limit), "severity": "error", "thresholds": {}, "options": {}} for r, (_, limit, _) in LIMITS.items()}
    base |= {r: {"enabled": True, "threshold": None, "severity": severity, "thresholds": knobs, "options": {k: json.dumps(v) for k, v in options.items()}} for r, (_, severity, knobs, options) in KNOBS.items()}
    rows = []
    for i, c in enumerate(CONFIGURED):
        for rule, own in base.items() if c.changes is not None else ():
            new = own | c.changes.get(rule, {})
            knobs, options = new["thresholds"], own["options"] | new["options"]
            rows.append((i, rule, str(new["enabled"]).lower(), new["threshold"], new["severity"], ",".join(f"{k}={v:g}" for k, v in sorted(knobs.items())), ",".join(f"{k}={v}" for k, v in sorted(options.items()))))
    return _sql("rule_id, enabled, threshold::DOUBLE AS threshold, severity, thresholds, options", rows)


def problems_sql() -> str:
    return _sql("level, message", [(i, *p) for i, c in enumerate(CONFIGURED) for p in c.problems])


def allowed_sql() -> str:
    return _sql("name", [(i, n) for i, c in enumerate(CONFIGURED) for n in c.allowed])


def findings_sql() -> str:
    rules = {"five": "size.parameter-count", "twelve": "size.parameter-count", "branchy": "complexity.cyclomatic"}
    return _sql("rule_id, symbol, value::DOUBLE AS value, limit_::DOUBLE AS limit_, severity", [(i, rules[f], f, _LINES[f][1], limit, severity) for i, c in enumerate(CONFIGURED) for f, limit, severity in c.findings]).replace(" AS limit_,", ' AS "limit",')
