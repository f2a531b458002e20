"""Small projects with the findings that each must give: one project a customer, the same paths in all of them.

A customer's key chooses the case. Cases without findings are there as well, and every
path occurs in many projects, so an operator that forgets the project shows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Case:
    """A project: its files' texts by path, and (path, rule, line, symbol, message) of each finding."""

    files: dict[str, str]
    findings: tuple[tuple[str, str, int | None, str | None, str], ...] = ()


def one(source: str, *findings: tuple[str, int, str | None, str], path: str = "app/main.py") -> Case:
    """A project of one file; findings are (rule, line, symbol, message)."""
    return Case({path: source}, tuple((path, *f) for f in findings))


def planted(customers: DataFrame, cases: list[Case]) -> DataFrame:
    """The cases as source units: project, path, file_type, source."""
    files = F.array(*[F.array(*[F.struct(F.lit(p).alias("path"), F.lit("python" if p.endswith(".py") else "text").alias("file_type"), F.lit(s).alias("source")) for p, s in c.files.items()]) for c in cases])
    chosen = F.element_at(files, (F.col("c_custkey") % len(cases)).cast("int") + 1)
    return customers.select(F.concat(F.lit("p"), F.col("c_custkey").cast("string")).alias("project"), F.explode(chosen).alias("f")).select("project", "f.*")


def planted_sql(cases: list[Case], about: dict[str, tuple[str, str, str]]) -> str:
    """DuckDB SQL of the findings that the planted cases must give; ``about`` has severity, pillar and confidence of each rule."""

    def text(x: str | int | None) -> str:
        return "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"

    rows = [f"({i}, {', '.join(map(text, (rule, path, line, symbol, *about[rule], message)))})" for i, c in enumerate(cases) for path, rule, line, symbol, message in c.findings]
    return (
        f"WITH expected(place, rule_id, file_path, line, symbol, severity, pillar, confidence, message) AS (VALUES {', '.join(rows)}) "
        f"SELECT 'p' || CAST(c_custkey AS VARCHAR) AS project, rule_id, file_path, line::INTEGER AS line, symbol, severity, pillar, confidence, message FROM customer JOIN expected ON c_custkey % {len(cases)} = place"
    )
