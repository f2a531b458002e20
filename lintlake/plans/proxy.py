"""Findings, rules and their companions derived from the order tables, for the relational operators.

Every line item is a finding; keys give it a project, file, rule, place and symbol.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Projects, by the remainder of the order key.
PROJECTS = 5000
#: Rule and pillar by the remainder of the part key.
RULES = (
    ("size.function-length", "size"), ("size.parameter-count", "size"), ("complexity.cyclomatic", "complexity"), ("complexity.cognitive", "complexity"),
    ("complexity.nesting-depth", "complexity"), ("naming.abbreviation", "naming"), ("docs.todo-density", "documentation"), ("waste.unused-import", "dead-code"),
    ("security.weak-crypto", "security"), ("sensitive-data.jwt-token", "sensitive-data"), ("test-quality.no-assertions", "test-quality"), ("modernisation.f-string-candidate", "modernisation"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def project_of(order: Column) -> Column:
    return F.concat(F.lit("p"), (order % PROJECTS).cast("string"))


def file_of(order: Column, shared: bool = False) -> Column:
    """An order's file: a path of its own, or one that it shares with orders of other projects."""
    return F.concat(F.lit("src/f"), (F.floor(order / PROJECTS) if shared else order).cast("string"), F.lit(".py"))


def shared_sql(sql: str) -> str:
    """The SQL of a relation with paths that projects share."""
    for k in ("l_orderkey", "o_orderkey"):
        sql = sql.replace(f"'src/f' || CAST({k} AS VARCHAR)", f"'src/f' || CAST({k} // {PROJECTS} AS VARCHAR)")
    return sql


def findings(spark: SparkSession, sf_dir: str, shared: bool = False) -> DataFrame:
    names, pillars = (F.array(*[F.lit(r[i]) for r in RULES]) for i in (0, 1))
    rule = (F.col("l_partkey") % len(RULES) + 1).cast("int")
    text = lambda c: c.cast("string")
    order, part, number = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_linenumber")
    line = F.when(order % 17 == 0, None).otherwise((part % 40 + number * 10).cast("int"))
    measured = F.col("l_quantity").cast("int")
    return table(spark, sf_dir, "lineitem").select(
        ((order * 10 + number) * 10_000_000 + part).alias("finding_id"),
        project_of(order).alias("project"),
        file_of(order, shared).alias("file_path"),
        F.element_at(names, rule).alias("rule_id"),
        F.element_at(pillars, rule).alias("pillar"),
        line.alias("line"),
        (line + number % 4).alias("end_line"),
        number.alias("column"),
        F.when(order % 5 == 0, None).otherwise(F.concat(F.lit("fn_"), text(number % 2))).alias("symbol"),
        F.when(F.col("l_returnflag") == "A", "error").when(F.col("l_returnflag") == "R", "warning").otherwise("advisory").alias("severity"),
        F.when(F.col("l_tax") < 0.02, "low").when(F.col("l_linestatus") == "O", "high").otherwise("medium").alias("confidence"),
        measured.alias("measured"),
        F.concat(F.lit("measured "), text(measured)).alias("message"),
        F.concat(F.lit('{"preview":"p'), text(part % 7), F.lit('"}')).alias("metadata_json"),
    )


_LIST = lambda i: "[" + ", ".join(f"'{r[i]}'" for r in RULES) + "]"
#: The same findings for DuckDB.
FINDINGS_SQL = f"""findings AS (
  SELECT (l_orderkey * 10 + l_linenumber) * 10000000 + l_partkey AS finding_id, 'p' || CAST(l_orderkey % 5000 AS VARCHAR) AS project,
    'src/f' || CAST(l_orderkey AS VARCHAR) || '.py' AS file_path,
    list_extract({_LIST(0)}, l_partkey % 12 + 1) AS rule_id, list_extract({_LIST(1)}, l_partkey % 12 + 1) AS pillar,
    CASE WHEN l_orderkey % 17 = 0 THEN NULL ELSE CAST(l_partkey % 40 + l_linenumber * 10 AS INTEGER) END AS line,
    CASE WHEN l_orderkey % 17 = 0 THEN NULL ELSE CAST(l_partkey % 40 + l_linenumber * 10 + l_linenumber % 4 AS INTEGER) END AS end_line,
    l_linenumber AS "column", CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE 'fn_' || CAST(l_linenumber % 2 AS VARCHAR) END AS symbol,
    CASE l_returnflag WHEN 'A' THEN 'error' WHEN 'R' THEN 'warning' ELSE 'advisory' END AS severity,
    CASE WHEN l_tax < 0.02 THEN 'low' WHEN l_linestatus = 'O' THEN 'high' ELSE 'medium' END AS confidence,
    CAST(l_quantity AS INTEGER) AS measured, 'measured ' || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS message,
    '{{"preview":"p' || CAST(l_partkey % 7 AS VARCHAR) || '"}}' AS metadata_json
  FROM lineitem)"""


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule for each part: the threshold is its size; every seventh counts low values, every eleventh is off."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("rule."), k.cast("string")).alias("rule_id"),
        F.concat(F.lit("pillar"), (k % 5).cast("string")).alias("pillar"),
        F.when(k % 3 == 0, "v02").otherwise("v01").alias("tier"),
        (k % 11 != 0).alias("enabled"),
        F.col("p_size").cast("double").alias("threshold"),
        (k % 7 == 0).alias("below"),
        F.lit("warning").alias("severity"),
    )


RULES_SQL = """rules AS (
  SELECT 'rule.' || CAST(p_partkey AS VARCHAR) AS rule_id, 'pillar' || CAST(p_partkey % 5 AS VARCHAR) AS pillar,
    CASE WHEN p_partkey % 3 = 0 THEN 'v02' ELSE 'v01' END AS tier, p_partkey % 11 <> 0 AS enabled,
    CAST(p_size AS DOUBLE) AS threshold, p_partkey % 7 = 0 AS below, 'warning' AS severity FROM part)"""


def suppressions(spark: SparkSession, sf_dir: str, shared: bool = False) -> DataFrame:
    """For every third order: of whole files (even keys) or of line 25, each of one rule."""
    k = F.col("o_orderkey")
    names = F.array(*[F.lit(r[0]) for r in RULES])
    return table(spark, sf_dir, "orders").where(k % 3 == 0).select(project_of(k).alias("project"), file_of(k, shared).alias("file_path"), F.element_at(names, (k % len(RULES) + 1).cast("int")).alias("rule_id"), F.when(k % 2 == 0, None).otherwise(25).cast("int").alias("line"))


SUPPRESSIONS_SQL = f"""suppressions AS (
  SELECT 'p' || CAST(o_orderkey % 5000 AS VARCHAR) AS project, 'src/f' || CAST(o_orderkey AS VARCHAR) || '.py' AS file_path, list_extract({_LIST(0)}, o_orderkey % 12 + 1) AS rule_id,
    CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE 25 END AS line FROM orders WHERE o_orderkey % 3 = 0)"""


def regions(spark: SparkSession, sf_dir: str, shared: bool = False) -> DataFrame:
    """Changed ranges: from each line item's line for as many lines as its tax has hundredths, in other files than its own."""
    start = (F.col("l_partkey") % 60 + 1).cast("int")
    order = F.col("l_orderkey")
    return table(spark, sf_dir, "lineitem").select(project_of(order).alias("project"), file_of(order, shared).alias("file_path"), start.alias("start"), (start + F.col("l_suppkey") % 7).cast("int").alias("end")).where(F.col("l_suppkey") % 4 == 0)


REGIONS_SQL = """regions AS (
  SELECT 'p' || CAST(l_orderkey % 5000 AS VARCHAR) AS project, 'src/f' || CAST(l_orderkey AS VARCHAR) || '.py' AS file_path, CAST(l_partkey % 60 + 1 AS INTEGER) AS "start",
    CAST(l_partkey % 60 + 1 + l_suppkey % 7 AS INTEGER) AS "end" FROM lineitem WHERE l_suppkey % 4 = 0)"""


def declarations(spark: SparkSession, sf_dir: str, shared: bool = False) -> DataFrame:
    """Two nested declarations for each order: lines 1 to 200, and a range by the customer key."""
    k = F.col("o_orderkey")
    file = [project_of(k).alias("project"), file_of(k, shared).alias("file_path")]
    orders = table(spark, sf_dir, "orders")
    outer = orders.select(*file, F.lit("fn_0").alias("symbol"), F.lit(1).alias("start"), F.lit(200).alias("end"))
    low = (F.col("o_custkey") % 50 + 1).cast("int")
    return outer.unionByName(orders.select(*file, F.lit("fn_1").alias("symbol"), low.alias("start"), (low + 20).alias("end")))


DECLARATIONS_SQL = """declarations AS (
  SELECT 'p' || CAST(o_orderkey % 5000 AS VARCHAR) AS project, 'src/f' || CAST(o_orderkey AS VARCHAR) || '.py' AS file_path, 'fn_0' AS symbol, 1 AS "start", 200 AS "end" FROM orders
  UNION ALL SELECT 'p' || CAST(o_orderkey % 5000 AS VARCHAR), 'src/f' || CAST(o_orderkey AS VARCHAR) || '.py', 'fn_1', CAST(o_custkey % 50 + 1 AS INTEGER), CAST(o_custkey % 50 + 21 AS INTEGER) FROM orders)"""
