"""Identities of findings as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Fields that are free text; what marks an escaped character until JSON is made.
TEXTS, MARK = ("file", "symbol", "message"), "\ue000"


def _json(**fields: Column) -> Column:
    """Compact JSON of the fields in order, nulls included, with slashes escaped."""
    fields = {k: escaped(c) if k in TEXTS else c for k, c in fields.items()}
    packed = F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]), {"ignoreNullFields": "false"})
    # to_json doubles the escapes' backslashes
    return F.regexp_replace(F.replace(packed, F.lit("/"), F.lit("\\/")), rf"{MARK}([0-9a-f]{{4}})", r"\\u$1")


def escaped(text: Column) -> Column:
    """Characters beyond ASCII as marked groups of four digits, one for each UTF-16 unit; other texts stay as they are."""
    digits = lambda c: F.lower(F.hex(F.encode(c, "UTF-16BE")))
    marked = lambda c: F.concat_ws("", F.lit(MARK), F.substring(digits(c), 1, 4), F.when(F.length(digits(c)) > 4, F.concat(F.lit(MARK), F.substring(digits(c), 5, 4))))
    parts = F.transform(F.split(text, ""), lambda c: F.when(c.rlike(r"[^\x00-\x7F]"), marked(c)).otherwise(c))
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.array_join(parts, "")).otherwise(text)


def fingerprint() -> Column:
    """16 hexadecimal digits of rule, file, lines, column and symbol."""
    body = _json(ruleId=F.col("rule_id"), file=F.col("file_path"), line=F.col("line"), endLine=F.col("end_line"), column=F.col("column"), symbol=F.col("symbol"))
    return F.substring(F.sha2(body, 256), 1, 16)


def stable_identity() -> Column:
    """16 hexadecimal digits that survive moved lines: rule, file and symbol, or the message without a symbol."""
    with_symbol = _json(ruleId=F.col("rule_id"), file=F.col("file_path"), symbol=F.col("symbol"))
    without = _json(ruleId=F.col("rule_id"), file=F.col("file_path"), message=F.col("message"))
    return F.substring(F.sha2(F.when(F.col("symbol").isNotNull(), with_symbol).otherwise(without), 256), 1, 16)
