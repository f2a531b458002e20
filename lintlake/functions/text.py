"""Text measures as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def line_count(source: Column) -> Column:
    """Line feeds and one more; 0 for an empty source."""
    return F.when(F.length(source) == 0, 0).otherwise(F.length(source) - F.length(F.replace(source, F.lit("\n"))) + 1)


def entropy(text: Column) -> Column:
    """Shannon entropy of a string's characters in bits."""
    letters = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.size(letters)
    shares = F.transform(F.array_distinct(letters), lambda c: F.size(F.filter(letters, lambda x: x == c)) / n)
    return F.aggregate(shares, F.lit(0.0), lambda total, p: total - p * F.log2(p))


def redacted(secret: Column) -> Column:
    """The first and last four characters and the length; short ones show nothing."""
    n = F.length(secret)
    shown = F.concat(F.substring(secret, 1, 4), F.lit("..."), F.right(secret, F.lit(4)))
    return F.concat(F.when(n >= 8, shown).otherwise(F.lit("...")), F.lit(" (redacted, "), n.cast("string"), F.lit(" chars)"))
