"""Addresses judged by a list of rules: a blocked Bloom filter passes possible hits to an exact hash join.

A rule is a host and the beginning of a path. An address is looked up under the keys
that a rule fitting it could have: the last labels of its host with the first
characters of its path, for each pair of numbers that the list's rules have. The
filter, a bounded array of blocks of eight words, holds the rules' keys. Keys it doesn't
hold go; the rest are joined with the rules themselves, so its false positives go too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lintlake.llm.shared import written

#: Words of a block and bits of a word; bits a rule; blocks at most (8 MB). A longer list has more false positives, and they go in the join.
WORDS, WORD_BITS, RULE_BITS, BLOCKS = 8, 64, 16, 1 << 17
#: Rules that are broadcast for the join at most; copies of a rule beyond that, over which a frequent key's rows are dealt.
BROADCAST_RULES, SALTS = 200_000, 32

CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What is after the first ``://`` up to ``/``, ``?``, ``#`` or the end, in small letters (A-Z only); empty without one."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), CAPITALS, SMALL)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def labels_of(host: Column) -> Column:
    """The number of a host's labels: its dots and one."""
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def block_of(key: Column, blocks: int) -> Column:
    return F.xxhash64(key).bitwiseAND(F.lit(blocks - 1))


def bits_of(key: Column) -> Column:
    """The hash whose pieces of six bits are the places in a block's words."""
    return F.xxhash64(F.lit(1), key)


def bloom_filter(rules: DataFrame, count: int) -> np.ndarray:
    """Blocks of words with the keys' bits, made by Spark; its size is bounded by ``BLOCKS``."""
    blocks = min(BLOCKS, 1 << (count * RULE_BITS // (WORDS * WORD_BITS)).bit_length())
    bits = [F.expr(f"shiftleft(1L, cast(shiftrightunsigned(bits, {6 * i}) & 63 as int))") for i in range(WORDS)]
    made = rules.select(block_of(F.col("key"), blocks).alias("block"), bits_of(F.col("key")).alias("bits")).groupBy("block").agg(*[F.bit_or(b).alias(f"w{i}") for i, b in enumerate(bits)])
    out = np.zeros((blocks, WORDS), np.uint64)
    for r in made.toLocalIterator():
        out[r["block"]] = np.array([r[f"w{i}"] for i in range(WORDS)], np.int64).view(np.uint64)
    return out


def held(filter_: np.ndarray, block: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which keys the filter holds (some that it doesn't, too): all eight bits of the key's block are set."""
    words, bits = filter_[block], bits.view(np.uint64)
    good = np.ones(len(block), bool)
    for i in range(WORDS):
        good &= (words[:, i] >> ((bits >> np.uint64(6 * i)) & np.uint64(63))) & np.uint64(1) == 1
    return good


def judge(pages: DataFrame, rules: DataFrame, id_column: str = "page_id", url_column: str = "url", default: str = "allow") -> DataFrame:
    """``id_column``, ``host``, ``path``, ``rule``, ``verdict`` of every row.

    ``rules`` has ``host``, ``path`` and ``verdict``. A rule fits an address whose host is
    its host or ends with a dot and its host, and whose path begins with its path. Of
    the fitting ones the one with most characters counts (of equally long ones that of
    the longer host); a rule given with both verdicts blocks. Without a fitting rule
    ``rule`` is null and the verdict is ``default``. A null address, or one without
    ``://``, has empty host and path. Rules without host, path or verdict are left out.
    Null and repeated ids, repeated rows and other columns don't matter; keys are cut
    from an address of any length, never the list of all its beginnings. An empty table
    gives no rows, an empty list only defaults.
    """
    spark = pages.sparkSession
    listed = rules.select(F.translate("host", CAPITALS, SMALL).alias("host"), "path", "verdict").where("host is not null and path is not null and verdict is not null")
    listed = listed.select(F.concat("host", "path").alias("key"), "verdict", labels_of(F.col("host")).alias("labels"), F.length("path").alias("start"), F.length("host").alias("host_length"))
    listed = written(listed.groupBy("key", "labels", "start", "host_length").agg(F.max("verdict").alias("verdict")), "rules")
    count = listed.count()
    # pairs of whole numbers: bounded by the labels and characters of the longest rule
    shapes = [(r["labels"], r["start"]) for r in listed.select("labels", "start").distinct().collect()]
    at = pages.select(F.col(id_column).alias("id"), host_of(F.col(url_column)).alias("host"), path_of(F.col(url_column)).alias("path"))
    if not shapes:
        return at.select(F.col("id").alias(id_column), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    filter_ = bloom_filter(listed, count)
    shared = spark.sparkContext.broadcast(filter_)
    have, long = labels_of(F.col("host")), F.length("path")
    wanted = F.array(*[F.struct(F.lit(n).alias("labels"), F.lit(k).alias("start")) for n, k in sorted(shapes)])
    fitting = F.filter(wanted, lambda s: (s["labels"] <= have) & (s["start"] <= long))
    keys = F.transform(fitting, lambda s: F.concat(F.call_function("substring_index", F.col("host"), F.lit("."), -s["labels"]), F.substring(F.col("path"), F.lit(1), s["start"])))
    asked = at.withColumn("keys", keys)
    asked = asked.withColumns({"blocks": F.transform("keys", lambda k: block_of(k, len(filter_))), "bits": F.transform("keys", bits_of)})

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, blocks, bits = (b.column(n) for n in ("keys", "blocks", "bits"))
            ends = keys.offsets.to_numpy() - keys.offsets[0].as_py()
            good = held(shared.value, blocks.flatten().to_numpy(), bits.flatten().to_numpy())
            kept = np.concatenate([[0], np.cumsum(good)])[ends]
            found = pa.ListArray.from_arrays(pa.array(kept.astype(np.int32)), keys.flatten().filter(pa.array(good)))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("host"), b.column("path"), found], names=["id", "host", "path", "keys"])

    text = T.StringType()
    schema = T.StructType([T.StructField("id", at.schema["id"].dataType), T.StructField("host", text), T.StructField("path", text), T.StructField("keys", T.ArrayType(text))])
    # a row is known by its place in the written table, so that rows of one id stay apart
    passed = written(asked.mapInArrow(passing, schema), "possible").withColumn("row", F.struct(F.expr("_metadata.file_path"), F.expr("_metadata.row_index")))
    hits = passed.where("size(keys) > 0").withColumn("key", F.explode("keys"))
    if count <= BROADCAST_RULES:  # small by count
        joined = hits.join(F.broadcast(listed), "key", "left")
    else:
        copies = listed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = hits.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(copies, ["key", "salt"], "left")
    found = F.when(F.col("verdict").isNotNull(), F.struct(F.length("key"), "host_length", F.col("key"), F.col("verdict")))
    best = joined.groupBy("row").agg(F.first("id").alias("id"), F.first("host").alias("host"), F.first("path").alias("path"), F.max(found).alias("best"))
    judged = best.select("id", "host", "path", F.col("best.key").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
    rest = passed.where("size(keys) = 0").select("id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    return judged.unionByName(rest).withColumnRenamed("id", id_column)
