"""Pipeline stages: each takes (spark, docs, sf_dir) and returns what the next stage works on."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.llm import jaccard, language, packing, secrets, toxicity

#: The columns of documents, which every stage but the last returns.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator rejects (score of 0.5 or more) go.

    It learns from the labels of the documents that the stage is given.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(toxicity.training_rows(docs, labels))
    scored = toxicity.score(docs, model, "doc_id", "text", keep=COLUMNS[1:])
    return scored.where("predicted = 0").select(*COLUMNS)


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no learned language (null, or without a letter) go; documents without a language get the predicted one."""
    found = language.identify(docs, language.training_samples(docs), "doc_id", "text", keep=COLUMNS[1:])
    kept = found.where(F.col("lang_pred") != language.UNKNOWN)
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the least id stays (of repeated ids the least text, of repeated rows one).

    Documents without words have no group and stay. Rows without an id stay only if
    no document with an id is near, and then one of each group. Rows of one id with
    other texts are documents of their own.
    """
    return jaccard.one_of_each_component(docs.select(*COLUMNS))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts give way to their kind in brackets; every document stays, with its new length."""
    scanned = secrets.scan(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=("lang", "source", "n_chars"))
    return scanned.select("doc_id", F.col("redacted").alias("text"), "lang", "source", F.when(F.col("spans") == "", F.col("n_chars")).otherwise(F.length("redacted")).cast("long").alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents' tokens, packed into sequences of 4096."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=4096)
