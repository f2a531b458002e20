import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lintlake.llm import language

WORDS = {"aa": "the and of to with stone river window letter".split(), "bb": "der und von zu mit stein fluß fenster brief".split(), "cc": "камень река окно письмо и в с к".split()}


def made(lang, n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abc", min_size=1, max_size=40), st.text(alphabet="abcd", max_size=60))
def test_phrases_equal_plain_cross_parsing(sample, text):
    alphabet = language.Alphabet(["abcd"])
    a, b = alphabet.encode(sample), alphabet.encode(text)
    table = language.automaton(a, alphabet.size)
    whole, want, at = bytes(a), 1, 0
    for i in range(len(b)):
        if bytes(b[at : i + 1]) not in whole:
            want += 1
            at = i if bytes(b[i : i + 1]) in whole else i + 1
    assert language.phrases(table, np.ascontiguousarray(b[:, None])).tolist() == [want]


@pytest.fixture(scope="module")
def model():
    return language.LanguageModel({k: made(k, 400, 1) for k in WORDS})


def test_predictions(model):
    texts = [made(k, n, 2) for k in WORDS for n in (5, 60, 5000)]
    assert [x for x, _ in model.predict(texts)] == [k for k in WORDS for _ in range(3)]
    assert model.predict([None, "", "12 !?", "\U0001f600"]) == [("und", 0.0)] * 4
    assert all(0 <= s <= 1 for _, s in model.predict(texts + ["zzz", "日本", "x"]))


def test_classify(spark):
    rows = [(i, made(k, 40, i), k) for i in range(120) for k in [list(WORDS)[i % 3]]]
    rows += [(500, None, "aa"), (501, "...", "bb"), (None, made("cc", 30, 9), None), (3, rows[3][1], "aa"), (502, made("bb", 50_000, 8), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumnRenamed("doc_id", "doc_id")
    got = language.classify(docs).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["lang_pred"] == list(WORDS)[i % 3] for i in range(120))
    assert by[500]["lang_pred"] == by[501]["lang_pred"] == "und" and by[None]["lang_pred"] == "cc" and by[502]["lang_pred"] == "bb"
    assert language.classify(docs.limit(0)).count() == 0
    assert {r["lang_pred"] for r in language.classify(docs.selectExpr("doc_id", "text", "cast(null as string) lang")).collect()} == {"und"}


def test_sample_of_rows_without_ids_is_bounded(spark):
    """Rows that share an id, or have none, are found by their own text: each place of the sample is filled once."""
    texts = [(None, f"{'word' * (i % 7 + 1)} number {i} ", "en") for i in range(3_000)] + [(7, "gleich und gleich", "de")] * 500
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    samples = language.training_samples(docs)
    assert set(samples) == {"en", "de"} and len(samples["en"]) <= language.SAMPLE_CHARS
    assert samples["de"].count("gleich und gleich") == language.SAMPLE_DOCS
    assert len({x for x in samples["en"].split("  ") if x}) == language.SAMPLE_DOCS
