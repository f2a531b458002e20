import random

import pytest

from lintlake.llm import toxicity

PLAIN = "the of and river stone window letter garden winter summer paper bottle carpet silver".split()
BAD = ["nastyword", "vileness", "scum"]


def made(n, toxic, seed):
    rng = random.Random(seed)
    return [" ".join(rng.choice(BAD) if toxic and rng.random() < 0.08 else rng.choice(PLAIN) + rng.choice(["", "ing", "ly", "er"]) for _ in range(rng.randint(40, 200))) for _ in range(n)]


@pytest.fixture(scope="module")
def model():
    return toxicity.fit([(t, 1) for t in made(150, True, 1)] + [(t, 0) for t in made(400, False, 2)])


def test_new_texts_are_told_apart(model):
    assert sum(s >= 0.5 for s in model.scores(made(100, True, 3))) >= 97
    assert sum(s >= 0.5 for s in model.scores(made(200, False, 4))) <= 2
    long = " ".join(made(60, False, 5))
    assert model.scores([long + " scum nastyword " * 12])[0] >= 0.5 > model.scores(["", "..."])[0]


def test_both_dictionaries_are_trained(monkeypatch):
    import zstandard

    made_of = []
    train = zstandard.train_dictionary
    monkeypatch.setattr(zstandard, "train_dictionary", lambda size, samples, **more: made_of.append((size, b"".join(samples))) or train(size, samples, **more))
    model = toxicity.fit([(t, 1) for t in made(150, True, 1)] + [(t, 0) for t in made(400, False, 2)])
    assert len(made_of) >= 2 and model.toxic and model.ordinary
    assert all(w.encode() in made_of[1][1] for w in BAD) and not any(w.encode() in made_of[0][1] for w in BAD)


def test_scores_equal_a_plain_version(model):
    """Window by window: the bytes that the toxic dictionary saves, then the logistic function of the three features."""
    import math

    import zstandard

    def length(dictionary, window):
        kept = zstandard.ZstdCompressionDict(model.ordinary + dictionary + toxicity.HEAD, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        params = zstandard.ZstdCompressionParameters(window_log=17, chain_log=14, hash_log=15, search_log=5, min_match=5, target_length=16, strategy=zstandard.STRATEGY_GREEDY, write_content_size=False, write_checksum=False, write_dict_id=False)
        return len(zstandard.ZstdCompressor(dict_data=kept, compression_params=params).compress(toxicity.HEAD + window))

    texts = made(6, True, 8) + made(6, False, 9) + ["", "x" * 5_000, "scum"]
    for text, got in zip(texts, model.scores(texts)):
        saved, words = [], text.lower().split()
        for i in range(0, max(1, len(words)), 4):
            window = f" {' '.join(words[i : i + 4])} ".encode() if words else b" "
            for k in range(0, len(window), 1_024):
                part = window[k : k + 1_024]
                saved.append(length(b"\xff" * len(model.toxic), part) - length(model.toxic, part))
        over = sum(s >= model.window_threshold for s in saved)
        z = sum(a * b for a, b in zip(model.weights, (1, min(max(saved), 12), math.log1p(over), over / len(saved))))
        assert abs(got - 1 / (1 + math.exp(-z))) < 1e-9


def test_sample_is_bounded_before_the_driver(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_CHARS", 1_000)
    docs = spark.createDataFrame([(i, "word " * 20) for i in range(100)] + [(200, "long " * 1_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)] + [(200, 1)], "doc_id long, toxic int")
    rows = toxicity.training_rows(docs, labels)
    assert all(sum(len(t) for t, y in rows if y == k) == 1_000 for k in (0, 1))


def test_without_a_class_nothing_is_toxic():
    assert max(toxicity.fit([("abc", 0)]).scores(["abc", ""])) < 0.5
    assert max(toxicity.fit([]).scores(["abc"])) < 0.5


def test_classify(spark):
    texts = [(t, 1) for t in made(120, True, 6)] + [(t, 0) for t in made(300, False, 7)]
    docs = spark.createDataFrame([(i, t, "x") for i, (t, _) in enumerate(texts)] + [(900, None, None), (None, "scum", "x"), (901, "", "x"), (0, texts[0][0], "x")], "doc_id long, text string, label string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(texts)] + [(None, 1), (5000, None), (5001, 1), (0, 1)], "doc_id long, toxic int")
    got = toxicity.classify(docs, labels).collect()
    assert len(got) == len(texts) + 4
    import zlib

    held = [(r["predicted"], texts[r["doc_id"]][1]) for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 900]
    assert sum(p == y for p, y in held) >= 0.97 * len(held) and len(held) > 50
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got if r["doc_id"] is not None)
    assert {r["predicted"] for r in got if r["doc_id"] in (900, 901)} == {0}
    assert all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.classify(docs.limit(0), labels).count() == 0
    assert toxicity.classify(docs, labels.limit(0)).where("predicted = 1").count() == 0
