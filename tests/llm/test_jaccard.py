import random
import re

import numpy as np
import pyarrow.parquet as pq
from hypothesis import given, settings
from hypothesis import strategies as st

from lintlake.llm import jaccard


def plain_set(text, n=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else ({tuple(words)} if words else set())


def brute(rows, percent=75):
    sets = [plain_set(t) for _, t in rows]
    part = list(range(len(rows)))

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                part[b] = a
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted(((doc, len(s), least.get(find(i))) for i, ((doc, _), s) in enumerate(zip(rows, sets))), key=str)


def run(spark, rows):
    frame = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, key int")
    return sorted((tuple(r) for r in jaccard.jaccard_components(frame).collect()), key=str)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aAbÉ é\t\n\x0b\x1c\xa0", max_size=40), max_size=6))
def test_sets_equal_plain_ones(texts):
    got = jaccard.shingle_sets(texts)
    assert [len(s) for s in got] == [len(plain_set(t)) for t in texts]
    for a, x in zip(texts, got):
        for b, y in zip(texts, got):
            assert len(np.intersect1d(x, y)) == len(plain_set(a) & plain_set(b))


def near_copies(seed, copies, edits):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(4000)]
    rows, shared = [], " ".join(rng.choice(vocabulary) for _ in range(55))
    for family in range(6):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(60, 220))]
        for _ in range(copies):
            words = list(base)
            for _ in range(rng.randint(0, edits)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append(" ".join(words[: rng.randint(len(words) * 3 // 4, len(words))]))
    rows += [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(5, 90))) + " " + shared for _ in range(30)]
    rng.shuffle(rows)
    return rows


def test_groups_of_near_copies_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    monkeypatch.setattr(jaccard, "SHORT", 5)
    rows = list(enumerate(near_copies(4, 22, 8)))
    assert run(spark, rows) == brute(rows)


def test_odd_rows(spark):
    text = "one two three four five six seven eight"
    rows = [(5, text), (4, text.upper()), (9, text), (None, text), (1, None), (2, ""), (3, " \t"), (6, "a b"), (7, "a  B"), (8, "a b c"), (10, "x " * 9000), (10, "x " * 9000), (None, "lonely words here")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_table_equals_brute_force(spark, sf_dir):
    t = pq.read_table(f"{sf_dir}/documents.parquet").to_pydict()
    rows = list(zip(t["doc_id"], t["text"]))
    assert sorted((tuple(r) for r in jaccard.jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()), key=str) == brute(rows)


def test_frequent_grams_are_dealt_and_null_ids_are_many(spark, monkeypatch):
    """With every n-gram of three documents dealt over tasks, and a third of the rows without an id, links are the same."""
    monkeypatch.setattr(jaccard, "HOT", 3)
    monkeypatch.setattr(jaccard, "SHORT", 4)
    monkeypatch.setattr(jaccard, "BLOCK_GRAMS", 900)
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, t) for i, t in enumerate(near_copies(9, 12, 6))]
    assert run(spark, rows) == brute(rows)
