"""Vector codes, ranked search and address rules against plain versions."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest

from lintlake.llm import ranked_search, url_filter, vector_codes

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def small(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def plain_codes(rows, scale=1024, parts=4, entries=256, rounds=4):
    """id, code, error, label error and digest by loops over whole numbers."""
    kept = [(i, lab, [math.floor(scale * c) for c in v]) for i, v, lab in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    out, total = [], Counter()
    for dim in {len(v) for _, _, v in kept}:
        mine = [r for r in kept if len(r[2]) == dim]
        cut = [i * dim // parts for i in range(parts + 1)]
        first = sorted(mine, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:entries]
        books = [[list(r[2][a:b]) for r in first] for a, b in zip(cut, cut[1:])]

        def nearest(v, p):
            piece = v[cut[p] : cut[p + 1]]
            return min((sum((x - y) ** 2 for x, y in zip(piece, e)), k) for k, e in enumerate(books[p]))

        for _ in range(rounds):
            at = [[nearest(v, p)[1] for p in range(parts)] for _, _, v in mine]
            for p in range(parts):
                for k in range(len(books[p])):
                    own = [v[cut[p] : cut[p + 1]] for (_, _, v), a in zip(mine, at) if a[p] == k]
                    if own:
                        books[p][k] = [sum(c) // len(own) for c in zip(*own)]
        digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
        for i, lab, v in mine:
            near = [nearest(v, p) for p in range(parts)]
            out.append([i, "".join(f"{k:02x}" for _, k in near), sum(d for d, _ in near), lab, digest])
            total[lab] += out[-1][2]
    return sorted(((i, c, e, total[lab], d) for i, c, e, lab, d in out), key=str)


def coded(frame, **more):
    return sorted((tuple(r) for r in vector_codes.compress(frame, **more).collect()), key=str)


def test_codes_of_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(x) for x in rng.normal(0, 0.3, 8)], int(i) % 3 if i % 5 else None) for i in rng.permutation(60)]
    rows += [(7, rows[0][1], 1), (7, rows[1][1], 1), (None, rows[2][1], None), (None, rows[2][1], None), (70, None, 1), (71, [], 1), (72, [1.0, None] * 4, 1), (73, [math.nan] + [0.0] * 7, 1), (74, [math.inf] + [0.0] * 7, 2), (75, [-0.5, 0.25, 100.0], 2), (76, [0.5, 0.2, -100.0], None), (77, [0.0] * 8, 2)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for more in ({"entries": 4}, {"entries": 16, "rounds": 2, "scale": 10}, {}):
        assert coded(frame, **more) == plain_codes(rows, **more)
    clash = frame.selectExpr("*", "vec_id as id", "label as x", "label as code")
    assert coded(clash, entries=4) == plain_codes(rows, entries=4)
    assert vector_codes.compress(frame.limit(0)).collect() == []


def test_codes_by_long_and_far_values(spark):
    rows = [(i, [(-1) ** i * i * 100.0, i / 7, -i * 50.5, 0.1 * i], i % 2) for i in range(40)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert coded(frame, entries=8) == plain_codes(rows, entries=8)


def test_first_vectors_by_ranges(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "FIRST_ROWS", 20)
    monkeypatch.setattr(vector_codes, "RANGES", 4)
    frame = spark.range(0, 4000, 7).selectExpr("id * id - 5000 as id", "array(id) as x")
    assert [r[0] for r in vector_codes.first_vectors(frame, 15)] == list(range(0, 105, 7))
    same = spark.range(100).selectExpr("case when id < 90 then 5L end as id", "array(99 - id) as x")
    assert [r[0] for r in vector_codes.first_vectors(same, 3)] == [10, 11, 12]


def test_labels_beyond_a_broadcast(spark, monkeypatch):
    rows = [(i, [i / 9, 1 / (i + 1)], None if i % 3 else i % 4) for i in range(50)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    monkeypatch.setattr(vector_codes, "BROADCAST_LABELS", 0)
    assert coded(frame, parts=2, entries=4) == plain_codes(rows, parts=2, entries=4)


def plain_ranks(docs, items, k=10):
    words = [(d, Counter(TERM.findall(small(t or "")))) for d, t in docs]
    words = [(d, c, sum(c.values())) for d, c in words if c]
    n_docs, n_terms = len(words), sum(n for *_, n in words)
    df = Counter(t for _, c, _ in words for t in c)
    out = []
    for item, text in items:
        asked = TERM.findall(small(text or ""))
        scores = []
        for d, c, n in words:
            m = 100 - 75 + (75 * n * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in asked if t in c)
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(item, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scores, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


def ranks(docs, items, **more):
    return sorted((tuple(r) for r in ranked_search.ranked(docs, items, **more).collect()), key=str)


@pytest.fixture
def searched():
    rng = np.random.default_rng(2)
    words = [f"W{i}" for i in range(300)] + ["Ünï", "straße", "ÀB"]
    odds = 1 / (np.arange(len(words)) + 1)
    docs = [(i, " ".join(rng.choice(words, int(rng.integers(1, 60)), p=odds / odds.sum()))) for i in range(700)]
    docs += [(900, None), (901, ""), (902, " .,- "), (None, "w5 w9 straße"), (None, "w5 w9 straße"), (3, "W5 w250"), (3, "W5 w250"), (904, "w1 " * 5000), (905, "rare-term")]
    items = [(i, " ".join(rng.choice(words, 12))) for i in range(20)] + [(50, None), (51, "?!"), (52, "straße STRAẞE ÜNÏ"), (52, "w5 w5 w9"), (53, "nowhere"), (54, "rare term w0"), (None, "w7")]
    return docs, items


@pytest.mark.parametrize("sizes", [{}, {"BLOCK": 4, "SEGMENT_DOCUMENTS": 50, "TASK_DOCUMENTS": 100}, {"BLOCK": 2, "SEGMENT_POSTINGS": 30, "ASKED_TERMS": 20, "PIECE": 7}])
def test_ranked_search(spark, searched, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(ranked_search, name, value)
    docs, items = searched
    docs_, items_ = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert ranks(docs_, items_) == plain_ranks(docs, items)
    clash = docs_.selectExpr("*", "doc_id as id", "text as term", "1 as segment")
    assert ranks(clash, items_, k=3) == plain_ranks(docs, items, k=3)


def test_search_of_nothing(spark, searched):
    docs, items = (spark.createDataFrame(x, f"{n} long, text string") for x, n in zip(searched, ("doc_id", "item_id")))
    assert ranks(docs.limit(0), items) == [] == ranks(docs, items.limit(0)) == ranks(docs.where("text = ''"), items)


def test_blocks_are_skipped():
    """Non-essential lists are decompressed only where a candidate's block can still lift it."""
    rows = np.arange(4096)
    segment = ranked_search.Segment(0)
    for i in rows:
        segment.add(int(i), Counter({b"often": 1, **({b"seldom": 9} if i in (5, 4000) else {})}), 100)
    batches = list(segment.rows())
    lists = {r["term"]: ranked_search.Postings(r["rows"], r["top"], r["blocks"], r["postings"]) for b in batches[1:] for r in b.to_pylist()}
    norms = np.full(4096, 100)
    at, scores = ranked_search.candidates([(1, lists[b"often"]), (1000, lists[b"seldom"])], norms, 10_000_000)
    assert at.tolist() == [5, 4000] and lists[b"often"].read.sum() == 2 < len(lists[b"often"].read)
    assert scores.tolist() == [1000 * (9 * 10**9 // (9000 + 800)) + 10**9 // 1800] * 2


def test_integers_of_any_size():
    values = np.array([0, 1, 127, 128, 16383, 16384, 2**31, 2**40 + 3, 2**62])
    data, ends = ranked_search.varints(values)
    assert ranked_search.integers(data).tolist() == values.tolist() and ends[-1] == len(data)


RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
URLS = [
    "http://example.com/en/1", "https://WWW.Example.com/en/?x", "http://a.www.example.com/en/x#y", "http://com/", "http://com", "http://xcom/", "http://a.com/?q=/en/", "http://a.net/es/", "http://a.net/es", "http://net/fr/x",
    "http://anet/fr/", "http://a.net/fr?/fr/", "a://b.com/en/://c.net/es/", "no address", "", None, "://net/es/", "http:///com/", "http://a.com:80/", "http://u@example.com/en/", "http://b.com/\nx", "http://a.b.c.d.example.com/en/" + "y" * 5000, "http://ÉX.com/", "http://.net/es/", "http://net./es/", "x" * 100_000 + "://net/fr/" + "é" * 10,
]


def plain_verdict(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([i for i, c in enumerate(rest) if c in "/?#"] or [len(rest)])
        host, path = small(rest[:end]), re.split("[?#]", rest[end:])[0]
    fit = [(len(h + p), len(h), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fit)[3], max(fit)[2]) if fit else (host, path, None, default)


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_rules_on_addresses(spark, monkeypatch, broadcast):
    monkeypatch.setattr(url_filter, "BROADCAST_RULES", broadcast)
    rows = [(i if i % 4 else None, u) for i, u in enumerate(URLS)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string")
    many = [*RULES, *((f"h{i}.net", f"/p{i % 7}/" + "z" * (i % 3), "block" if i % 2 else "allow") for i in range(3000)), ("both.com", "/", "allow"), ("both.com", "/", "block"), ("no.com", "", "block"), (None, "/", "block")]
    rows += [(5, f"http://x.h{i}.net/p{i % 7}/zz") for i in range(0, 3000, 50)] + [(6, "http://both.com/a"), (6, "http://no.com"), (6, "http://sub.no.com?x")]
    for rules in (RULES, many):
        got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(rules, "host string, path string, verdict string"))
        want = [(i, *plain_verdict(u, [r for r in rules if r[0]])) for i, u in rows]
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    none = url_filter.judge(pages.selectExpr("*", "url as key", "1 as host"), spark.createDataFrame([], "host string, path string, verdict string"), default="block")
    assert {r["verdict"] for r in none.collect()} == {"block"} and none.count() == len(rows[: 2 * len(URLS)])
    assert url_filter.judge(pages.limit(0), spark.createDataFrame(RULES, "host string, path string, verdict string")).collect() == []


def test_filter_rejects_and_its_false_positives_go(spark):
    keys = spark.range(2000).selectExpr("concat('k', id) as key")
    made = url_filter.bloom_filter(keys, 2000)
    asked = spark.range(6000).selectExpr("concat('k', id) as key")
    rows = asked.select("key", url_filter.block_of(asked["key"], len(made)).alias("block"), url_filter.bits_of(asked["key"]).alias("bits")).toPandas()
    held = url_filter.held(made, rows["block"].to_numpy(), rows["bits"].to_numpy())
    assert held[:2000].all() and held[2000:].mean() < 0.05
