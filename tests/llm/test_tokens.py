import hashlib
import struct
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lintlake.llm import bpe, packing, token_files
from lintlake.llm.bpe import Encoder
from lintlake.llm.library_tokens import LibraryEncoder

WORD, BYTE = (public_tokenizers.path(f) for f in ("word_bpe_49k.json", "byte_bpe_50k.json"))
TEXTS = ["", "<|endoftext|> a<|startoftext|>b", "İstanbul ΣΑΣ", "naïve café", "½ ² Ⅷ 1234 ab12", "a\x1cb   c \n\n d ", "日本語テスト", "é ́x", "it's we'll !!'s ''s", "\U0001f600 smile", "  lead", "tr  ", "x\n y\n \n z", "ﬁ ẞ", "a" * 500, "ab" * 300]
ROWS = [(i, t, "en") for i, t in enumerate(TEXTS)] + [(99, None, None), (None, "no id", "en"), (3, TEXTS[3], "en")]
KINDS = "doc_id long, text string, part string"


@pytest.fixture(scope="module")
def encoders():
    return {p: (Encoder(p), LibraryEncoder(p), Tokenizer.from_file(p)) for p in (WORD, BYTE)}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("abcdeothein ABC'st \n\t.!?é_09"), st.characters(codec="utf-8")), max_size=60), max_size=4))
def test_encoders_equal_the_library(encoders, texts):
    for own, cached, library in encoders.values():
        want = [library.encode(t, add_special_tokens=False).ids for t in texts + TEXTS]
        assert list(own.encode(texts + TEXTS)) == want
        assert [list(struct.unpack(f"<{len(b) // 4}I", b)) for b in cached.encode(texts + TEXTS)] == want
        assert [own.decode(x) for x in want] == [library.decode(x, skip_special_tokens=False) for x in want]


def test_words_that_greedy_matching_gets_wrong_are_merged(encoders):
    own = encoders[WORD][0].vocabulary
    words = [w for w in ("thationer", "ererndha", "whingnt", "ndheheinsh", "unenessed")]
    assert any(own.propose(w) != own.merge(w) for w in words)
    assert own.encode_words(words) == [own.merge(w) for w in words]


def test_round_trip_query(spark):
    tk = Tokenizer.from_file(WORD)
    got = bpe.digest(spark.createDataFrame(ROWS, KINDS), WORD).collect()
    assert len(got) == len(ROWS)
    want = []
    for i, t, _ in ROWS:
        ids = tk.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(tk.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)
    assert bpe.encode_decode(spark.createDataFrame([], KINDS), WORD).count() == 0


def test_token_files(spark, tmp_path):
    tk = Tokenizer.from_file(BYTE)
    docs = spark.createDataFrame(ROWS, KINDS)
    got = sorted(map(tuple, token_files.tokens_by_files(docs, BYTE).collect()), key=lambda r: r[1])
    start = 0
    for (i, t, _), r in zip(sorted(ROWS, key=lambda r: (r[0] is not None, r[0], r[1] or "")), got, strict=True):
        ids = [*tk.encode(t or "", add_special_tokens=False).ids, 2]
        assert r == (i, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)
    assert token_files.tokens_by_files(docs.limit(0), BYTE).count() == 0
    path = str(tmp_path / "orc")
    token_files.write_tokens(docs, path, BYTE, 2)
    one = token_files.read_tokens(spark, path).where("doc_id = 4")
    assert [r["ids"] for r in one.collect()] == [[*tk.encode(TEXTS[4]).ids, 2]]
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,4)]" in one._jdf.queryExecution().toString()


def check_packed(rows, capacity):
    bins = defaultdict(list)
    for r in rows:
        assert 1 <= r["length"] <= capacity
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for members in bins.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def best_fit_decreasing(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        g = min(fits) if fits else capacity
        if fits:
            gaps.remove(g)
        gaps.append(g - n)
    return len(gaps)


def test_packing(spark, sf_dir):
    tk = Tokenizer.from_file(WORD)
    docs = spark.createDataFrame(ROWS + [(500, "word " * 9000, "en")], KINDS)
    got = packing.pack_documents(docs, WORD).collect()
    check_packed(got, 4096)
    ids = [*tk.encode("word " * 9000, add_special_tokens=False).ids, 1]
    cut = sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got if r["doc_id"] == 500)
    assert cut == [(k, s, len(p), zlib.crc32(struct.pack(f"<{len(p)}I", *p))) for k, s in enumerate(range(0, len(ids), 4096)) for p in [ids[s : s + 4096]]]
    assert len({r["doc_id"] for r in got}) == len({r[0] for r in ROWS}) + 1
    assert packing.pack_documents(docs.limit(0), WORD).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=120))
def test_match_runs_is_best_fit_decreasing(lengths):
    counts = {n: lengths.count(n) for n in set(lengths)}
    bins, ranks = defaultdict(int), []
    for length, first, end, bin_, per_bin, base in packing.match_runs(counts, 50):
        ranks += range(first, end)
        for r in range(end - first):
            b = bin_ + r // per_bin
            assert bins[b] == base + (r % per_bin) * length
            bins[b] += length
    assert ranks == list(range(len(lengths)))
    assert all(n <= 50 for n in bins.values())
    assert len(bins) == best_fit_decreasing(lengths, 50)
