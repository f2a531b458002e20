"""BPE encoding and decoding by speculation and verification.

A word is first cut by greedy longest match. Byte-pair encoding is the one cut
whose neighbours are all compatible, i.e. the encoding of the two tokens' joined
text is the two tokens themselves. So all adjacent pairs of all proposed words of
a batch are checked together with numpy, and only words with a pair that fails
are merged exactly, step by step.

Texts are cut into words with array operations; equal words are encoded once per
worker and kept in a bounded cache, since words repeat far more often than texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lintlake.llm.shared import worker_state
from lintlake.llm.words import Splitter, WordCutter, WordIds, per_text

#: Words that a worker keeps at most.
CACHE_WORDS = 400_000


class Vocabulary(Splitter):
    """A BPE vocabulary file with its merges as arrays: rank, left and right half of each token."""

    def __init__(self, path: str):
        super().__init__(path)
        spec, model = self.spec, self.spec["model"]
        del self.spec
        self.ids: dict[str, int] = model["vocab"]
        self.bytes_decoder = bool(spec.get("decoder"))
        self.byte_of = {c: b for b, c in self.letters.items()}
        size = 1 + max(chain(self.ids.values(), self.special.values()))
        self.tokens = [""] * size
        for text, i in chain(self.ids.items(), self.special.items()):
            self.tokens[i] = text
        self.decimal = [str(i) for i in range(size)]
        self.size = size
        self.rank = np.full(size, -1, np.int64)
        self.left = np.arange(size)
        self.right = np.arange(size)
        keys = []
        for r, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            a, b, t = self.ids[a], self.ids[b], self.ids[a + b]
            keys.append((a * size + b, r, t))
            if self.rank[t] < 0:
                self.rank[t], self.left[t], self.right[t] = r, a, b
        keys.sort()
        self.pair_keys = np.array([k for k, _, _ in keys], np.int64)
        self.pair_ranks = np.array([r for _, r, _ in keys], np.int64)
        self.merge_rank = {k: r for k, r, _ in keys}
        self.made = {r: t for _, r, t in keys}
        proper = self._proper()
        # inner tokens can't end a word where the vocabulary has a suffix, and final ones must
        self.inner: dict[str, int] = {}
        self.final: dict[str, int] = {}
        for text, i in self.ids.items():
            if proper[i]:
                if self.suffix and text.endswith(self.suffix):
                    self.final[text[: -len(self.suffix)]] = i
                else:
                    self.inner[text] = i
        if not self.suffix:
            self.final = self.inner
        #: the longest token that begins with each two letters (or the letter alone)
        self.longest: dict[str, int] = {}
        for text in chain(self.inner, self.final):
            for head in (text[:1], text[:2]):
                self.longest[head] = max(len(text), self.longest.get(head, 1))

    def _proper(self) -> np.ndarray:
        """Whether each token's own text encodes to the token: halves that are proper and meet nowhere earlier."""
        merged = np.flatnonzero(self.rank >= 0)
        out = np.ones(self.size, bool)
        out[merged] = self.compatible(self.left[merged], self.right[merged], self.rank[merged])
        for t in merged[np.argsort(self.rank[merged])]:
            out[t] &= out[self.left[t]] and out[self.right[t]]
        return out

    def _pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the merge of each pair, or a rank beyond all."""
        keys = a * self.size + b
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], np.iinfo(np.int64).max)

    def compatible(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """Whether no merge joins the right edge of token a with the left edge of token b (before rank ``until``).

        An edge part exists from its own rank until its parent's merge. Undoing the
        later of the two parts step by step meets every pair of edge parts that
        exist at the same time. The leftmost of equal merges goes first: the left
        part must be merged strictly before it is consumed, the right part may tie.
        """
        far = np.iinfo(np.int64).max
        x, y = np.array(a, np.int64), np.array(b, np.int64)
        end_x = np.full(len(x), far) if until is None else np.array(until, np.int64)
        end_y = end_x.copy() if until is None else end_x - 1
        good, open_ = np.ones(len(x), bool), np.arange(len(x))
        while len(open_):
            xs, ys = x[open_], y[open_]
            r = self._pair_rank(xs, ys)
            joined = (r < end_x[open_]) & (r <= end_y[open_]) & (r < far)
            good[open_[joined]] = False
            rx, ry = self.rank[xs], self.rank[ys]
            go = ~joined & ((rx >= 0) | (ry >= 0))
            open_, xs, ys, rx, ry = open_[go], xs[go], ys[go], rx[go], ry[go]
            undo_x = rx > ry
            i, j = open_[undo_x], open_[~undo_x]
            end_x[i], x[i] = rx[undo_x], self.right[xs[undo_x]]
            end_y[j], y[j] = ry[~undo_x], self.left[ys[~undo_x]]
        return good

    def propose(self, word: str) -> list[int]:
        """Greedy longest match of a word in vocabulary letters."""
        out, at, n = [], 0, len(word)
        inner, final, longest = self.inner.get, self.final.get, self.longest.get
        while True:
            most = longest(word[at : at + 2], 1)
            if n - at <= most and (t := final(word[at:])) is not None:
                out.append(t)
                return out
            for end in range(min(at + most, n - 1), at, -1):
                if (t := inner(word[at:end])) is not None:
                    out.append(t)
                    at = end
                    break

    def merge(self, word: str) -> list[int]:
        """The exact encoding of a word: the lowest merge first, the leftmost of equal ones; n log n in its length."""
        ids, size, get, made = self.ids, self.size, self.merge_rank.get, self.made
        parts = [ids[c] for c in word[:-1]]
        parts.append(ids[word[-1] + self.suffix])
        n = len(parts)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (r := get(a * size + b)) is not None]
        heapify(heap)
        while heap:
            r, i = heappop(heap)
            j = right[i]
            if j >= n or parts[i] < 0 or get(parts[i] * size + parts[j]) != r:
                continue  # one of the two has been merged since
            parts[i], parts[j] = made[r], -1
            k = right[i] = right[j]
            if k < n:
                left[k] = i
                if (r := get(parts[i] * size + parts[k])) is not None:
                    heappush(heap, (r, i))
            k = left[i]
            if k >= 0 and (r := get(parts[k] * size + parts[i])) is not None:
                heappush(heap, (r, k))
        return [p for p in parts if p >= 0]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Token ids of each word (in vocabulary letters): proposed, checked together, merged where a check fails."""
        cuts = [self.propose(w) for w in words]
        sizes = np.fromiter(map(len, cuts), np.int64, len(cuts))
        flat = np.fromiter(chain.from_iterable(cuts), np.int64, int(sizes.sum()))
        if len(flat) > 1:
            inside = np.ones(len(flat), bool)
            inside[np.cumsum(sizes) - 1] = False  # a word's last token has no right neighbour
            at = np.flatnonzero(inside)
            pairs, which = np.unique(flat[at] * self.size + flat[at + 1], return_inverse=True)
            bad = at[~self.compatible(pairs // self.size, pairs % self.size)[which]]
            for k in np.unique(np.searchsorted(np.cumsum(sizes), bad, side="right")):
                cuts[k] = self.merge(words[k])
        return cuts


class Encoder:
    """Encodes texts with a ``Vocabulary``; keeps the ids of words already met."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.cutter = WordCutter(path)
        self.met = WordIds(CACHE_WORDS)

    def _plain(self, texts: list[str]) -> Iterable[list[int]]:
        """The ids of texts without special tokens' strings."""
        keys, whole, which, words = self.cutter.cut(texts)

        def encode(new: list[int]) -> list[list[int]]:
            cut = self.cutter.words([keys[i] for i in new], whole[new].tolist())
            fresh = list(set(chain.from_iterable(cut)))
            ids = dict(zip(fresh, self.vocabulary.encode_words(fresh)))
            return [ids[ws[0]] if len(ws) == 1 else list(chain.from_iterable(map(ids.__getitem__, ws))) for ws in cut]

        flat, many = self.met.ids(self.met.places(keys, encode)[which])
        at = 0
        for end in np.cumsum(per_text(many, words)).tolist():
            yield flat[at:end].tolist()
            at = end

    def encode(self, texts: Iterable[str]) -> Iterable[list[int]]:
        """The ids of each text; special tokens' strings are those tokens."""
        v = self.vocabulary
        parts = [[t] if self.cutter.plain(t) else v.marks.split(t) for t in texts]  # every second part is a special token
        found = iter(self._plain([p for row in parts for p in row[::2]]))
        for row in parts:
            ids = next(found)
            for mark in row[1::2]:
                ids = [*ids, v.special[mark], *next(found)]
            yield ids

    def decode(self, ids: list[int]) -> str:
        """The text of ids, special tokens included: joined bytes, or tokens set apart by spaces where the file has no decoder."""
        v = self.vocabulary
        if not v.bytes_decoder:
            return " ".join(map(v.tokens.__getitem__, ids))
        return b"".join(t.encode() if t in v.special else bytes(map(v.byte_of.__getitem__, t)) for t in map(v.tokens.__getitem__, ids)).decode("utf-8", "replace")


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    return worker_state(("bpe", path), lambda: Encoder(path))


def slices(texts: list[str], chars: int = 1_000_000) -> Iterable[list[str]]:
    """Consecutive runs of texts of about ``chars`` characters, so that working memory is bounded."""
    run, size = [], 0
    for t in texts:
        run.append(t)
        size += len(t)
        if size >= chars:
            yield run
            run, size = [], 0
    if run:
        yield run


def encode_decode(docs: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Encode and decode each text; one row per input row, in the scan's own partitions, without a shuffle.

    Returns ``id_column``, ``ids array<int>``, ``decoded string``. A null text
    counts as empty (no ids, empty decoded text); null ids and repeated rows stay
    as they are; an empty table gives none; other columns are not carried.
    """
    return docs.select(id_column, text_column).mapInArrow(_per_text(vocabulary, _ids_and_text), f"{id_column} {dict(docs.dtypes)[id_column]}, ids array<int>, decoded string")


def digest(docs: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """As ``encode_decode``, but with ``n_tokens`` and the digests of ids and decoded text instead of them."""
    return docs.select(id_column, text_column).mapInArrow(_per_text(vocabulary, _digests), f"{id_column} {dict(docs.dtypes)[id_column]}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _ids_and_text(enc: Encoder, texts: list[str]) -> list[pa.Array]:
    ids = list(enc.encode(texts))
    return [pa.array(ids, pa.list_(pa.int32())), pa.array(map(enc.decode, ids), pa.string())]


def _digests(enc: Encoder, texts: list[str]) -> list[pa.Array]:
    decimal = enc.vocabulary.decimal
    sizes, sums, backs = [], [], []
    for run in slices(texts):
        for ids in enc.encode(run):
            sizes.append(len(ids))
            sums.append(hashlib.sha256(" ".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
            backs.append(hashlib.sha256(enc.decode(ids).encode()).hexdigest())
    return [pa.array(sizes, pa.int64()), pa.array(sums, pa.string()), pa.array(backs, pa.string())]


def _per_text(vocabulary: str, made):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        enc = encoder(vocabulary)
        names = {_ids_and_text: ["ids", "decoded"], _digests: ["n_tokens", "ids_sha256", "decoded_sha256"]}[made]
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *made(enc, texts)], names=[b.schema.names[0], *names])

    return run
