"""Language identification by cross-parsing entropy.

Each language has a suffix automaton of a labelled sample. A text is parsed against
it: the longest match in the sample is one phrase, and the next phrase begins where
the match ends. Text of the sample's language needs few phrases; the language with
the fewest per symbol wins. All blocks of a batch step through an automaton
together as numpy arrays.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lintlake.llm.bpe import slices
from lintlake.llm.shared import crc32_text, worker_state

#: Sampled documents and characters per language at most; documents up to LONG characters are taken first.
SAMPLE_DOCS, SAMPLE_CHARS, LONG = 96, 48_000, 4_000
#: Letters that have a symbol of their own; symbols in a block (a parse begins anew at each).
LETTERS, BLOCK = 90, 256
UNKNOWN = "und"


def _is_letter() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


class Alphabet:
    """Symbols of characters: 0 for runs of anything but letters, 1 for rare letters, then the frequent ones."""

    def __init__(self, texts: Iterable[str]):
        seen = Counter(c for t in texts for c in t.lower() if c.isalpha())
        frequent = sorted(c for c, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:LETTERS])
        self.size = 2 + len(frequent)
        self.symbols = _is_letter().astype(np.uint8)
        self.symbols[[ord(c) for c in frequent]] = np.arange(2, self.size)

    def encode(self, text: str) -> np.ndarray:
        """The text's symbols between two gaps; runs of other characters are one gap."""
        codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), "<u4")
        out = self.symbols[codes]
        return out[(out != 0) | (np.concatenate([[1], out[:-1]]) != 0)]


def automaton(text: np.ndarray, symbols: int) -> np.ndarray:
    """The suffix automaton of a text as a table: next state by state and symbol, -1 where the text has no such continuation.

    The last column is for padding and keeps the state.
    """
    moves: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in text.tolist():
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                twin = len(moves)
                moves.append(moves[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    table = np.full((len(moves), symbols + 1), -1, np.int32)
    for state, to in enumerate(moves):
        table[state, list(to)] = list(to.values())
    table[:, symbols] = np.arange(len(moves))
    return table


def phrases(table: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Phrases that each column of ``blocks`` (symbols down the rows) needs."""
    width = table.shape[1]
    flat = table.ravel()
    begin = np.maximum(table[0], 0)
    state = np.zeros(blocks.shape[1], np.int64)
    count = np.ones(blocks.shape[1], np.int32)
    for symbols in blocks:
        to = flat[state * width + symbols]
        missed = to < 0
        count += missed
        state = np.where(missed, begin[symbols], to)
    return count


class LanguageModel:
    """The automata of all learned languages."""

    def __init__(self, samples: dict[str, str]):
        self.languages = sorted(samples)
        self.alphabet = Alphabet(samples[k] for k in self.languages)
        self.tables = [automaton(self.alphabet.encode(samples[k]), self.alphabet.size) for k in self.languages]

    def rates(self, texts: list[str]) -> np.ndarray:
        """Phrases per symbol, by text and language, over the whole texts."""
        encoded = [self.alphabet.encode(t) for t in texts]
        sizes = np.array([len(e) for e in encoded])
        blocks = -(-sizes // BLOCK)
        flat = np.full(int(blocks.sum()) * BLOCK, self.alphabet.size, np.uint8)
        starts = np.concatenate([[0], np.cumsum(blocks)])
        for e, at in zip(encoded, starts.tolist()):
            flat[at * BLOCK : at * BLOCK + len(e)] = e
        columns = np.ascontiguousarray(flat.reshape(-1, BLOCK).T)
        out = np.empty((len(texts), len(self.tables)))
        for k, table in enumerate(self.tables):
            out[:, k] = np.add.reduceat(phrases(table, columns), starts[:-1]) / sizes
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, score) of each text; the score is how far the runner-up stays behind, 0 to 1."""
        known = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
        out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
        if not known or not self.languages:
            return out
        rates = self.rates([texts[i] for i in known])
        order = np.argsort(rates, axis=1, kind="stable")
        for i, row, by in zip(known, rates, order):
            second = row[by[1]] if len(by) > 1 else np.inf
            out[i] = (self.languages[by[0]], float(1 - row[by[0]] / second))
        return out


def training_samples(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", fold: int = 3, held_out: int = 1) -> dict[str, str]:
    """A bounded sample of whole documents per language, by hash of the id, outside the held-out fold."""
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"), F.col(lang_column).alias("lang")).where("lang is not null and text is not null and length(text) > 0")
    rows = rows.where(crc32_text("id") % fold != held_out)
    order = Window.partitionBy("lang").orderBy("long", "hash", "id", "own")
    ids = rows.select("lang", "id", (F.length("text") > LONG).alias("long"), F.xxhash64("id").alias("hash"), F.xxhash64("text").alias("own"))
    ids = ids.withColumn("place", F.row_number().over(order)).where(F.col("place") <= SAMPLE_DOCS)
    # by id and the text's own hash, as ids may be null or repeat; of repeated rows one text for each place
    chosen = F.broadcast(ids.select(F.col("lang").alias("in_lang"), F.col("id").alias("chosen"), F.col("own").alias("chosen_text"), "place"))
    mine = F.col("id").eqNullSafe(F.col("chosen")) & (F.col("lang") == F.col("in_lang")) & (F.xxhash64("text") == F.col("chosen_text"))
    got = rows.join(chosen, mine).groupBy("lang", "place").agg(F.min(F.substring("text", 1, SAMPLE_CHARS)).alias("text"))
    samples: dict[str, str] = {}
    for r in sorted(got.collect(), key=lambda r: (r["lang"], r["place"], r["text"])):
        if len(samples.get(r["lang"], "")) < SAMPLE_CHARS:
            samples[r["lang"]] = f"{samples.get(r['lang'], '')} {r['text']}"[:SAMPLE_CHARS]
    return samples


def _model(samples: dict[str, str]) -> LanguageModel:
    """The worker's model of the samples."""
    return worker_state(("languages", tuple(sorted(samples.items()))), lambda: LanguageModel(samples))


def identify(docs: DataFrame, samples: dict[str, str], id_column: str = "doc_id", text_column: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Each whole text's ``lang_pred`` and ``score``, with ``keep`` columns; workers build the automata from the samples.

    One row per document, in the scan's own partitions. Null texts and texts
    without a letter are ``und`` with score 0; equal phrase rates go to the first
    language by name; null ids and repeated rows stay; an empty table gives none.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        model = _model(samples)
        for b in batches:
            texts = b.column(b.num_columns - 1).to_pylist()
            found, at = [], 0
            for run_of in slices([t or "" for t in texts]):
                found += model.predict(texts[at : at + len(run_of)])
                at += len(run_of)
            langs, scores = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*b.schema.names[:-1], "lang_pred", "score"])

    fields = ", ".join(f"`{c}` {dict(docs.dtypes)[c]}" for c in (id_column, *keep))
    return docs.select(id_column, *keep, docs[text_column].alias("identified_text")).mapInArrow(run, f"{fields}, lang_pred string, score double")


def classify(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", fold: int = 3, held_out: int = 1) -> DataFrame:
    """Learn from labelled documents outside the held-out fold and identify all: id, ``held_out``, ``lang_pred``, ``score``."""
    samples = training_samples(docs, id_column, text_column, lang_column, fold, held_out)
    return identify(docs, samples, id_column, text_column).select(id_column, (crc32_text(id_column) % fold == held_out).alias("held_out"), "lang_pred", "score")
