"""Toxicity by compression distance.

Two dictionaries are trained by zstandard, one on windows of toxic text and one on
windows of ordinary text. A document is cut into windows of a few words; each is
compressed with the ordinary dictionary alone and with the toxic one beside it, so
a window that comes out shorter the second time holds toxic passages. The saved
bytes of all windows are compared with thresholds calibrated on labelled documents
that the dictionaries have not seen.
"""

from __future__ import annotations

import random
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lintlake.llm.shared import crc32_text, worker_state

#: Labelled documents and characters per class that the fit takes at most (those of the lowest hash).
SAMPLE_DOCS = 6_000
SAMPLE_CHARS = 12_000_000
#: Words of a window; its bytes at most.
WINDOW, WINDOW_BYTES = 4, 1_024
#: Bytes of the ordinary dictionary and of the windows that the trainer reads at most.
ORDINARY, TRAINED_ON = 4_096, 1_500_000
#: Sizes of the toxic dictionary and segment lengths of the trainer, of which calibration takes the best.
TOXIC_SIZES, SEGMENTS, STEP = (1_024, 3_072), (16, 24), 6
#: Cells of the table of byte runs, their length, and what makes a run telling: times as frequent, and by so many deviations.
CELLS, RUN, RATIO, DEVIATIONS = 1 << 22, 6, 8.0, 5.0
#: Of ordinary documents so many at most may score as toxic in calibration.
FALSE_SHARE = 0.003
#: Begins every window and ends both dictionaries, so that a frame always has one match to describe; no text holds these bytes.
HEAD = bytes(range(224, 256))
MULTIPLIERS = (1, 2654435761, 2246822519, 3266489917)


def windows(text: str, words: int = WINDOW) -> list[bytes]:
    """Consecutive windows of so many words over the whole text, lower-cased, in UTF-8 between single spaces; one at least."""
    found = text.lower().split()
    out = []
    for i in range(0, len(found), words):
        w = (" " + " ".join(found[i : i + words]) + " ").encode()
        out += [w] if len(w) <= WINDOW_BYTES else [w[k : k + WINDOW_BYTES] for k in range(0, len(w), WINDOW_BYTES)]
    return out or [b" "]


def distinct(texts: list[str]) -> list[str]:
    """Texts without near copies of earlier ones (any of four least hashes of 24 bytes in common)."""
    seen, out = set(), []
    for t in texts:
        runs = _runs(_spaced(t), 24)
        keys = {(k, int((runs * np.uint64(m)).min())) for k, m in enumerate(MULTIPLIERS)} if len(runs) else {t}
        if not keys & seen:
            out.append(t)
        seen |= keys
    return out


def _spaced(text: str) -> bytes:
    """A text lower-cased, in UTF-8 with a single space around each word."""
    return f" {' '.join(text.lower().split())} ".encode()


def _runs(text: bytes, n: int) -> np.ndarray:
    """A hash of each run of ``n`` bytes."""
    data = np.frombuffer(text, np.uint8).astype(np.uint64)
    out = np.zeros(max(0, len(data) - n + 1), np.uint64)
    for k in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + data[k : k + len(out)] + np.uint64(1)
    return (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _cells(text: bytes) -> np.ndarray:
    """The table cell of each run of ``RUN`` bytes."""
    return (_runs(text, RUN) >> np.uint64(64 - CELLS.bit_length() + 1)).astype(np.int64)


def _told(text: str, marks: np.ndarray) -> list[bytes]:
    """The windows of one word (with its spaces) that hold a marked run."""
    data = _spaced(text)
    spaces = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
    at = np.flatnonzero(marks[_cells(data)])
    word = np.searchsorted(spaces, at, side="right") - 1
    word = np.unique(word[at + RUN - 1 <= spaces[np.minimum(word + 1, len(spaces) - 1)]])
    return [data[a : min(b + 1, a + WINDOW_BYTES)] for a, b in zip(spaces[word].tolist(), spaces[word + 1].tolist())]


def telling(texts: list[str], others: list[str]) -> np.ndarray:
    """Which cells hold byte runs that are markedly more frequent in the documents of ``texts`` than of ``others``."""

    def documents(some: list[str]) -> np.ndarray:
        counts = np.zeros(CELLS, np.int32)
        for t in some:
            counts[np.unique(_cells(_spaced(t)))] += 1
        return counts

    here, there = documents(texts), documents(others)
    n, m = max(1, len(texts)), max(1, len(others))
    p, q, both = here / n, (there + 0.5) / m, (here + there) / (n + m)
    deviation = np.sqrt(both * (1 - both) * (1 / n + 1 / m)) + 1e-9
    return (p > RATIO * q) & (p - q > DEVIATIONS * deviation) & (here >= 3)


def _trained(samples: list[bytes], size: int, segment: int) -> bytes:
    """A dictionary that zstandard trains on the samples; of too few samples their end."""
    import zstandard

    kept = list(samples)
    random.Random(5).shuffle(kept)
    most = np.searchsorted(np.cumsum([len(x) for x in kept]), TRAINED_ON) if kept else 0
    try:
        return zstandard.train_dictionary(size, kept[: most + 1], k=segment, d=STEP).as_bytes()
    except zstandard.ZstdError:
        return b"".join(kept[: most + 1])[-size:]


def dictionaries(toxic: list[str], ordinary: list[str]) -> tuple[bytes, dict[tuple[int, int], bytes]]:
    """The ordinary dictionary, and the toxic ones by size and segment length.

    The toxic ones learn from the words of toxic text that hold a telling run of
    bytes: the rest of a toxic document is text like any other.
    """
    marks = telling(toxic, ordinary)
    chosen = [w for t in toxic for w in _told(t, marks)]
    plain = _trained([w for t in ordinary for w in windows(t, 1)], ORDINARY, SEGMENTS[0])
    return plain, {(size, k): _trained(chosen, size, k) for size in TOXIC_SIZES for k in SEGMENTS}


@dataclass
class ToxicityModel:
    """Both dictionaries, the window threshold and the weights of a document's saved bytes."""

    toxic: bytes = b""
    ordinary: bytes = b""
    weights: list[float] = field(default_factory=lambda: [-4.0, 0.0, 0.0, 0.0])
    window_threshold: int = 2

    def _compressors(self):
        import zstandard

        def make(content: bytes):
            kept = zstandard.ZstdCompressionDict(self.ordinary + content + HEAD, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            # frames without sizes or sums
            params = zstandard.ZstdCompressionParameters(window_log=17, chain_log=14, hash_log=15, search_log=5, min_match=5, target_length=16, strategy=zstandard.STRATEGY_GREEDY, write_content_size=False, write_checksum=False, write_dict_id=False)
            return zstandard.ZstdCompressor(dict_data=kept, compression_params=params).compress

        # in the place of the toxic dictionary, bytes that match nothing: distances to the ordinary one are the same
        return make(self.toxic), make(b"\xff" * len(self.toxic))

    def savings(self, texts: Iterable[str]) -> list[list[int]]:
        """Bytes that the toxic dictionary saves on each window of each text."""
        toxic, ordinary = worker_state(("toxicity", self.toxic, self.ordinary), self._compressors)
        return [[len(ordinary(w)) - len(toxic(w)) for w in (HEAD + x for x in windows(t))] for t in texts]

    def features(self, saved: list[int]) -> tuple[float, float, float]:
        """The largest saving, the number of windows over the threshold, and their share."""
        over = sum(s >= self.window_threshold for s in saved)
        return float(min(max(saved), 12)), float(np.log1p(over)), over / len(saved)

    def scores(self, texts: list[str]) -> list[float]:
        """Each text's chance of a toxic label, 0 to 1."""
        x = np.array([(1.0, *self.features(s)) for s in self.savings(texts)]).reshape(len(texts), 4)
        return (1 / (1 + np.exp(-(x @ np.array(self.weights)).clip(-30, 30)))).tolist()


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Weights of a logistic regression by Newton's steps."""
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-(x @ w).clip(-30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(hessian, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _calibrated(toxic: bytes, ordinary: bytes, held: list[str], y: np.ndarray) -> tuple[float, ToxicityModel]:
    """The best threshold and weights for two dictionaries on held-out texts, and how likely they make the labels."""
    saved = ToxicityModel(toxic, ordinary).savings(held)
    best = (-np.inf, ToxicityModel())
    for threshold in range(1, 9):
        m = ToxicityModel(toxic, ordinary, window_threshold=threshold)
        x = np.array([(1.0, *m.features(s)) for s in saved])
        weights = _logistic(x, y)
        p = (1 / (1 + np.exp(-(x @ weights).clip(-30, 30)))).clip(1e-9, 1 - 1e-9)
        fitness = float((y * np.log(p) + (1 - y) * np.log(1 - p)).sum())
        if fitness > best[0]:
            # few ordinary texts may come out at one half or more
            weights[0] -= max(0.0, float(np.quantile((x @ weights)[y == 0], 1 - FALSE_SHARE)))
            m.weights = weights.tolist()
            best = (fitness, m)
    return best


def fit(rows: list[tuple[str, int]]) -> ToxicityModel:
    """Train dictionaries on two thirds of the labelled texts and calibrate them on the last third.

    Without a text of each class the model gives every text a low score.
    """
    by = {k: distinct([t for t, y in rows if y == k]) for k in (0, 1)}
    if not by[0] or not by[1]:
        return ToxicityModel()
    ordinary, toxic = dictionaries(*([t for i, t in enumerate(by[k]) if i % 3] for k in (1, 0)))
    held = [t for k in (1, 0) for t in by[k][::3]]
    y = np.repeat([1.0, 0.0], [len(by[1][::3]), len(by[0][::3])])
    found = {k: _calibrated(x, ordinary, held, y) for k, x in toxic.items()}
    return max(found.values(), key=lambda x: x[0])[1]


def training_rows(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", fold: int = 5) -> list[tuple[str, int]]:
    """Labelled texts outside the held-out fold, at most ``SAMPLE_DOCS`` and ``SAMPLE_CHARS`` of each class, by hash.

    Both bounds hold before a text reaches the driver; a text longer than what is
    left of the second is passed over. Of rows with one id the least text counts.
    """
    known = labels.select(F.col(id_column).alias("label_id"), F.col(label_column).cast("int").alias("label")).where("label in (0, 1) and label_id is not null").groupBy("label_id").agg(F.max("label").alias("label"))
    few = known.where(F.crc32(F.col("label_id").cast("string").cast("binary")) % fold != 0)
    # bounded before the texts are touched
    few = few.where("label = 1").orderBy(F.xxhash64("label_id")).limit(SAMPLE_DOCS).unionByName(few.where("label = 0").orderBy(F.xxhash64("label_id")).limit(SAMPLE_DOCS))
    got = docs.select(F.col(id_column).alias("label_id"), F.col(text_column).alias("text")).where(F.length("text") <= SAMPLE_CHARS).join(F.broadcast(few), "label_id")
    one = got.groupBy("label_id", "label").agg(F.min("text").alias("text"))
    running = F.sum(F.length("text")).over(Window.partitionBy("label").orderBy(F.xxhash64("label_id"), "label_id").rowsBetween(Window.unboundedPreceding, 0))
    chosen = one.withColumn("chars", running).where(F.col("chars") <= SAMPLE_CHARS)
    return sorted((r["text"], r["label"]) for r in chosen.select("text", "label").toLocalIterator())


def score(docs: DataFrame, model: ToxicityModel, id_column: str = "doc_id", text_column: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Each text's ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on), with ``keep`` columns.

    One row per document, in the scan's own partitions, over all windows of the
    text. Null and empty texts are scored as one empty window; null ids and
    repeated rows stay; an empty table gives none.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            got = model.scores([t or "" for t in b.column(b.num_columns - 1).to_pylist()])
            arrays = [*b.columns[:-1], pa.array(got, pa.float64()), pa.array([int(s >= 0.5) for s in got], pa.int32())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*b.schema.names[:-1], "score", "predicted"])

    fields = ", ".join(f"`{c}` {dict(docs.dtypes)[c]}" for c in (id_column, *keep))
    return docs.select(id_column, *keep, docs[text_column].alias("scored_text")).mapInArrow(run, f"{fields}, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", fold: int = 5) -> DataFrame:
    """Fit on the labelled documents outside the held-out fold and score all: id, ``held_out``, ``score``, ``predicted``."""
    model = fit(training_rows(docs, labels, id_column, text_column, fold=fold))
    return score(docs, model, id_column, text_column).select(id_column, (crc32_text(id_column) % fold == 0).alias("held_out"), "score", "predicted")
