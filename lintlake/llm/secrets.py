"""Secret scans: fixed shapes, and random strings found by token efficiency.

Text that people write compresses into few tokens of a vocabulary trained on such
text; a random string needs a token for one or two characters. So a run of key
characters with few characters per token is reported, unless it is a digest of
a known length, a UUID or an identifier made of words and counters. Words are
what the vocabulary codes in few tokens; letters alone don't make one.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame

from lintlake.llm.shared import worker_state

#: Shapes with the length that a match (assign: its value) must have. Kinds in the order of reports.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # the same as AKIA[A-Z0-9]+ of at least 20 characters
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_VALUE = 6
KINDS = ("assign", "access", "hex", "random")

#: A run of key characters that may be a secret; what may part a rest of it from a fixed shape.
RUN, RUN_LENGTH, SEPARATORS = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}"), 20, "+/_-="
#: Known digests and UUIDs; names that look like words and numbers joined by separators.
KNOWN = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})|(?:[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{64})|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|sha(?:1|256|384|512)-.*")
WORDS = re.compile(r"(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+)(?:[+/_=-]+(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+))*[+/_=-]*|(?:[A-Z][a-z]+)+[0-9]*")
#: The letters of a name, by words; real ones have so many characters a token (random ones seldom, names of code rarely less).
WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
WORD_CHARS_PER_TOKEN = 2.5


def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encoding(path: str, pattern: str):
    """The worker's tiktoken encoding of a rank file."""
    return worker_state(("ranks", path, pattern), lambda: _encoding(path, pattern))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed shapes, by start and then by kind."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_VALUE]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def is_named(run: str, coder) -> bool:
    """Whether a run is made of numbers and real words: their letters are coded in few tokens, in some letter case."""
    if not (run.isalpha() or WORDS.fullmatch(run)):
        return False
    words = WORD.findall(run)
    tokens = sum(min(len(coder.encode_ordinary(x)) for x in (w, w.lower(), f" {w.lower()}")) for w in words)
    return sum(map(len, words)) >= WORD_CHARS_PER_TOKEN * tokens


def random_spans(text: str, coder, taken: list[tuple[int, int, str]], chars_per_token: float) -> list[tuple[int, int, str]]:
    """Runs of low token efficiency, and what fixed shapes leave of runs (``taken`` is sorted by start; one sweep over both)."""
    shapes: list[list[int]] = []  # overlapping ones as one
    for start, end, _ in taken:
        if shapes and start < shapes[-1][1]:
            shapes[-1][1] = max(shapes[-1][1], end)
        else:
            shapes.append([start, end])
    out, at = [], 0
    for m in RUN.finditer(text):
        start, end = m.span()
        while at < len(shapes) and shapes[at][1] <= start:
            at += 1
        pieces, k = [], at
        while k < len(shapes) and shapes[k][0] < end:
            pieces.append((start, shapes[k][0]))
            start = shapes[k][1]
            k += 1
        for a, b in [*pieces, (start, end)]:
            if (a, b) != m.span():  # a rest has the length of a run, without what parted it from the shape
                a, b = a + len(text[a:b]) - len(text[a:b].lstrip(SEPARATORS)), b - len(text[a:b]) + len(text[a:b].rstrip(SEPARATORS))
            if b - a >= RUN_LENGTH and _is_random(text[a:b], coder, chars_per_token):
                out.append((a, b, "random"))
    return out


def _is_random(run: str, coder, chars_per_token: float) -> bool:
    if run.isdigit() or len(set(run)) < 8 or KNOWN.fullmatch(run):
        return False
    return len(run) / len(coder.encode_ordinary(run)) < chars_per_token and not is_named(run, coder)


def spans_of(text: str, coder, chars_per_token: float = 2.0) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """The fixed shapes' spans, and all spans."""
    base = base_spans(text)
    more = random_spans(text, coder, base, chars_per_token)
    return base, sorted(base + more, key=lambda x: (x[0], KINDS.index(x[2])))


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span (overlapping ones together) replaced by its kind in brackets."""
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def scan(docs: DataFrame, ranks: str, pattern: str, chars_per_token: float = 2.0, id_column: str = "doc_id", text_column: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Scan each whole text: the id, ``keep`` columns, counts per kind, ``base_sha256``, ``spans``, ``redacted``.

    One row per document, in the scan's own partitions. Null texts are empty: no
    spans (``redacted`` stays null); null ids and repeated rows stay; an empty
    table gives none.
    """
    names = ["n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans", "redacted"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        coder = encoding(ranks, pattern)
        for b in batches:
            rows = []
            for x in b.column(b.num_columns - 1):
                text = x.as_py()
                base, spans = spans_of(text or "", coder, chars_per_token)
                counts = [sum(k == kind for _, _, k in spans) for kind in KINDS]
                rows.append((*counts, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans), redact(text, spans) if text else text))
            columns = zip(*rows) if rows else ((),) * 7
            kinds = (*[pa.int64()] * 4, *[pa.string()] * 3)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(c, k) for c, k in zip(columns, kinds))], names=[*b.schema.names[:-1], *names])

    fields = ", ".join(f"`{c}` {dict(docs.dtypes)[c]}" for c in (id_column, *keep))
    return docs.select(id_column, *keep, docs[text_column].alias("scanned_text")).mapInArrow(run, f"{fields}, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string, redacted string")
