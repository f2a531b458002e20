"""Token ids by the tokenizers library, each distinct word encoded once per worker.

Texts are cut into words with array operations (``words``); the library's model
encodes the words that a worker has not met lately, and the ids of all words are
gathered as arrays. Texts with special tokens' strings go to the library whole.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterable

import numpy as np

from lintlake.llm.shared import worker_state
from lintlake.llm.words import WordCutter, WordIds, per_text

#: Words that a worker keeps at most.
CACHE_WORDS = 400_000


class LibraryEncoder:
    """``tokenizers.Tokenizer`` of a file; gives each text's ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks use the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.cutter = WordCutter(path)
        self.met = WordIds(CACHE_WORDS)

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one text after the other, and how many each text has."""
        keys, whole, which, words = self.cutter.cut(texts)
        tokens = self.tokenizer.model.tokenize

        def encode(new: list[int]) -> list[list[int]]:
            cut = self.cutter.words([keys[i] for i in new], whole[new].tolist())
            return [[t.id for t in tokens(ws[0])] if len(ws) == 1 else [t.id for w in ws for t in tokens(w)] for ws in cut]

        flat, many = self.met.ids(self.met.places(keys, encode)[which])
        return flat, per_text(many, words)

    def encode(self, texts: Iterable[str]) -> Iterable[bytes]:
        """The ids of each text."""
        texts = list(texts)
        plain = [self.cutter.plain(t) for t in texts]
        flat, sizes = self.encode_flat([t for t, p in zip(texts, plain) if p])
        view, ends = memoryview(flat).cast("B") if len(flat) else b"", iter(np.cumsum(sizes).tolist())
        at = 0
        for text, p in zip(texts, plain):
            if p:
                end = 4 * next(ends)
                yield bytes(view[at:end])
                at = end
            else:
                found = self.tokenizer.encode(text, add_special_tokens=False).ids
                yield struct.pack(f"<{len(found)}I", *found)


def library_encoder(path: str) -> LibraryEncoder:
    """The worker's encoder for a vocabulary file."""
    return worker_state(("library", path), lambda: LibraryEncoder(path))
