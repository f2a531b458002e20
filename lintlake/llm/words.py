"""Texts cut into a vocabulary's words with array operations, equal words found once a batch.

The split patterns of the vocabulary files make a word of each run of letters,
digits or signs; a byte vocabulary keeps a space with the word after it, one with
word ends drops white space. Both follow from the class of each character and of
its neighbour, so a batch of texts is cut by comparing arrays. Runs between spaces
that hold an apostrophe (the patterns' endings) or a character whose class two
libraries may see differently are left whole, for the file's own splitter.
"""

from __future__ import annotations

import json
import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa
import regex

#: The split patterns that the two vocabulary files state.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Up to this character (Latin letters) the patterns are applied here.
LATIN = "\u024f"
#: Signs that are a word of their own after letters.
SIGNS = frozenset(".,;:!?)\"")


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in vocabulary files."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class Splitter:
    """Cuts a text into a vocabulary file's words, written in the vocabulary's letters for bytes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            self.spec = json.load(f)
        self.path, self.library = path, None
        self.special = {t["content"]: t["id"] for t in self.spec["added_tokens"]}
        self.suffix: str = self.spec["model"].get("end_of_word_suffix") or ""
        self.lowers = bool(self.spec.get("normalizer"))
        self.pattern = regex.compile((WORD_PATTERN if self.suffix else BYTE_PATTERN).replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.letters = byte_alphabet()
        self.gap = self.letters[32]
        self.table = {i: "".join(map(self.letters.__getitem__, chr(i).encode())) for i in range(ord(LATIN) + 1)}
        self.marks = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")

    def words(self, piece: str) -> list[str]:
        """The words of a text; special tokens' strings are not looked for here."""
        if not piece.isascii():
            plain = unicodedata.normalize("NFC", piece).lower() if self.lowers else piece
            if max(piece) > LATIN or max(plain) > LATIN:  # two libraries' Unicode tables may differ there: take the file's own splitter
                if self.library is None:
                    from tokenizers import Tokenizer

                    self.library = Tokenizer.from_file(self.path)
                if self.lowers:
                    piece = self.library.normalizer.normalize_str(piece)
                return [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(piece)]
            piece = plain
        elif self.lowers:
            piece = piece.lower()
        # most pieces are a word, or a word and a sign
        core = piece[1:] if piece[:1] == " " else piece
        if core.isalpha():
            return [self.gap + core if piece is not core and piece.isascii() else piece.translate(self.table)]
        if core[-1:] in SIGNS and core[:-1].isalpha():
            return [piece[:-1].translate(self.table), core[-1]]
        return [w.translate(self.table) for w in self.pattern.findall(piece)]


SPACE, LETTER, DIGIT, SIGN, OTHER = range(5)
#: White space of the Unicode property; general punctuation and the euro sign, signs in every version of Unicode.
WHITE = (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
MORE_SIGNS = (*range(0x2010, 0x2028), *range(0x2030, 0x205F), 0x20AC)

#: A private character between words that are rewritten together; it is in no word but those left whole.
MARK = "\ue000"


def _classes() -> np.ndarray:
    """The class of every 16-bit unit."""
    out = np.full(1 << 16, OTHER, np.uint8)
    for i in range(ord(LATIN) + 1):
        kind = unicodedata.category(chr(i))[0]
        out[i] = {"L": LETTER, "N": DIGIT}.get(kind, SIGN)
    out[list(MORE_SIGNS)] = SIGN
    out[list(WHITE)] = SPACE
    return out


def _lowered(classes: np.ndarray) -> np.ndarray:
    """Lower case of every unit; letters whose lower case is another length or not Latin stay and are told apart by class."""
    out = np.arange(1 << 16, dtype=np.uint16)
    for i in range(ord(LATIN) + 1):
        low = chr(i).lower()
        if len(low) == 1 and low <= LATIN:
            out[i] = ord(low)
        else:
            classes[i] = OTHER
    return out


class WordCutter:
    """Cuts batches of texts into the words of a vocabulary file."""

    def __init__(self, path: str):
        self.splitter = Splitter(path)
        del self.splitter.spec
        self.special = list(self.splitter.special)
        self.classes = _classes()
        self.lower = _lowered(self.classes) if self.splitter.lowers else None
        self.table = self.splitter.table | {i: "".join(map(self.splitter.letters.__getitem__, chr(i).encode())) for i in (*MORE_SIGNS, *WHITE)}

    def plain(self, text: str) -> bool:
        """Whether no special token's string is in a text."""
        return not any(s in text for s in self.special)

    def words(self, keys: list[str], whole: list[bool]) -> list[list[str]]:
        """The words (in the vocabulary's letters) of keys that ``cut`` gives: one, none for dropped space, more for what was left whole."""
        single = [k for k, w in zip(keys, whole) if not w]
        letters = iter(MARK.join(single).translate(self.table).split(MARK) if single else ())
        if self.splitter.suffix:
            return [self.splitter.words(k) if w else [x] if (x := next(letters)) and self.kind(k[0]) != SPACE else [] for k, w in zip(keys, whole)]
        return [self.splitter.words(k) if w else [next(letters)] for k, w in zip(keys, whole)]

    def kind(self, letter: str) -> int:
        return self.classes[min(ord(letter), 0xFFFF)]

    def cut(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Of texts without special tokens' strings: distinct keys, whether each was left whole, the key of each word, the words of each text."""
        coded = [t.encode("utf-16-le") for t in texts]
        sizes = np.fromiter(map(len, coded), np.int64, len(coded)) // 2
        raw = np.frombuffer(b"".join(coded), "<u2")
        n = len(raw)
        if not n:
            return [], np.zeros(0, bool), np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        kinds = self.classes[raw]
        begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        head = np.zeros(n, bool)  # the first unit of a text
        head[begins[sizes > 0]] = True
        starts = head.copy()
        starts[1:] |= kinds[1:] != kinds[:-1]
        if self.splitter.suffix:
            starts |= kinds == DIGIT
        else:  # the last space before a word is part of it, other white space before one is a word
            word = np.flatnonzero((kinds[1:] != SPACE) & (kinds[:-1] == SPACE) & ~head[1:]) + 1
            starts[word - 1] = True
            starts[word] = raw[word - 1] != 0x20
        units = raw if self.lower is None else self.lower[raw]
        odd = (kinds == OTHER) | (raw == 0x27)
        whole = None
        if odd.any():
            solid = kinds != SPACE
            first = solid & head
            first[1:] |= solid[1:] & (kinds[:-1] == SPACE)
            run = np.cumsum(first)
            marked = np.zeros(run[-1] + 1, bool)
            marked[run[odd]] = True
            whole = marked[run] & solid
            starts &= ~whole | first
            units = np.where(whole, raw, units)
        at = np.flatnonzero(starts)
        text = units.tobytes().decode("utf-16-le").encode()
        if len(text) == n:
            offsets = np.concatenate([at, [n]]).astype(np.int32)
        else:  # places in UTF-8: one byte below 80, two below 800 and for each half of a pair, else three
            width = 1 + (units > 0x7F).astype(np.int32) + ((units > 0x7FF) & ((units & 0xF800) != 0xD800))
            offsets = np.concatenate([[0], np.cumsum(width, dtype=np.int32)])[np.concatenate([at, [n]])].astype(np.int32)
        words = pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(text)).dictionary_encode()
        bounds = np.searchsorted(at, np.concatenate([begins, [n]]))
        keys, which = words.dictionary.to_numpy(zero_copy_only=False).tolist(), words.indices.to_numpy(zero_copy_only=False)
        left = np.zeros(len(keys), bool)
        if whole is not None:  # a run may begin with the space before it
            last = np.concatenate([at[1:], [n]]) - 1
            left[which[whole[last]]] = True
        return keys, left, which, np.diff(bounds)


class WordIds:
    """The ids of the words a worker has met lately, as arrays; the longest unused go when there are too many."""

    def __init__(self, most: int):
        self.most, self.turn = most, 0
        self.known: dict[str, int] = {}  # key: its place
        self.first, self.size, self.used = (np.zeros(0, np.int64) for _ in range(3))
        self.flat = np.zeros(0, np.uint32)

    def _forget(self) -> None:
        """Keep the more recent half."""
        keep = np.sort(np.argsort(self.used, kind="stable")[len(self.used) - self.most // 2 :])
        keys = list(self.known)
        self.known = {keys[i]: k for k, i in enumerate(keep.tolist())}
        self.flat, self.size = gathered(self.flat, self.first, self.size, keep)
        self.used, self.first = self.used[keep], np.cumsum(self.size) - self.size

    def places(self, keys: list[str], encode) -> np.ndarray:
        """The place of each of a batch's keys; ``encode`` gives the ids of those not met, by their place in ``keys``."""
        if len(self.known) > self.most:
            self._forget()
        self.turn += 1
        known = self.known
        new = [i for i, k in enumerate(keys) if k not in known]
        if new:
            found = encode(new)
            known.update(zip(map(keys.__getitem__, new), range(len(known), len(known) + len(new))))
            size = np.fromiter(map(len, found), np.int64, len(found))
            flat = np.fromiter(chain.from_iterable(found), np.uint32, int(size.sum()))
            self.first = np.concatenate([self.first, len(self.flat) + np.cumsum(size) - size])
            self.size, self.flat = np.concatenate([self.size, size]), np.concatenate([self.flat, flat])
            self.used = np.concatenate([self.used, np.zeros(len(new), np.int64)])
        at = np.fromiter(map(known.__getitem__, keys), np.int64, len(keys))
        self.used[at] = self.turn
        return at

    def ids(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words at these places, one after the other, and how many each has."""
        return gathered(self.flat, self.first, self.size, at)


def gathered(flat: np.ndarray, first: np.ndarray, size: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of runs of ``flat`` (their beginnings and sizes) the chosen ones, one after the other, and their sizes."""
    many = size[which]
    ends = np.cumsum(many)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(first[which] - (ends - many), many) + np.arange(total)], many


def per_text(many: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Sums of ``many`` (a number a word) for texts of so many words each."""
    ends = np.concatenate([[0], np.cumsum(many)])[np.concatenate([[0], np.cumsum(words)])]
    return np.diff(ends)
