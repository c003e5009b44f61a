"""Words and hashed word n-grams, for the workers: many texts at once, without a Python step for each word."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

WORD = re.compile(r"[^\W_]+")
PIECE = 1_000_000  # characters that are hashed at once; a longer text is a piece by itself
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPECIAL, _DROPPED, _BLANK = 0xFFFF, 0xFFFE, 0x20
_marks: re.Pattern | None = None
_tables: dict[bool, np.ndarray] = {}
_values: np.ndarray | None = None
_powers: list[np.ndarray] = []


def fold(text: str) -> str:
    """Compatibility decomposition without combining marks."""
    global _marks
    if text.isascii():
        return text
    if _marks is None:  # within the first plane, where the class is a bitmap
        _marks = re.compile("[" + "".join(chr(c) for c in range(0x10000) if unicodedata.category(chr(c))[0] == "M") + "]+")
    text = unicodedata.normalize("NFKD", text)
    if max(text) > "\uffff":
        text = "".join(c for c in text if c <= "\uffff" or unicodedata.category(c)[0] != "M")
    return _marks.sub("", text)


def words(text: str | None) -> list[str]:
    """Longest runs of letters and digits, in lower case."""
    found = WORD.findall(text or "")
    return " ".join(found).lower().split(" ") if found else []


def scramble(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ngram_hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """A hash of every run of n ids, in order; empty if there are fewer."""
    if len(ids) < n:
        return np.zeros(0, np.uint64)
    h = np.zeros(len(ids) - n + 1, np.uint64)
    for k in range(n):
        h = h * _MIX[0] + scramble(ids[k : len(ids) - n + 1 + k] + _MIX[1 + k % 2])
    return scramble(h)


def _table(folded: bool) -> np.ndarray:
    """For each character of the first plane the one it counts as: itself in lower case (without its mark), a blank, nothing,
    or special, if it becomes several or depends on its neighbours."""
    if folded not in _tables:
        out = np.empty(0x10000, np.uint16)
        for c in range(0x10000):
            own = unicodedata.normalize("NFKD", chr(c)) if folded else chr(c)
            own = "".join(x for x in own if not folded or unicodedata.category(x)[0] != "M")
            low = own.lower()
            if 0xD800 <= c < 0xE000 or c in (0x3A3, _SPECIAL, _DROPPED):
                out[c] = _SPECIAL
            elif not own:
                out[c] = _DROPPED
            elif not any(x.isalnum() for x in own):
                out[c] = _BLANK
            else:
                out[c] = ord(low) if len(own) == len(low) == 1 and ord(low) < _DROPPED else _SPECIAL
        _tables[folded] = out
    return _tables[folded]


def _value() -> np.ndarray:
    """A random number for each character that can stand in a word, 0 for the others."""
    global _values
    if _values is None:
        own = np.random.default_rng(13).integers(1, 1 << 64, 0x10000, np.uint64)
        own[[c for c in range(0x10000) if not chr(c).isalnum()]] = 0
        _values = own
    return _values


def _power(size: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse."""
    if not _powers or len(_powers[0]) < size:
        grown = max(size, PIECE + 1)
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(grown - 1, b, np.uint64)])) for b in (_BASE, _INVERSE)]
    return [p[:size] for p in _powers]


def word_id(word: str) -> int:
    """The id of one word in lower case."""
    total = 0
    for k, c in enumerate(word):
        own = int(_value()[ord(c) & 0xFFFF]) or 1
        total += own * pow(_BASE, k, 1 << 64)
    return int(scramble(np.array([total % (1 << 64)], np.uint64))[0])


@dataclass
class Tokens:
    """Word ids of many texts, one after the other; text k has those from start[k] to start[k + 1]."""

    ids: np.ndarray
    start: np.ndarray

    def of(self, k: int) -> np.ndarray:
        return self.ids[self.start[k] : self.start[k + 1]]

    def ngrams(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, text, place in its text) of every run of n words."""
        h = ngram_hashes(self.ids, n)
        text = np.repeat(np.arange(len(self.start) - 1), np.diff(self.start))
        inside = text[: len(h)] == text[n - 1 :] if len(h) else np.zeros(0, bool)
        text = text[: len(h)][inside]
        return h[inside], text, np.nonzero(inside)[0] - self.start[text]


def _piece(texts: list[str], folded: bool) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words, number of words of each text)."""
    codes = np.frombuffer(" ".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    end = np.cumsum([len(t) + 1 for t in texts]) - 1  # where each text ends, without the blank after it
    mapped = _table(folded)[np.minimum(codes, _SPECIAL)]
    special = np.unique(np.searchsorted(end, np.nonzero(mapped == _SPECIAL)[0], "left")).tolist()
    for k in special:
        mapped[end[k] - len(texts[k]) : end[k]] = _BLANK  # read one by one below
    dropped = mapped == _DROPPED
    if dropped.any():
        end = end - np.cumsum(dropped)[np.minimum(end, len(dropped)) - 1] * (end > 0)
        mapped = mapped[~dropped]
    value = _value()[mapped]
    power, inverse = _power(len(value) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value * power[:-1])])
    inside = np.concatenate([[False], value != 0, [False]])
    change = np.nonzero(inside[1:] != inside[:-1])[0]
    first, after = change[::2], change[1::2]
    ids = scramble((total[after] - total[first]) * inverse[first])
    number = np.bincount(np.searchsorted(end, first, "left"), minlength=len(texts)) if len(first) else np.zeros(len(texts), np.int64)
    if special:
        parts, at = [], np.concatenate([[0], np.cumsum(number)])
        for k in range(len(texts)):
            parts.append(ids[at[k] : at[k + 1]])
        for k in special:
            parts[k] = np.array([word_id(w) for w in words(fold(texts[k]) if folded else texts[k])], np.uint64)
        ids, number = np.concatenate(parts), np.array([len(p) for p in parts])
    return ids, number


def tokens(texts: list[str | None], folded: bool = False) -> Tokens:
    """Word ids of the texts (null as empty), the same in every process. With `folded`, as of `fold(text)`."""
    ids, number = [], []
    for piece in _pieces([t or "" for t in texts]):
        own, n = _piece(piece, folded)
        ids.append(own)
        number.append(n)
    if not ids:
        return Tokens(np.zeros(0, np.uint64), np.zeros(1, np.int64))
    return Tokens(np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(number))]).astype(np.int64))


def _pieces(texts: list[str]) -> Iterator[list[str]]:
    own, size = [], 0
    for t in texts:
        if own and size + len(t) > PIECE:
            yield own
            own, size = [], 0
        own.append(t)
        size += len(t)
    if own:
        yield own
