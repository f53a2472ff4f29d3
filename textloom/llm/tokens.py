"""Vectorised word and shingle kernels, run on Arrow batches inside Python workers.

A *word* is a maximal run of letters and digits, lower-cased. A *shingle* is a run of consecutive words
(three unless a caller says otherwise). Words are hashed to 64 bits once per worker through a
dictionary; everything after that is numpy over the concatenated words of a whole batch.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import xxhash

WORD = re.compile(r"[^\W_]+")
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
#: A worker forgets its word hashes beyond this many words, so that its memory stays bounded.
VOCABULARY_LIMIT = 1_000_000


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > VOCABULARY_LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


_HASHES = _Hashes()


def words(text: str) -> list[str]:
    """The words of a text, in order."""
    return WORD.findall(text.lower())


def plain(text: str) -> str:
    """The text without accents: decomposed, combining marks removed."""
    if text.isascii():
        return text
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def hashed(word_list: list[str]) -> np.ndarray:
    """64-bit hashes of words."""
    return np.fromiter(map(_HASHES.__getitem__, word_list), np.uint64, len(word_list))


def hash_texts(texts: list[str | None], strip_accents: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts end to end, and where each text starts (one more offset than texts)."""
    lists = [words(plain(t) if strip_accents else t) if t else [] for t in texts]
    offsets = np.zeros(len(lists) + 1, np.int64)
    np.cumsum([len(x) for x in lists], out=offsets[1:])
    flat: list[str] = [w for x in lists for w in x]
    return hashed(flat), offsets


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every bit depends on every bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX
    return x ^ (x >> np.uint64(29))


def shingles(h: np.ndarray, offsets: np.ndarray, k: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words inside one text, with offsets like those of the words."""
    n = len(h) - k + 1
    counts = np.maximum(np.diff(offsets) - k + 1, 0)
    starts = np.zeros(len(offsets), np.int64)
    np.cumsum(counts, out=starts[1:])
    if n <= 0 or starts[-1] == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    value = h[:n].copy()
    for i in range(1, k):
        value = value * _ODD + h[i : i + n]
    inside = np.ones(len(h) + 1, bool)
    for i in range(k - 1):  # the last k-1 words of each text start no shingle
        at = offsets[1:] - 1 - i
        inside[at[at >= offsets[:-1]]] = False
    return mix(value[inside[:n]]), starts


def sequence_hash(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One signed 64-bit hash for the whole word sequence of each text."""
    out = [xxhash.xxh64_intdigest(h[a:b].tobytes(), 7) for a, b in zip(offsets[:-1], offsets[1:])]
    return np.array(out, np.uint64).view(np.int64)


def permutations(count: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and addends of ``count`` hash functions, the same in every process."""
    state = np.array([xxhash.xxh64_intdigest(f"{seed}:{i}") for i in range(2 * count)], np.uint64)
    return state[:count] | np.uint64(1), state[count:]


def minhashes(sh: np.ndarray, starts: np.ndarray, count: int, seed: int = 1) -> np.ndarray:
    """``count`` min-hashes (32 bits) of each text's shingles; a text without shingles gets the largest."""
    n = len(starts) - 1
    out = np.full((n, count), 0xFFFFFFFF, np.uint32)
    filled = np.flatnonzero(np.diff(starts) > 0)
    if not len(filled):
        return out
    a, b = permutations(count, seed)
    at = starts[:-1][filled]
    for i in range(count):
        value = ((sh * a[i] + b[i]) >> np.uint64(32)).astype(np.uint32)
        out[filled, i] = np.minimum.reduceat(value, at)
    return out


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sorted arrays of distinct shingle hashes."""
    if not len(a) or not len(b):
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)
