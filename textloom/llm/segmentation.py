"""Splitting oversized items at natural boundaries, by lexical cohesion.

A text over the limit is cut into sentences; at each sentence end the words of a block of sentences before
and after are compared (cosine of word counts). Valleys of this similarity mark changes of topic; their
depth is measured against the peaks on both sides. Within the window of sizes that a piece may have, the
deepest valley becomes the cut, paragraph ends being favoured. Without a sentence end in the window the cut
falls on a word end, and inside a word only where the window holds no blank at all. The next piece starts
``overlap`` characters before the cut, or slightly fewer so as to start a sentence or a word.

All work is on single texts in Arrow batches: no shuffle. Only texts over the limit reach Python.

Defined results: null texts and texts within the limit give no piece; the pieces of a text, without the
overlaps, give the text back exactly; repeated rows come out each; an empty table gives an empty result.
Sizes are in Unicode code points.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.tokens import words

LIMIT, OVERLAP = 6000, 200
#: Share of the limit that a piece has at least where a boundary allows it, and sentences in a block.
LEAST, BLOCK = 0.5, 8
#: Added to the depth of a valley at the end of a paragraph.
PARAGRAPH = 0.35
#: How much shorter than asked an overlap may be to start a sentence; to start a word it may be shorter by one word.
SHORTER = 80
_SENTENCE = re.compile(r"(?:[.!?…。！？]+[\"'”’»)\]]*(?=\s)|\n)\s*")


def boundaries(text: str) -> list[tuple[int, bool]]:
    """Ends of sentences (after the blanks that follow) and whether a paragraph ends there."""
    return [(m.end(), "\n\n" in m.group() or "\r\n\r\n" in m.group()) for m in _SENTENCE.finditer(text) if 0 < m.end() < len(text)]


def _rises(similarity: list[float]) -> list[float]:
    """For each place the highest similarity that is reached to its left without going below any place on the way down from it.

    That is the end of the run of values that never fall, read from the place: one pass.
    """
    out: list[float] = []
    for i, s in enumerate(similarity):
        out.append(out[-1] if i and similarity[i - 1] >= s else s)
    return out


def depths(text: str, ends: list[int]) -> np.ndarray:
    """How deep the valley of block similarity is at each boundary.

    The blocks roll: a sentence enters the right block, passes to the left one and leaves it, and the product and
    the norms of both are kept up to date by its words, so the work is in proportion to the text.
    """
    edges = [0, *ends, len(text)]
    bags = [Counter(words(text[a:b])) for a, b in zip(edges, edges[1:])]
    n = len(ends)
    left, right = Counter(), Counter()
    dot = left_norm = right_norm = 0
    similarity = [0.0] * n

    def move(bag: Counter, side: Counter, other: Counter, sign: int) -> tuple[int, int]:
        """Change of the product and of the side's squared norm when a bag enters or leaves it."""
        product = norm = 0
        for w, c in bag.items():
            before = side[w]
            product += sign * c * other[w]
            norm += 2 * sign * c * before + c * c
            if before + sign * c:
                side[w] = before + sign * c
            else:
                del side[w]
        return product, norm

    for bag in bags[:BLOCK]:
        right_norm += move(bag, right, left, 1)[1]
    for i in range(n):
        for bag, side, other, sign in ((bags[i], right, left, -1), (bags[i], left, right, 1), *(((bags[i + BLOCK], right, left, 1),) if i + BLOCK < len(bags) else ()), *(((bags[i - BLOCK], left, right, -1),) if i >= BLOCK else ())):
            product, norm = move(bag, side, other, sign)
            dot += product
            if side is left:
                left_norm += norm
            else:
                right_norm += norm
        norm = (left_norm * right_norm) ** 0.5
        similarity[i] = dot / norm if norm else 0.0
    up = np.array(_rises(similarity)) + np.array(_rises(similarity[::-1])[::-1])
    return up - 2 * np.array(similarity)


def _word_end(text: str, lo: int, hi: int) -> int | None:
    """The last place in (lo, hi] where a word starts after blanks."""
    for i in range(hi, lo, -1):
        if text[i - 1].isspace() and (i == len(text) or not text[i].isspace()):
            return i
    return None


def _start(text: str, ends: list[int], begin: int, cut: int, overlap: int) -> int:
    """Where the piece after a cut starts: a sentence or word start at most ``overlap`` before the cut."""
    lo = max(begin + 1, cut - overlap)
    first = bisect_left(ends, lo)
    if first < len(ends) and ends[first] <= min(lo + SHORTER, cut):
        return ends[first]
    for i in range(lo, min(lo + SHORTER, cut)):
        if text[i - 1].isspace() and not text[i].isspace():
            return i
    return lo


def pieces(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of the pieces of a text, in order."""
    if overlap * 2 >= limit:
        raise ValueError("the overlap has to be less than half of the limit")
    if len(text) <= limit:
        return [(0, len(text))]
    found = boundaries(text)
    ends = [e for e, _ in found]
    depth = depths(text, ends) + np.array([PARAGRAPH * p for _, p in found])
    at = np.array(ends, np.int64)
    out, begin = [], 0
    while len(text) - begin > limit:
        least = begin + max(int(limit * LEAST), overlap + 1)
        a, b = np.searchsorted(at, least), np.searchsorted(at, begin + limit, side="right")
        if a < b:
            cut = ends[a + int(depth[a:b].argmax())]
        else:
            a = np.searchsorted(at, begin + overlap + 1)
            cut = ends[b - 1] if a < b else _word_end(text, begin + overlap, begin + limit) or begin + limit
        out.append((begin, cut))
        begin = _start(text, ends, begin, cut, overlap)
    out.append((begin, len(text)))
    return out


def split_oversized(df: DataFrame, id_col: str, text_col: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(rec_id, piece, start, end, text): the pieces of all texts over the limit, numbered from 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, numbers, starts, stops, texts = [], [], [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for k, (a, b) in enumerate(pieces(text, limit, overlap)):
                    ids.append(i), numbers.append(k), starts.append(a), stops.append(b), texts.append(text[a:b])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(numbers, pa.int32()), pa.array(starts, pa.int32()), pa.array(stops, pa.int32()), pa.array(texts, pa.string())], names=["rec_id", "piece", "start", "end", "text"])

    long = df.select(F.col(id_col).cast("bigint").alias("rec_id"), F.col(text_col).alias("text")).where(F.length("text") > limit)
    return long.mapInArrow(run, "rec_id bigint, piece int, start int, end int, text string")
