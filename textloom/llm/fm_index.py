"""A compressed full-text index (FM-index) over word sequences, with vectorised backward search.

The indexed texts are laid end to end, each followed by a separator, and their suffixes sorted by prefix
doubling. Kept are the Burrows-Wheeler transform, as its symbols and as the list of each symbol's positions (one
narrow integer each, the lists end to end), and every ``SAMPLED``-th place of the suffix array. A backward
step asks for the rank of a symbol, which a binary search within its list answers for many patterns at once; matches
are located by walking backwards to the next sampled place. Symbols are word hashes replaced by their rank within the
shard. This takes some nine bytes a word: 4 for the transform, 4 for the lists, and 1 for the sample.
"""

from __future__ import annotations

import numpy as np

#: Places of the texts whose suffix array entries are kept: every so many words.
SAMPLED = 8


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffix array of a sequence of non-negative integers, by prefix doubling."""
    n = len(symbols)
    _, rank = np.unique(symbols, return_inverse=True)
    rank = rank.astype(np.int64)
    width = 1
    while True:
        second = np.zeros(n, np.int64)
        second[: n - width] = rank[width:] + 1 if width < n else 0
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.zeros(n, np.int64)
        new[1:] = np.cumsum(ordered[1:] != ordered[:-1])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if n == 0 or new[-1] == n - 1:
            return order
        width *= 2


class FMIndex:
    """Index over several word sequences given end to end with their offsets."""

    def __init__(self, h: np.ndarray, offsets: np.ndarray):
        texts = len(offsets) - 1
        lengths = np.diff(offsets)
        self.alphabet, codes = np.unique(h, return_inverse=True)
        starts = offsets[:-1] + np.arange(texts)
        body = np.zeros(len(h) + texts, np.int64)
        where = np.arange(len(h)) + np.repeat(np.arange(texts), lengths)
        body[where] = codes + texts + 1  # symbols 1..texts are the separators, each of its own
        ends = starts + lengths
        body[ends] = np.arange(texts) + 1
        self.body_starts, self.texts, self.n = starts, texts, len(body)
        sa = suffix_array(body)
        self.bwt = body[sa - 1].astype(np.uint32)
        self.places = np.argsort(self.bwt, kind="stable").astype(np.uint32)  # the positions of each symbol, symbol after symbol
        self.first = np.searchsorted(self.bwt[self.places], np.arange(texts + len(self.alphabet) + 2)).astype(np.int64)  # where each list starts: also the symbols smaller than it
        kept = sa % SAMPLED == 0
        self.kept = np.packbits(np.append(kept, np.zeros(-len(kept) % 64, bool)), bitorder="little").view(np.uint64)
        self.kept_before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.kept), dtype=np.int64))).astype(np.uint32)
        self.sample = sa[kept].astype(np.uint32)

    def encode(self, h: np.ndarray) -> np.ndarray:
        """Symbols of words; 0 for words that the index does not hold."""
        if not len(self.alphabet):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.alphabet, h), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == h, at + self.texts + 1, 0)

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs in the transform before a position: a binary search within its list, for all at once."""
        lo, size = self.first[symbols], self.first[symbols + 1]
        size -= lo
        out = lo.copy()
        live = np.flatnonzero(size)
        lo, size, at = lo[live], size[live], at[live]
        while len(live):  # the first place of [lo, lo + size] that is not before ``at``
            half = size >> 1
            less = self.places[lo + half] < at
            lo += np.where(less, half + 1, 0)
            size = np.where(less, size - half - 1, half)
            done = size == 0
            if done.any():
                out[live[done]] = lo[done]
                go = ~done
                live, lo, size, at = live[go], lo[go], size[go], at[go]
        return out - self.first[symbols]

    def step(self, symbols: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One backward step: intervals of the patterns with a symbol put in front."""
        base = self.first[symbols]
        ranks = self.rank(np.concatenate((symbols, symbols)), np.concatenate((lo, hi)))
        return base + ranks[: len(lo)], base + ranks[len(lo) :]

    def seeds(self, h: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All windows of ``length`` words that occur in the index: (start in h, interval lo, hi)."""
        symbols = self.encode(h)
        room = np.maximum(np.diff(offsets) - length + 1, 0)
        total = int(room.sum())
        before = np.cumsum(room) - room
        start = np.arange(total) - np.repeat(before, room) + np.repeat(offsets[:-1], room)
        lo, hi = np.zeros(total, np.int64), np.full(total, self.n, np.int64)
        for back in range(length - 1, -1, -1):
            c = symbols[start + back]
            lo, hi = self.step(c, lo, hi)
            alive = (hi > lo) & (c > 0)
            start, lo, hi = start[alive], lo[alive], hi[alive]
        return start, lo, hi

    def _texts_at(self, rows: np.ndarray) -> np.ndarray:
        """Suffix array entries: steps back through the text until a sampled one, and as many forward."""
        out = np.empty(len(rows), np.int64)
        left, at, steps = np.arange(len(rows)), rows.astype(np.int64), 0
        while len(left):
            word, bit = self.kept[at >> 6], (at & 63).astype(np.uint64)
            there = (word >> bit) & np.uint64(1) == 1
            before = np.bitwise_count(word[there] & ((np.uint64(1) << bit[there]) - np.uint64(1)))
            out[left[there]] = self.sample[self.kept_before[at[there] >> 6] + before].astype(np.int64) + steps
            left, at = left[~there], at[~there]
            symbols = self.bwt[at].astype(np.int64)
            at, steps = self.first[symbols] + self.rank(symbols, at), steps + 1
        return out

    def locate(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All occurrences of intervals: (which interval, text, word position within the text)."""
        width = hi - lo
        which = np.repeat(np.arange(len(lo)), width)
        before = np.cumsum(width) - width
        place = self._texts_at(np.arange(len(which)) - np.repeat(before, width) + np.repeat(lo, width))
        text = np.searchsorted(self.body_starts, place, side="right") - 1
        return which, text, place - self.body_starts[text]


def maximal_matches(index: FMIndex, h: np.ndarray, offsets: np.ndarray, seed: int) -> tuple[np.ndarray, ...]:
    """Maximal exact matches of at least ``seed`` words between streamed texts and indexed texts.

    Returns arrays (streamed text, its start, indexed text, its start, length). Seeds on one diagonal that
    follow each other by one word are parts of one match; a run of them is that match, which neither end
    can extend.
    """
    start, lo, hi = index.seeds(h, offsets, seed)
    which, text, place = index.locate(lo, hi)
    start = start[which]
    stream = np.searchsorted(offsets, start, side="right") - 1
    mine = start - offsets[stream]
    diagonal = place - mine
    order = np.lexsort((mine, diagonal, text, stream))
    stream, text, mine, place, diagonal = stream[order], text[order], mine[order], place[order], diagonal[order]
    if not len(stream):
        return stream, mine, text, place, mine
    new = np.ones(len(stream), bool)
    new[1:] = (stream[1:] != stream[:-1]) | (text[1:] != text[:-1]) | (diagonal[1:] != diagonal[:-1]) | (mine[1:] != mine[:-1] + 1)
    first = np.flatnonzero(new)
    run = np.diff(np.append(first, len(stream)))
    return stream[first], mine[first], text[first], place[first], run + seed - 1


def merged_spans(stream: np.ndarray, mine: np.ndarray, text: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, ...]:
    """Spans of the streamed text merged per (streamed, indexed): (stream, text, words covered, spans, longest)."""
    order = np.lexsort((mine, text, stream))
    stream, mine, text, length = stream[order], mine[order], text[order], length[order]
    if not len(stream):
        return stream, text, length, length, length
    pair = np.ones(len(stream), bool)
    pair[1:] = (stream[1:] != stream[:-1]) | (text[1:] != text[:-1])
    group = np.cumsum(pair) - 1
    shift = group * (int(mine.max() + length.max()) + 1)  # keeps the running maximum inside a pair
    reach = np.maximum.accumulate(mine + length + shift)
    before = np.where(pair, 0, np.concatenate(([0], reach[:-1] - shift[1:])))
    added = np.maximum(mine + length - np.maximum(mine, before), 0)
    added = np.where(pair, length, added)
    first = np.flatnonzero(pair)
    gap = pair | (mine > before)
    return stream[first], text[first], np.add.reduceat(added, first), np.add.reduceat(gap.astype(np.int64), first), np.maximum.reduceat(length, first)
