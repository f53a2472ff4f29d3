"""Evaluation texts leaking into training text.

1. *Join.* One pass looks every run of ``SEED`` words of every document up in the table of the items' runs and writes
   the places found, with the words (as numbers) of the documents that have any. The evaluation set is
   small by nature; its size is checked, and up to ``BROADCAST_WORDS`` words the table goes
   to the workers as it is. Beyond that, items go block by block (``leaks_in_blocks``).
2. *Rare seeds.* The places are counted by run over all documents. For each window of ``RUN`` words of an item the run
   with the lowest count is made a seed, so that no leaked window is without one, and common phrases are
   followed only where there is nothing rarer.
3. *Alignment.* Hits of one document and item are chained by diagonal into passages, and each passage is
   aligned with the item by Smith-Waterman (word matches, substitutions and gaps), in which edits split the
   passage but do not end it. The score, the aligned words and the longest unbroken run come out.

A document contains an item if the longest run has ``RUN`` words (``contains``); ``score`` and ``matched`` also
tell edited copies with shorter runs apart, down to ``MIN_SCORE``.

Defined results: null and empty texts are in no pair; items shorter than a seed can't be found; repeated
documents come out each; empty tables give an empty result. Accents are ignored on both sides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import tokens
from textloom.session import materialise

SEED, RUN = 6, 12
#: Largest evaluation set (in words) that is given to the workers whole: 8 bytes a word and as much for seeds.
BROADCAST_WORDS = 4_000_000
#: Characters taken as a word when the size of an evaluation set is told from its characters.
CHARS_A_WORD = 8
MATCH, MISMATCH, GAP = 2, -2, -2
#: Alignments below this score (as of ten matched words) are not reported.
MIN_SCORE = 20
#: Words of context on each side of a passage that the alignment may use.
MARGIN = 24


def _items(items: DataFrame, id_col: str, text_col: str) -> tuple[list, np.ndarray, np.ndarray]:
    rows = items.select(id_col, text_col).where(F.col(text_col).isNotNull()).orderBy(id_col).collect()
    h, at = tokens.hash_texts([r[1] for r in rows], strip_accents=True)
    return [r[0] for r in rows], h, at


def _grams(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All seed-length runs: their hashes and their first word's position in ``h``."""
    sh, starts = tokens.shingles(h, at, SEED)
    room = np.diff(starts)
    first = np.arange(len(sh)) - np.repeat(starts[:-1], room) + np.repeat(at[:-1], room)
    return sh, first


def _filter(values: np.ndarray) -> np.ndarray:
    """A bitmap over the low 20 bits of the given hashes: a cheap first test before the binary search."""
    bits = np.zeros(1 << 20, bool)
    bits[(values & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
    return bits


def _lookup(sh: np.ndarray, table: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Where ``sh`` holds values of the sorted ``table``: positions in ``sh``."""
    maybe = np.flatnonzero(bits[(sh & np.uint64((1 << 20) - 1)).astype(np.int64)])
    at = np.minimum(np.searchsorted(table, sh[maybe]), len(table) - 1)
    return maybe[table[at] == sh[maybe]]


def seed_places(docs: DataFrame, doc_id: str, text_col: str, grams: np.ndarray) -> DataFrame:
    """(doc, run, at, words): of each document with any of the given runs, which ones and where, and all its words as 32-bit numbers."""
    table = np.unique(grams)
    bits = _filter(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, at = tokens.hash_texts(batch.column(1).to_pylist(), strip_accents=True)
            sh, first = _grams(h, at)
            hit = _lookup(sh, table, bits) if len(sh) else np.zeros(0, np.int64)
            doc = np.searchsorted(at, first[hit], side="right") - 1
            kept, start = np.unique(doc, return_index=True)
            ends = np.append(start, len(hit)).astype(np.int32)
            short = _short(h)
            arrays = [
                batch.column(0).take(pa.array(kept, pa.int64())),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(np.searchsorted(table, sh[hit]).astype(np.int32))),
                pa.ListArray.from_arrays(pa.array(ends), pa.array((first[hit] - at[doc]).astype(np.int32))),
                pa.array([short[at[d] : at[d + 1]].tobytes() for d in kept], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc", "run", "at", "words"])

    return docs.select(F.col(doc_id).cast("bigint"), F.col(text_col)).where(F.col(text_col).isNotNull()).mapInArrow(run, "doc bigint, run array<int>, at array<int>, words binary")


def _short(h: np.ndarray) -> np.ndarray:
    """Words as 32-bit numbers, for comparing words of a few texts with each other."""
    return (h >> np.uint64(32)).astype(np.uint32)


def rare_seeds(h: np.ndarray, at: np.ndarray, counts: dict[int, int]) -> np.ndarray:
    """First-word positions of the seeds: in each window of ``RUN`` words the run with the lowest count."""
    sh, first = _grams(h, at)
    n = np.array([counts.get(int(x), 0) for x in sh.view(np.int64)], np.int64)
    chosen: set[int] = set()
    span = RUN - SEED + 1
    owner = np.searchsorted(at, first, side="right") - 1
    for item in np.unique(owner):
        own = np.flatnonzero(owner == item)
        for i in range(max(1, len(own) - span + 1)):
            window = own[i : i + span]
            chosen.add(int(first[window[n[window].argmin()]]))
    return np.array(sorted(chosen), np.int64)


def smith_waterman(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Local alignment of two word sequences: (score, matched words, longest run of matches without edit).

    Computed along antidiagonals, so that a whole antidiagonal is one numpy step. Runs are the diagonal runs of
    equal words, the longest of which an optimal local alignment can always hold.
    """
    n, m = len(a), len(b)
    if not n or not m:
        return 0, 0, 0
    best = np.zeros((3, n + 1), np.int64)  # scores on the last antidiagonals, indexed by position in a
    hits = np.zeros((3, n + 1), np.int64)
    runs = np.zeros((3, n + 1), np.int64)
    top = (0, 0)
    longest = 0
    for d in range(2, n + m + 1):
        lo, hi = max(1, d - m), min(n, d - 1)
        i = np.arange(lo, hi + 1)
        now, last, before = d % 3, (d - 1) % 3, (d - 2) % 3
        best[now], hits[now], runs[now] = 0, 0, 0
        same = a[i - 1] == b[d - i - 1]
        diagonal = best[before, i - 1] + np.where(same, MATCH, MISMATCH)
        up, left = best[last, i - 1] + GAP, best[last, i] + GAP
        value = np.maximum(np.maximum(diagonal, 0), np.maximum(up, left))
        from_diagonal, from_up = value == diagonal, value == up
        count = np.where(from_diagonal, hits[before, i - 1] + same, np.where(from_up, hits[last, i - 1], hits[last, i]))
        best[now, i], hits[now, i] = value, np.where(value > 0, count, 0)
        runs[now, i] = np.where(same, runs[before, i - 1] + 1, 0)
        k = int(value.argmax())
        if (value[k], count[k]) > top:
            top = (int(value[k]), int(count[k]))
        longest = max(longest, int(runs[now, i].max()))
    return top[0], top[1], longest


def _passages(doc_at: np.ndarray, item_at: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Hits of one document and item, chained by diagonal: (document from, to, item from, to), ends excluded."""
    diagonal = doc_at - item_at
    order = np.lexsort((doc_at, diagonal // MARGIN))
    doc_at, item_at, diagonal = doc_at[order], item_at[order], diagonal[order]
    new = np.ones(len(order), bool)
    new[1:] = (diagonal[1:] // MARGIN != diagonal[:-1] // MARGIN) | (doc_at[1:] - doc_at[:-1] > 2 * MARGIN)
    first = np.flatnonzero(new)
    return [(int(doc_at[a]), int(doc_at[b - 1]) + SEED, int(item_at[a:b].min()), int(item_at[a:b].max()) + SEED) for a, b in zip(first, np.append(first[1:], len(order)))]


def _align(doc: np.ndarray, item: np.ndarray, doc_at: np.ndarray, item_at: np.ndarray) -> tuple[int, int, int]:
    found = [(0, 0, 0)]
    for a, b, c, d in _passages(doc_at, item_at):
        before, after = min(c, a, len(item)) + MARGIN, len(item) - d + MARGIN
        found.append(smith_waterman(doc[max(0, a - before) : b + after], item))
    return max(x[0] for x in found), max(found)[1], max(x[2] for x in found)


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, score, matched, longest_run, contains): documents that hold passages of items."""
    size = items.agg(F.sum(F.length(text_col))).first()[0] or 0
    if size > CHARS_A_WORD * BROADCAST_WORDS:
        return leaks_in_blocks(docs, items, doc_id=doc_id, item_id=item_id, text_col=text_col)
    return _leaks(docs, items, doc_id, item_id, text_col)


def _leaks(docs: DataFrame, items: DataFrame, doc_id: str, item_id: str, text_col: str) -> DataFrame:
    """``leaks`` for items that the workers can hold."""
    spark = docs.sparkSession
    ids, h, at = _items(items, item_id, text_col)
    sh, first = _grams(h, at)
    schema = f"{doc_id} bigint, {item_id} bigint, score int, matched int, longest_run int, contains boolean"
    if not len(sh):
        return spark.createDataFrame([], schema)
    table = np.unique(sh)
    found = materialise(seed_places(docs, doc_id, text_col, sh))
    counts = {int(table[r.run].view(np.int64)): r.n for r in found.select(F.explode("run").alias("run")).groupBy("run").agg(F.count("*").alias("n")).collect()}  # at most one row per run of an item
    seeds = np.isin(first, rare_seeds(h, at, counts))
    which = np.searchsorted(table, sh[seeds])
    order = np.argsort(which, kind="stable")
    places = first[seeds][order]
    from_, to = np.searchsorted(which[order], np.arange(len(table)), "left"), np.searchsorted(which[order], np.arange(len(table)), "right")
    items_ = _short(h)
    owner = np.searchsorted(at, places, side="right") - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            runs, spots, docs_, texts = (batch.column(i) for i in range(4))
            for runs_, spots_, doc, words in zip(runs, spots, docs_.to_pylist(), texts):
                gram, spot = runs_.values.to_numpy(), spots_.values.to_numpy().astype(np.int64)
                lo, hi = from_[gram], to[gram]
                if not (hi > lo).any():
                    continue
                own = np.repeat(np.arange(len(gram)), hi - lo)
                place = np.arange(len(own)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)
                by_item = np.argsort(owner[place], kind="stable")
                own, place = own[by_item], place[by_item]
                ends = np.flatnonzero(np.append(np.diff(owner[place]) != 0, True)) + 1
                text = np.frombuffer(words.as_py(), np.uint32)
                for a, b in zip(np.append(0, ends[:-1]), ends):
                    i = owner[place[a]]
                    score, matched, longest = _align(text, items_[at[i] : at[i + 1]], spot[own[a:b]], places[place[a:b]] - at[i])
                    if score >= MIN_SCORE or longest >= RUN:
                        rows.append((doc, ids[i], score, matched, longest, longest >= RUN))
            columns = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_()))], names=[doc_id, item_id, "score", "matched", "longest_run", "contains"])

    return found.select("run", "at", "doc", "words").mapInArrow(run, schema)


def leaks_in_blocks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text", block_chars: int = CHARS_A_WORD * BROADCAST_WORDS) -> DataFrame:
    """``leaks`` for evaluation sets beyond the bound: block after block of items, each about half of it.

    A stated query set against all documents, in blocks: each document is read once for each block.
    """
    size = items.agg(F.sum(F.length(text_col))).first()[0] or 0
    blocks = max(1, -(-2 * size // block_chars))
    out = None
    for b in range(blocks):
        part = _leaks(docs, items.where(F.pmod(F.xxhash64(item_id), F.lit(blocks)) == b), doc_id, item_id, text_col)
        out = part if out is None else out.unionByName(part)
    return out


def leak_report(pairs: DataFrame) -> DataFrame:
    """Per item: documents that contain it, documents with an edited passage only, and the best score."""
    return pairs.groupBy("item_id").agg(F.sum(F.col("contains").cast("bigint")).alias("documents"), F.sum((~F.col("contains")).cast("bigint")).alias("edited_only"), F.max("score").alias("best_score"), F.max("longest_run").alias("longest_run"))
