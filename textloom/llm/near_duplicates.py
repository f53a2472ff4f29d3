"""Near-duplicate records with small edits, by multi-index hashing.

Each text gets a fingerprint of ``SEGMENTS`` x ``WIDTH`` min-hash symbols; two texts of similarity *s* agree in
each symbol with probability *s*, so the Hamming distance of fingerprints (in symbols) measures their
similarity. The fingerprint is cut into segments, one table each. In every segment the Hamming ball of radius 1
around a text's symbols is enumerated as its ``WIDTH`` patterns with one symbol left open (the alphabet of min-hash
symbols is too large to list the ball's members one by one); texts whose balls meet are the table matches. Of
every match the complete distance, over all symbols of both fingerprints, is tested inside the join,
before anything is emitted, and the survivors' exact similarity is computed from their texts.

With 14 segments of 4 symbols a pair of similarity 0.5 is missed by the tables with probability 0.0053,
one of 0.6 with 0.00008; the distance test loses about 2 in 1,000 at 0.5. Fingerprints of bits can't do
this at a similarity of 0.5: the bits of two such texts differ with probability 0.27 (simhash) or 0.25 (one-bit
min-hash), so 16-bit segments within distance 1 occur for 5 % of such pairs; some 100 tables with 17 keys
each would be needed, in which unrelated texts meet once in 4,000 look-ups.

Scale: exact copies are collapsed into classes first (a group of copies, however large, is one row from
there on); keys are spread by hash over the shuffle partitions and hot keys are split by the adaptive
skew join; no bucket is ever gathered into one task; no cap on partners. Texts move once to be collapsed and
once more for the pairs that passed the distance test.

Defined results: null, empty and short texts (fewer than ``min_words`` words) are in no pair; repeated
rows pair with each other (similarity 1); an empty table gives an empty result; columns other than the
named ones are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.vectors import let, present
from textloom.llm import tokens
from textloom.llm.components import connected_components
from textloom.session import materialise

SEGMENTS, WIDTH = 14, 4
#: Bits of each symbol that distances are told by, and 64-bit words that hold them: 56 symbols of 3 bits.
SYMBOL_BITS, PACKED = 3, 3
#: Largest complete distance of a match that is looked at further. Fingerprints of similarity 0.5 differ in
#: 56 * 0.5 * 7/8 = 24.5 symbols on average with a standard deviation of 3.7, those of similarity 0.1 that meet in a table in 42.
MAX_DISTANCE = 34


def segment_keys(symbols: np.ndarray) -> np.ndarray:
    """Keys of the radius-1 balls: for each segment and each left-out symbol a hash of the others."""
    n = len(symbols)
    parts = symbols.reshape(n, SEGMENTS, WIDTH).astype(np.uint64)
    out = np.empty((n, SEGMENTS * WIDTH), np.uint64)
    for segment in range(SEGMENTS):
        for left_out in range(WIDTH):
            value = np.full(n, segment * WIDTH + left_out + 1, np.uint64)
            for i in range(WIDTH):
                if i != left_out:
                    value = tokens.mix(value * np.uint64(0x9E3779B97F4A7C15) + parts[:, segment, i])
            out[:, segment * WIDTH + left_out] = value
    return out.view(np.int64)


def packed_symbols(symbols: np.ndarray, bits: int = SYMBOL_BITS, words: int = PACKED) -> list[np.ndarray]:
    """The low bits of all symbols, packed into 64-bit words."""
    low = (symbols & np.uint32((1 << bits) - 1)).astype(np.uint64)
    each = -(-symbols.shape[1] // words)
    out = []
    for start in range(0, each * words, each):
        value = np.zeros(len(symbols), np.uint64)
        for i in range(start, min(start + each, symbols.shape[1])):
            value |= low[:, i] << np.uint64((i - start) * bits)
        out.append(value.view(np.int64))
    return out


def symbol_distance(left: str, right: str, bits: int = SYMBOL_BITS, words: int = PACKED) -> str:
    """SQL: in how many symbols the packed words v0, v1 … of two rows differ."""
    lowest = sum(1 << bits * i for i in range(64 // bits))
    parts = []
    for i in range(words):
        x = f"({left}.v{i} ^ {right}.v{i})"
        parts.append("bit_count((" + " | ".join([x, *(f"shiftrightunsigned({x}, {b})" for b in range(1, bits))]) + f") & {lowest}L)")
    return "(" + " + ".join(parts) + ")"


def with_class(df: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """(rec, cls, text): the class of a text is the hash of its words; texts of too few words are left out."""
    words = F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    named = let(words, lambda w: F.when(F.size(w) >= min_words, F.xxhash64(w)))
    return df.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("rec"), F.col(text_col).alias("text"), present(named).alias("cls")).select("rec", "cls", "text")


def class_texts(classed: DataFrame) -> DataFrame:
    """(cls, text): one text of each class."""
    return classed.groupBy("cls").agg(F.min("text").alias("text"))


def keyed(texts: DataFrame) -> DataFrame:
    """(k, cls, v0, v1, v2): a row for each table key of each class, with its whole fingerprint."""
    n_keys = SEGMENTS * WIDTH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, at = tokens.hash_texts(batch.column(1).to_pylist())
            sh, starts = tokens.shingles(h, at)
            symbols = tokens.minhashes(sh, starts, n_keys)
            columns = [segment_keys(symbols).ravel(), np.repeat(batch.column(0).to_numpy(), n_keys), *(np.repeat(v, n_keys) for v in packed_symbols(symbols))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["k", "cls", *(f"v{i}" for i in range(PACKED))])

    return texts.mapInArrow(run, "k bigint, cls bigint, " + ", ".join(f"v{i} bigint" for i in range(PACKED)))


def class_pairs(texts: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity), a < b: pairs of different classes whose similarity reaches the threshold."""
    keys = keyed(texts)
    distance = f"{symbol_distance('x', 'y')} <= {MAX_DISTANCE}"
    near = keys.alias("x").join(keys.alias("y"), F.expr(f"x.k = y.k and x.cls < y.cls and {distance}")).select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b")).distinct()
    left, right = texts.select(F.col("cls").alias("a"), F.col("text").alias("ta")), texts.select(F.col("cls").alias("b"), F.col("text").alias("tb"))
    both = near.join(left, "a").join(right, "b").select("a", "b", "ta", "tb")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = []
            for name in ("ta", "tb"):
                sh, at = tokens.shingles(*tokens.hash_texts(batch.column(name).to_pylist()))
                sets.append([np.unique(sh[x:y]) for x, y in zip(at[:-1], at[1:])])
            value = np.array([tokens.jaccard(x, y) for x, y in zip(*sets)], np.float64)
            ok = pa.array(np.flatnonzero(value >= threshold))
            yield pa.RecordBatch.from_arrays([batch.column("a").take(ok), batch.column("b").take(ok), pa.array(value).take(ok)], names=["a", "b", "similarity"])

    return both.mapInArrow(verify, "a bigint, b bigint, similarity double")


def near_duplicate_groups(df: DataFrame, id_col: str, text_col: str, min_words: int = 8, threshold: float = 0.5) -> DataFrame:
    """(rec_id, group_id, links): the group of every row that has a near or exact copy.

    Groups are the connected components of the links between different texts, named by their smallest id; links
    counts the different texts that a row's text is linked to. Exact copies share their class and need no links among them.
    """
    classed = with_class(df, id_col, text_col, min_words)
    pairs = materialise(class_pairs(class_texts(classed), threshold))
    both = pairs.select(F.col("a").alias("cls"), F.col("b").alias("other")).union(pairs.select("b", "a"))
    labels = connected_components(pairs.select("a", "b")).withColumnRenamed("v", "cls").join(both.groupBy("cls").agg(F.count("*").alias("links")), "cls")
    members = classed.select(F.col("rec").alias("rec_id"), "cls")
    copies = members.groupBy("cls").agg(F.count("*").alias("n"))
    found = members.join(copies, "cls").join(labels, "cls", "left").where("n > 1 or links is not null").withColumn("label", F.coalesce("label", "cls"))
    first = found.groupBy("label").agg(F.min("rec_id").alias("group_id"))
    return found.join(first, "label").select("rec_id", "group_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))


def near_duplicate_classes(df: DataFrame, id_col: str, text_col: str, min_words: int = 8, threshold: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): pairs (a, b, similarity), a < b, of linked classes, and the class (rec, cls) of every row.

    Copies are one class and stay so: rows of one class are pairs of similarity 1 that aren't listed.
    """
    classed = with_class(df, id_col, text_col, min_words)
    members = materialise(classed.select("rec", "cls"))
    return class_pairs(class_texts(classed), threshold), members


def near_duplicate_pairs(df: DataFrame, id_col: str, text_col: str, min_words: int = 8, threshold: float = 0.5) -> DataFrame:
    """(rec_id_a, rec_id_b, similarity), rec_id_a < rec_id_b: all pairs of rows that reach the threshold.

    Copies come out expanded into rows; ``near_duplicate_classes`` gives the compact form.
    """
    pairs, members = near_duplicate_classes(df, id_col, text_col, min_words, threshold)
    left, right = members.select(F.col("rec").alias("l"), F.col("cls").alias("a")), members.select(F.col("rec").alias("r"), F.col("cls").alias("b"))
    different = pairs.join(left, "a").join(right, "b").select(F.least("l", "r").alias("rec_id_a"), F.greatest("l", "r").alias("rec_id_b"), "similarity")
    same = members.alias("x").join(members.alias("y"), F.expr("x.cls = y.cls and x.rec < y.rec")).select(F.col("x.rec").alias("rec_id_a"), F.col("y.rec").alias("rec_id_b"), F.lit(1.0).alias("similarity"))
    return different.unionByName(same)
