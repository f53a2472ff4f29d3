"""Same or near-same records across splits, by a full-text index over evaluation shards.

1. Every text becomes a class (the hash of its word sequence), so that copies, however many, count once.
2. Evaluation classes are dealt to shards of about ``SHARD_WORDS`` words. Training classes are routed to the
   shards that can hold a relative of theirs: both sides are joined on 40 keys of three min-hashes, the
   distance of 64 symbols is tested inside the join, and a training class goes to the distinct
   shards of its matches. Without this routing every training text would have to pass every shard, which
   grows with the square of the data. A pair of similarity 0.5 shares no key with probability 0.0048, one of
   0.6 with 0.00006, one of 0.7 with 0.0000001; the distance test loses about 2 in 1,000 at 0.5.
3. In each shard an FM-index is built over its evaluation texts and the routed training texts are streamed
   through backward search. Seeds are joined to maximal matches, the matched spans merged, and their words
   counted per pair of texts. Pairs whose spans cover enough are verified exactly; this loses nothing, see ``MIN_COVER``.

Scale: shards have a bounded number of words; the training side of a shard is salted into parts of bounded
size, each with its own copy of the small index; copies are expanded only in the last join. Texts are
shuffled once per shard that they can match, ids and keys otherwise.

Defined results: null and empty texts, texts under ``min_words`` words, and rows without a split are in no
pair; a record listed with one split only ever counts there; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import tokens
from textloom.llm.fm_index import FMIndex, maximal_matches, merged_spans
from textloom.llm.near_duplicates import packed_symbols, symbol_distance
from textloom.session import materialise

SHARD_WORDS = 120_000
#: Training classes that one part of a shard takes.
PART_TEXTS = 4_000
BANDS, ROWS = 40, 3
#: Symbols that distances are told by, and the largest one: at similarity 0.5 they differ in 64 * 0.5 * 3/4 = 24
#: of 64 on average with a standard deviation of 3.9, unrelated texts in 48.
CHECKS, MAX_DISTANCE = 64, 35
SEED = 6
#: A pair is verified if its merged spans cover this share of the shorter text. Texts of similarity 0.5 share at least
#: two thirds of the shorter one's shingles; runs of fewer than six words hold at most one shingle for every two of
#: their words (and the word that ends them), so at least a third of the shorter text lies in longer ones.
MIN_COVER = 0.2


def split_members(manifest: DataFrame) -> DataFrame:
    """(pair_id, split): one row per pair id that the manifest lists. Ids listed twice count once."""
    listed = manifest.select(F.explode("splits").alias("split", "ids")).select("split", F.explode("ids").alias("pair_id"))
    return listed.where("pair_id is not null").groupBy("pair_id").agg(F.min("split").alias("split"))


def _sketches(df: DataFrame, min_words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, at = tokens.hash_texts(batch.column("text").to_pylist())
            sh, starts = tokens.shingles(h, at)
            keep = np.flatnonzero(np.diff(at) >= min_words)
            symbols = tokens.minhashes(sh, starts, BANDS * ROWS)[keep]
            v0, v1 = packed_symbols(symbols[:, :CHECKS], 2, 2)
            values = symbols.reshape(len(keep), BANDS, ROWS).astype(np.uint64)
            keys = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(keep), 1))
            for i in range(ROWS):
                keys = tokens.mix(keys * np.uint64(0x9E3779B97F4A7C15) + values[:, :, i])
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS), pa.int32()), pa.array(keys.view(np.int64).ravel()))
            ok = pa.array(keep)
            arrays = [batch.column("rec_id").take(ok), batch.column("pair_id").take(ok), batch.column("split").take(ok), batch.column("source").take(ok), pa.array(tokens.sequence_hash(h, at)[keep]), pa.array(np.diff(at)[keep].astype(np.int32)), flat, pa.array(v0), pa.array(v1)]
            yield pa.RecordBatch.from_arrays(arrays, names=["rec_id", "pair_id", "split", "source", "cls", "n_words", "keys", "v0", "v1"])

    return df.mapInArrow(run, "rec_id bigint, pair_id string, split string, source string, cls bigint, n_words int, keys array<bigint>, v0 bigint, v1 bigint")


def _texts(df: DataFrame) -> DataFrame:
    """(cls, toks): the word hashes of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, at = tokens.hash_texts(batch.column("text").to_pylist())
            short = (h >> np.uint64(32)).astype(np.uint32)
            rows = [short[a:b].tobytes() for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("rec_id"), pa.array(tokens.sequence_hash(h, at)), pa.array(rows, pa.binary())], names=["rec_id", "cls", "toks"])

    return df.select("rec_id", "text").where("text is not null").mapInArrow(run, "rec_id bigint, cls bigint, toks binary")


def _unpack(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows = table.column("toks").to_pylist()
    at = np.zeros(len(rows) + 1, np.int64)
    np.cumsum([len(x) // 4 for x in rows], out=at[1:])
    return table.column("cls").to_numpy(), np.frombuffer(b"".join(rows), np.uint32).astype(np.uint64), at


def _search(threshold: float, min_cover: float):
    schema = pa.schema([("t", pa.int64()), ("e", pa.int64()), ("similarity", pa.float64()), ("matched_words", pa.int64()), ("n_spans", pa.int64()), ("longest_match", pa.int64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        e_cls, e_h, e_at = _unpack(left)
        t_cls, t_h, t_at = _unpack(right)
        index = FMIndex(e_h, e_at)
        stream, mine, text, _, length = maximal_matches(index, t_h, t_at, SEED)
        stream, text, words, spans, longest = merged_spans(stream, mine, text, length)
        shorter = np.minimum(np.diff(t_at)[stream], np.diff(e_at)[text])
        ok = words >= min_cover * shorter
        stream, text, words, spans, longest = stream[ok], text[ok], words[ok], spans[ok], longest[ok]
        e_sh, e_s = tokens.shingles(e_h, e_at)
        t_sh, t_s = tokens.shingles(t_h, t_at)
        e_sets = {i: np.unique(e_sh[e_s[i] : e_s[i + 1]]) for i in np.unique(text)}
        value, last, own = np.zeros(len(stream)), -1, None
        for i, (a, b) in enumerate(zip(stream, text)):
            if a != last:
                last, own = a, np.unique(t_sh[t_s[a] : t_s[a + 1]])
            value[i] = tokens.jaccard(own, e_sets[b])
        good = value >= threshold
        columns = [t_cls[stream][good], e_cls[text][good], value[good], words[good], spans[good], longest[good]]
        return pa.Table.from_arrays([pa.array(c) for c in columns], schema=schema)

    return run


def cross_split_classes(records: DataFrame, manifest: DataFrame | None = None, min_words: int = 50, threshold: float = 0.5, train: tuple[str, ...] = ("train",), evaluation: tuple[str, ...] = ("val", "test")) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): the class of every record with a split, and all similar (train, evaluation) classes.

    ``records`` has rec_id, pair_id, text, split, source; rows whose split is null take it from ``manifest``
    by pair_id. members: rec_id, cls, split, source. pairs: t, e, similarity, matched_words, n_spans, longest_match.
    """
    prints = _sketches(records.select("rec_id", "pair_id", "split", "source", "text").where("text is not null"), min_words)
    if manifest is not None:
        listed = split_members(manifest).select(F.col("pair_id").alias("_key"), F.col("split").alias("listed"))
        spread = F.coalesce("pair_id", F.concat(F.lit("\x00"), F.col("rec_id").cast("string")))  # records without a pair id must not meet in one task
        prints = prints.withColumn("_key", spread).join(listed, "_key", "left").withColumn("split", F.coalesce("split", "listed")).drop("listed", "_key")
    prints = materialise(prints.drop("pair_id").where(F.col("split").isin(*train, *evaluation)))
    one = prints.withColumn("side", F.when(F.col("split").isin(*train), "t").otherwise("e")).dropDuplicates(["cls", "side"])
    eval_side, train_side = one.where("side = 'e'"), one.where("side = 't'")
    words = eval_side.agg(F.sum("n_words")).first()[0] or 0
    shards = max(1, -(-words // SHARD_WORDS))
    shard = F.pmod(F.xxhash64(F.lit("shard"), "cls"), F.lit(shards)).cast("int")
    e_keys = eval_side.select(F.explode("keys").alias("k"), shard.alias("shard"), "v0", "v1").alias("x")
    t_keys = train_side.select(F.explode("keys").alias("k"), "cls", "rec_id", "v0", "v1").alias("y")
    near = F.expr(f"x.k = y.k and {symbol_distance('x', 'y', 2, 2)} <= {MAX_DISTANCE}")
    routes = materialise(t_keys.join(e_keys, near).select("y.cls", "y.rec_id", "x.shard").distinct())
    load = routes.groupBy("shard").agg(F.ceil(F.count("*") / PART_TEXTS).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64(F.lit("part"), "cls"), F.col("parts")).cast("int").alias("part")
    t_routes = routes.join(load, "shard").select("rec_id", "shard", part)
    e_routes = eval_side.select("rec_id", shard.alias("shard")).join(load, "shard").select("rec_id", "shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    eval_texts, train_texts = (_texts(records).join(r, "rec_id").select("shard", "part", "cls", "toks") for r in (e_routes, t_routes))
    pairs = eval_texts.groupBy("shard", "part").cogroup(train_texts.groupBy("shard", "part")).applyInArrow(_search(threshold, MIN_COVER), "t bigint, e bigint, similarity double, matched_words bigint, n_spans bigint, longest_match bigint")
    members = prints.select("rec_id", "cls", "split", "source")
    return members, pairs


def cross_split_pairs(records: DataFrame, manifest: DataFrame | None = None, train: tuple[str, ...] = ("train",), **options) -> DataFrame:
    """All pairs of one train and one evaluation record that are the same or nearly the same text."""
    members, pairs = cross_split_classes(records, manifest, train=train, **options)
    t = members.where(F.col("split").isin(*train)).select(F.col("cls").alias("t"), F.col("rec_id").alias("train_id"), F.col("source").alias("train_source"))
    e = members.where(~F.col("split").isin(*train)).select(F.col("cls").alias("e"), F.col("rec_id").alias("eval_id"), F.col("split").alias("eval_split"), F.col("source").alias("eval_source"))
    return pairs.join(t, "t").join(e, "e").select("train_id", "eval_id", "eval_split", "train_source", "eval_source", "similarity", "matched_words", "n_spans", "longest_match")


def overlap_report(pairs: DataFrame) -> DataFrame:
    """Per evaluation split and source: leaked evaluation records, the train records they meet, and pairs."""
    return pairs.groupBy("eval_split", "eval_source").agg(F.countDistinct("eval_id").alias("leaked_records"), F.countDistinct("train_id").alias("train_records"), F.count("*").alias("pairs"), F.sum((F.col("similarity") == 1).cast("bigint")).alias("exact_pairs"))
