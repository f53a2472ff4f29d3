"""Self-BLEU without pairs: each document against all others of its group, in a fixed number of aggregations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from textloom.functions.text import word_tokens
from textloom.session import materialise

ORDERS, EPSILON = 4, 0.1
#: Words whose n-grams one task holds at once, parts that a group is divided into at most, and words that are rolled at once.
PART_WORDS, MOST_PARTS, SLICE_WORDS = 3_000_000, 24, 1 << 17
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """(group hash, key, word hashes) in slices of about SLICE_WORDS words, whole documents each, with their lengths."""
    lengths = batch.column(2).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.flatnonzero(np.diff((np.cumsum(lengths) - lengths) // SLICE_WORDS, prepend=-1))
    for a, b in zip(starts, np.append(starts[1:], len(lengths))):
        yield batch.slice(a, b - a), lengths[a:b]


def _grams(h: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hash and document of each n-gram, order by order; the hashes roll from one order to the next."""
    ends, owner, rolled = np.cumsum(lengths), np.repeat(np.arange(len(lengths), dtype=np.int32), lengths), h
    for n in range(min(ORDERS, len(h))):
        if n:
            rolled = rolled[:-1] * _STEP + h[n:]
        inside = np.arange(len(rolled)) + n < ends[owner[: len(rolled)]]
        mixed = (rolled ^ (rolled >> np.uint64(31))) * _MIX
        yield (mixed ^ (mixed >> np.uint64(29)))[inside], owner[: len(rolled)][inside]


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(group hash, key, word hashes) to (group hash, key, length, g, c): every n-gram of a document with its count.

    The two lowest bits of g are the order less one.
    """
    for batch in batches:
        for part, lengths in _slices(batch):
            of_order = list(_grams(part.column(2).flatten().to_numpy(zero_copy_only=False).view(np.uint64), lengths))
            if not of_order:
                continue
            g = np.concatenate([g & ~np.uint64(3) | np.uint64(n) for n, (g, _) in enumerate(of_order)])
            doc = np.concatenate([doc for _, doc in of_order])
            order = np.lexsort((g, doc))
            g, doc = g[order], doc[order]
            first = np.flatnonzero(np.append(True, (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])))
            rows = doc[first]
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(rows)), part.column(1).take(pa.array(rows)), pa.array(lengths[rows]), pa.array(g[first].view(np.int64)), pa.array(np.diff(np.append(first, len(g))))],
                names=["_b", "_key", "_len", "_g", "_c"],
            )


def _hits(g: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """Clipped matches of each document with the others; n-grams are given in the order of documents."""
    order = np.argsort(g, kind="stable")
    g, doc = g[order], doc[order]
    del order
    gram = np.append(True, g[1:] != g[:-1])
    first = np.flatnonzero(gram | np.append(True, doc[1:] != doc[:-1]))
    c, doc, gram = np.diff(np.append(first, len(g))), doc[first], gram[first]
    at = np.flatnonzero(gram)
    size = np.diff(np.append(at, len(gram)))
    shared = np.repeat(size > 1, size)  # an n-gram of one document alone matches nothing
    c, doc, size = c[shared], doc[shared], size[size > 1]
    if not len(c):
        return np.zeros(docs, np.int64)
    at = np.cumsum(size) - size
    largest = np.repeat(np.maximum.reduceat(c, at), size)
    top = c == largest
    second = np.maximum.reduceat(np.where(top, 0, c), at)
    alone = top & np.repeat(np.add.reduceat(top.astype(np.int64), at) == 1, size)
    return np.bincount(doc, np.where(alone, np.minimum(c, np.repeat(second, size)), c), docs).astype(np.int64)


def _part_hits(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole groups to (group hash, key, length, hits by order), from the n-grams that fall into the part."""
    _, parts, part = (k.as_py() for k in key)
    grams: list[tuple[list, list]] = [([], []) for _ in range(ORDERS)]
    groups, keys, sizes, n_docs = [], [], [], 0
    for batch in batches:
        for own, lengths in _slices(batch.select(["_b", "_key", "_w"])):
            group = own.column(0).to_numpy(zero_copy_only=False)
            h = own.column(2).flatten().to_numpy(zero_copy_only=False).view(np.uint64) ^ np.repeat(group.view(np.uint64) * _STEP, lengths)
            for (gs, docs), (g, doc) in zip(grams, _grams(h, lengths)):
                if parts > 1:
                    mine = g % np.uint64(parts) == part
                    g, doc = g[mine], doc[mine]
                gs.append(g)
                docs.append(doc + np.int32(n_docs))
            groups.append(group.copy())
            keys.append(pa.concat_arrays([own.column(1)]))
            sizes.append(lengths.copy())
            n_docs += len(lengths)
    hits = np.zeros((ORDERS, n_docs), np.int64)
    for n, (gs, docs) in enumerate(grams):
        if gs:
            g, doc = np.concatenate(gs), np.concatenate(docs)
            gs.clear()
            docs.clear()
            hits[n] = _hits(g, doc, n_docs) if len(g) else 0
    found = np.flatnonzero(hits.any(axis=0))
    if len(found):
        own = pa.chunked_array(keys).take(pa.array(found)).combine_chunks()
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(groups)[found]), own if isinstance(own, pa.Array) else own.chunk(0), pa.array(np.concatenate(sizes)[found]), *(pa.array(h[found]) for h in hits)], names=["_b", "_key", "_len", *(f"_h{n}" for n in range(1, ORDERS + 1))])


def self_bleu(df: DataFrame, key: str, text: str, by: str, part_words: int = PART_WORDS, most_parts: int = MOST_PARTS) -> DataFrame:
    """(by, n_docs, self_bleu): the mean 4-gram BLEU of each document of a group against the others; NaN below two.

    The clipped count of an n-gram against all other documents is limited by its largest count elsewhere, which
    follows from the two largest counts in the group. The closest reference length follows from the neighbours in
    the list of lengths. A zero count becomes ``EPSILON`` (smoothing method 1).

    A task takes whole groups of ``part_words`` words together, so that words are shuffled and no n-grams. A larger
    group goes to up to ``most_parts`` tasks, each of which counts the n-grams of its share of the hashes. Groups beyond
    that, or of very many short documents, have their n-grams shuffled as rows. Documents without a key or a group are
    counted in ``n_docs`` and not compared; the mean is null where no two others are left.
    """
    docs = df.where(F.col(text).isNotNull()).select(F.col(by).alias("_by"), F.col(key).alias("_key"), F.col(text).alias("_text"))
    keyed = docs.where("_key is not null and _by is not null").withColumn("_b", F.xxhash64("_by"))
    words = F.transform(word_tokens("_text"), lambda w: F.xxhash64(w)).alias("_w")
    lengths = docs.groupBy("_by", F.size(word_tokens("_text")).cast("long").alias("_len")).agg(F.count("*").alias("_all"), F.count(F.when(F.col("_by").isNotNull(), F.col("_key"))).alias("_same"))
    lengths = materialise(lengths)  # read three times below; a row for each length of a group
    sizes = lengths.groupBy("_by").agg(F.sum("_all").alias("n_docs"), F.sum("_same").alias("_docs"), F.sum((F.col("_len") + 1) * F.col("_same")).alias("_size"))
    # Groups of an eighth of a part or more are placed by name, which are at most eight to every part_words words; smaller ones by hash.
    large = F.col("_size") > part_words // 8
    placed = sizes.where(large).select("_by", F.ceil(F.col("_size") / part_words).alias("_parts"), (F.col("_docs") > part_words // 2).alias("_many"))
    buckets = sizes.where(~large).agg(F.greatest(F.lit(1), F.ceil(F.coalesce(F.sum("_size"), F.lit(0)) / max(1, part_words // 2))).alias("_buckets"))
    beyond = F.expr(f"_parts > {most_parts} or _many")

    inside = keyed.join(F.broadcast(placed), "_by", "left").where(F.coalesce(~beyond, F.lit(True))).crossJoin(F.broadcast(buckets))
    inside = inside.select("_b", "_key", words, F.when(F.col("_parts").isNull(), F.pmod("_b", "_buckets")).otherwise(F.col("_b")).alias("_bucket"), F.coalesce("_parts", F.lit(1)).alias("_parts"))
    inside = inside.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)).alias("_part"))
    found = StructType([StructField("_b", LongType()), keyed.schema["_key"], *(StructField(c, LongType()) for c in ("_len", *(f"_h{n}" for n in range(1, ORDERS + 1))))])
    hits = inside.groupBy("_bucket", "_parts", "_part").applyInArrow(_part_hits, found)

    counts = keyed.join(F.broadcast(placed.where(beyond).select("_by")), "_by").select("_b", "_key", words)
    counts = counts.mapInArrow(_gram_counts, StructType([*found.fields[:3], StructField("_g", LongType()), StructField("_c", LongType())]))
    # The two largest counts of each n-gram: the values that occur, with the number of documents that have the largest.
    values = counts.groupBy("_b", "_g", "_c").agg(F.count("*").alias("_m"))
    top = values.groupBy("_b", "_g").agg(F.max(F.struct("_c", "_m")).alias("_t"), F.array_sort(F.collect_list("_c")).alias("_cs"))
    top = top.select("_b", "_g", F.col("_t._c").alias("_c1"), F.col("_t._m").alias("_m1"), F.coalesce(F.try_element_at("_cs", F.lit(-2)), F.lit(0)).alias("_c2"))
    top = top.where("_m1 > 1 or _c2 > 0")  # an n-gram of one document alone matches nothing
    other = F.when((F.col("_c") < F.col("_c1")) | (F.col("_m1") > 1), F.col("_c1")).otherwise(F.col("_c2"))
    order = F.col("_g").bitwiseAND(3)
    rows = counts.join(top, ["_b", "_g"]).groupBy("_b", "_key", "_len").agg(*(F.coalesce(F.sum(F.when(order == n - 1, F.least("_c", other))), F.lit(0)).alias(f"_h{n}") for n in range(1, ORDERS + 1)))
    hits = hits.unionByName(rows).groupBy("_b", "_key", "_len").agg(*(F.sum(f"_h{n}").alias(f"_h{n}") for n in range(1, ORDERS + 1)))

    w = Window.partitionBy("_by").orderBy("_len")
    refs = lengths.where("_same > 0").withColumn("_below", F.lag("_len").over(w)).withColumn("_above", F.lead("_len").over(w))
    below, above, own = F.col("_below"), F.col("_above"), F.col("_len")
    near = F.when(F.col("_same") > 1, own).when(below.isNull(), above).when(above.isNull(), below).when(own - below <= above - own, below).otherwise(above)
    joined = hits.join(refs.select(F.xxhash64("_by").alias("_b"), "_len", near.alias("_ref")), ["_b", "_len"])
    logs = F.lit(0.0)
    for n in range(1, ORDERS + 1):
        h = F.col(f"_h{n}").cast("double")
        room = F.greatest(F.lit(1), own - n + 1).cast("double")
        logs = logs + F.log(F.when(h > 0, h).otherwise(EPSILON) / room) / ORDERS
    penalty = F.when(own > F.col("_ref"), 1.0).otherwise(F.exp(1.0 - F.col("_ref") / F.greatest(own, F.lit(1))))
    score = F.when(F.col("_h1") == 0, 0.0).otherwise(penalty * F.exp(logs))
    scores = joined.groupBy("_b").agg(F.sum(score).alias("_s"))
    # A document without hits scores 0 and has no row.
    mean = F.when(F.col("n_docs") < 2, float("nan")).when(F.col("_docs") > 1, F.coalesce("_s", F.lit(0.0)) / F.col("_docs"))
    return sizes.withColumn("_b", F.xxhash64("_by")).join(scores, "_b", "left").select(F.col("_by").alias(by), "n_docs", mean.alias("self_bleu"))
