"""Joins of the pair log, its split manifest, clusters, topics and passages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators.selection import bucketed_rank, hash_order

#: A side is broadcast on purpose only where it is known to be below this number of rows.
SMALL_ROWS = 100_000
#: Bytes of centroids that go to the workers at once, and cells of one matrix product (8 bytes each).
TABLE_BYTES, PRODUCT_CELLS = 128 << 20, 4 << 20


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows; else Catalyst and AQE choose."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def rows_in_split(pairs: DataFrame, manifest: DataFrame, split: str, key: str = "pair_id") -> DataFrame:
    """Rows whose id the manifest lists under the split (left semi: no row is multiplied)."""
    return pairs.join(manifest.where(F.col("split") == split).select(key), key, "left_semi")


def rows_with_topics(df: DataFrame, topics: DataFrame, topic: str = "topic") -> DataFrame:
    return df.join(topics.select(topic), topic, "left_semi")


def rows_without_topics(df: DataFrame, topics: DataFrame, topic: str = "topic") -> DataFrame:
    """Rows whose topic isn't there yet; null topics are never there."""
    return df.join(topics.select(topic), topic, "left_anti")


def cluster_members(clusters: DataFrame, members: str = "member_pair_ids", cluster: str = "cluster_id") -> DataFrame:
    """(pair_id, cluster_id): of an id in several clusters the last cluster holds."""
    return clusters.select(cluster, F.explode(members).alias("pair_id")).groupBy("pair_id").agg(F.max(cluster).alias(cluster))


def pairs_with_templates(pairs: DataFrame, clusters: DataFrame, template: str = "canonical_template") -> DataFrame:
    """Pairs with the template of their cluster; pairs without a cluster or with a blank template are left out."""
    named = pairs.join(cluster_members(clusters), "pair_id")
    return named.join(clusters.select("cluster_id", template).where(T.strip(F.coalesce(F.col(template), F.lit(""))) != ""), "cluster_id")


def nearest(vectors: DataFrame, centroids: DataFrame, vec_id: str, vector: str, cluster: str = "cluster_id", centroid: str = "centroid") -> DataFrame:
    """(vec_id, cluster_id, similarity): the centroid of largest cosine; of equals the smallest id.

    The centroids, a table whose number is a parameter of the clustering, go to the workers in parts of at most
    ``TABLE_BYTES`` (their number and width are checked first); with more than one part the best of all parts is taken per
    vector. An Arrow batch of vectors is multiplied with a few thousand centroids at a time. Null centroids are left out, and ids
    are those of the table, not positions.
    """
    usable = centroids.where(F.col(centroid).isNotNull()).select(F.col(cluster).cast("bigint").alias("_c"), F.col(centroid).alias("_v"))
    size = usable.agg(F.count("*").alias("n"), F.max(F.size("_v")).alias("width")).first()
    parts = max(1, -(-size.n * 8 * (size.width or 1) // TABLE_BYTES))
    found = None
    for part in range(parts):
        near = _nearest(vectors, usable.where(F.pmod(F.xxhash64("_c"), F.lit(parts)) == part), vec_id, vector, cluster)
        found = near if found is None else found.unionByName(near)
    if parts == 1:
        return found
    best = found.groupBy(vec_id).agg(F.max(F.struct(F.round("similarity", 12).alias("s"), (-F.col(cluster)).alias("c"), "similarity")).alias("m"))
    return best.select(vec_id, (-F.col("m.c")).alias(cluster), "m.similarity")


def _nearest(vectors: DataFrame, centroids: DataFrame, vec_id: str, vector: str, cluster: str) -> DataFrame:
    """``nearest`` among centroids (_c, _v) that the workers can hold."""
    import numpy as np
    import pyarrow as pa

    rows = centroids.orderBy("_c").collect()
    ids = np.array([r[0] for r in rows], np.int64)
    table = np.array([r[1] for r in rows], np.float64)
    unit = table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-300) if len(rows) else table
    shared = vectors.sparkSession.sparkContext.broadcast((ids, unit))

    def run(batches):
        ids, unit = shared.value
        for batch in batches:
            if not len(ids) or not batch.num_rows:
                continue
            v = np.array(batch.column(1).to_pylist(), np.float64)
            v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
            top, best = np.full(len(v), -np.inf), np.zeros(len(v), np.int64)
            step = max(1, PRODUCT_CELLS // len(v))
            for a in range(0, len(ids), step):
                sims = v @ unit[a : a + step].T
                own = np.argmax(np.round(sims, 12), axis=1)
                value = sims[np.arange(len(own)), own]
                better = np.round(value, 12) > np.round(top, 12)
                top[better], best[better] = value[better], own[better] + a
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids[best]), pa.array(top)], names=[vec_id, cluster, "similarity"])

    return vectors.where(F.col(vector).isNotNull()).select(F.col(vec_id).cast("bigint").alias(vec_id), vector).mapInArrow(run, f"{vec_id} bigint, {cluster} bigint, similarity double")


def assigned_templates(near: DataFrame, clusters: DataFrame, template: str = "canonical_template", at_least: float = 0.6) -> DataFrame:
    """Rows with the template of their nearest cluster; too distant ones and blank templates are left out."""
    return near.where(F.col("similarity") >= at_least).join(clusters.select("cluster_id", template).where(T.strip(F.coalesce(F.col(template), F.lit(""))) != ""), "cluster_id")


def with_passages(df: DataFrame, passages: DataFrame, fallback: str | None, topic: str = "topic", passage: str = "source_passage") -> DataFrame:
    """``df`` with the passage of its topic, else the fallback; an error for rows with neither."""
    joined = df.join(passages.select(topic, F.col(passage).alias("_p")), topic, "left")
    last = F.lit(fallback) if fallback is not None else F.raise_error(F.concat(F.lit("no passage for topic "), F.coalesce(F.col(topic), F.lit("null")))).cast("string")
    return joined.withColumn(passage, F.coalesce("_p", last)).drop("_p")


def cross_topics(pairs: DataFrame, topics: DataFrame, per_pair: int = 10, seed: int = 42, topic: str = "topic") -> DataFrame:
    """New (pair, topic) rows: each pair gets up to ``per_pair`` topics, no topic twice within a cluster.

    Pairs are ranked within their cluster and topics by hash; pair number r takes the topics of ranks
    (r-1)*k+1 .. r*k, the hand-out of a sequential loop in closed form. Pair ids are hexadecimal hashes, so both
    numberings are made in buckets; the join is on a block number.
    """
    ranked = bucketed_rank(topics.select(F.col(topic).alias("new_topic")).distinct().withColumn("_o", hash_order(seed, "new_topic")), "_o").select("new_topic", F.ceil(F.col("rank") / per_pair).cast("bigint").alias("block"))
    numbered = bucketed_rank(pairs, "pair_id", "cluster_id").withColumnRenamed("rank", "block").drop("n_all")
    return numbered.join(ranked, "block").drop("block")


def fill_from(df: DataFrame, other: DataFrame, key: str, *columns: str) -> DataFrame:
    """Missing values of the columns taken from the other table by key."""
    theirs = other.select(key, *(F.col(c).alias(f"_{c}") for c in columns))
    joined = df.join(theirs, key, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.col(f"_{c}")) for c in columns}).drop(*(f"_{c}" for c in columns))


def with_parent(df: DataFrame, key: str = "prompt_id", parent: str = "parent_id", *columns: str) -> DataFrame:
    """Each row with columns of the row it descends from, null for roots."""
    theirs = df.select(F.col(key).alias("_pk"), *(F.col(c).alias(f"parent_{c}") for c in columns))
    return df.join(theirs, F.col(parent) == F.col("_pk"), "left").drop("_pk")


def mixed_training(organic: DataFrame, manifest: DataFrame, *synthetic: DataFrame) -> DataFrame:
    """Organic pairs of the training split and all synthetic pairs."""
    out = rows_in_split(organic, manifest, "train")
    for s in synthetic:
        out = out.unionByName(s, allowMissingColumns=True)
    return out
