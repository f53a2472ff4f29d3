"""Embeddings by group: centroids, medoids, representatives, clustering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.vectors import unit
from textloom.operators.selection import first_per


def centroids(df: DataFrame, vector: str, *by: str) -> DataFrame:
    """The mean vector of each group, its components averaged in one aggregation over (group, position)."""
    each = df.select(*by, F.posexplode(vector).alias("pos", "x"))
    means = each.groupBy(*by, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("centroid"))


def pooled(df: DataFrame, vector: str, key: str, position: str, max_chunks: int | None = 14) -> DataFrame:
    """The L2-normalised mean of each document's first ``max_chunks`` chunk vectors; of all of them for None."""
    first = df if max_chunks is None else df.where(F.col(position) < max_chunks)
    return centroids(first, vector, key).withColumn("centroid", unit(F.col("centroid")))


def medoids(df: DataFrame, vec_id: str, vector: str, by: str) -> DataFrame:
    """(by, vec_id, mean_distance): the member with the smallest mean cosine distance to all members, itself included.

    The mean distance to all members is one minus the product with the mean of their unit vectors, so no pairs are
    formed: one aggregation for the means, one join back on the group, one minimum.
    """
    units = df.select(by, vec_id, unit(F.col(vector)).alias("u"))
    joined = units.join(centroids(units, "u", by), by)
    dot = F.aggregate(F.zip_with("u", "centroid", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    each = joined.select(by, vec_id, (1.0 - dot).alias("mean_distance"))
    return each.groupBy(by).agg(F.min(F.struct(F.round("mean_distance", 12).alias("_d"), F.col(vec_id), "mean_distance")).alias("m")).select(by, f"m.{vec_id}", "m.mean_distance")


def nearest_to_centroid(df: DataFrame, vec_id: str, vector: str, by: str, centers: DataFrame) -> DataFrame:
    """(by, vec_id, distance): the member nearest to its group's centre in L2; for a centre without members the nearest of all.

    ``centers`` has (by, centroid); their number is a parameter of the clustering.
    """
    distance = F.sqrt(F.aggregate(F.zip_with(vector, "centroid", lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda a, x: a + x))
    smallest = lambda d: d.groupBy(by).agg(F.min(F.struct(F.round("distance", 12).alias("_d"), vec_id, "distance")).alias("m")).select(by, f"m.{vec_id}", "m.distance")
    own = smallest(df.join(centers, by).select(by, vec_id, distance.alias("distance")))
    empty = centers.join(df.select(by).distinct(), by, "left_anti")
    far = smallest(df.select(vec_id, vector).join(F.broadcast(empty)).select(by, vec_id, distance.alias("distance")))
    return own.unionByName(far)


def member_lists(df: DataFrame, by: str, shard: Column, *members: str) -> DataFrame:
    """Cluster documents: number of members and their sorted values, a row per cluster and shard, so that no row grows without bound."""
    return df.groupBy(by, shard.alias("shard")).agg(F.count("*").alias("n_organic"), *(F.array_sort(F.collect_list(m)).alias(f"member_{m}s") for m in members))


def shards_for(rows: int, least: int = 16, limit: int = 1_000_000) -> int:
    """How many shards keep lists of evenly spread members below ``limit``: a power of two, so that shards only ever divide."""
    shards = least
    while rows > shards * limit:
        shards *= 2
    return shards


def small_groups(df: DataFrame, by: str, least: int = 3) -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias("n")).where(F.col("n") < least)


def kmeans(df: DataFrame, vec_id: str, vector: str, k: int, seed: int = 42):
    """(rows with cluster_id, centres): k-means on unit vectors with the engine's own implementation."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    features = df.select(vec_id, vector, array_to_vector(unit(F.col(vector))).alias("features"))
    model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster_id").fit(features)
    centers = df.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "cluster_id int, centroid array<double>")
    return model.transform(features).drop("features"), centers


def representatives(df: DataFrame, by: str, score: str, vec_id: str) -> DataFrame:
    """The lowest scored member of each group."""
    return first_per(df, [by], F.col(score).asc(), F.col(vec_id).asc())
