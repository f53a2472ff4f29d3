"""Sliding windows over long documents, fixed character chunks, and the scores of windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def window_starts(n: Column, window: int, stride: int, max_chunks: int | None = None) -> Column:
    """The starts of the windows over ``n`` tokens: one if they fit, else stride by stride until the end is reached."""
    if stride <= 0:
        raise ValueError("the stride has to be positive")
    last = F.when(n <= window, 0).otherwise(F.ceil((n - window) / stride) * stride).cast("int")
    starts = F.filter(F.sequence(F.lit(0), last, F.lit(stride)), lambda s: (s == 0) | (s < n))
    return F.slice(starts, 1, max_chunks) if max_chunks else starts


def token_windows(df: DataFrame, key: str, tokens: Column, window: int = 512, stride: int = 256, max_chunks: int | None = None) -> DataFrame:
    """(key, chunk, start, tokens): a row for each window of each document. No shuffle."""
    base = df.select(F.col(key), tokens.alias("_t"))
    chunks = base.select(key, "_t", F.posexplode(window_starts(F.size("_t"), window, stride, max_chunks)).alias("chunk", "start"))
    return chunks.select(key, "chunk", "start", F.slice("_t", F.col("start") + 1, F.lit(window)).alias("tokens"))


def char_chunks(df: DataFrame, key: str, text: str, size: int, max_chunks: int | None = None) -> DataFrame:
    """(key, chunk, text): consecutive pieces of ``size`` characters; a null or empty text has none."""
    n = F.ceil(F.length(text) / size).cast("int")
    n = F.least(n, F.lit(max_chunks)) if max_chunks else n
    base = df.where(F.length(text) > 0).select(key, F.col(text).alias("_t"), F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk"))
    return base.select(key, "chunk", F.expr(f"substring(_t, chunk * {size} + 1, {size})").alias("text"))


def chunk_scores(chunks: DataFrame, key: str, score: str) -> DataFrame:
    """(key, mean, max, n_chunks) of the window scores."""
    return chunks.groupBy(key).agg(F.avg(score).alias("mean"), F.max(score).alias("max"), F.count("*").alias("n_chunks"))


def weighted(mean: Column, top: Column, w_mean: float = 0.5, w_max: float = 0.5) -> Column:
    """(wm * mean + wx * max) / (wm + wx); the mean where the weights add up to nothing."""
    total = w_mean + w_max
    return (F.lit(w_mean) * mean + F.lit(w_max) * top) / F.lit(total) if total > 0 else mean


def aggregate_score(mean: Column, top: Column, how: str = "weighted", w_mean: float = 0.5, w_max: float = 0.5) -> Column:
    if how == "mean":
        return mean
    if how == "max":
        return top
    if how == "weighted":
        return weighted(mean, top, w_mean, w_max)
    raise ValueError(f"unknown aggregate {how}")


def distinct_ratio(tokens: Column) -> Column:
    """A deterministic stand-in for a model's score of a window: distinct words over words. 0 for none."""
    return F.coalesce(F.try_divide(F.size(F.array_distinct(tokens)).cast("double"), F.size(tokens).cast("double")), F.lit(0.0))
