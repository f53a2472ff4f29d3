"""Filling fixed-capacity containers with documents: vector best-fit.

Every container has three capacities: tokens, documents, and attention cost (the sum of squared lengths, which
is what attention within documents costs). The default attention capacity, the square of the token capacity, is
slack: lengths that add up to the token capacity never have squares that add up to more. A lower one binds. Documents are placed in decreasing length; among the open containers
in which all three residuals suffice, the one is chosen whose residual vector after placement has the smallest
weighted norm (each residual as a share of its capacity). Documents over the token capacity, or alone over the
attention capacity, are cut into pieces as large as both allow and a rest, which is placed like any other; no
other document is divided.

Scale: token counts are taken in one pass without a shuffle. Items are dealt by hash into groups of about
``GROUP`` items, each packed by itself in one task of bounded size, so a group wastes less than one container
in several hundred. A hot source makes no difference, since groups are by item.

Defined results: null and empty texts have no tokens and share containers; repeated rows are items of their own;
an empty table gives an empty result. The tokenizer's path is a parameter, its file is read by each worker.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.session import materialise, partitions

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the byte-level vocabulary above cuts a text before merging (the pattern published with it).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CAPACITY, MAX_DOCUMENTS = 2048, 64
#: Weights of the residual shares: tokens, documents, attention cost.
WEIGHTS = (1.0, 0.02, 0.02)
GROUP = 6000
_ENCODERS: dict = {}


def encoder(path: str):
    """The tokenizer of a rank file, loaded once per worker."""
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def token_counts(df: DataFrame, id_col: str, text_col: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["doc_id", "n_tokens"])

    return df.select(F.col(id_col).cast("bigint").alias("doc_id"), text_col).mapInArrow(run, "doc_id bigint, n_tokens bigint")


def best_fit(sizes: np.ndarray, capacity: int, max_documents: int, attention: int, weights: tuple[float, float, float] = WEIGHTS) -> np.ndarray:
    """The container (from 0) of each item; sizes in decreasing order, each within the capacities."""
    n = len(sizes)
    limit = np.array([capacity, max_documents, attention], float)
    residual = np.empty((n, 3))
    number = np.empty(n, np.int64)
    where = np.empty(n, np.int64)
    live = total = 0
    w = np.array(weights)
    for i, size in enumerate(sizes.tolist()):
        need = np.array([size, 1.0, float(size) * size])
        left = residual[:live] - need
        fits = np.flatnonzero((left >= 0).all(1))
        if len(fits):
            share = left[fits] / limit
            k = int(fits[int(((share * share) @ w).argmin())])
            residual[k] -= need
        else:
            k, live = live, live + 1
            residual[k], number[k] = limit - need, total
            total += 1
        where[i] = number[k]
        if residual[k, 0] <= 0 or residual[k, 1] <= 0:  # a full container takes no more looks
            live -= 1
            residual[k], number[k] = residual[live], number[live]
    return where


def _spread(items: DataFrame, groups: int, group_size: int) -> DataFrame:
    """``items`` with the group (g) of each, by hash. Ids that alone would fill a group (rows repeated very often) are spread over several."""
    salt = F.lit(0)
    if groups > 1:
        hot = items.groupBy("doc_id", "piece").agg(F.count("*").alias("_n")).where(F.col("_n") > group_size)
        if hot.limit(1).count():
            items = items.join(hot, ["doc_id", "piece"], "left")
            salt = F.when(F.col("_n").isNotNull(), F.pmod(F.monotonically_increasing_id(), F.ceil(F.col("_n") / group_size)))
    return items.withColumn("g", F.pmod(F.xxhash64("doc_id", "piece", F.coalesce(salt, F.lit(0)).cast("bigint")), F.lit(groups)))


def pack(counts: DataFrame, capacity: int = CAPACITY, max_documents: int = MAX_DOCUMENTS, attention: int | None = None, group_size: int = GROUP) -> DataFrame:
    """(doc_id, piece, n_tokens, container): the container of every document, or of each piece of an oversized one."""
    cost = attention or capacity * capacity
    largest = min(capacity, math.isqrt(cost))
    pieces = F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / largest)).cast("int")
    items = counts.withColumn("piece", F.explode(F.sequence(F.lit(0), pieces - 1)))
    items = materialise(items.select("doc_id", "piece", F.least(F.lit(largest), F.col("n_tokens") - F.col("piece") * largest).alias("n_tokens")))
    groups = max(1, -(-items.count() // group_size))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "doc_id", "piece"], ascending=[False, True, True])
        place = best_fit(pdf["n_tokens"].to_numpy(), capacity, max_documents, cost)
        return pd.DataFrame({"doc_id": pdf["doc_id"], "piece": pdf["piece"], "n_tokens": pdf["n_tokens"], "container": key[0] + groups * place})

    dealt = _spread(items, groups, group_size).repartition(min(groups, 50 * partitions(counts.sparkSession)), "g")  # a number that AQE keeps: packing takes time, not bytes
    return dealt.groupBy("g").applyInPandas(run, "doc_id bigint, piece int, n_tokens bigint, container bigint")


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, items, tokens, share of the space in use, emptiest and fullest container."""
    each = packed.groupBy("container").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("items"))
    return each.agg(F.count("*").alias("containers"), F.sum("items").alias("items"), F.sum("used").alias("tokens"), F.round(F.sum("used") / (F.count("*") * capacity), 6).alias("fill"), F.min("used").alias("least_used"), F.max("used").alias("most_used"), F.max("items").alias("most_items"))
