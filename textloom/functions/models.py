"""Where models plug in: scorers and embedders as vectorised functions, loaded once per worker.

A *loader* is a function without arguments that returns the model: a function from a list of texts to a list of
results. It is shipped to the workers, so that the model itself never travels and is made once in each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType

from textloom.functions import vectors as V

Loader = Callable[[], Callable[[list[str]], Sequence]]
DECODERS = {"expected_value": V.expected_value, "top_bucket_prob": V.top_probability, "last": V.last_probability}


def _column(loader: Loader, kind, batch: int):
    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = loader()
        for texts in batches:
            out: list = []
            for i in range(0, len(texts), batch):
                part = ["" if t is None else t for t in texts.iloc[i : i + batch]]
                out.extend(model(part))
            yield pd.Series(out, index=texts.index)

    return run


def scores(loader: Loader, batch: int = 16):
    """A column function from texts to scores."""
    return _column(loader, DoubleType(), batch)


def probabilities(loader: Loader, batch: int = 16):
    """A column function from texts to distributions over buckets."""
    return _column(loader, ArrayType(DoubleType()), batch)


def embeddings(loader: Loader, batch: int = 32):
    """A column function from texts to vectors."""
    return _column(loader, ArrayType(FloatType()), batch)


def decoded(probs: Column, how: str = "expected_value") -> Column:
    """A score from a distribution over buckets."""
    if how not in DECODERS:
        raise ValueError(f"unknown decoder {how}; there are {sorted(DECODERS)}")
    return DECODERS[how](probs)


def document_scores(df: DataFrame, key: str, text: str, scorer: Callable[[Column], Column], chunked: bool = False, window: int = 512, stride: int | None = None, max_chunks: int | None = None, how: str = "weighted", w_mean: float = 0.5, w_max: float = 0.5) -> DataFrame:
    """(key, score, mean, max, n_chunks) of each document, scored whole or by sliding windows of words.

    Windows are scored as rows of their own, so long documents spread over tasks like any other.
    """
    from textloom.functions.text import word_list
    from textloom.operators import chunks

    if not chunked:
        whole = df.select(key, scorer(F.col(text)).alias("score"))
        return whole.select(key, "score", F.col("score").alias("mean"), F.col("score").alias("max"), F.lit(1).cast("bigint").alias("n_chunks"))
    windows = chunks.token_windows(df, key, word_list(text), window, stride or max(1, window // 2), max_chunks)
    each = windows.select(key, scorer(F.array_join("tokens", " ")).alias("s"))
    per = chunks.chunk_scores(each, key, "s")
    return per.select(key, chunks.aggregate_score(F.col("mean"), F.col("max"), how, w_mean, w_max).alias("score"), "mean", "max", "n_chunks")


def bag_of_words_detector(train: DataFrame, text: str, label: str, features: int = 1 << 14):
    """A logistic regression on hashed words: a stand-in for a detector where none can be loaded.

    Returns the fitted pipeline; ``transform`` adds ``probability``.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF

    from textloom.functions.text import word_tokens

    rows = train.select(word_tokens(text).alias("_w"), F.col(label).cast("double").alias("_y"))
    return Pipeline(stages=[HashingTF(inputCol="_w", outputCol="_f", numFeatures=features), LogisticRegression(featuresCol="_f", labelCol="_y", maxIter=20, regParam=0.01)]).fit(rows)
