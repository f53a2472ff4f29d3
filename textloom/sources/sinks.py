"""Sinks: split files, appends, replaced rounds, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.vectors import finite_or_null


def json_safe(df: DataFrame) -> DataFrame:
    """NaN and infinities of all number columns as null; JSON has neither."""
    return df.withColumns({c: finite_or_null(F.col(c)) for c, kind in df.dtypes if kind in ("double", "float")})


def write_splits(df: DataFrame, path: str, split: str = "split") -> None:
    """JSON lines in one folder per split, replacing what was there."""
    json_safe(df).write.mode("overwrite").partitionBy(split).json(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    json_safe(df).write.mode("append").json(path)


def replace_rounds(df: DataFrame, path: str, round_: str = "round") -> None:
    """The rounds in ``df`` written anew, all other rounds kept (dynamic partition overwrite)."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(round_).parquet(path)


def json_lines(df: DataFrame, *columns: str) -> DataFrame:
    """(value): one JSON text per row."""
    return json_safe(df).select(F.to_json(F.struct(*(columns or df.columns))).alias("value"))


def report(df: DataFrame, path: str) -> None:
    """A report of few rows as one JSON file."""
    json_safe(df).coalesce(1).write.mode("overwrite").json(path)


def checkpoint_row(df: DataFrame, **values: object) -> DataFrame:
    """A one-row state table from literals, for the state of a round."""
    return df.sparkSession.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))


def preview_line(text: Column, score: Column) -> Column:
    from textloom.functions.text import preview

    return F.to_json(F.struct(preview(text).alias("preview"), score.alias("score")))
