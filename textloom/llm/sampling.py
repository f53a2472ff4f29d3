"""A reproducible sample that stays stable while data grows.

The stable key of a record is hashed together with a fixed salt to a number in [0, 1); the record is selected
if that number is below the rate. Nothing else enters, so a record's fate does not depend on the run, on the
partitioning or on other records, and a higher rate only adds records.

The filter comes before the shuffle that collapses equal keys, so only the selected share moves; partial
aggregation handles keys with very many rows.

Defined results: null key parts are a value of their own (distinct from an empty string); equal keys are
selected together and come out as one row with their number; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hexadecimal digits of the hash that make up the number: 13 digits are 52 bits, exact in a double.
DIGITS = 13
SALT = "textloom-sample-1"


def key_hash(columns: list[str], salt: str = SALT) -> Column:
    """SHA-256 of the salt and the key parts. Each part is marked as null or given with its length, so no two keys share a text."""
    parts = [F.when(F.col(c).isNull(), F.lit("-")).otherwise(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string"))) for c in columns]
    return F.sha2(F.concat_ws("|", F.lit(salt), *parts), 256)


def unit_interval(digest: Column) -> Column:
    """The first digits of a hexadecimal hash as a number in [0, 1)."""
    return F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("double") / F.lit(float(16**DIGITS))


def stable_sample(df: DataFrame, key: list[str], rate: float, salt: str = SALT) -> DataFrame:
    """All rows of ``df`` whose key is selected, with ``sample_key`` (the hash)."""
    hashed = df.withColumn("sample_key", key_hash(key, salt))
    return hashed.where(unit_interval(F.col("sample_key")) < rate)


def stable_sample_of_keys(df: DataFrame, key: list[str], rate: float, id_col: str, salt: str = SALT) -> DataFrame:
    """One row per selected distinct key: the key, sample_key, n_rows and the smallest id."""
    return stable_sample(df.select(id_col, *key), key, rate, salt).groupBy("sample_key", *key).agg(F.count("*").alias("n_rows"), F.min(id_col).alias(f"first_{id_col}"))
