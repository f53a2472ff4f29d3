"""Shares of grouped splits: as near to the targets as whole groups allow, and audits that name the balanced split."""

import random

import pytest
from pyspark.sql import functions as F

from textloom.llm import splits


@pytest.mark.parametrize("hot", [0, 700, 3000])
def test_shares_within_a_group_of_the_target(spark, hot):
    rng = random.Random(hot)
    rows, n = [], 0
    for topic, size in [("hot", hot)] + [(f"big{i}", 60) for i in range(10)] + [(f"t{i}", rng.randrange(1, 8)) for i in range(900)]:
        rows += [(n + i, topic) for i in range(size)]
        n += size
    got = splits.grouped_splits(spark.createDataFrame(rows, "rec_id long, topic string"), "rec_id", ["topic"]).groupBy("split").count().collect()
    assert sum(r["count"] for r in got) == n
    assert all(abs(r["count"] - n * splits.TARGETS[r.split]) <= 8 for r in got)


def test_bins_divide_what_is_left():
    places = splits.bins_for({"train": 600.0, "val": 150.0, "test": 150.0}, 100)
    assert sum(places.values()) in range(100, 201) and places["train"] * 150 == places["val"] * 600
    assert splits.heavy_first([(1, 50), (2, 30), (3, 2)], 100, 10) == [(1, 50), (2, 30)]


def test_audit_names_the_balanced_split(spark):
    rows = [(i, f"t{i % 40}", "train" if i % 3 else "val") for i in range(400)] + [(900, None, "train"), (900, None, "val")]
    df = spark.createDataFrame(rows, "rec_id long, topic string, split string")
    got = {r.first_id: r for r in splits.broken_groups(df, "rec_id", ["topic"], F.col("split")).collect()}
    assert set(got) == set(range(40)) and {r.balanced for r in got.values()} == {"train", "val", "test"} and got[0].n_rows == 10
    both = df.withColumn("author", F.concat(F.lit("a"), (F.col("rec_id") % 7).cast("string"))).where("topic is not null")
    assert [r.n_rows for r in splits.broken_groups(both, "rec_id", ["topic", "author"], F.col("split")).collect()] == [400]
    assert splits.broken_groups(df.where("rec_id < 0"), "rec_id", ["topic"], F.col("split")).count() == 0
