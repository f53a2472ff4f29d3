import hashlib

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from textloom.operators import selection as S


def test_first_and_last_per_key(spark):
    df = spark.createDataFrame([("a", 3), ("a", 1), ("b", 2), (None, 5), (None, 4)], "k string, i int")
    assert rows_of(S.distinct_first(df, "k", "i").where("k is not null")) == [("a", 1), ("b", 2)]
    assert {(r.k, r.i, r.first_i) for r in S.distinct_last(df, "k", "i").collect()} == {("a", 3, 1), ("b", 2, 2), (None, 5, 4)}


def test_best_per_takes_the_first_of_equals(spark):
    df = spark.createDataFrame([("a", 0.5, 2), ("a", 0.5, 1), ("a", None, 0), ("b", 0.1, 9)], "k string, s double, i int")
    assert rows_of(S.best_per(df, "k", "s", "i"), "k", "i") == [("a", 1), ("b", 9)]
    assert rows_of(S.best_per(df, "k", "s", "i", largest=True), "k", "i") == [("a", 1), ("b", 9)]


def test_source_index(spark):
    rows = [("a", "p1", 0.5, 1), ("a", "p2", 0.2, 2), ("a", "p3", 0.2, 3), ("b", "p4", None, 4), ("b", "p5", None, 5), ("a", "p6", None, 6), ("c", " ", 0.1, 7), (" ", "p8", 0.1, 8)]
    df = spark.createDataFrame(rows, "topic string, source_passage string, slop_score double, seq long")
    assert rows_of(S.source_index(df), "topic", "source_passage") == [("a", "p2"), ("b", "p5")]


def test_pool_merge_by_prefix(spark):
    old = spark.createDataFrame([("x" * 4000 + "a", 0.3, 1), ("y", None, 2)], "essay string, slop_score double, ordinal long")
    new = spark.createDataFrame([("x" * 4000 + "b", 0.2, 3), (" ", 0.1, 4), ("z", 0.9, 5)], old.schema)
    pool = S.pool_merge(old, new, 3)
    assert rows_of(pool, "ordinal") == [(3,), (4,), (5,)]
    assert rows_of(S.fewshot_texts(pool, 2), "ordinal") == [(3,)]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 100])
def test_split_manifest_sizes(spark, n):
    ids = spark.createDataFrame([(f"id{i}",) for i in range(n)] * 2, "pair_id string")
    got = S.split_manifest(ids, "pair_id", 42).collect()
    counts = {s: sum(r.split == s for r in got) for s in ("train", "val", "test")}
    if n < 3:
        want = {"train": min(n, 1), "val": 0, "test": max(0, n - 1)}
    else:
        train = max(1, min(int(n * 0.7), n - 2))
        val = max(1, min(int(n * 0.15), n - train - 1))
        want = {"train": train, "val": val, "test": n - train - val}
    assert counts == want and len({r.pair_id for r in got}) == n
    if n == 7:
        first = min((hashlib.sha256(f"42|id{i}".encode()).hexdigest(), f"id{i}") for i in range(n))[1]
        assert next(r.split for r in got if r.pair_id == first) == "train"


def test_stratified_split_covers_every_stratum(spark):
    df = spark.range(200).select("id", (F.col("id") % 4).alias("k")).union(spark.createDataFrame([(999, 77)], "id long, k long"))
    got = S.stratified_split(df, ["k"], 1, "id", 0.1, 0.1).groupBy("k", "split").count().collect()
    assert {(r.k, r.split): r["count"] for r in got if r.k < 4} == {(k, s): n for k in range(4) for s, n in (("train", 40), ("val", 5), ("test", 5))}


def test_weighted_sample_follows_weights(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 3.0), (3, 0.0)], "id long, w double")
    got = {r.id: r["count"] for r in S.weighted_sample(df, 4000, "w", 5, "id").groupBy("id").count().collect()}
    assert sum(got.values()) == 4000 and 3 not in got and 0.7 < got[2] / 4000 < 0.8


def test_elite_has_at_least_one(spark):
    df = spark.range(12).select("id", (F.col("id") % 2).alias("k")).union(spark.createDataFrame([(50, 9)], "id long, k long"))
    df = df.withColumn("s", F.col("id") / 100)
    assert rows_of(S.elite(df, 0.34, ["k"], "s", "id"), "id") == [(0,), (1,), (2,), (3,), (50,)]


def test_refill_and_epsilon_shares(spark):
    df = S.refill_plan(spark.range(4000), 3, "id").groupBy("action").count().collect()
    share = {r.action: r["count"] / 4000 for r in df}
    assert abs(share["mutate"] - 0.4) < 0.05 and abs(share["seed"] - 0.1) < 0.03
    same = spark.range(1000).select(S.epsilon_greedy(F.lit("best"), 0.2, 1, F.col("id").cast("string"), ("a", "b")).alias("x")).where("x = 'best'").count()
    assert 740 < same < 860
