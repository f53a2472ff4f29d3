"""Operators whose tasks must not grow with a hot group: ties, heavy weights, parts, streams on any file system."""

import random

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from textloom import session
from textloom.operators import evaluation, joins, rounds, rows
from textloom.operators import selection as S
from textloom.operators import vectors as G
from textloom.streaming import trace


def test_ranks_with_ties(spark):
    rng = random.Random(2)
    data = [(i, f"g{i % 3}" if i % 7 else None, rng.choice([0.5, 0.5, 0.5, rng.random() * 4 - 2]), "x") for i in range(400)] + [(900, "g1", None, "x")]
    df = spark.createDataFrame(data, "id long, g string, s double, rank string")
    for descending in (False, True):
        got = {(r.id): (r["rank"], r.n_all) for r in S.ranked_by_score(df.drop("rank"), ["g"], "s", "id", descending, block=7).collect()}
        for g in {d[1] for d in data}:
            own = sorted((d for d in data if d[1] == g and d[2] is not None), key=lambda d: (-d[2] if descending else d[2], d[0]))
            assert [got[d[0]] for d in own] == [(k, len(own)) for k in range(1, len(own) + 1)]
    assert 900 not in got


def test_first_rows(spark):
    df = spark.createDataFrame([(i, (i * 37) % 101) for i in range(101)], "id long, v long").repartition(5)
    assert rows_of(S.first_rows(df, 0.1, 1, F.col("v").asc()), "v") == [(i,) for i in range(10)]
    assert S.first_rows(df.where("id < 5"), 0.1, 1, F.col("v").asc()).count() == 1 and S.first_rows(df.where("id < 0"), 0.1, 1, F.col("v")).count() == 0
    assert rows.held_out_or_head(df.where("id < 0"), df, F.col("v").desc()).count() == 10


def test_weighted_sample_of_a_heavy_row(spark):
    df = spark.createDataFrame([(0, 5000.0)] + [(i, 1.0) for i in range(1, 1001)] + [(5000, 0.0), (5001, None), (5002, -1.0)], "id long, w double")
    got = S.weighted_sample(df, 6000, "w", 3, "id", bucket_rows=2)
    assert got.count() == 6000 and abs(got.where("id = 0").count() / 6000 - 5 / 6) < 0.02 and got.where("id >= 5000").count() == 0
    assert rows_of(got) == rows_of(S.weighted_sample(df.repartition(7), 6000, "w", 3, "id", bucket_rows=2))
    assert S.weighted_sample(df.where("id < 0"), 10, "w", 3, "id").count() == 0


def test_parts_grow_with_the_rows():
    assert [S.part_digits(n) for n in (0, 60_000, 12_800_000, 12_800_001, 10**10)] == [2, 2, 2, 3, 5]
    assert [G.shards_for(n) for n in (0, 16_000_000, 16_000_001, 10**9)] == [16, 16, 32, 1024]


def test_nearest_in_parts(spark, monkeypatch):
    rng = random.Random(4)
    vec = lambda: [rng.random() - 0.5 for _ in range(6)]
    v = spark.createDataFrame([(i, vec()) for i in range(50)] + [(99, None)], "vec_id long, e array<double>")
    same = vec()
    c = spark.createDataFrame([(i, vec()) for i in range(40)] + [(50, same), (41, same), (60, None)], "cluster_id long, centroid array<double>")
    whole = rows_of(joins.nearest(v, c, "vec_id", "e"), "vec_id", "cluster_id")
    monkeypatch.setattr(joins, "TABLE_BYTES", 6 * 8 * 9)
    monkeypatch.setattr(joins, "PRODUCT_CELLS", 70)
    assert rows_of(joins.nearest(v, c, "vec_id", "e"), "vec_id", "cluster_id") == whole and len(whole) == 50


def test_recency_oversample_of_many(spark):
    df = spark.createDataFrame([(i * 90_000, 2 if i % 2 else 1) for i in range(20)], "id long, round long")
    assert rows_of(rounds.recency_oversample(df, "round", "id", 1.5).where("repeated"), "id") == [(i * 90_000,) for i in (1, 3, 5, 7, 9)]


def test_auc_of_scores_outside_the_unit_interval(spark):
    df = spark.createDataFrame([(1, 5e9), (0, -7e9), (1, 0.5), (0, 0.4), (0, 7e9)], "y int, s double")
    assert evaluation.roc_auc(df, "y", "s").first().auc == pytest.approx(4 / 6)


def test_ratchet_and_pool_remember_earlier_batches(spark, tmp_path):
    path = tmp_path.as_uri()
    each = trace.keep_ratchet(f"{path}/ratchet", "k", "s", "k string, s double, ordinal long")
    batches = [[("a", 0.5, 1), ("b", 0.9, 2)], [("a", 0.6, 3), ("b", 0.4, 4)], [("a", 0.3, 5), ("b", 0.4, 6), ("b", 0.1, 7)]]
    for n, b in enumerate(batches):
        for _ in range(2):  # a batch that is run again gives the same result
            each(spark.createDataFrame(b, "k string, s double, ordinal long"), n)
    assert rows_of(spark.read.parquet(*(f"{path}/ratchet/batch={n}" for n in range(3))), "ordinal") == [(1,), (2,), (4,), (5,), (7,)]
    pool = trace.keep_pool(f"{path}/pool", 2, "essay string, slop_score double, ordinal long")
    for n, b in enumerate([[("x", 0.5, 1)], [("y", 0.4, 2)], [("z", 0.6, 3)]]):
        pool(spark.createDataFrame(b, "essay string, slop_score double, ordinal long"), n)
    assert rows_of(spark.read.parquet(f"{path}/pool/batch=2"), "ordinal") == [(1,), (2,)]


def test_a_cluster_needs_a_shared_checkpoint_folder():
    from types import SimpleNamespace as N

    none = N(isDefined=lambda: False)
    sc = N(master="spark://host:7077", _jsc=N(sc=lambda: N(getCheckpointDir=lambda: none)))
    with pytest.raises(ValueError):
        session.ensure_checkpoint_dir(N(sparkContext=sc, conf=N(get=lambda *_: None)))
