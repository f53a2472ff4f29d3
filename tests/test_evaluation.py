import math
import random

import numpy as np
import pytest

from textloom.operators import evaluation as E
from textloom.operators import rows as R


def sample(n, seed, classes=2):
    rng = random.Random(seed)
    return [(rng.randrange(classes), round(rng.random(), 1)) for _ in range(n)]


def brute_macro(pairs):
    labels = sorted({x for p in pairs for x in p})
    scores = []
    for c in labels:
        tp = sum(y == c == z for y, z in pairs)
        fp, fn = sum(z == c != y for y, z in pairs), sum(y == c != z for y, z in pairs)
        scores.append(2 * tp / (2 * tp + fp + fn) if tp else 0.0)
    return sum(scores) / len(scores)


@pytest.mark.parametrize("seed", [1, 2])
def test_binary_sweep(spark, seed):
    data = sample(60, seed)
    got = {r.threshold: r for r in E.threshold_sweep(spark.createDataFrame(data, "y int, s double"), "y", "s").collect()}
    assert len(got) == 181
    for t in np.linspace(0.05, 0.95, 181):
        pairs = [(y, int(s >= t)) for y, s in data]
        assert got[float(t)].macro_f1 == pytest.approx(brute_macro(pairs))
        assert got[float(t)].accuracy == pytest.approx(np.mean([y == z for y, z in pairs]))


def test_ternary_sweep(spark):
    data = sample(50, 3, 3)
    got = E.ternary_sweep(spark.createDataFrame(data, "y int, s double"), "y", "s").collect()
    assert len(got) == 625
    for r in random.Random(0).sample(got, 40):
        pairs = [(y, 2 if s >= r.t_high else 1 if s >= r.t_low else 0) for y, s in data]
        assert r.macro_f1 == pytest.approx(brute_macro(pairs))


def test_best_is_first_in_grid(spark):
    df = spark.createDataFrame([(0.1, 0.5), (0.2, 0.7), (0.3, 0.7)], "threshold double, f double")
    assert E.best_of_grid(df, "f", "threshold").first().threshold == 0.2


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_roc_auc(spark, seed):
    data = sample(80, seed)
    pos, neg = [s for y, s in data if y], [s for y, s in data if not y]
    want = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    assert E.roc_auc(spark.createDataFrame(data, "y int, s double"), "y", "s").first().auc == pytest.approx(want)


def test_roc_auc_of_one_class_is_nan(spark):
    assert math.isnan(E.roc_auc(spark.createDataFrame([(1, 0.5)], "y int, s double"), "y", "s").first().auc)
    assert math.isnan(E.roc_auc(spark.createDataFrame([], "y int, s double"), "y", "s").first().auc)


def test_macro_f1(spark):
    data = [(0, 0), (0, 1), (1, 1), (2, 1), (3, 3)]
    got = E.macro_f1(spark.createDataFrame(data, "y int, z int"), "y", "z").first()
    assert (got.macro_f1, got.accuracy, got.n) == (pytest.approx(brute_macro(data)), pytest.approx(0.6), 5)


def test_stats_of_none_and_one(spark):
    df = spark.createDataFrame([("a", 0.2), ("b", None), ("c", 0.1), ("c", 0.5)], "k string, s double")
    got = {r.k: r for r in E.score_stats(df, "s", 0.5, "k").collect()}
    assert (got["a"].stdev, got["a"].n) == (0.0, 1)
    assert got["b"].n == 0 and got["b"].mean is None and got["b"].stdev is None
    assert got["c"].share_below == 0.5 and got["c"].stdev == pytest.approx(np.std([0.1, 0.5], ddof=1))


def test_histogram_edges(spark):
    df = spark.createDataFrame([(0.0,), (0.1,), (1.0,), (-0.2,), (1.3,), (None,)], "s double")
    assert {r.bin: r.n for r in E.histogram(df, "s").collect()} == {"[0.0,0.1)": 2, "[0.1,0.2)": 1, "[0.9,1.0)": 2}


def test_labels(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(-0.1,), (0.0,), (0.33,), (0.5,), (0.66,), (0.999,), (1.0,), (1.2,), (float("nan"),), (None,)], "s double")
    got = df.select(R.bucketize(F.col("s"), 11).alias("b"), R.binary_label(F.col("s")).alias("y"), R.ternary_label(F.col("s")).alias("t")).collect()
    assert [r.b for r in got][:8] == [0, 0, 3, 5, 7, 10, 10, 10] and got[8].b == 10 and got[9].b is None
    assert [r.t for r in got][:6] == [0, 0, 1, 1, 2, 2] and got[9].t is None
    assert [r.y for r in got][:4] == [0, 0, 0, 1]


def test_constraints_first_reason_wins(spark):
    from pyspark.sql import functions as F

    w = lambda n: " ".join(["w"] * n)
    data = [(w(149), "en", 0.9), (w(150), "en", 0.3), (w(2001), "fr", 0.0), ("as an AI " + w(150), "fr", 0.0), (w(150), "fr", 0.0), (w(150), "en", 0.29), (w(150), None, None)]
    df = spark.createDataFrame(data, "t string, lang string, sim double")
    got = [r.x for r in df.select(R.constraint(F.col("t"), F.col("lang"), F.col("sim")).alias("x")).collect()]
    assert got == ["too_short", "ok", "too_long", "refusal", "non_english", "off_topic", "ok"]
