import math
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from textloom.functions import drift, vectors as V
from textloom.operators import bleu, chunks, joins, rounds, rows, search
from textloom.operators import vectors as G


@pytest.mark.parametrize("window,stride", [(4, 2), (4, 4), (3, 5), (1, 1)])
def test_windows_like_the_loop(spark, window, stride):
    df = spark.range(0, 15).select("id", F.expr("if(id = 0, array(), sequence(1L, id))").alias("t"))
    got = {}
    for r in chunks.token_windows(df, "id", F.col("t"), window, stride).collect():
        got.setdefault(r.id, []).append((r.start, list(r.tokens)))
    for n in range(15):
        tokens, want, start = list(range(1, n + 1)), [], 0
        if n <= window:
            want = [(0, tokens)]
        else:
            while start < n:
                want.append((start, tokens[start : start + window]))
                if start + window >= n:
                    break
                start += stride
        assert sorted(got[n]) == want


def test_stride_has_to_advance():
    with pytest.raises(ValueError):
        chunks.window_starts(F.lit(5), 2, 0)


def test_char_chunks(spark):
    df = spark.createDataFrame([(1, "abcdefg"), (2, ""), (3, None)], "id long, t string")
    assert rows_of(chunks.char_chunks(df, "id", "t", 3)) == [(1, 0, "abc"), (1, 1, "def"), (1, 2, "g")]
    assert chunks.char_chunks(df, "id", "t", 3, 2).count() == 2


def test_vector_functions(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [2.0, 0.0, 1.0]), ([0.0, 0.0, 0.0], [1.0, 1.0, 1.0])], "a array<double>, b array<double>")
    r, zero = df.select(V.cosine(F.col("a"), F.col("b")).alias("c"), V.softmax(F.col("a")).alias("p"), V.semantic_drift(F.col("a"), F.col("b")).alias("d"), V.expected_value(V.softmax(F.col("a"))).alias("e")).collect()
    a, b = np.array([1, 2, 3.0]), np.array([2, 0, 1.0])
    p = np.exp(a) / np.exp(a).sum()
    assert r.c == pytest.approx(a @ b / np.linalg.norm(a) / np.linalg.norm(b)) and r.p == pytest.approx(p.tolist())
    assert r.e == pytest.approx((p * [0, 0.5, 1]).sum()) and zero.c is None and zero.d == 1.0


def test_clamp_and_finite(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (2.0,), (-1.0,), (float("inf"),)], "x double")
    got = df.select(V.clamp(F.col("x")).alias("c"), V.finite_or_null(F.col("x")).alias("f")).collect()
    assert [r.c for r in got] == [None, 1.0, 1.0, 0.0, 1.0] and [r.f for r in got] == [None, None, 2.0, -1.0, None]


def test_medoid_and_representatives(spark):
    rng = np.random.default_rng(1)
    data = [(i, i % 3, rng.normal(size=4).tolist()) for i in range(30)]
    df = spark.createDataFrame(data, "vec_id long, label int, embedding array<double>")
    got = {r.label: r.vec_id for r in G.medoids(df, "vec_id", "embedding", "label").collect()}
    for k in range(3):
        own = [(i, np.array(v) / np.linalg.norm(v)) for i, lab, v in data if lab == k]
        assert got[k] == min(own, key=lambda x: np.mean([1 - x[1] @ y for _, y in own]))[0]
    centers = G.centroids(df, "embedding", "label").union(spark.createDataFrame([(9, [5.0, 5.0, 5.0, 5.0])], "label int, c array<double>"))
    near = {r.label: r.vec_id for r in G.nearest_to_centroid(df, "vec_id", "embedding", "label", centers).collect()}
    assert near[9] == min(data, key=lambda x: np.linalg.norm(np.array(x[2]) - 5))[0]


def test_nearest_uses_ids_and_ties_go_to_the_smallest(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, None)], "vec_id long, e array<double>")
    c = spark.createDataFrame([(7, [0.0, 1.0]), (4, [3.0, 0.0]), (2, [1.0, 0.0]), (5, None)], "cluster_id long, centroid array<double>")
    assert rows_of(joins.nearest(v, c, "vec_id", "e"), "vec_id", "cluster_id") == [(1, 2), (2, 7)]


def test_passage_fallback_or_error(spark):
    topics = spark.createDataFrame([("a",), ("b",)], "topic string")
    passages = spark.createDataFrame([("a", "pa")], "topic string, source_passage string")
    assert rows_of(joins.with_passages(topics, passages, "g"), "topic", "source_passage") == [("a", "pa"), ("b", "g")]
    with pytest.raises(Exception, match="no passage for topic b"):
        joins.with_passages(topics, passages, None).collect()


def test_cross_topics_hand_out(spark):
    pairs = spark.createDataFrame([(f"{i:03x}p", i % 2) for i in range(7)], "pair_id string, cluster_id int")
    topics = spark.createDataFrame([(f"t{i}",) for i in range(5)], "topic string")
    got = joins.cross_topics(pairs, topics, 2).collect()
    assert len({(r.cluster_id, r.new_topic) for r in got}) == len(got) == 10
    per = Counter(r.pair_id for r in got)
    assert max(per.values()) == 2 and sorted(per.values()) == [1, 1, 2, 2, 2, 2]


def test_cluster_members_last_wins(spark):
    c = spark.createDataFrame([(0, ["a", "b"]), (2, ["b"])], "cluster_id int, member_pair_ids array<string>")
    assert rows_of(joins.cluster_members(c), "pair_id", "cluster_id") == [("a", 0), ("b", 2)]


def test_plateau(spark):
    runs = {"two": [0.5, 0.49], "flat": [0.5, 0.49, 0.48], "edge": [0.5, 0.48, 0.4799], "moving": [0.5, 0.3, 0.1]}
    df = spark.createDataFrame([(k, i, float(v)) for k, vs in runs.items() for i, v in enumerate(vs)], "run string, round int, best double")
    stop = {r.run for r in rounds.plateau(df, ["run"], "round", "best").where("stop").collect()}
    assert stop == {"flat"}


def test_ratchet_and_early_stop(spark):
    df = spark.createDataFrame([("a", i, s) for i, s in enumerate([0.5, 0.6, 0.5, 0.4, 0.45, 0.41])], "k string, i int, s double")
    assert rows_of(rounds.ratchet(df, ["k"], "i", "s", block=2), "i") == [(0,), (3,)]
    got = rounds.best_so_far(df, ["k"], ["i"], "s", 2).orderBy("i").collect()
    assert [r.waited for r in got] == [0, 1, 2, 0, 1, 2] and [r.stop for r in got] == [False, False, True, False, False, True]


def test_trajectory(spark):
    df = spark.createDataFrame([("a", i, f"p{i}", s) for i, s in enumerate([0.5, 0.6, 0.4])], "run string, step int, p string, s double")
    got = {(r.parent, r.child, r.kind) for r in rounds.trajectory_pairs(df, ["run"], "step", "p", "s").collect()}
    assert got == {("p1", "p2", "step"), ("p0", "p2", "whole")}


def test_recency_oversample(spark):
    df = spark.createDataFrame([(i, 1 if i < 3 else 2) for i in range(8)], "id long, round int")
    assert rows_of(rounds.recency_oversample(df, "round", "id", 1.5).where("repeated"), "id") == [(3,), (4,)]


def test_candidate_fitness(spark):
    df = spark.createDataFrame([("a", 0.2, 0.5, True), ("a", 0.4, 0.5, True), ("b", 0.1, 0.9, True), ("b", 1.0, 0.0, False)], "p string, s double, m double, ok boolean")
    got = {r.p: r.fitness for r in rounds.candidate_means(df, ["p"], "s", "s", "m", "ok").collect()}
    assert got["a"] == pytest.approx(-0.3 + 0.15) and got["b"] == -math.inf


def test_round_robin_and_budget(spark):
    seeds = spark.createDataFrame([("x", 1), ("y", 2)], "p string, i int")
    assert Counter(r.p for r in rounds.round_robin(spark, seeds, 5, "i").collect()) == {"x": 3, "y": 2}
    assert rounds.call_budget(1, 1, 6, 4, 2)["essay_calls"] == 48
    assert rounds.amortisation(10, 0) == math.inf


def test_time_to_result(spark):
    df = spark.createDataFrame([("r", 50, 0.65), ("r", 100, 0.45)], "run string, step int, s double")
    assert rows_of(rounds.time_to_result(df, ["run"], "step", "s", (0.7, 0.5, 0.4)), "threshold", "step") == [(0.5, 100), (0.7, 50)]


def test_instruction_filter_edges(spark):
    w = lambda n: " ".join(["w"] * n)
    data = [(1, "why " + "x" * 146, None, w(50)), (2, "why " + "x" * 147, "", w(50)), (3, "whylike", " ", w(500)), (4, "why", "ctx", w(50)), (5, "why", "", w(501)), (6, "sing", "", w(50)), (7, "why", "", w(49))]
    df = spark.createDataFrame(data, "id int, i string, c string, o string")
    assert rows_of(rows.instruction_filter(df, "i", "c", "o"), "id") == [(1,), (3,)]


def test_scored_record_falls_back(spark):
    df = spark.createDataFrame([("", "other", None, 1.5), ("t", "o", -0.5, 0.2), (None, None, None, None)], "a string, b string, s double, s2 double")
    assert sorted((r.text, r.score) for r in rows.scored_record(df, ["a", "b"], ["s", "s2"], "x").collect()) == [("", 0.0), ("other", 1.0), ("t", 0.0)]


def test_routed(spark):
    df = spark.createDataFrame([("t", "i", "o", "b", "e"), ("t", "i", "o", None, "e"), (" ", "i", "o", "b", "e"), ("t", "", "o", "b", "e")], "topic string, input_prompt string, output_prompt string, baseline_essay string, best_essay string")
    scored, build = rows.routed(df, "baseline_essay", "best_essay")
    assert (scored.count(), build.count()) == (1, 1)


def brute_bleu(docs):
    out = []
    for i, hyp in enumerate(docs):
        refs = [d for j, d in enumerate(docs) if j != i]
        logs, first = 0.0, 0
        for n in range(1, 5):
            grams = Counter(tuple(hyp[k : k + n]) for k in range(len(hyp) - n + 1))
            best = Counter()
            for ref in refs:
                for g, c in Counter(tuple(ref[k : k + n]) for k in range(len(ref) - n + 1)).items():
                    best[g] = max(best[g], c)
            hit = sum(min(c, best[g]) for g, c in grams.items())
            first = hit if n == 1 else first
            logs += math.log((hit or 0.1) / max(1, len(hyp) - n + 1)) / 4
        close = min((abs(len(r) - len(hyp)), len(r)) for r in refs)[1]
        bp = 1.0 if len(hyp) > close else math.exp(1 - close / max(1, len(hyp)))
        out.append(bp * math.exp(logs) if first else 0.0)
    return sum(out) / len(out)


def test_self_bleu(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(list("abcdef"), size=rng.integers(2, 14))) for _ in range(9)] + ["zz yy", "a b c a b c a b c"]
    df = spark.createDataFrame([(i, t, "g") for i, t in enumerate(texts)] + [(99, "alone here", "h")], "id long, t string, g string")
    got = {r.g: r.self_bleu for r in bleu.self_bleu(df, "id", "t", "g").collect()}
    assert got["g"] == pytest.approx(brute_bleu([re.findall(r"\w+", t) for t in texts])) and math.isnan(got["h"])


@pytest.mark.parametrize("part_words,most_parts", [(3_000_000, 8), (400, 8), (24, 50), (24, 2), (1, 0)])
def test_self_bleu_in_parts(spark, part_words, most_parts):
    rng = np.random.default_rng(6)
    texts = {g: [" ".join(rng.choice(list("abcdefgh"), size=rng.integers(0, 14))) for _ in range(n)] for g, n in (("g", 30), ("h", 9), ("i", 2), ("j", 1))}
    rows = [(100 * k + i, t, g) for k, (g, ts) in enumerate(texts.items()) for i, t in enumerate(ts)]
    df = spark.createDataFrame([*rows, (None, "a b c d e", "g"), (901, "a b", None), (902, "a b", None), (903, None, "h"), (904, "a b", "k"), (None, "a b", "k")], "id long, t string, g string").repartition(3)
    got = {r.g: (r.n_docs, r.self_bleu) for r in bleu.self_bleu(df, "id", "t", "g", part_words, most_parts).collect()}
    for g in "ghi":
        assert got[g] == (len(texts[g]) + (g == "g"), pytest.approx(brute_bleu([t.split() for t in texts[g]])))
    assert got["j"][0] == 1 and math.isnan(got["j"][1]) and got[None] == (2, None) and got["k"] == (2, None)


def test_self_bleu_holds_little_at_once():
    rng = np.random.default_rng(7)
    words = rng.integers(-(2**62), 2**62, 5000)[rng.integers(0, 5000, (4000, 200))]
    batch = pa.RecordBatch.from_arrays([pa.array(np.full(4000, 5)), pa.array(np.arange(4000)), pa.FixedSizeListArray.from_arrays(pa.array(words.ravel()), 200).cast(pa.list_(pa.int64()))], names=["_b", "_key", "_w"])
    tracemalloc.start()
    try:
        rows = sum(b.num_rows for b in bleu._gram_counts(iter([batch])))
        assert rows > 3_000_000 and tracemalloc.get_traced_memory()[1] < 64e6  # all 4,000 documents at once took 273 MB
        tracemalloc.reset_peak()
        key = tuple(map(pa.scalar, (5, 1, 0)))
        assert sum(b.num_rows for b in bleu._part_hits(key, iter([batch]))) == 4000 and tracemalloc.get_traced_memory()[1] < 150 * words.size
    finally:
        tracemalloc.stop()


def test_rouge_and_penalty(spark):
    df = spark.createDataFrame([("the cat sat down", "the cat down"), ("a", ""), ("same text", "same text")], "a string, b string")
    got = [r.x for r in df.select(drift.rouge_l_drift("a", "b").alias("x")).collect()]
    assert got == pytest.approx([1 - 6 / 7, 1.0, 0.0])
    gated = spark.createDataFrame([(0.42,), (0.43,)], "s double").select(drift.penalty(F.lit(0.2), F.lit(0.1), F.lit(0.4), F.col("s"), 0.42).alias("p")).collect()
    assert gated[0].p.penalty == pytest.approx(0.2 + 0.035 + 0.2) and gated[1].p.penalty == pytest.approx(0.235)
    options = drift.drift_options({"drift": {"lambda_rouge_l": 0.2, "use_bertscore": True}})
    assert options["weights"] == drift.Weights(1.0, 0.2, 0.5) and options["use_bertscore"]
    with pytest.raises(ValueError):
        drift.drift_options({"alignment_reference_mode": "x"})


def test_drift_grid_at_threshold(spark):
    df = spark.createDataFrame([(0.5, 0.0, 0.0, 0.0), (0.3, 0.1, 0.0, 0.0)], "detector_slop double, drift_semantic double, drift_rouge_l double, drift_bertscore double")
    got = search.drift_grid(df, [1.0], [0.3], [0.5]).first()
    assert got.fool_rate_hard == 0.5 and got.fool_rate_approx == pytest.approx((0.5 + 1 / (1 + math.exp(-4))) / 2)
    assert search.sensitivity(df, {"semantic": 1.0, "rouge": 0.3, "bertscore": 0.5}, "rouge", [0.1, 0.2, 0.3]).count() == 3
