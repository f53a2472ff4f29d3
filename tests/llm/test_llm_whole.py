"""Cases that the training-data queries once left out."""

import random

from pyspark.sql import functions as F

from textloom.llm import near_duplicates, packing, pair_defects
from textloom.llm import queries as Q


def essay(rng, n, end):
    text = " ".join(rng.choice(("mill", "sea", "rope", "valley", "wind", "boats", "stone")) for _ in range(n))
    return text[: n - len(end)] + end


def test_pair_defects_finds_weak_endings_at_a_limit(spark, tmp_path):
    rng = random.Random(7)
    rows = [(i, "alpaca", essay(rng, rng.randrange(150, 600), ".")) for i in range(600)]
    rows += [(1000 + i, "alpaca", essay(rng, 300, " of the")) for i in range(40)]
    rows += [(2000, "alpaca", essay(rng, 300, " about 3.")), (2001, "alpaca", essay(rng, 347, " about 3.")), (2002, None, essay(rng, 300, " about 3.")), (2003, "alpaca", essay(rng, 300, " rope."))]
    df = spark.createDataFrame(rows, "rec_id long, source string, best_essay string").selectExpr("*", "'Tell it.' as output_prompt", "'Tell of it.' as input_prompt", "if(rec_id = 2000, best_essay, null) as baseline_essay")
    df.write.parquet(str(tmp_path / "prompt_pairs.parquet"))
    got = {(r.rec_id, r.field) for r in Q.p7_found(spark, str(tmp_path)).where("defect = 'truncated'").collect()}
    assert got == {(i, "best_essay") for i in (*range(1000, 1040), 2000)}
    assert pair_defects.pair_defects(df.drop("source")).where("defect = 'truncated' and rec_id in (2000, 2002)").count() == 2


def test_packing_keeps_an_attention_budget_that_binds(spark):
    counts = spark.createDataFrame([(i, n) for i, n in enumerate([5000, 2048, 1500, 1025, 1024, 0] + [700] * 20 + [90] * 50)], "doc_id long, n_tokens long")
    budget = 2048 * 2048 // 4
    used = {}
    got = packing.pack(counts, attention=budget).collect()
    for r in got:
        used.setdefault(r.container, []).append(r.n_tokens)
    assert all(sum(ns) <= 2048 and sum(n * n for n in ns) <= budget for ns in used.values())
    assert sum(r.n_tokens for r in got) == counts.agg(F.sum("n_tokens")).first()[0]


def test_near_duplicate_classes_expand_to_the_pairs(spark):
    first, other = "the mill by the sea has a rope for every boat of the valley", "nobody saw the wind turn over the old stone harbour that night"
    texts = [first, first, first + " today", first + " today", other, other.upper(), "too short", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    pairs, members = near_duplicates.near_duplicate_classes(df, "id", "t")
    held = {}
    for r in members.collect():
        held.setdefault(r.cls, []).append(r.rec)
    assert sorted(sorted(m) for m in held.values()) == [[0, 1], [2, 3], [4, 5]] and pairs.count() == 1
    spread = {(min(x, y), max(x, y)) for r in pairs.collect() for x in held[r.a] for y in held[r.b]} | {(x, y) for m in held.values() for x in m for y in m if x < y}
    assert spread == {(r.rec_id_a, r.rec_id_b) for r in near_duplicates.near_duplicate_pairs(df, "id", "t").collect()} and len(spread) == 7


def test_packing_of_a_row_repeated_very_often(spark):
    counts = spark.createDataFrame([(7, 1000)] * 300 + [(i, 50) for i in range(100, 160)], "doc_id long, n_tokens long")
    got = packing.pack(counts, group_size=40).collect()
    used, held = {}, {}
    for r in got:
        used[r.container] = used.get(r.container, 0) + r.n_tokens
        held[r.container] = held.get(r.container, 0) + 1
    assert len(got) == 360 and max(used.values()) <= 2048 and sum(used.values()) == 303000
    few = packing.pack(counts, max_documents=3, group_size=40).collect()
    assert max(sum(r.container == c for r in few) for c in {r.container for r in few}) <= 3
