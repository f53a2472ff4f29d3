"""Operators on small tables: nulls, blanks, ties, repeated rows, empty tables, clashing columns, hot groups."""

import random

import pytest
from pyspark.sql import functions as F

from textloom.llm import cross_split, encoding, leaks, near_duplicates, packing, pair_defects, sampling, segmentation, splits, truncation

WORDS = [a + b for a in ("ba", "ce", "di", "fo", "gu", "ha", "je", "ki", "lo", "mu") for b in ("n", "r", "st", "lk", "m", "p", "sh", "tt", "x", "zz")]


def text_of(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(rng, text, share):
    return " ".join(rng.choice(WORDS) if rng.random() < share else w for w in text.split())


def similarity(a, b):
    sh = lambda t: set(zip(*(t.split()[i:] for i in range(3))))
    return len(sh(a) & sh(b)) / max(1, len(sh(a) | sh(b)))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    base = [text_of(rng, rng.randrange(60, 120)) for _ in range(12)]
    out = base + [edited(rng, b, 0.06) for b in base] + [edited(rng, b, 0.3) for b in base] + [base[0].upper(), base[0] + "!", "too short", "", None]
    return list(enumerate(out, 1))


def brute(rows, threshold, least):
    own = [(i, t.lower().rstrip("!")) for i, t in rows if t and len(t.split()) >= least]
    return {(i, j) for k, (i, a) in enumerate(own) for j, b in own[k + 1 :] if similarity(a, b) >= threshold}


def test_near_duplicates(spark, texts):
    df = spark.createDataFrame([(i, t, "x") for i, t in texts], "rec long, t string, cls string").withColumn("rec_id_a", F.lit(1))
    got = {(r.rec_id_a, r.rec_id_b) for r in near_duplicates.near_duplicate_pairs(df, "rec", "t").collect()}
    assert got == brute(texts, 0.5, 8) and len(got) > 12
    groups = {r.rec_id: r for r in near_duplicates.near_duplicate_groups(df, "rec", "t").collect()}
    assert set(groups) == {i for p in got for i in p}
    assert all(groups[a].group_id == groups[b].group_id for a, b in got) and groups[1].group_id != groups[2].group_id


def test_near_duplicates_of_a_hot_group(spark):
    rng = random.Random(4)
    hot = text_of(rng, 40)
    rows = [(i, hot) for i in range(60)] + [(100 + i, edited(rng, hot, 0.04)) for i in range(20)] + [(200 + i, text_of(rng, 40)) for i in range(20)]
    got = {(r.rec_id_a, r.rec_id_b) for r in near_duplicates.near_duplicate_pairs(spark.createDataFrame(rows, "id long, t string"), "id", "t").collect()}
    assert got == brute(rows, 0.5, 8)


def test_near_duplicates_of_nothing(spark):
    empty = spark.createDataFrame([], "id long, t string")
    assert near_duplicates.near_duplicate_pairs(empty, "id", "t").count() == 0
    assert near_duplicates.near_duplicate_groups(empty, "id", "t").count() == 0


def records(spark, rows):
    return spark.createDataFrame(rows, "rec_id long, pair_id string, split string, source string, text string")


def test_cross_split(spark, texts):
    own = [(i, t) for i, t in texts]
    split = {i: ("train", "val", None, "test", "train")[i % 5] for i, _ in own}
    df = records(spark, [(i, f"p{i}" if i % 2 else None, split[i] if not i % 2 else None, None if i == 3 else "s", t) for i, t in own])
    manifest = spark.createDataFrame([({"train": [f"p{i}" for i in split if split[i] == "train"] * 2, "val": [f"p{i}" for i in split if split[i] == "val"] + ["gone"], "test": [f"p{i}" for i in split if split[i] == "test"]},)], "splits map<string, array<string>>")
    got = {tuple(sorted((r.train_id, r.eval_id))) for r in cross_split.cross_split_pairs(df, manifest).collect()}
    want = {(a, b) for a, b in brute(own, 0.5, 50) if {split[a] == "train", split[b] == "train"} == {True, False} and split[a] and split[b]}
    assert got == want and want
    report = cross_split.overlap_report(cross_split.cross_split_pairs(df, manifest)).collect()
    assert sum(r.pairs for r in report) == len(want)


def test_cross_split_of_nothing(spark):
    rng = random.Random(1)
    assert cross_split.cross_split_pairs(records(spark, [])).count() == 0
    one_sided = records(spark, [(i, None, "train", "s", text_of(rng, 60)) for i in range(3)])
    assert cross_split.cross_split_pairs(one_sided).count() == 0


def test_truncation(spark):
    rng = random.Random(7)
    rows, cut = [], set()
    for i in range(400):
        body = " ".join(text_of(rng, rng.randrange(5, 15)).capitalize() + "." for _ in range(rng.randrange(3, 12)))
        if i % 8 == 0:
            body = (body + " " + text_of(rng, 400))[:500]
            cut |= {i} if body.rstrip()[-1].isalpha() else set()
        elif i % 8 == 1:
            body += rng.choice(["\n\nThank you for reading", "\n\n***", " 🙂", f"\n\n[draft {i}]", "\n\n* one thing\n* another thing", "\n\nTopic: <topic>", "\n\n— The End", f"\n\nSee also sheet {i} below"])
        elif i % 8 == 2 and i % 3:
            body += " And then the"
            cut.add(i)
        rows.append((i, body, "limited" if i % 8 == 0 or i % 2 else "free"))
    rows += [(900, None, "free"), (901, "", None), (902, "N/A", "free"), (903, "A broken sign�", None)]
    cut.add(903)
    df = spark.createDataFrame(rows, "id long, t string, s string")
    got = truncation.truncated(df, "id", "t", "s")
    flagged = {r.rec_id: r.kind for r in got.where("kind is not null").collect()}
    assert cut <= set(flagged) and len(set(flagged) - cut) <= 2
    limits = [k for i, k in flagged.items() if i % 8 == 0 and i < 400]
    assert set(limits) == {"field_limit"} and flagged[903] == "transfer"
    rates = {r.source: r for r in truncation.truncation_rates(got).collect()}
    assert rates[None].texts == 2 and rates["limited"].at_field_limit == len(limits)
    assert truncation.truncated(df.where("id < 0"), "id", "t", "s").count() == 0


def test_stable_sample(spark):
    rows = [(i, None if i % 7 == 0 else f"t{i % 300}", "" if i % 7 else f"p{i}", None) for i in range(900)]
    df = spark.createDataFrame(rows, "rec_id long, topic string, input_prompt string, n_rows string").withColumn("output_prompt", F.col("input_prompt"))
    key = ["topic", "input_prompt", "output_prompt"]
    full = {r.sample_key: r for r in sampling.stable_sample_of_keys(df, key, 0.3, "rec_id").collect()}
    part = {r.sample_key for r in sampling.stable_sample_of_keys(df.where("rec_id < 500").repartition(7), key, 0.3, "rec_id").collect()}
    assert part <= set(full)
    lower = {r.sample_key for r in sampling.stable_sample_of_keys(df, key, 0.1, "rec_id").collect()}
    assert lower <= set(full) and 0.2 < len(full) / df.select(*key).distinct().count() < 0.4
    assert sampling.stable_sample(df, key, 1.0).count() == 900 and sampling.stable_sample(df, key, 0.0).count() == 0
    by_key = df.groupBy(*key).count().collect()
    assert {(r.topic, r.input_prompt): r.n_rows for r in full.values()}.items() <= {(r.topic, r.input_prompt): r["count"] for r in by_key}.items()
    nulls = spark.createDataFrame([(1, None, "-"), (2, "-", None), (3, None, "-")], "id long, a string, b string")
    assert sampling.stable_sample(nulls, ["a", "b"], 1.0).select("sample_key").distinct().count() == 2


def test_segmentation(spark):
    rng = random.Random(2)
    long = " ".join(text_of(rng, 9).capitalize() + "." for _ in range(400))
    df = spark.createDataFrame([(1, long), (2, "x" * 6000), (3, "é" * 6001), (4, None), (5, ""), (6, long)], "rec_id long, text string").withColumn("piece", F.lit("clash"))
    got = segmentation.split_oversized(df, "rec_id", "text").collect()
    assert {r.rec_id for r in got} == {1, 3, 6}
    own = sorted((r.piece, r.start, r.end, r.text) for r in got if r.rec_id == 1)
    assert all(t == long[a:b] and b - a <= 6000 for _, a, b, t in own) and own[-1][2] == len(long)
    assert all(0 < b - c <= 200 for (_, _, b, _), (_, c, _, _) in zip(own, own[1:]))
    assert all(t.rstrip().endswith(".") for *_, t in own)
    assert own == sorted((r.piece, r.start, r.end, r.text) for r in got if r.rec_id == 6)


def test_pair_defects(spark):
    en = "Write about the mill and the sea in the valley, with the wind on it and a rope for the boats."
    fr = "Le moulin est dans la vallée et la mer ne se voit pas, mais les cordes sont pour le bateau."
    done = "The sea is in the valley and the rope is old, so the boats of the mill are in the wind."
    rows = [
        (1, en, done, done, fr), (2, en, None, "", "N/A"), (3, None, fr, done, "The sea is in the"), (4, en, en + " Sure.", "Sorry, I am not able to help with it.", done),
        (5, en, "Use it well.\n\nTopic: <topic>", '"I cannot help," said the miller of the valley.', None), (1, en, done, done, fr), (6, "hi", "hi", "go now.", "x."),
    ]
    df = spark.createDataFrame(rows, "rec_id long, input_prompt string, output_prompt string, baseline_essay string, best_essay string").withColumn("defect", F.lit(0)).withColumn("field", F.lit(0))
    got = sorted((r.rec_id, r.field, r.defect) for r in pair_defects.pair_defects(df).collect())
    assert got == sorted(
        [(1, "best_essay", "other_language"), (1, "best_essay", "other_language"), (2, "baseline_essay", "empty"), (2, "best_essay", "empty"), (3, "best_essay", "truncated"), (4, "output_prompt", "copy"), (4, "baseline_essay", "refusal"), (6, "output_prompt", "copy")]
    )
    assert pair_defects.pair_defects(df.where("rec_id < 0")).count() == 0


def test_packing(spark, tmp_path):
    counts = spark.createDataFrame([(i, n) for i, n in enumerate([5000, 2048, 2049, 0, 0, 100, 1948, 30, 4096] + [700] * 40)], "doc_id long, n_tokens long")
    got = packing.pack(counts, group_size=20).collect()
    used = {}
    for r in got:
        used[r.container] = used.get(r.container, 0) + r.n_tokens
    assert max(used.values()) <= 2048 and sum(used.values()) == counts.agg(F.sum("n_tokens")).first()[0]
    pieces = {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r.n_tokens)
    assert sorted(pieces[0]) == [904, 2048, 2048] and sorted(pieces[8]) == [2048, 2048] and len(pieces) == 49 and pieces[3] == [0]
    assert packing.fill_report(packing.pack(counts)).first()["items"] == len(got)
    assert packing.pack(counts.where("doc_id < 0")).count() == 0


def test_token_counts(spark):
    import os

    if not os.path.exists(packing.TOKENIZER):
        pytest.skip("no tokenizer files")
    df = spark.createDataFrame([(1, "Hello world"), (2, ""), (3, None), (4, "<|endoftext|>")], "id long, t string")
    got = {r.doc_id: r.n_tokens for r in packing.token_counts(df, "id", "t").collect()}
    assert (got[1], got[2], got[3]) == (2, 0, 0) and got[4] > 1


def test_leaks(spark):
    rng = random.Random(9)
    item = text_of(rng, 40).split()
    filler = lambda n: text_of(rng, n).split()
    docs = [
        (1, filler(50) + item + filler(50)), (2, filler(20) + item[5:17] + filler(5)), (3, filler(20) + item[5:16] + filler(5)),
        (4, filler(9) + item[:11] + ["edit"] + item[11:22] + ["edit"] + item[22:33] + filler(9)), (5, filler(80)), (6, item[:12]), (6, item[:12]),
    ]
    rows = [(i, " ".join(w).upper().replace("A", "Á") if i == 1 else ", ".join(w)) for i, w in docs] + [(7, None), (8, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    items = spark.createDataFrame([(1, " ".join(item)), (2, text_of(rng, 30)), (3, "too short"), (4, None)], "item_id long, text string")
    got = leaks.leaks(df, items).collect()
    assert sorted((r.doc_id, r.item_id) for r in got if r.contains) == [(1, 1), (2, 1), (6, 1), (6, 1)]
    edited_only = {r.doc_id: r for r in got if not r.contains}
    assert edited_only[4].longest_run == 11 and edited_only[4].matched >= 33
    assert {(r.doc_id, r.item_id, r.score) for r in leaks.leaks_in_blocks(df, items, block_chars=600).collect()} == {(r.doc_id, r.item_id, r.score) for r in got}
    assert leaks.leaks(df, items.where("item_id > 2")).count() == 0 and leaks.leaks(df.where("doc_id > 90"), items).count() == 0
    assert leaks.leak_report(leaks.leaks(df, items)).first().documents == 4


def test_grouped_splits(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"t{i % 97}", None if i % 2 else f"a{i % 11}") for i in range(900)] + [(i, None, None) for i in range(900, 930)]
    df = spark.createDataFrame(rows, "rec_id long, topic string, author string").withColumn("component", F.lit("clash")).withColumn("split", F.lit("clash"))
    got = splits.grouped_splits(df, "rec_id", ["topic"])
    by = got.join(df.select("rec_id", "topic"), "rec_id").where("topic is not null").groupBy("topic").agg(F.countDistinct("split").alias("n"))
    assert by.where("n > 1").count() == 0 and got.count() == 930
    shares = {r.split: r.share for r in splits.split_shares(got).collect()}
    assert abs(shares["train"] - 0.7) < 0.02 and abs(shares["val"] - 0.15) < 0.02
    both = splits.components(df, "rec_id", ["topic", "author"])
    assert both.where("rec_id < 900").select("component").distinct().count() < 60 and both.where("rec_id >= 900").select("component").distinct().count() == 30
    assert splits.grouped_splits(df.where("rec_id < 0"), "rec_id", ["topic"]).count() == 0


def test_components_of_chains(spark):
    rows = [(i, f"a{i // 2}", f"b{(i + 1) // 2}") for i in range(60)] + [(100, "z", None), (101, "z", "y")]
    got = splits.components(spark.createDataFrame(rows, "id long, a string, b string"), "id", ["a", "b"]).collect()
    of = {r.id: r.component for r in got}
    assert len({of[i] for i in range(60)}) == 1 and of[100] == of[101] != of[0]


def test_many_buckets_of_components(spark):
    weights = spark.range(700).select(F.col("id").alias("component"), (F.col("id") % 13 + 1).alias("weight"))
    got = splits.balanced_bins(weights, bins=7, bucket_size=20)
    sums = [r.w for r in got.groupBy("bin").agg(F.sum("weight").alias("w")).collect()]
    assert got.count() == 700 and len(sums) == 7 and max(sums) - min(sums) <= 13


def test_broken_groups(spark):
    rows = [(5, "The Mill", "train"), (3, "mill_", None), (9, "mill", "val"), (1, None, "train"), (2, None, "val"), (4, "sea", "train"), (6, "sea", "train"), (7, " ", "val"), (8, "", "train")]
    df = splits.with_name_key(spark.createDataFrame(rows, "rec_id long, topic string, split string"), "topic")
    got = splits.broken_groups(df, "rec_id", ["topic_key"], F.col("split")).collect()
    assert [(r.first_id, r.n_rows, r.splits) for r in got] == [(3, 3, ["train", "val"])]


FRENCH = ["L'élève préfère la forêt où l'été s'achève.", "Ça dépend du château près de l'église à côté.", "Le théâtre fermé là-bas répète l'œuvre du maître.", "Même ainsi, la vallée dépasse l'écluse à peine."]


def test_encoding(spark):
    rng = random.Random(5)
    clean = [" ".join(rng.sample(FRENCH, 3)) for _ in range(60)]
    rows = [(i, f"s{i % 2}", t) for i, t in enumerate(clean)]
    bad = {100: clean[0].encode().decode("cp1252", "replace"), 101: clean[1].encode().decode("mac_roman"), 102: clean[2].encode("latin-1", "replace").decode("cp437"), 103: clean[3].encode("utf-8").decode("latin-1"), 104: clean[4].encode("latin-1", "replace").decode("utf-8", "replace"), 105: "Plain text first. " + FRENCH[3].encode().decode("cp437"), 106: clean[1].encode().decode("mac_roman")}
    rows += [(i, None if i == 103 else "s0", t) for i, t in bad.items()]
    rows += [(200, "s0", None), (201, None, ""), (202, "s1", "├── drafts"), (203, "s1", "«книги», Λόγος"), (204, "s1", "caf&eacute; &amp; √44")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("repaired", F.lit(1))
    got = {r.doc_id: r for r in encoding.encoding_damage(df).collect()}
    assert set(got) == set(bad)
    assert got[101].repaired == clean[1] and got[103].repaired == clean[3] and got[105].repaired == "Plain text first. " + FRENCH[3] and got[106].repaired == got[101].repaired
    assert not got[104].restored and got[101].restored
    assert encoding.encoding_damage(df.where("doc_id < 0")).count() == 0
    assert sum(r.damaged for r in encoding.damage_report(encoding.encoding_damage(df)).collect()) == len(bad)
