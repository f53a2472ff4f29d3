import pandas as pd
import pytest
from pyspark.sql import functions as F

from textloom.functions import models
from textloom.operators import rows
from textloom.plans import search_loop
from textloom.sources import builtin


def loaders():
    """Loaders made here travel to the workers by value; this module isn't there."""

    def length_model():
        return lambda texts: [min(1.0, len(t) / 100) for t in texts]

    def bucket_model():
        return lambda texts: [[0.25, 0.75] if t else [1.0, 0.0] for t in texts]

    return length_model, bucket_model


def test_plugged_scores(spark):
    df = spark.createDataFrame([(1, "x" * 50), (2, None), (3, "x" * 200)], "id long, t string").repartition(2)
    got = {r.id: r.s for r in df.select("id", models.scores(loaders()[0], 2)("t").alias("s")).collect()}
    assert got == {1: 0.5, 2: 0.0, 3: 1.0}
    p = models.probabilities(loaders()[1])("t")
    got = {r.id: (r.e, r.m) for r in df.select("id", p.alias("p")).select("id", models.decoded(F.col("p")).alias("e"), models.decoded(F.col("p"), "top_bucket_prob").alias("m")).collect()}
    assert got[1] == (0.75, 0.75) and got[2] == (0.0, 1.0)
    with pytest.raises(ValueError):
        models.decoded(F.col("p"), "nope")


def test_document_scores(spark):
    df = spark.createDataFrame([(1, "aa " * 10), (2, "b")], "id long, t string")
    scorer = models.scores(loaders()[0])
    whole = {r.id: r.score for r in models.document_scores(df, "id", "t", scorer).collect()}
    assert whole[1] == 0.3 and whole[2] == 0.01
    by = {r.id: r for r in models.document_scores(df, "id", "t", scorer, chunked=True, window=4, stride=3, how="mean").collect()}
    assert by[1].n_chunks == 3 and by[1].max == 0.11 and by[1].score == pytest.approx(0.11) and by[2].n_chunks == 1
    assert {r.id: r.score for r in models.document_scores(df, "id", "t", scorer, chunked=True, window=4, stride=3, w_mean=0, w_max=0).collect()}[1] == by[1].mean


def test_stand_in_detector(spark):
    rng = [("the mill turns slowly " + "sea " * (i % 5), 0) for i in range(40)] + [("delve into the tapestry " + "sea " * (i % 5), 1) for i in range(40)]
    df = spark.createDataFrame(rng, "t string, y int")
    model = models.bag_of_words_detector(df, "t", "y", 1 << 10)
    from textloom.functions.text import word_tokens

    out = model.transform(df.select(word_tokens("t").alias("_w"), F.col("y").cast("double").alias("_y")))
    assert out.where("prediction = _y").count() == 80


def test_row_projections(spark):
    df = spark.createDataFrame([(" a ", 0.9, {"m": "0.5"}), (None, None, None)], "t string, s double, x map<string,string>")
    assert [r.essay for r in rows.essay_rows(df, "t").collect()] == ["a"]
    assert [(list(r.tokens or []), r.bucket) for r in rows.training_rows(df, "t", "s", 4).collect()][0] == (["a"], 3)
    assert rows.training_record(df.limit(1), {"t": "input_text", "s": "score"}, "rewrite: ").first().asDict() == {"input_text": "rewrite:  a ", "score": 0.9}
    nested = spark.createDataFrame([(1, ("0.5", 2)), (2, None), (3, ("n/a", 1))], "round int, st struct<mean:string, n:int>")
    assert [(r.mean, r.n) for r in rows.nested_fields(nested, mean="st.mean", n="st.n").orderBy("round").collect()] == [(0.5, 2.0), (None, None), (None, 1.0)]
    assert rows.held_out_or_head(df.where("1 = 0"), spark.range(25), F.col("id")).count() == 2
    essays = spark.createDataFrame([("organic", "a", "b"), ("alpaca", "a", "b"), ("organic", "", "b")], "source string, baseline_essay string, best_essay string")
    assert rows.usable_essays(essays, ["organic"]).count() == 1 and rows.usable_essays(essays).count() == 2


def test_search_loop(spark):
    settings = search_loop.Settings(generations=3, population=5, keep=0.4, min_words=1, max_words=50)
    columns = "prompt_id string, system_prompt string, user_template string, style_instructions string"

    def generate(candidates):
        return candidates.select("prompt_id", F.lit("rope").alias("topic"), F.concat_ws(" ", "system_prompt", "user_template").alias("essay"))

    def mutate(places):
        def shorter(batches):
            for b in batches:
                text = b["user_template"].str.slice(0, -3) + "."
                yield pd.DataFrame({"prompt_id": b["prompt_id"].str.slice(0, 6) + b["place"].astype(str), "system_prompt": b["system_prompt"], "user_template": text, "style_instructions": b["style_instructions"]})

        return places.mapInPandas(shorter, columns)

    every, ranked = search_loop.optimise(builtin.prompts(spark), generate, mutate, lambda c: F.least(F.lit(1.0), F.length(c) / 200.0), lambda e, t: F.lit(0.5), settings)
    sizes = {r.generation: r["count"] for r in every.groupBy("generation").count().collect()}
    assert sizes == {0: 5, 1: 5, 2: 5}
    best = {r.generation: r.b for r in ranked.groupBy("generation").agg(F.max("fitness").alias("b")).collect()}
    assert best[0] <= best[1] <= best[2] and best[2] > best[0]
    pairs = search_loop.improving_pairs(every, ranked, builtin.prompts(spark), 1, at_least=0.0)
    assert pairs.count() >= 1
