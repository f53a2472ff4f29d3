"""Rounds over topics: carried state, early stop, resume after an interruption."""

from pyspark.sql import functions as F

from textloom.plans import round_loop, search_loop
from textloom.sources import builtin


def plug_ins():
    def write(candidates, few):
        n = few.count()
        return candidates.select("prompt_id", "topic", F.concat("user_template", F.lit(" "), "topic", F.repeat(F.lit(" word"), n)).alias("essay"))

    def mutate(places):
        return places.withColumn("prompt_id", F.concat("prompt_id", F.lit("-"), F.col("place").cast("string"))).withColumn("user_template", F.substring("user_template", 1, 40)).drop("place", "action")

    return write, mutate, lambda c: F.least(F.lit(1.0), F.length(c) / 150.0), lambda e, t: F.lit(0.5)


def test_rounds_resume_and_stop(spark, tmp_path):
    topics = spark.createDataFrame([("sea",), ("mill",), ("rope",), ("sea",)], "topic string")
    settings = round_loop.RoundSettings(rounds=4, topics_per_round=2, threshold=0.6, few_shot=2, pool_cap=3, search=search_loop.Settings(generations=2, population=3, keep=0.4, min_words=1, max_words=90))
    one = round_loop.RoundSettings(**{**settings.__dict__, "rounds": 1})
    folder = tmp_path.as_uri()
    assert round_loop.run_rounds(spark, topics, builtin.prompts(spark), *plug_ins(), folder, one).count() == 1
    first = spark.read.parquet(f"{folder}/essays/round=0").count()
    got = round_loop.run_rounds(spark, topics, builtin.prompts(spark), *plug_ins(), folder, settings).collect()
    assert [r["round"] for r in got] == [0, 1, 2] and all(r.n_topics == 2 and r.n_essays > 0 for r in got)  # two rounds without a gain end the run
    assert spark.read.parquet(f"{folder}/essays/round=0").count() == first
    pool = spark.read.parquet(f"{folder}/pool/round=2").collect()
    assert 0 < len(pool) <= 3 and all(r.slop_score < 0.6 for r in pool)
    before, after = ({r.topic: r.slop_score for r in spark.read.parquet(f"{folder}/passages/round={n}").collect()} for n in (1, 2))
    assert before and all(after[t] <= s for t, s in before.items())
    assert spark.read.parquet(f"{folder}/pairs/round=0").where("improvement > 0").count() == 2
