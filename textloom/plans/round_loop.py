"""Rounds of prompt search over many topics, with the state that is carried from round to round.

Each round draws its topics, searches prompts for each, and writes five tables under its number: the essays of all
trials, the pairs that it logs, the pool of lowest scored essays, the topics' best passages so far, and a summary. A round reads only what
the rounds before it wrote, so a run that was interrupted goes on at the first round without a summary, and a
round that is run again gives the same tables. Rounds and topics a round are parameters; everything inside is declared
over DataFrames.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import rounds, selection
from textloom.plans import search_loop
from textloom.sources.files import exists

#: (candidates with their topic, few-shot texts) -> (prompt_id, topic, essay)
Write = Callable[[DataFrame, DataFrame], DataFrame]
POOL = "essay string, slop_score double, round int, topic string, ordinal string"
PASSAGES = "topic string, source_passage string, slop_score double, round int"


@dataclass(frozen=True)
class RoundSettings:
    rounds: int = 5
    topics_per_round: int = 20
    threshold: float = 0.5
    patience: int = 2
    epsilon: float = 0.02
    few_shot: int = 5
    pool_cap: int = 50
    seed: int = 42
    search: search_loop.Settings = field(default_factory=search_loop.Settings)


def summaries(spark: SparkSession, folder: str, upto: int) -> DataFrame | None:
    """The summaries of the rounds before ``upto`` that have been written, in order."""
    done = [f"{folder}/summary/round={r}" for r in range(upto) if exists(spark, f"{folder}/summary/round={r}/_SUCCESS")]
    return spark.read.parquet(*done).orderBy("round") if done else None


def _before(spark: SparkSession, folder: str, name: str, number: int, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{folder}/{name}/round={number - 1}") if number else spark.createDataFrame([], schema)


def one_round(spark: SparkSession, number: int, topics: DataFrame, seeds: DataFrame, write: Write, mutate: search_loop.Mutate, score: Callable[[Column], Column], similarity: Callable[[Column, Column], Column], folder: str, settings: RoundSettings) -> None:
    """One round, its tables written; the summary comes last."""
    place = lambda name: f"{folder}/{name}/round={number}"
    pool = _before(spark, folder, "pool", number, POOL)
    drawn = [r.topic for r in selection.hash_sample(topics.select("topic").distinct(), settings.topics_per_round, settings.seed + number, "topic").collect()]
    few = selection.fewshot_texts(pool, settings.few_shot).select("essay")
    essays = pairs = None
    for topic in drawn:
        every, ranked = search_loop.optimise(seeds, lambda c, topic=topic: write(c.withColumn("topic", F.lit(topic)), few), mutate, score, similarity, settings.search)
        winners = rounds.best_ever(ranked.where("ok").withColumn("topic", F.lit(topic)), ["topic"], "fitness", "prompt_id")
        lowest = every.where("constraint_ok").groupBy("topic").agg(F.min("slop_score").alias("output_slop_score"), F.min_by("essay", F.struct("slop_score", "essay")).alias("best_essay"))
        logged = winners.select("topic", "prompt_id", "fitness").join(lowest, "topic").withColumn("input_slop_score", F.lit(1.0))
        own = every.select("topic", "prompt_id", "essay", "slop_score", "constraint_ok")
        essays, pairs = (own, logged) if essays is None else (essays.unionByName(own), pairs.unionByName(logged))
    if essays is None:
        essays = spark.createDataFrame([], "topic string, prompt_id string, essay string, slop_score double, constraint_ok boolean")
        pairs = spark.createDataFrame([], "topic string, prompt_id string, fitness double, output_slop_score double, best_essay string, input_slop_score double")
    essays.withColumn("round", F.lit(number)).write.mode("overwrite").parquet(place("essays"))
    pairs.withColumn("round", F.lit(number)).withColumn("improvement", F.col("input_slop_score") - F.col("output_slop_score")).write.mode("overwrite").parquet(place("pairs"))
    essays = spark.read.parquet(place("essays"))
    fooled = essays.where(F.col("constraint_ok") & (F.col("slop_score") < settings.threshold)).withColumn("ordinal", F.sha2("essay", 256))
    fresh = selection.top_k(fooled, settings.few_shot, F.col("slop_score").asc(), F.col("ordinal").asc()).select("essay", "slop_score", "round", "topic", "ordinal")
    selection.pool_merge(pool, fresh, settings.pool_cap).select("essay", "slop_score", "round", "topic", "ordinal").write.mode("overwrite").parquet(place("pool"))
    passages = _before(spark, folder, "passages", number, PASSAGES).unionByName(fooled.select("topic", F.col("essay").alias("source_passage"), "slop_score", "round"))
    best = passages.groupBy("topic").agg(F.min(F.struct("slop_score", "round", "source_passage")).alias("m"))  # an earlier passage stays unless a later one is lower
    best.select("topic", "m.source_passage", "m.slop_score", "m.round").write.mode("overwrite").parquet(place("passages"))
    made = essays.where("constraint_ok").agg(F.min("slop_score").alias("best_score"), F.avg("slop_score").alias("mean_score"), F.count_if(F.col("slop_score") < settings.threshold).alias("n_fooled"), F.count("*").alias("n_essays"))
    made.select(F.lit(number).alias("round"), "best_score", "mean_score", "n_fooled", "n_essays", F.lit(len(drawn)).alias("n_topics")).coalesce(1).write.mode("overwrite").parquet(place("summary"))


def run_rounds(spark: SparkSession, topics: DataFrame, seeds: DataFrame, write: Write, mutate: search_loop.Mutate, score: Callable[[Column], Column], similarity: Callable[[Column, Column], Column], folder: str, settings: RoundSettings = RoundSettings()) -> DataFrame | None:
    """The summaries of all rounds, those of an earlier run included. Stops when the best score no longer falls."""
    for number in range(settings.rounds):
        if not exists(spark, f"{folder}/summary/round={number}/_SUCCESS"):
            one_round(spark, number, topics, seeds, write, mutate, score, similarity, folder, settings)
        so_far = summaries(spark, folder, number + 1)
        last = rounds.plateau(so_far.withColumn("run", F.lit(0)), ["run"], "round", "best_score", settings.patience, settings.epsilon).where(F.col("round") == number).first()
        if last and last.stop:
            break
    return summaries(spark, folder, settings.rounds)
