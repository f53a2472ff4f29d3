"""The prompt search as a driver over DataFrames: generations within a round, rounds with carried state.

Text generation and mutation are plugged in as functions from a DataFrame to a DataFrame (usually ``mapInPandas``);
everything between them is declared here.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators import rounds, rows, selection
from textloom.session import materialise

#: candidates (prompt_id, system_prompt, user_template, style_instructions, …) -> (prompt_id, topic, essay)
Generate = Callable[[DataFrame], DataFrame]
#: places (place, action, prompt_id of the parent, …) -> candidates
Mutate = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Settings:
    generations: int = 3
    population: int = 6
    keep: float = 0.2
    similarity_weight: float = 0.3
    min_words: int = 150
    max_words: int = 2000
    seed: int = 42


def trials(candidates: DataFrame, generate: Generate, score: Callable[[Column], Column], similarity: Callable[[Column, Column], Column], settings: Settings, generation: int) -> DataFrame:
    """A row per generated essay: its constraint, score and similarity (1 and 0 where a constraint failed)."""
    essays = generate(candidates).withColumn("essay_no", F.monotonically_increasing_id())
    judged = essays.withColumn("constraint_reason", rows.constraint(F.col("essay"), min_words=settings.min_words, max_words=settings.max_words))
    ok = F.col("constraint_reason") == "ok"
    scored = judged.withColumn("constraint_ok", ok).withColumn("raw_score", score(F.col("essay"))).withColumn("similarity", similarity(F.col("essay"), F.col("topic")))
    value, near = rows.penalised(F.col("constraint_ok"), F.col("raw_score"), F.col("similarity"))
    return scored.withColumn("slop_score", value).withColumn("similarity", near).withColumn("generation", F.lit(generation))


def next_places(ranked: DataFrame, settings: Settings, generation: int) -> DataFrame:
    """The free places of the next population: what each is filled with, and the survivor that it starts from."""
    spark = ranked.sparkSession
    survivors = selection.top_k(ranked, max(1, int(settings.population * settings.keep)), F.col("fitness").desc(), F.col("prompt_id").asc()).select("prompt_id")
    free = settings.population - survivors.count()
    places = selection.refill_plan(spark.range(max(0, free)).select((F.col("id") + 1000 * generation).alias("place")), settings.seed, "place")
    return rounds.round_robin(spark, survivors, max(0, free), "prompt_id").select((F.col("place") + 1000 * generation).alias("place"), "prompt_id").join(places, "place")


def optimise(seeds: DataFrame, generate: Generate, mutate: Mutate, score: Callable[[Column], Column], similarity: Callable[[Column, Column], Column], settings: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """(all trials, candidates with their fitness per generation) of one topic's search. Survivors stay in the population."""
    population = rounds.round_robin(seeds.sparkSession, seeds, settings.population, "prompt_id").drop("place").dropDuplicates(["prompt_id"])
    every, ranked_all = None, None
    for generation in range(settings.generations):
        made = materialise(trials(population, generate, score, similarity, settings, generation))
        ranked = rounds.candidate_means(made, ["prompt_id"], "slop_score", "raw_score", "similarity", "constraint_ok", settings.similarity_weight).withColumn("generation", F.lit(generation))
        ranked = materialise(ranked)
        every = made if every is None else every.unionByName(made)
        ranked_all = ranked if ranked_all is None else ranked_all.unionByName(ranked)
        if generation + 1 < settings.generations:
            places = next_places(ranked, settings, generation + 1)
            kept = selection.top_k(ranked, max(1, int(settings.population * settings.keep)), F.col("fitness").desc(), F.col("prompt_id").asc())
            survivors = population.join(kept.select("prompt_id"), "prompt_id", "left_semi")
            children = mutate(places.join(population, "prompt_id"))
            population = materialise(survivors.unionByName(children.select(*survivors.columns)).dropDuplicates(["prompt_id"]))
    return every, ranked_all


def improving_pairs(every: DataFrame, ranked: DataFrame, prompts: DataFrame, round_: int, at_least: float = 0.05) -> DataFrame:
    """Pairs of each trajectory (best candidate per generation) whose score falls by at least ``at_least``."""
    best = rounds.best_ever(ranked.where("ok").withColumn("run", F.lit(round_)), ["run", "generation"], "fitness", "prompt_id")
    pairs = rounds.trajectory_pairs(best, ["run"], "generation", "prompt_id", "mean_score")
    text = prompts.select("prompt_id", "user_template").dropDuplicates(["prompt_id"])
    named = pairs.join(text.select(F.col("prompt_id").alias("parent"), F.col("user_template").alias("input_prompt")), "parent", "left").join(text.select(F.col("prompt_id").alias("child"), F.col("user_template").alias("output_prompt")), "child", "left")
    gained = named.withColumn("improvement", F.col("parent_score") - F.col("child_score"))
    return rows.improving(gained, "improvement", at_least).select(F.lit(round_).alias("round"), "input_prompt", "output_prompt", F.col("parent_score").alias("input_slop_score"), F.col("child_score").alias("output_slop_score"), "improvement", "kind")
