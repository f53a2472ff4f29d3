"""Round-over-round logic: plateaus, ratchets, trajectories, early stops, oversampling of recent rounds.

Every window is partitioned by a run (``run`` columns) and ordered by its rounds, of which a run has few.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators.selection import ranked_by_score, ranked_in_buckets


def plateau(df: DataFrame, run: Sequence[str], round_: str, best: str, patience: int = 2, epsilon: float = 0.02) -> DataFrame:
    """``df`` with ``stop``: whether the last ``patience`` improvements were all below epsilon."""
    w = Window.partitionBy(*run).orderBy(round_)
    gained = df.withColumn("_gain", F.lag(best).over(w) - F.col(best))
    last = w.rowsBetween(-(patience - 1), 0)
    full = F.count("_gain").over(last) == patience
    return gained.withColumn("stop", full & F.coalesce(F.every(F.col("_gain") < epsilon).over(last), F.lit(False))).drop("_gain")


def trajectory_pairs(df: DataFrame, run: Sequence[str], step: str, item: str, score: str) -> DataFrame:
    """(run, parent, child, parent_score, child_score, kind): neighbouring steps, and first to last, where the score falls."""
    w = Window.partitionBy(*run).orderBy(step)
    steps = df.select(*run, F.col(item).alias("parent"), F.lead(item).over(w).alias("child"), F.col(score).alias("parent_score"), F.lead(score).over(w).alias("child_score"), F.lit("step").alias("kind")).where("child is not null")
    ends = df.groupBy(*run).agg(F.min_by(F.struct(item, score), step).alias("a"), F.max_by(F.struct(item, score), step).alias("b"), F.count("*").alias("n")).where("n > 2")
    whole = ends.select(*run, F.col(f"a.{item}").alias("parent"), F.col(f"b.{item}").alias("child"), F.col(f"a.{score}").alias("parent_score"), F.col(f"b.{score}").alias("child_score"), F.lit("whole").alias("kind"))
    return steps.unionByName(whole).where("child_score < parent_score")


def ratchet(df: DataFrame, run: Sequence[str], order: str, score: str, block: int = 100_000) -> DataFrame:
    """Rows whose score is below every earlier one of their run.

    Runs may hold a large share of all rows (a hot topic), so each is first reduced within blocks of the order
    column, a number: a row that isn't lowest so far in its block can't be in its run. Few rows are left per block.
    """
    lowest = lambda d, *by: d.withColumn("_best", F.min(score).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))).where(F.col("_best").isNull() | (F.col(score) < F.col("_best"))).drop("_best")
    return lowest(lowest(df.withColumn("_block", F.floor(F.col(order) / block)), *run, "_block"), *run).drop("_block")


def best_so_far(df: DataFrame, run: Sequence[str], order: Sequence[str], score: str, patience: int) -> DataFrame:
    """``df`` with best (so far), waited (rounds since it was last improved) and stop (waited >= patience)."""
    w = Window.partitionBy(*run).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    marked = df.withColumn("best", F.min(score).over(upto)).withColumn("_n", F.row_number().over(w))
    before = F.min(score).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = marked.withColumn("_hit", F.when(before.isNull() | (F.col(score) < before), F.col("_n")))
    return marked.withColumn("waited", F.col("_n") - F.max("_hit").over(upto)).withColumn("stop", F.col("waited") >= patience).drop("_n", "_hit")


def best_ever(df: DataFrame, run: Sequence[str], fitness: str, *order: str) -> DataFrame:
    """The row of largest fitness of each run, the first of equals."""
    rank = F.row_number().over(Window.partitionBy(*run).orderBy(F.col(fitness).desc(), *(F.col(o).asc() for o in order)))
    return df.withColumn("_rn", rank).where("_rn = 1").drop("_rn")


def recency_oversample(df: DataFrame, round_: str, ordinal: str, weight: float = 1.5) -> DataFrame:
    """All rows, and the first floor(n * (weight - 1)) rows of the last round once more (``repeated``). The ordinal is a number."""
    last = df.agg(F.max(round_).alias("_last"))
    recent = df.join(F.broadcast(last), F.col(round_) == F.col("_last")).drop("_last")
    ranked = ranked_in_buckets(recent.withColumn("_all", F.lit(0)), ["_all"], F.floor(F.col(ordinal) / 100_000), F.col(ordinal).asc())
    more = ranked.where(F.col("rank") <= F.floor(F.col("n_all") * (weight - 1))).select(*df.columns)
    return df.withColumn("repeated", F.lit(False)).unionByName(more.withColumn("repeated", F.lit(True)))


def curriculum(df: DataFrame, by: Sequence[str], gap: str, ordinal: str) -> DataFrame:
    """``df`` with its rank by gap, largest first, stable."""
    ranked = ranked_by_score(df, by, gap, ordinal, descending=True)
    return ranked.withColumn("curriculum_rank", F.col("rank").cast("int")).drop("rank", "n_all")


def round_robin(spark, seeds: DataFrame, n: int, ordinal: str) -> DataFrame:
    """``n`` places filled with the seeds in turn. Seeds are a handful of prompts."""
    numbered = seeds.withColumn("_i", F.row_number().over(Window.orderBy(ordinal)) - 1)
    total = numbered.count()
    return spark.range(n).select(F.col("id").alias("place"), (F.col("id") % total).cast("int").alias("_i")).join(F.broadcast(numbered), "_i").drop("_i")


def time_to_result(df: DataFrame, run: Sequence[str], step: str, score: str, thresholds: Sequence[float]) -> DataFrame:
    """(run, threshold, step): the first step whose score is at or below each threshold."""
    reached = F.filter(F.array(*map(F.lit, thresholds)), lambda t: F.col(score) <= t)
    return df.select(*run, step, F.explode(reached).alias("threshold")).groupBy(*run, "threshold").agg(F.min(step).alias(step))


def candidate_means(df: DataFrame, by: Sequence[str], score: str, raw: str, similarity: str, ok: str, weight: float = 0.3) -> DataFrame:
    """Per candidate: means, whether any text failed, and fitness = -score + weight * similarity, -inf if failed."""
    from textloom.functions.drift import fitness

    means = df.groupBy(*by).agg(F.avg(score).alias("mean_score"), F.avg(raw).alias("mean_raw"), F.avg(similarity).alias("mean_sim"), F.bool_and(ok).alias("ok"))
    return means.withColumn("fitness", fitness(F.col("mean_score"), F.col("mean_sim"), ~F.col("ok"), weight))


def round_summary(df: DataFrame, round_: str, score: str, threshold: float) -> DataFrame:
    """Per round: best and mean score, texts below the threshold, and a struct of statistics."""
    per = df.groupBy(round_, F.col(score).alias("_s")).agg(F.count("*").alias("_n"))
    n = F.when(F.col("_s").isNotNull(), F.col("_n")).otherwise(0)
    mean = F.try_divide(F.sum(F.col("_s") * F.col("_n")), F.sum(n).cast("double"))
    return per.groupBy(round_).agg(
        F.min("_s").alias("best_score"), mean.alias("mean_score"), F.sum(F.when(F.col("_s") < threshold, F.col("_n")).otherwise(0)).alias("n_below"),
        F.struct(F.sum(n).alias("count"), mean.alias("mean"), F.percentile("_s", 0.5, F.col("_n")).alias("median"), F.min("_s").alias("min"), F.max("_s").alias("max")).alias("stats"),
    )


def call_budget(rounds: int, topics: int, population: int, generations: int, essays: int) -> dict[str, int]:
    """Calls of a search: essays, survivors of a generation, mutations at most, and their sum."""
    essay_calls = rounds * topics * population * generations * essays
    elite = max(1, population // 5)
    mutations = rounds * topics * max(0, generations - 1) * (population - elite)
    return {"essay_calls": essay_calls, "elite": elite, "mutations_at_most": mutations, "calls_at_most": essay_calls + mutations}


def amortisation(search_calls: int, held_out_rows: int) -> float:
    """Search calls per held-out row; infinite without any."""
    return search_calls / held_out_rows if held_out_rows else float("inf")
