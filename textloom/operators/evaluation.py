"""Evaluation of scores: threshold sweeps, F1, ROC AUC, statistics, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.vectors import linspace


def _f1(tp: Column, fp: Column, fn: Column) -> Column:
    return F.coalesce(F.try_divide(2.0 * tp, 2.0 * tp + fp + fn), F.lit(0.0))


def score_histogram(df: DataFrame, label: str, score: str) -> DataFrame:
    """(label, score, n): the only thing a sweep needs of the rows, pre-aggregated."""
    return df.where(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(F.col(label).alias("y"), F.col(score).alias("s")).agg(F.count("*").alias("n"))


def threshold_sweep(df: DataFrame, label: str, score: str, low: float = 0.05, high: float = 0.95, steps: int = 181) -> DataFrame:
    """(threshold, macro_f1, accuracy) of the rule score >= threshold against a 0/1 label, at each grid threshold.

    Every row is first reduced to the number of grid thresholds it reaches, so at most ``2 * (steps + 1)``
    counts are left; the confusion counts of all thresholds are running sums over these. The grid is a
    literal array: no join of rows with thresholds.
    """
    spark = df.sparkSession
    grid = linspace(low, high, steps)
    reached = F.size(F.filter(F.array(*map(F.lit, grid)), lambda t: t <= F.col("s")))
    counted = score_histogram(df, label, score).groupBy("y", reached.alias("r")).agg(F.sum("n").alias("n"))
    thresholds = spark.createDataFrame([(i + 1, t) for i, t in enumerate(grid)], "i int, threshold double")
    by = counted.groupBy("r").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("pos"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("neg"))
    pairs = thresholds.join(F.broadcast(by), F.col("r") >= F.col("i"), "left").groupBy("i", "threshold").agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("tp"), F.coalesce(F.sum("neg"), F.lit(0)).alias("fp"))
    totals = by.agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("p"), F.coalesce(F.sum("neg"), F.lit(0)).alias("q"))
    c = pairs.join(F.broadcast(totals))
    fn, tn = F.col("p") - F.col("tp"), F.col("q") - F.col("fp")
    return c.select("threshold", _macro([_class_f1(F.col("tp"), F.col("fp"), fn), _class_f1(tn, fn, F.col("fp"))]).alias("macro_f1"), F.coalesce(F.try_divide((F.col("tp") + tn).cast("double"), (F.col("p") + F.col("q")).cast("double")), F.lit(0.0)).alias("accuracy"))


def _class_f1(tp: Column, fp: Column, fn: Column) -> Column:
    """F1 of a class, null if it is neither in the labels nor in the predictions."""
    return F.when(tp + fp + fn > 0, _f1(tp, fp, fn))


def _macro(parts: list[Column]) -> Column:
    present = [F.when(p.isNotNull(), 1).otherwise(0) for p in parts]
    total, n = F.lit(0.0), F.lit(0)
    for p, q in zip(parts, present):
        total, n = total + F.coalesce(p, F.lit(0.0)), n + q
    return F.coalesce(F.try_divide(total, n.cast("double")), F.lit(0.0))


def ternary_grid() -> list[tuple[int, float, float]]:
    """The 625 pairs (t_low, t_high), in the order they are tried."""
    return [(i * 25 + j, lo, hi) for i, lo in enumerate(linspace(0.15, 0.55, 25)) for j, hi in enumerate(linspace(lo + 0.1, 0.9, 25))]


def ternary_sweep(df: DataFrame, label: str, score: str) -> DataFrame:
    """(i, t_low, t_high, macro_f1) of the three-way rule below t_low / from t_low / from t_high at each grid pair.

    All thresholds of the grid together cut the line into at most 651 stretches; rows are reduced to counts per
    (label, stretch), and only these counts meet the 625 pairs.
    """
    spark = df.sparkSession
    grid = ternary_grid()
    cuts = sorted({x for _, lo, hi in grid for x in (lo, hi)})
    reached = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda t: t <= F.col("s")))
    counted = score_histogram(df, label, score).groupBy("y", reached.alias("r")).agg(F.sum("n").alias("n"))
    place = {t: k + 1 for k, t in enumerate(cuts)}
    pairs = spark.createDataFrame([(i, lo, hi, place[lo], place[hi]) for i, lo, hi in grid], "i int, t_low double, t_high double, k_low int, k_high int")
    predicted = F.when(F.col("r") >= F.col("k_high"), 2).when(F.col("r") >= F.col("k_low"), 1).otherwise(0)
    joined = F.broadcast(pairs).join(counted).withColumn("z", predicted)
    sums = []
    for c in (0, 1, 2):
        mine, said = F.col("y") == c, F.col("z") == c
        for name, test in (("tp", mine & said), ("fp", ~mine & said), ("fn", mine & ~said)):
            sums.append(F.sum(F.when(test, F.col("n")).otherwise(0)).alias(f"{name}{c}"))
    each = joined.groupBy("i", "t_low", "t_high").agg(*sums)
    return each.select("i", "t_low", "t_high", _macro([_class_f1(F.col(f"tp{c}"), F.col(f"fp{c}"), F.col(f"fn{c}")) for c in (0, 1, 2)]).alias("macro_f1"))


def best_of_grid(sweep: DataFrame, score: str, *order: str) -> DataFrame:
    """The best row of a sweep; of equals the first in grid order."""
    return sweep.orderBy(F.col(score).desc(), *(F.col(o).asc() for o in order)).limit(1)


def confusion(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """(y, z, n) counts of label and prediction."""
    return df.groupBy(F.col(label).alias("y"), F.col(predicted).alias("z")).agg(F.count("*").alias("n"))


def macro_f1(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """One row: macro_f1 over the classes present in labels or predictions, accuracy, n."""
    counts = confusion(df, label, predicted)
    sides = counts.select(F.explode(F.expr("array(struct(y as c, if(y = z, n, 0L) as tp, 0L as fp, if(y = z, 0L, n) as fn), struct(z as c, 0L as tp, if(y = z, 0L, n) as fp, 0L as fn))")).alias("x")).select("x.*")
    per = sides.groupBy("c").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    both = per.agg(F.avg(_f1(F.col("tp"), F.col("fp"), F.col("fn"))).alias("macro_f1"), F.sum("tp").alias("_right"), F.sum(F.col("tp") + F.col("fn")).alias("n"))
    return both.select("macro_f1", (F.col("_right") / F.col("n")).alias("accuracy"), "n")


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """One row (auc, n_pos, n_neg): the rank-sum AUC with average ranks for ties; NaN with one class only.

    Rows are reduced to counts per distinct score; ranks are running sums over ranges of scores, of which each
    task takes one, with the sums of the ranges before added (no single task sorts all scores).
    """
    per = score_histogram(df, label, score).groupBy("s").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("p"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("q"))
    ranged = per.withColumn("_b", F.greatest(F.lit(0), F.least(F.lit(1024), F.floor(F.col("s") * 1024))))  # scores outside of [0, 1] share the outer ranges
    sizes = ranged.groupBy("_b").agg(F.sum("q").alias("_q"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_b", F.coalesce(F.sum("_q").over(before), F.lit(0)).alias("_before"))
    below = F.coalesce(F.sum("q").over(Window.partitionBy("_b").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wins = ranged.withColumn("_in", below).join(F.broadcast(offsets), "_b").withColumn("_w", F.col("p") * (F.col("_before") + F.col("_in") + F.col("q") / 2.0))
    out = wins.agg(F.coalesce(F.sum("_w"), F.lit(0.0)).alias("_w"), F.coalesce(F.sum("p"), F.lit(0)).alias("n_pos"), F.coalesce(F.sum("q"), F.lit(0)).alias("n_neg"))
    return out.select(F.coalesce(F.try_divide(F.col("_w"), (F.col("n_pos") * F.col("n_neg")).cast("double")), F.lit(float("nan"))).alias("auc"), "n_pos", "n_neg")


def score_stats(df: DataFrame, score: str, threshold: float, *by: str) -> DataFrame:
    """count, mean, median, min, max, sample deviation (0 for one value) and share below a threshold; nulls for none.

    Everything is computed from counts per distinct score, so the exact median never gathers the rows of a group.
    """
    per = df.groupBy(*by, F.col(score).cast("double").alias("_s")).agg(F.count("*").alias("_n"))
    s, n = F.col("_s"), F.when(F.col("_s").isNotNull(), F.col("_n")).otherwise(0)
    out = per.groupBy(*by).agg(
        F.sum(n).alias("n"), F.sum(s * n).alias("_sum"), F.sum(s * s * n).alias("_squares"), F.percentile("_s", 0.5, F.col("_n")).alias("median"),
        F.min(s).alias("min"), F.max(s).alias("max"), F.sum(F.when(s < threshold, n).otherwise(0)).alias("_below"),
    )
    total = F.col("n").cast("double")
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("_squares") - F.col("_sum") * F.col("_sum") / total) / (total - 1))
    stdev = F.when(F.col("n") == 1, 0.0).when(F.col("n") > 1, spread)
    return out.select(*by, "n", F.try_divide(F.col("_sum"), total).alias("mean"), "median", "min", "max", stdev.alias("stdev"), F.try_divide(F.col("_below").cast("double"), total).alias("share_below"))


def run_summary(df: DataFrame, score: str, **means: str) -> DataFrame:
    """One row: mean and population deviation of the score, and the means of further columns, NaN where there is nothing."""
    nan = F.lit(float("nan"))
    return df.agg(F.coalesce(F.avg(score), nan).alias("mean_score"), F.coalesce(F.stddev_pop(score), nan).alias("std_score"), *(F.coalesce(F.avg(c), nan).alias(name) for name, c in means.items()))


def histogram(df: DataFrame, score: str, bins: int = 10) -> DataFrame:
    """(bin, n) of the non-empty bins, labelled [low,high); 1.0 and more go to the last, negatives to the first."""
    b = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(F.col(score) * bins)))
    label = F.format_string("[%.1f,%.1f)", b / float(bins), (b + 1) / float(bins))
    return df.where(F.col(score).isNotNull()).groupBy(label.alias("bin")).agg(F.count("*").alias("n"))


def counts_below(df: DataFrame, score: str, *thresholds: float) -> DataFrame:
    """One row: how many scores lie below each threshold."""
    return df.agg(F.count("*").alias("n"), *(F.count_if(F.col(score) < t).alias(f"below_{int(round(t * 100)):02d}") for t in thresholds))


def label_balance(df: DataFrame, label: str, enough: int = 2000) -> DataFrame:
    """One row: rows of label 0 and 1, the number of pairs they can make, and whether that is enough."""
    human, machine = F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)
    return df.agg(human.alias("n_human"), machine.alias("n_ai"), F.least(human, machine).alias("n_pairs"), (F.least(human, machine) >= enough).alias("enough"))


def percent_improvement(df: DataFrame, before: str, after: str) -> DataFrame:
    """``df`` with the improvement of each row in percent; null where there was nothing to improve."""
    return df.withColumn("improvement_pct", F.try_divide((F.col(before) - F.col(after)) * 100.0, F.col(before)))
