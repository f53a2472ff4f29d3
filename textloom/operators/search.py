"""Searching drift coefficients over scored rows. The original search module isn't public; grid and sensitivity only."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def drift_grid(df: DataFrame, semantic: list[float], rouge: list[float], bertscore: list[float], threshold: float = 0.5, temperature: float = 40.0, score: str = "detector_slop") -> DataFrame:
    """(alpha_semantic, alpha_rouge, alpha_bertscore, fool_rate_hard, fool_rate_approx) for each combination.

    The grid is a literal array exploded per row (27 combinations), aggregated map-side: no join.
    """
    grid = [(float(a), float(b), float(c)) for a, b, c in product(semantic, rouge, bertscore)]
    literal = F.array(*(F.struct(F.lit(a).alias("alpha_semantic"), F.lit(b).alias("alpha_rouge"), F.lit(c).alias("alpha_bertscore")) for a, b, c in grid))
    each = df.select(score, "drift_semantic", "drift_rouge_l", "drift_bertscore", F.explode(literal).alias("g")).select("*", "g.*")
    x = F.col(score) + F.col("alpha_semantic") * F.col("drift_semantic") + F.col("alpha_rouge") * F.col("drift_rouge_l") + F.col("alpha_bertscore") * F.col("drift_bertscore")
    soft = 1.0 / (1.0 + F.exp(-F.lit(temperature) * (F.lit(threshold) - x)))
    return each.groupBy("alpha_semantic", "alpha_rouge", "alpha_bertscore").agg(F.avg((x < threshold).cast("double")).alias("fool_rate_hard"), F.avg(soft).alias("fool_rate_approx"))


def sensitivity(df: DataFrame, weights: dict[str, float], name: str, values: list[float], **options) -> DataFrame:
    """The grid along one coefficient, the others fixed."""
    axes = {k: (values if k == name else [weights[k]]) for k in ("semantic", "rouge", "bertscore")}
    return drift_grid(df, axes["semantic"], axes["rouge"], axes["bertscore"], **options)
