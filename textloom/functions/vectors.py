"""Vector and probability functions over arrays, inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` uses it (also inside lambdas over arrays)."""
    return F.element_at(F.transform(F.array(value), f), 1)


def present(value: Column) -> Column:
    """A generator of the value where it isn't null, of no row where it is.

    A filter on a computed column is pushed below the projection and computes the column a second time; this
    computes it once.
    """
    return F.explode(F.array_compact(F.array(value)))


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null if a vector has no length."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def unit(a: Column) -> Column:
    """The vector divided by its length; a zero vector stays zero."""
    return let(norm(a), lambda n: F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(0.0)))


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """``c`` kept within the bounds. Null stays null (greatest and least would skip it); NaN counts as largest."""
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def semantic_drift(a: Column, b: Column) -> Column:
    """1 - cosine, the cosine clipped to [0, 1]; 1 where a vector is missing or has no length."""
    return F.coalesce(1.0 - clamp(cosine(a, b)), F.lit(1.0))


def squared_distance(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def softmax(logits: Column) -> Column:
    """Probabilities of logits, shifted by the largest so that nothing overflows."""
    shifted = let(F.array_max(logits).cast("double"), lambda top: F.transform(logits, lambda x: F.exp(x.cast("double") - top)))
    return let(shifted, lambda e: let(_sum(e), lambda total: F.transform(e, lambda x: x / total)))


def expected_value(probs: Column) -> Column:
    """Mean bucket of a distribution over buckets 0..K-1, scaled to [0, 1]."""
    k = F.size(probs)
    weighted = F.zip_with(probs, F.sequence(F.lit(0), k - 1), lambda p, i: p * i)
    return _sum(weighted) / (k - 1)


def top_probability(probs: Column) -> Column:
    return F.array_max(probs)


def last_probability(probs: Column) -> Column:
    return F.element_at(probs, -1)


def finite_or_null(c: Column) -> Column:
    """Null in place of NaN and infinities, for sinks that have neither."""
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def linspace(low: float, high: float, n: int) -> list[float]:
    """The grid values exactly as numpy makes them."""
    import numpy as np

    return [float(x) for x in np.linspace(low, high, n)]
