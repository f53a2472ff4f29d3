"""Splits that keep related records together, balanced by largest differencing.

1. Records are joined into components: all records with one value of any key column are related, directly or
   through others. One key column needs one aggregation; several go through the connected components of a
   graph of key values (not of record pairs).
2. Components that outweigh a bin (a topic with a third of all rows) stay whole and are given out first, the
   heaviest first, each to the split furthest below its target. There are fewer of them than twice ``BINS``.
3. The weights of the others (rows, pre-aggregated) are balanced by multi-way largest differencing into equal bins:
   bin tuples start as (weight, 0, …); the two tuples with the widest spread are combined, the largest
   part of one with the smallest of the other, again and again until one is left. Components are dealt by hash to
   buckets of about ``BUCKET`` components; each bucket is differenced into one tuple of bins, and the bucket
   tuples are combined by the same rule, level by level, so that no task ever holds all components.
4. The number of bins (``BINS`` to twice as many) is the one that what is left of the targets divides best. Whole bins go
   to the splits, as many to each as its target asks for, the heaviest first, and bins of two splits change places as
   long as that brings them nearer to their targets.

Defined results: records whose keys are all null are components of their own; repeated rows weigh as often as
they occur; an empty table gives empty results; every component gets exactly one split.
"""

from __future__ import annotations

import heapq
import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from textloom.llm.components import connected_components
from textloom.session import materialise

BINS = 100
BUCKET = 2000
#: Bucket tuples that one task combines in one level.
FAN_IN = 256
TARGETS = {"train": 0.70, "val": 0.15, "test": 0.15}


def name_key(name: str | None) -> str | None:
    """What is left of a name without case, accents, Unicode form, punctuation, underscores, spacing, a leading 'the', and with '&' as 'and'."""
    if name is None:
        return None
    text = unicodedata.normalize("NFKD", name.replace("&amp;", "&").replace("&", " and "))
    text = "".join(c for c in text if not unicodedata.combining(c)).casefold()
    parts = [p for p in re.split(r"[\W_]+", "".join(c for c in text if unicodedata.category(c) != "Cf")) if p]
    if len(parts) > 1 and parts[0] == "the":
        parts = parts[1:]
    return "".join(parts) or None


@F.pandas_udf(StringType())
def _name_key(names: pd.Series) -> pd.Series:
    seen: dict = {}
    return names.map(lambda x: seen[x] if x in seen else seen.setdefault(x, name_key(x)))


def with_name_key(df: DataFrame, name: str, key: str = "topic_key") -> DataFrame:
    """``df`` with the key of a name column; null and blank names have no key."""
    return df.withColumn(key, _name_key(F.col(name)))


def components(df: DataFrame, id_col: str, keys: list[str], *keep: Column) -> DataFrame:
    """(id, component): related records share a component, named by a hash of one of their key values.

    ``keep``: further columns of the records to come out beside these two.
    """
    node = lambda c: F.when(F.col(c).isNotNull(), F.xxhash64(F.lit(c), F.col(c).cast("string")))
    nodes = [node(c) for c in keys]
    own = F.xxhash64(F.lit("\x00record"), F.col(id_col).cast("string"))
    base = df.select(F.col(id_col), F.coalesce(*nodes, own).alias("_first"), F.array_compact(F.array(*nodes)).alias("_nodes"), F.struct(F.lit(0), *keep).alias("_keep"))
    kept = [F.col(f"_keep.{c}") for c in df.select(*keep).columns]
    if len(keys) == 1:
        return base.select(id_col, F.col("_first").alias("component"), *kept)
    edges = base.where(F.size("_nodes") > 1).select(F.col("_first").alias("a"), F.explode("_nodes").alias("b")).where("a <> b").distinct()
    labels = connected_components(edges)
    named = labels.withColumnRenamed("v", "_first")
    return base.join(named, "_first", "left").select(id_col, F.coalesce("label", "_first").alias("component"), *kept)


def _difference(tuples: list[tuple[np.ndarray, list[list]]]) -> tuple[np.ndarray, list[list]]:
    """Combine (sorted descending weights, members per bin) by largest spread until one is left."""
    heap = [(-float(w[0] - w[-1]), i, w, m) for i, (w, m) in enumerate(tuples)]
    heapq.heapify(heap)
    n = len(heap)
    while len(heap) > 1:
        _, _, w1, m1 = heapq.heappop(heap)
        _, _, w2, m2 = heapq.heappop(heap)
        w = w1 + w2[::-1]
        m = [a + b if len(a) >= len(b) else b + a for a, b in zip(m1, reversed(m2))]
        order = np.argsort(-w, kind="stable")
        n += 1
        w = w[order]
        heapq.heappush(heap, (-float(w[0] - w[-1]), n, w, [m[i] for i in order]))
    return heap[0][2], heap[0][3]


def _bucket_bins(bins: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["weight", "component"], ascending=[False, True])
        start = []
        for i, w in enumerate(pdf["weight"].to_numpy()):
            start.append((np.array([w] + [0] * (bins - 1), np.int64), [[i]] + [[] for _ in range(bins - 1)]))
        _, members = _difference(start)
        place = np.empty(len(pdf), np.int64)
        for b, own in enumerate(members):
            place[own] = b
        return pd.DataFrame({"bucket": key[0], "component": pdf["component"].to_numpy(), "weight": pdf["weight"].to_numpy(), "bin": place})

    return run


def _level(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Combine the bin tuples of some buckets: for each bucket and bin the bin of the group."""
    tuples = []
    for bucket, own in pdf.groupby("bucket"):
        own = own.sort_values(["weight", "bin"], ascending=[False, True])
        tuples.append((own["weight"].to_numpy(), [[(bucket, b)] for b in own["bin"]]))
    weights, members = _difference(tuples)
    rows = [(key[0], bucket, b, i, int(weights[i])) for i, own in enumerate(members) for bucket, b in own]
    return pd.DataFrame(rows, columns=["group", "bucket", "bin", "to_bin", "group_weight"])


def balanced_bins(weights: DataFrame, bins: int = BINS, bucket_size: int = BUCKET) -> DataFrame:
    """(component, weight, bin): components in ``bins`` bins of nearly equal weight."""
    weights = materialise(weights.select("component", "weight"))
    n = weights.count()
    buckets = max(1, -(-n // bucket_size))
    keyed = weights.withColumn("bucket", F.pmod(F.xxhash64("component", F.lit(3)), F.lit(buckets)).cast("long"))
    dealt = materialise(keyed.groupBy("bucket").applyInPandas(_bucket_bins(bins), "bucket long, component long, weight long, bin long"))
    while buckets > 1:
        empty = F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")
        sums = dealt.groupBy("bucket", "bin").agg(F.sum("weight").alias("weight"))
        full = dealt.select("bucket").distinct().select("bucket", empty).withColumn("bin", F.col("bin").cast("long")).join(sums, ["bucket", "bin"], "left").fillna(0, ["weight"])
        groups = full.withColumn("group", F.floor(F.col("bucket") / FAN_IN)).groupBy("group").applyInPandas(_level, "group long, bucket long, bin long, to_bin long, group_weight long")
        dealt = materialise(dealt.join(groups.select("bucket", "bin", "group", "to_bin"), ["bucket", "bin"]).select(F.col("group").alias("bucket"), "component", "weight", F.col("to_bin").alias("bin")))
        buckets = -(-buckets // FAN_IN)
    return dealt.select("component", "weight", "bin")


def allocate(weights: list[tuple[int, int]], targets: dict[str, float], total: int | None = None) -> dict[int, str]:
    """A split for each (name, weight): the heaviest first, always to the split furthest below its share of ``total`` (of these, if null)."""
    total = sum(w for _, w in weights) if total is None else total
    left = {s: total * p for s, p in targets.items()}
    out = {}
    for name, w in sorted(weights, key=lambda x: (-x[1], x[0])):
        out[name] = max(left, key=lambda s: left[s])
        left[out[name]] -= w
    return out


def allocate_bins(weights: list[tuple[int, int]], targets: dict[str, float], places: dict[str, int]) -> dict[int, str]:
    """A split for each bin (name, weight), ``places`` bins to each.

    The heaviest bin first, to the split whose free places have to be filled most; then bins of two splits change places
    as long as that brings the splits nearer to their targets. There are a few hundred bins at most.
    """
    left, free = dict(targets), dict(places)
    out = {}
    for name, w in sorted(weights, key=lambda x: (-x[1], x[0])):
        best = max((s for s in left if free[s]), key=lambda s: left[s] / free[s])
        out[name] = best
        left[best] -= w
        free[best] -= 1
    weight = dict(weights)
    while True:
        gains = []
        for a, s in out.items():
            for b, t in out.items():
                if s < t and weight[a] != weight[b]:
                    d = weight[a] - weight[b]  # s loses d, t gains it
                    gains.append((left[s] ** 2 + left[t] ** 2 - (left[s] + d) ** 2 - (left[t] - d) ** 2, a, b))
        gain, a, b = max(gains, default=(0.0, None, None))
        if gain <= 1e-9:
            return out
        d, s, t = weight[a] - weight[b], out[a], out[b]
        left[s] += d
        left[t] -= d
        out[a], out[b] = t, s


def heavy_first(weights: list[tuple[int, int]], total: int, bins: int) -> list[tuple[int, int]]:
    """The components, of the heaviest in falling order, that outweigh a bin of what is left without them."""
    n = 0
    while n < min(len(weights), bins) and weights[n][1] * bins > total:
        total -= weights[n][1]
        n += 1
    return weights[:n]


def bins_for(left: dict[str, float], bins: int) -> dict[str, int]:
    """How many bins each split gets: their number lies between ``bins`` and twice as many, where it divides the targets best."""
    total = sum(left.values())
    best: tuple[float, dict[str, int]] = (float("inf"), {})
    for n in range(bins, 2 * bins + 1):
        exact = {s: v / total * n for s, v in left.items()}
        whole = {s: int(x) for s, x in exact.items()}
        for s in sorted(exact, key=lambda s: whole[s] - exact[s])[: n - sum(whole.values())]:
            whole[s] += 1
        error = sum(abs(whole[s] - exact[s]) for s in exact) / n
        if error < best[0] - 1e-12:
            best = (error, whole)
    return best[1]


def assigned_components(weights: DataFrame, targets: dict[str, float] = TARGETS, bins: int = BINS) -> DataFrame:
    """(component, split) for each (component, weight), the shares of weight as near to the targets as whole components allow."""
    spark = weights.sparkSession
    weights = materialise(weights.select("component", "weight"))
    total = weights.agg(F.sum("weight")).first()[0] or 0
    top = [(r.component, r.weight) for r in weights.orderBy(F.col("weight").desc(), "component").limit(2 * bins).collect()]
    heavy = heavy_first(top, total, 2 * bins)
    given = allocate(heavy, targets, total)
    left = {s: max(0.0, total * p - sum(w for c, w in heavy if given[c] == s)) for s, p in targets.items()}
    named = spark.createDataFrame(list(given.items()), "component long, split string")
    if total == sum(w for _, w in heavy):
        return named
    scale = (total - sum(w for _, w in heavy)) / (sum(left.values()) or 1.0)
    left = {s: v * scale for s, v in left.items()} if any(left.values()) else {s: p * (total - sum(w for _, w in heavy)) for s, p in targets.items()}
    places = bins_for(left, bins)
    rest = weights.join(F.broadcast(named.select("component")), "component", "left_anti")  # fewer than twice the bins
    placed = balanced_bins(rest, sum(places.values()))
    sums = {r.bin: r.w for r in placed.groupBy("bin").agg(F.sum("weight").alias("w")).collect()}  # one row per bin
    chosen = spark.createDataFrame(list(allocate_bins([(b, sums.get(b, 0)) for b in range(sum(places.values()))], left, places).items()), "bin long, split string")
    return placed.join(F.broadcast(chosen), "bin").select("component", "split").unionByName(named)


def grouped_splits(df: DataFrame, id_col: str, keys: list[str], targets: dict[str, float] = TARGETS, bins: int = BINS) -> DataFrame:
    """(id, component, split) for every record; related records share a split."""
    of = materialise(components(df, id_col, keys))
    splits = assigned_components(of.groupBy("component").agg(F.count("*").alias("weight")), targets, bins)
    return of.join(splits, "component").select(id_col, "component", "split")


def broken_groups(df: DataFrame, id_col: str, keys: list[str], split: Column, targets: dict[str, float] = TARGETS, bins: int = BINS) -> DataFrame:
    """Components whose records lie in more than one of the given splits, and the one split that balancing gives them.

    (component, first_id, n_rows, splits, balanced). Records without a split count for first_id and n_rows only.
    """
    keyed = F.coalesce(*(F.col(k).isNotNull() if len(keys) == 1 else F.when(F.col(k).isNotNull(), True) for k in keys), F.lit(False))
    of = components(df, id_col, keys, split.alias("_split"), keyed.alias("_keyed"))
    found = of.groupBy("component").agg(F.min(id_col).alias("first_id"), F.count("*").alias("n_rows"), F.collect_set("_split").alias("splits"), F.max("_keyed").alias("_keyed"))
    found = materialise(found)
    balanced = assigned_components(found.select("component", F.col("n_rows").alias("weight")), targets, bins).withColumnRenamed("split", "balanced")
    return found.where(F.col("_keyed") & (F.size("splits") > 1)).join(balanced, "component").select("component", "first_id", "n_rows", F.array_sort("splits").alias("splits"), "balanced")


def split_shares(assigned: DataFrame) -> DataFrame:
    """Rows, components and share of rows of each split."""
    total = assigned.count()
    return assigned.groupBy("split").agg(F.count("*").alias("n_rows"), F.countDistinct("component").alias("n_groups"), F.round(F.count("*") / F.lit(max(1, total)), 6).alias("share"))
