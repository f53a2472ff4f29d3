"""Choosing rows: first-wins deduplication, best per key, top-k pools, deterministic samples and splits.

Ties are always broken by a unique column, so results do not depend on partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.session import materialise


def first_per(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order.

    An aggregation of structs where the order is plain ascending columns would save the sort; the window
    keeps any order and any column. Catalyst pushes a partial limit below the shuffle (WindowGroupLimit).
    """
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def distinct_first(df: DataFrame, key: str, ordinal: str) -> DataFrame:
    """One row per value, the earliest."""
    return first_per(df, [key], F.col(ordinal).asc())


def distinct_last(df: DataFrame, key: str, ordinal: str) -> DataFrame:
    """One row per value, the latest, with the place of the earliest in ``first_<ordinal>``.

    Two maxima in one aggregation, combined before the shuffle: a key with very many rows is no burden.
    """
    rest = [c for c in df.columns if c not in (key, ordinal)]
    out = df.groupBy(key).agg(F.max(F.struct(ordinal, *rest)).alias("_m"), F.min(ordinal).alias(f"first_{ordinal}"))
    return out.select(key, f"_m.{ordinal}", *(f"_m.{c}" for c in rest), f"first_{ordinal}")


def best_per(df: DataFrame, key: str, score: str, ordinal: str, largest: bool = False) -> DataFrame:
    """The row with the smallest (or largest) score of each key, the earliest of equals."""
    return first_per(df.where(F.col(score).isNotNull()), [key], F.col(score).desc() if largest else F.col(score).asc(), F.col(ordinal).asc())


def source_index(df: DataFrame, topic: str = "topic", passage: str = "source_passage", score: str = "slop_score", ordinal: str = "seq") -> DataFrame:
    """One passage per topic: the lowest scored one, the first of equals; without any scored one the last.

    Blank topics and passages are no candidates.
    """
    from textloom.functions.text import strip

    usable = df.where((strip(F.coalesce(F.col(topic), F.lit(""))) != "") & (strip(F.coalesce(F.col(passage), F.lit(""))) != ""))
    rank = [F.col(score).isNull().asc(), F.col(score).asc(), F.when(F.col(score).isNull(), -F.col(ordinal)).otherwise(F.col(ordinal)).asc()]
    return first_per(usable, [topic], *rank)


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first ``k`` rows in an order (TakeOrderedAndProject: no full sort)."""
    return df.orderBy(*order).limit(k)


def elite_count(n: Column, share: float = 0.2) -> Column:
    return F.greatest(F.lit(1), F.floor(n * share)).cast("int")


def ranked_in_buckets(df: DataFrame, by: Sequence[str], bucket: Column, *order: Column) -> DataFrame:
    """``df`` with rank and n_all within each group, without any task that holds a whole group.

    ``bucket`` has to rise with the order. Rows are numbered within their bucket, and the sizes of the buckets
    before are added; only these sizes are gathered by group.
    """
    names = [f"_by{i}" for i in range(len(by))]
    b = df.withColumns({n: F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for n, c in zip(names, by)}).withColumn("_b", bucket)
    sizes = b.groupBy(*names, "_b").agg(F.count("*").alias("_n"))
    group = Window.partitionBy(*names)
    before = group.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*names, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(group).alias("n_all"))
    inside = b.withColumn("_in", F.row_number().over(Window.partitionBy(*names, "_b").orderBy(*order)))
    return inside.join(offsets, [*names, "_b"]).withColumn("rank", F.col("_before") + F.col("_in")).drop(*names, "_b", "_in", "_before")


def ranked_by_score(df: DataFrame, by: Sequence[str], score: str, ordinal: str, descending: bool = False, block: int = 100_000) -> DataFrame:
    """``df`` with rank and n_all within each group by score, the earliest of equals first; null scores are left out.

    No task holds a group, nor all rows of one score: the rows of smaller scores are counted on counts per distinct score
    (in 1,001 ranges of the score), and rows of equal score are numbered within blocks of the ordinal, a number.
    """
    names = [f"_by{i}" for i in range(len(by))]
    value = -F.col(score) if descending else F.col(score)
    rows = df.where(F.col(score).isNotNull()).withColumns({n: F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for n, c in zip(names, by)} | {"_v": value, "_o": F.floor(F.col(ordinal) / block)})
    cells = rows.groupBy(*names, "_v", "_o").agg(F.count("*").alias("_n"))
    scores = cells.groupBy(*names, "_v").agg(F.sum("_n").alias("_n")).withColumn("_b", F.greatest(F.lit(-1000), F.least(F.lit(1000), F.floor(F.col("_v") * 1000))))
    ranges = scores.groupBy(*names, "_b").agg(F.sum("_n").alias("_n"))
    so_far = lambda *part: F.coalesce(F.sum("_n").over(part[0].rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = ranges.select(*names, "_b", so_far(Window.partitionBy(*names).orderBy("_b")).alias("_range"), F.sum("_n").over(Window.partitionBy(*names)).alias("n_all"))
    scores = scores.withColumn("_below", so_far(Window.partitionBy(*names, "_b").orderBy("_v"))).join(offsets, [*names, "_b"]).select(*names, "_v", (F.col("_range") + F.col("_below")).alias("_below"), "n_all")
    cells = cells.withColumn("_before", so_far(Window.partitionBy(*names, "_v").orderBy("_o"))).join(scores, [*names, "_v"]).select(*names, "_v", "_o", (F.col("_below") + F.col("_before")).alias("_before"), "n_all")
    inside = rows.withColumn("_in", F.row_number().over(Window.partitionBy(*names, "_v", "_o").orderBy(ordinal)))
    return inside.join(cells, [*names, "_v", "_o"]).withColumn("rank", F.col("_before") + F.col("_in")).drop(*names, "_v", "_o", "_in", "_before")


def first_rows(df: DataFrame, share: float, least: int, *order: Column) -> DataFrame:
    """The first max(least, floor(share * n)) rows in an order, by one distributed sort.

    The sorted rows are written, numbered within their partitions, and the sizes of the partitions before are added.
    """
    place = F.monotonically_increasing_id()
    ordered = materialise(df.orderBy(*order).withColumns({"_p": F.shiftright(place, 33), "_i": place}))
    sizes = ordered.groupBy("_p").agg(F.count("*").alias("_n"), F.min("_i").alias("_first"))  # a row per partition
    offsets = sizes.select("_p", "_first", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    kept = F.col("_before") + F.col("_i") - F.col("_first") < F.greatest(F.lit(least), F.floor(F.col("_all") * share))
    return ordered.join(F.broadcast(offsets), "_p").where(kept).select(*(f"`{c}`" for c in df.columns))


def elite(df: DataFrame, share: float, by: Sequence[str], score: str, ordinal: str) -> DataFrame:
    """The max(1, share of the group) lowest scored rows of each group, the earliest of equals first."""
    return ranked_by_score(df, by, score, ordinal).where(F.col("rank") <= elite_count(F.col("n_all"), share)).drop("rank", "n_all")


def pool_merge(existing: DataFrame, new: DataFrame, cap: int, text: str = "essay", score: str = "slop_score", ordinal: str = "ordinal", prefix: int = 4000) -> DataFrame:
    """The ``cap`` lowest scored texts of two pools, one per prefix of ``prefix`` characters; a missing score counts as 1."""
    both = existing.unionByName(new, allowMissingColumns=True).withColumn("_s", F.coalesce(F.col(score), F.lit(1.0))).withColumn("_p", F.xxhash64(F.substring(text, 1, prefix)))
    one = first_per(both.withColumn("_p2", F.sha2(F.substring(text, 1, prefix), 256)), ["_p2"], F.col("_s").asc(), F.col(ordinal).asc())
    return top_k(one, cap, F.col("_s").asc(), F.col(ordinal).asc()).drop("_s", "_p", "_p2")


def fewshot_texts(pool: DataFrame, n: int, text: str = "essay", score: str = "slop_score", ordinal: str = "ordinal") -> DataFrame:
    """The ``n`` lowest scored rows of a pool, blank ones dropped after the cut."""
    from textloom.functions.text import strip

    lowest = top_k(pool, n, F.coalesce(F.col(score), F.lit(1.0)).asc(), F.col(ordinal).asc())
    return lowest.where(strip(F.coalesce(F.col(text), F.lit(""))) != "")


def hash_order(seed: int, *key: str) -> Column:
    """A pseudo-random order that every engine and every run agrees on."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") for k in key)), 256)


def hash_sample(df: DataFrame, n: int, seed: int, *key: str) -> DataFrame:
    """``n`` rows in hash order: the deterministic counterpart of a seeded draw."""
    return top_k(df, n, hash_order(seed, *key).asc(), *(F.col(k).asc() for k in key))


def stratified_split(df: DataFrame, strata: Sequence[str], seed: int, key: str, val: float, test: float) -> DataFrame:
    """``df`` with a split: in each stratum the first shares in hash order are test and val, the rest train.

    A stratum with fewer than two rows can't be divided and is split with all others of its kind, as one stratum.
    """
    sizes = df.groupBy(*strata).agg(F.count("*").alias("_size"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in strata]
    joined = df.alias("a").join(sizes.alias("b"), on=same)
    marked = joined.select("a.*", (F.col("_size") < 2).alias("_small")).withColumn("_o", hash_order(seed, key))
    groups = {f"_g{i}": F.when(~F.col("_small"), F.col(c).cast("string")) for i, c in enumerate(strata)}
    ranked = ranked_in_buckets(marked.withColumns(groups), ["_small", *groups], F.substring("_o", 1, 3), F.col("_o").asc(), F.col(key).asc())
    n_test, n_val = F.ceil(F.col("n_all") * test), F.ceil(F.col("n_all") * val)
    split = F.when(F.col("rank") <= n_test, "test").when(F.col("rank") <= n_test + n_val, "val").otherwise("train")
    return ranked.withColumn("split", split).drop("_small", "_o", "rank", "n_all", *groups)


def bucketed_rank(df: DataFrame, order: str, *by: str) -> DataFrame:
    """rank and n_all by an evenly spread hexadecimal string, of all rows or within groups: 4,096 buckets a group."""
    if by:
        return ranked_in_buckets(df, by, F.substring(order, 1, 3), F.col(order).asc())
    return ranked_in_buckets(df.withColumn("_all", F.lit(0)), ["_all"], F.substring(order, 1, 3), F.col(order).asc()).drop("_all")


def split_manifest(ids: DataFrame, pair_id: str, seed: int, train: float = 0.70, val: float = 0.15) -> DataFrame:
    """(pair_id, split) of the distinct ids in hash order, each split with at least one id where there are three.

    One id is train; of two the first is train and the second test.
    """
    one = ids.select(F.col(pair_id).alias("pair_id")).where("pair_id is not null").distinct().withColumn("_o", hash_order(seed, "pair_id"))
    n = F.col("n_all")
    n_train = F.when(n < 3, 1).otherwise(F.greatest(F.lit(1), F.least(F.floor(n * train), n - 2)))
    n_val = F.when(n < 3, 0).otherwise(F.greatest(F.lit(1), F.least(F.floor(n * val), n - n_train - 1)))
    split = F.when(F.col("rank") <= n_train, "train").when(F.col("rank") <= n_train + n_val, "val").otherwise("test")
    return bucketed_rank(one, "_o").select("pair_id", split.alias("split"))


def part_digits(n: int, rows: int = 50_000, least: int = 2) -> int:
    """Leading hexadecimal digits by which ``n`` evenly spread ids are cut into parts of about ``rows`` at most."""
    digits = least
    while n > rows * 16**digits:
        digits += 1
    return digits


def nested_manifest(flat: DataFrame, digits: int | None = None) -> DataFrame:
    """The manifest as rows of sorted id lists: one per split and leading digits of the id.

    The number of digits follows from the number of ids, so no list grows with them (from 12.8 million ids on).
    """
    digits = digits or part_digits(flat.count())
    return flat.groupBy("split", F.substring("pair_id", 1, digits).alias("part")).agg(F.array_sort(F.collect_list("pair_id")).alias("pair_ids"))


def unnested_manifest(nested: DataFrame, column: str = "splits") -> DataFrame:
    """(pair_id, split) of manifests with a map from split to ids; an id listed twice comes out once."""
    return nested.select(F.explode(column).alias("split", "ids")).select("split", F.explode("ids").alias("pair_id")).groupBy("pair_id").agg(F.min("split").alias("split"))


def manifest_is_current(manifest: DataFrame, source_sha256: str) -> bool:
    """Whether a stored manifest was made from the source that is there now; null checksums never are."""
    return manifest.where(F.col("source_sha256") == source_sha256).limit(1).count() > 0


def weighted_sample(df: DataFrame, n: int, weight: str, seed: int, key: str, bucket_rows: int = 100_000) -> DataFrame:
    """``n`` draws with replacement, rows drawn in proportion to their weight: (draw, key).

    Weights are summed to a cumulative line in hash order of the key, bucket by bucket; their number grows with the rows.
    The line is cut into as many cells as there are rows; a row's interval lies in one cell or, if it is heavy, in several,
    and each draw, hashed to a point of the line, meets the few rows of its cell.
    """
    spark = df.sparkSession
    ordered = materialise(df.select(F.col(key).alias("_key"), F.col(weight).cast("double").alias("_w")).where("_w > 0").withColumn("_o", hash_order(seed, "_key")))
    size = ordered.agg(F.count("*").alias("n"), F.sum("_w").alias("w")).first()
    if not size.n:
        return spark.createDataFrame([], df.select(F.lit(0).cast("bigint").alias("draw"), key).schema)
    spread = ordered.withColumn("_b", F.substring("_o", 1, part_digits(size.n, bucket_rows)))
    inside = Window.partitionBy("_b").orderBy("_o", "_key").rowsBetween(Window.unboundedPreceding, 0)
    line = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = spread.groupBy("_b").agg(F.sum("_w").alias("_bw")).select("_b", F.coalesce(F.sum("_bw").over(line), F.lit(0.0)).alias("_from"))
    rows = spread.withColumn("_hi", F.sum("_w").over(inside)).join(offsets, "_b").withColumn("_hi", F.col("_hi") + F.col("_from")).withColumn("_lo", F.col("_hi") - F.col("_w"))
    width = size.w / size.n
    celled = rows.select("_key", "_lo", "_hi", F.explode(F.sequence(F.floor(F.col("_lo") / width), F.floor(F.col("_hi") / width))).alias("_cell"))
    draws = spark.range(n).select(F.col("id").alias("draw"), (unit_uniform(seed, F.col("id").cast("string")) * size.w).alias("_at")).withColumn("_cell", F.floor(F.col("_at") / width))
    return draws.join(celled, "_cell").where("_at >= _lo and _at < _hi").select("draw", F.col("_key").alias(key))


def unit_uniform(seed: int, key: Column) -> Column:
    """A number in [0, 1) from the hash of a key."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}|"), key), 256), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def pick(seed: int, key: Column, options: Sequence[str]) -> Column:
    """One of the options, chosen by hash."""
    return F.element_at(F.array(*map(F.lit, options)), (F.floor(unit_uniform(seed, key) * len(options)) + 1).cast("int"))


def epsilon_greedy(best: Column, epsilon: float, seed: int, key: Column, options: Sequence[str]) -> Column:
    """A random option in a share ``epsilon`` of the rows, else the best known one."""
    return F.when(unit_uniform(seed, key) < epsilon, pick(seed + 1, key, options)).otherwise(best)


def refill_plan(df: DataFrame, seed: int, key: str) -> DataFrame:
    """What each free place of a population is filled with: 40 % mutate, 30 % crossover, 20 % mutate_any, 10 % seed."""
    u = unit_uniform(seed, F.col(key).cast("string"))
    return df.withColumn("action", F.when(u < 0.4, "mutate").when(u < 0.7, "crossover").when(u < 0.9, "mutate_any").otherwise("seed"))
