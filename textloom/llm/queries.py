"""The queries of the training-data problems, each over its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import cross_split, encoding, languages, leaks, near_duplicates, packing, pair_defects, sampling, segmentation, splits, truncation
from textloom.session import table


def _topics(spark: SparkSession, sf: str) -> DataFrame:
    return splits.with_name_key(table(spark, sf, "prompt_pairs").select("rec_id", "topic", "pair_id"), "topic")


def _essays(spark: SparkSession, sf: str) -> DataFrame:
    """best_essay of the pair log and the fool essays, in one table with their sources and shipped splits."""
    pairs = table(spark, sf, "prompt_pairs").select("rec_id", "pair_id", F.lit(None).cast("string").alias("split"), "source", F.col("best_essay").alias("text"))
    fools = table(spark, sf, "fool_essays").select("rec_id", F.lit(None).cast("string").alias("pair_id"), "split", "source", "text")
    return pairs.unionByName(fools)


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    shipped = cross_split.split_members(table(spark, sf, "rewriter_split_manifest"))
    rows = _topics(spark, sf).join(shipped, "pair_id", "left")
    return splits.broken_groups(rows, "rec_id", ["topic_key"], F.col("split")).select(F.col("first_id").alias("rec_id"))


def p1_splits(spark: SparkSession, sf: str) -> DataFrame:
    return splits.grouped_splits(_topics(spark, sf), "rec_id", ["topic_key"]).select("rec_id", "split")


def p1_split_shares(spark: SparkSession, sf: str) -> DataFrame:
    return splits.split_shares(splits.grouped_splits(_topics(spark, sf), "rec_id", ["topic_key"]))


def _cuts(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.truncated(_essays(spark, sf), "rec_id", "text", "source")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return _cuts(spark, sf).where("kind is not null").select("rec_id")


def p2_rates(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.truncation_rates(_cuts(spark, sf))


def _overlaps(spark: SparkSession, sf: str) -> DataFrame:
    return cross_split.cross_split_pairs(_essays(spark, sf), table(spark, sf, "rewriter_split_manifest"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return _overlaps(spark, sf).select(F.least("train_id", "eval_id").alias("rec_id_a"), F.greatest("train_id", "eval_id").alias("rec_id_b"))


def p3_report(spark: SparkSession, sf: str) -> DataFrame:
    return cross_split.overlap_report(_overlaps(spark, sf))


def p4_sample(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.stable_sample_of_keys(table(spark, sf, "prompt_pairs"), ["topic", "input_prompt", "output_prompt"], 0.1, "rec_id")


def _oversized(spark: SparkSession, sf: str) -> DataFrame:
    return segmentation.split_oversized(_essays(spark, sf), "rec_id", "text")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return _oversized(spark, sf).where("piece = 0").select("rec_id")


def p5_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return _oversized(spark, sf)


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    pairs = table(spark, sf, "prompt_pairs")
    found = [near_duplicates.near_duplicate_pairs(pairs, "rec_id", f).select(F.lit(f).alias("field"), "rec_id_a", "rec_id_b") for f in ("input_prompt", "output_prompt")]
    return found[0].unionByName(found[1])


def p6_groups(spark: SparkSession, sf: str) -> DataFrame:
    pairs = table(spark, sf, "prompt_pairs")
    found = [near_duplicates.near_duplicate_groups(pairs, "rec_id", f).select(F.lit(f).alias("field"), "rec_id", "group_id", "links") for f in ("input_prompt", "output_prompt")]
    return found[0].unionByName(found[1])


def _defects(spark: SparkSession, sf: str) -> DataFrame:
    try:
        profiles = languages.learn(table(spark, sf, "documents"))
    except AnalysisException:  # no labelled texts: function words decide
        profiles = None
    return pair_defects.pair_defects(table(spark, sf, "prompt_pairs"), source="source", profiles=profiles)


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """Without ``copy_inside``: the list counts as copies only answers that are alike as a whole."""
    return _defects(spark, sf).where("defect <> 'copy_inside'").select("rec_id", "field", "defect")


def p7_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _defects(spark, sf).groupBy("field", "defect").agg(F.count("*").alias("n_rows"))


def _packed(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(packing.token_counts(table(spark, sf, "documents"), "doc_id", "text"))


def p8_containers(spark: SparkSession, sf: str) -> DataFrame:
    return _packed(spark, sf)


def p8_fill(spark: SparkSession, sf: str) -> DataFrame:
    return packing.fill_report(_packed(spark, sf))


def _leaked(spark: SparkSession, sf: str) -> DataFrame:
    return leaks.leaks(table(spark, sf, "documents"), table(spark, sf, "heldout_items"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return _leaked(spark, sf).where("contains").select("doc_id", "item_id")


def p9_items(spark: SparkSession, sf: str) -> DataFrame:
    return leaks.leak_report(_leaked(spark, sf))


def _damage(spark: SparkSession, sf: str) -> DataFrame:
    return encoding.encoding_damage(table(spark, sf, "documents"))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return _damage(spark, sf).select("doc_id")


def p10_restored(spark: SparkSession, sf: str) -> DataFrame:
    return _damage(spark, sf).select("doc_id", "repaired", "restored")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [p1_found, p1_splits, p1_split_shares, p2_found, p2_rates, p3_found, p3_report, p4_sample, p5_found, p5_pieces, p6_found, p6_groups, p7_found, p7_counts, p8_containers, p8_fill, p9_found, p9_items, p10_found, p10_restored]
    return {f.__name__: f for f in found}
