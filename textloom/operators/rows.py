"""Row-level operators: labels, filters, record builders, row multiplication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions.vectors import clamp
from textloom.operators.selection import first_rows, top_k


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """``df`` itself, or an error naming the columns that are missing."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")
    return df


def text_length_between(df: DataFrame, text: str, low: int = 500, high: int = 12000) -> DataFrame:
    """Rows whose text has ``low`` to ``high`` characters, both included."""
    return df.where(F.length(text).between(low, high))


def min_length(df: DataFrame, text: str, n: int) -> DataFrame:
    return df.where(F.length(text) >= n)


def bucketize(score: Column, k: int) -> Column:
    """The bucket floor(score * k), kept within 0..k-1. NaN sorts above all numbers and gets the last; null stays null."""
    return F.when(F.isnan(score), k - 1).when(score.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(k - 1), F.floor(score * k)))).cast("int")


def binary_label(score: Column, threshold: float = 0.5) -> Column:
    return (score >= threshold).cast("int")


def ternary_label(score: Column, low: float = 0.33, high: float = 0.66) -> Column:
    return F.when(score >= high, 2).when(score >= low, 1).when(score.isNotNull(), 0).cast("int")


def scored_record(df: DataFrame, text_fields: Sequence[str], score_fields: Sequence[str], split: str) -> DataFrame:
    """text (first non-empty field), score (first non-null field, clamped to [0, 1]), split."""
    score = clamp(F.coalesce(*(F.col(c).cast("double") for c in score_fields), F.lit(0.0)))
    return df.select(T.first_text(*text_fields).alias("text"), score.alias("score"), F.lit(split).alias("split"))


def with_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Defaults for columns that are missing or null."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in df.columns else F.lit(v) for c, v in defaults.items()})


def constraint(text: Column, lang: Column | None = None, topic_similarity: Column | None = None, min_words: int = 150, max_words: int = 2000, min_similarity: float = 0.3) -> Column:
    """The reason code of the first violated constraint, or 'ok'. Cheap tests come first.

    A language or a similarity that isn't known (null) passes.
    """
    words = T.word_count(text)
    out = F.when(words < min_words, "too_short").when(words > max_words, "too_long").when(T.is_refusal(text), "refusal")
    if lang is not None:
        out = out.when(lang != "en", "non_english")
    if topic_similarity is not None:
        out = out.when(topic_similarity < min_similarity, "off_topic")
    return out.otherwise("ok")


def penalised(ok: Column, score: Column, similarity: Column) -> tuple[Column, Column]:
    """Score and similarity of a text: 1 and 0 where a constraint failed."""
    return F.when(ok, score).otherwise(1.0), F.when(ok, similarity).otherwise(0.0)


def improving(df: DataFrame, improvement: str, at_least: float) -> DataFrame:
    return df.where(F.col(improvement) >= at_least)


def instruction_filter(df: DataFrame, instruction: str, context: str, output: str, max_chars: int = 150, min_words: int = 50, max_words: int = 500, keywords: Sequence[str] = T.KEYWORDS, max_samples: int | None = None, order: Sequence[str] = ()) -> DataFrame:
    """Essay-like instructions: no context, short instruction with a keyword, answer of a fair length.

    With ``max_samples`` the first so many of them in the given order, as a scan that stops there would have them.
    """
    i, o = F.col(instruction), F.col(output)
    blank = T.strip(F.coalesce(F.col(context), F.lit(""))) == ""
    filled = (T.strip(i) != "") & (T.strip(o) != "")
    kept = df.where(blank & filled & (F.length(T.strip(i)) <= max_chars) & T.any_keyword(i, tuple(keywords)) & T.word_count(o).between(min_words, max_words))
    return kept if max_samples is None else top_k(kept, max_samples, *(F.col(c).asc() for c in order))


def score_below(df: DataFrame, score: str, threshold: float) -> DataFrame:
    """Rows whose score is below a threshold; null and NaN scores are not."""
    return df.where(F.col(score) < threshold)


def missing_prompts(df: DataFrame, *prompts: str) -> DataFrame:
    """Rows that lack any of the prompts (null or blank)."""
    lacks = F.lit(False)
    for p in prompts:
        lacks = lacks | (T.strip(F.coalesce(F.col(p), F.lit(""))) == "")
    return df.where(lacks)


def two_labels(df: DataFrame, human: str, machine: str, index: str) -> DataFrame:
    """Each pair as two labelled rows: the human text with score 0, the machine's with score 1."""
    rows = F.array(F.struct(F.col(human).alias("text"), F.lit(0.0).alias("score")), F.struct(F.col(machine).alias("text"), F.lit(1.0).alias("score")))
    return df.select(F.col(index).alias("mirror_idx"), F.explode(rows).alias("x")).select("mirror_idx", "x.text", "x.score")


def routed(df: DataFrame, baseline: str, best: str) -> tuple[DataFrame, DataFrame]:
    """(rows with both essays, which only need scores; rows that need their essays built). Rows without topic or prompts are in neither."""
    usable = df.where((T.strip(F.coalesce(F.col("topic"), F.lit(""))) != "") & T.truthy("input_prompt").isNotNull() & T.truthy("output_prompt").isNotNull())
    both = T.truthy(baseline).isNotNull() & T.truthy(best).isNotNull()
    return usable.where(both), usable.where(~both)


def exploded_variants(df: DataFrame, prompt: str, pair_id: str) -> DataFrame:
    """A row for each rewording of the prompt, tagged and with the id of the pair it comes from."""
    made = df.where(T.truthy(prompt).isNotNull()).select("*", F.posexplode(T.variants(prompt)).alias("variant_no", "variant"))
    return made.withColumn(prompt, F.col("variant")).withColumn("source_pair_id", F.col(pair_id)).withColumn("source", F.lit("augmented")).drop("variant")


def essay_rows(df: DataFrame, text: str, name: str = "essay") -> DataFrame:
    """One text column, as text, stripped, under a new name; null texts are left out."""
    return df.where(F.col(text).isNotNull()).select(T.strip(F.col(text).cast("string")).alias(name))


def usable_essays(df: DataFrame, sources: Sequence[str] | None = None, baseline: str = "baseline_essay", best: str = "best_essay") -> DataFrame:
    """Rows with both essays, of the given sources if any are given."""
    both = T.truthy(baseline).isNotNull() & T.truthy(best).isNotNull()
    return df.where(both & (F.col("source").isin(*sources) if sources else F.lit(True)))


def training_record(df: DataFrame, names: dict[str, str], prefix: str = "") -> DataFrame:
    """The columns of a training record under their new names; the first one gets a prefix in front of its text."""
    first, *rest = names.items()
    return df.select(F.concat(F.lit(prefix), F.col(first[0])).alias(first[1]), *(F.col(a).alias(b) for a, b in rest))


def training_rows(df: DataFrame, text: str, score: str, buckets: int, max_tokens: int = 512) -> DataFrame:
    """(tokens, bucket): the first tokens of each text and the bucket of its score."""
    return df.select(F.slice(T.word_list(text), 1, max_tokens).alias("tokens"), bucketize(F.col(score), buckets).alias("bucket"))


def nested_fields(df: DataFrame, **fields: str) -> DataFrame:
    """``df`` with numbers taken from nested fields by path; null where a struct or a number is missing."""
    return df.withColumns({name: F.col(path).try_cast("double") for name, path in fields.items()})


def held_out_or_head(held_out: DataFrame, df: DataFrame, *order: Column) -> DataFrame:
    """The held-out rows; without any, the first max(1, n // 10) rows in the given order."""
    if held_out.limit(1).count():
        return held_out
    return first_rows(df, 0.1, 1, *order)
