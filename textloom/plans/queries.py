"""Registered queries over the reference's own operators, each over its whole tables.

Scores of models are not available, so where a score has to be computed, ``distinct_ratio`` of a window stands in;
everything that depends on it is called proxy.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import drift
from textloom.functions import text as T
from textloom.functions import vectors as V
from textloom.operators import bleu, chunks, evaluation, joins, rounds, rows, search, selection
from textloom.operators import vectors as G
from textloom.session import table

WINDOW, STRIDE = 128, 64
LEXICON = ("nobody", "price", "difference", "critics", "rarely")
_REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    _REGISTRY[f.__name__] = f
    return f


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def _score(c: str = "score") -> Column:
    """A recorded score as a number in [0, 1]; null stays null, NaN becomes null."""
    return V.clamp(F.when(~F.isnan(c), F.col(c)))


def _docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents")


def _pairs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "prompt_pairs")


def _proxy(s: SparkSession, d: str) -> DataFrame:
    """(doc_id, mean, max, n_chunks, proxy_score) from the windows of each document."""
    base = _docs(s, d).where("text is not null")
    scored = chunks.token_windows(base, "doc_id", T.word_tokens("text"), WINDOW, STRIDE).select("doc_id", chunks.distinct_ratio(F.col("tokens")).alias("s"))
    return chunks.chunk_scores(scored, "doc_id", "s").withColumn("proxy_score", chunks.weighted(F.col("mean"), F.col("max")))


def _judged(s: SparkSession, d: str) -> DataFrame:
    """(doc_id, y, t, score, proxy): labels from the recorded score and the stand-in score, rounded so that all engines agree."""
    labels = _docs(s, d).select("doc_id", _score().alias("score")).where("score is not null")
    return labels.join(_proxy(s, d), "doc_id").select("doc_id", "score", rows.binary_label(F.col("score")).alias("y"), rows.ternary_label(F.col("score")).alias("t"), r6("proxy_score").alias("proxy"))


@_query
def len_filter_dedup(s, d):
    kept = rows.text_length_between(_docs(s, d), "text")
    return kept.groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("doc_id"), F.max(F.length("text")).cast("bigint").alias("n_chars")).drop("h")


@_query
def word_count_gate(s, d):
    enough = V.let(T.word_count("text").cast("bigint"), lambda n: F.when(n >= 150, n))
    return _docs(s, d).select("doc_id", V.present(enough).alias("n_words"))


@_query
def constraint_cascade(s, d):
    return _docs(s, d).where("text is not null").select("doc_id", rows.constraint(F.col("text"), F.col("lang"), min_words=60).alias("reason"))


@_query
def scored_record(s, d):
    kept = rows.min_length(rows.scored_record(_docs(s, d).withColumn("other", F.col("source")), ["text", "other"], ["score", "round"], "train"), "text", 10)
    return kept.groupBy("split").agg(F.count("*").alias("n"), r6(F.avg("score")).alias("mean_score"))


@_query
def labels(s, d):
    x = _score()
    return _docs(s, d).where("score is not null and not isnan(score)").select("doc_id", *(rows.bucketize(x, k).alias(f"b{k}") for k in (11, 4, 2)), rows.binary_label(x).alias("y"), rows.ternary_label(x).alias("t"))


@_query
def clean_boilerplate(s, d):
    cleaned = _docs(s, d).where("text is not null").select("doc_id", V.present(T.clean_output("text", 50, normalise=False)).alias("cleaned"))
    return cleaned.select("doc_id", F.sha2("cleaned", 256).alias("cleaned"))


@_query
def clean_output_nfkc(s, d):
    return _docs(s, d).where("text is not null").select("doc_id", V.present(T.clean_output("text", 50)).alias("cleaned"))


@_query
def clean_title(s, d):
    return table(s, d, "topic_sources").where("topic is not null").select("seq", T.clean_title("topic").alias("title"))


@_query
def title_prompt(s, d):
    low, high = T.length_band(T.word_count("text"))
    mirror = T.mirror_prompt(F.coalesce("source", F.lit("")), T.word_count("text"))
    return _docs(s, d).where("text is not null").select("doc_id", F.sha2(T.title_prompt("text"), 256).alias("prompt"), low.alias("low"), high.alias("high"), F.sha2(mirror, 256).alias("mirror"))


@_query
def mirror_rows(s, d):
    full = _pairs(s, d).where("baseline_essay is not null and best_essay is not null")
    return rows.two_labels(full, "best_essay", "baseline_essay", "rec_id").select("mirror_idx", "score", F.length("text").alias("n_chars"))


@_query
def label_balance(s, d):
    return evaluation.label_balance(_docs(s, d).select(rows.binary_label(_score()).alias("y")), "y")


@_query
def missing_prompts(s, d):
    return rows.missing_prompts(_pairs(s, d), "input_prompt", "output_prompt").select("rec_id")


@_query
def improving_pairs(s, d):
    return rows.improving(_pairs(s, d), "improvement", 0.1).groupBy("mutation_op").agg(F.count("*").alias("n"), r6(F.avg("improvement")).alias("mean_improvement"))


@_query
def keyword_filter(s, d):
    lines = _pairs(s, d).select("rec_id", F.posexplode(F.split("input_prompt", "\n")).alias("line_no", "instruction"), F.lit("").alias("context"), F.col("best_essay").alias("output"))
    return rows.instruction_filter(lines, "instruction", "context", "output").select("rec_id", "line_no")


@_query
def stratified_split(s, d):
    strata = _docs(s, d).select("doc_id", F.coalesce("domain", F.lit("none")).alias("domain"), rows.bucketize(F.coalesce(_score(), F.lit(0.0)), 4).alias("bucket"))
    return selection.stratified_split(strata, ["domain", "bucket"], 42, "doc_id", 0.05, 0.05).select("doc_id", "split")


@_query
def hash_split_manifest(s, d):
    return selection.split_manifest(_pairs(s, d), "pair_id", 42)


@_query
def split_semi_join(s, d):
    return joins.rows_in_split(_pairs(s, d), selection.unnested_manifest(table(s, d, "rewriter_split_manifest")), "train").select("rec_id")


@_query
def split_by_topic(s, d):
    train = joins.rows_in_split(_pairs(s, d), selection.unnested_manifest(table(s, d, "rewriter_split_manifest")), "train").select("topic").distinct()
    return joins.rows_with_topics(_pairs(s, d), train).select("rec_id")


@_query
def nested_manifest(s, d):
    return selection.nested_manifest(selection.unnested_manifest(table(s, d, "rewriter_split_manifest"))).select("split", "part", F.size("pair_ids").cast("bigint").alias("n"), F.sha2(F.array_join("pair_ids", ","), 256).alias("ids"))


@_query
def pair_row_id(s, d):
    made = T.pair_row_id(F.col("topic"), F.col("input_prompt"), F.col("output_prompt"))
    return _pairs(s, d).select("rec_id", made.alias("made"), (made == F.col("pair_id")).alias("same"))


@_query
def token_windows(s, d):
    base = _docs(s, d).where("text is not null")
    return chunks.token_windows(base, "doc_id", T.word_tokens("text"), WINDOW, STRIDE).select("doc_id", "chunk", "start", F.size("tokens").alias("n_tokens"))


@_query
def char_chunks(s, d):
    return chunks.char_chunks(_docs(s, d), "doc_id", "text", 400).select("doc_id", "chunk", F.length("text").alias("n_chars"))


@_query
def chunk_score_agg(s, d):
    return _proxy(s, d).select("doc_id", r6("mean").alias("mean"), r6("max").alias("max"), "n_chunks", r6("proxy_score").alias("proxy_score"))


@_query
def slop_stats(s, d):
    stats = evaluation.score_stats(_docs(s, d).select("source", _score().alias("x")), "x", 0.5, "source")
    return stats.select("source", "n", *(r6(c).alias(c) for c in ("mean", "median", "min", "max", "stdev", "share_below")))


@_query
def slop_histogram(s, d):
    return evaluation.histogram(_docs(s, d).select(_score().alias("x")), "x")


@_query
def conditional_counts(s, d):
    return evaluation.counts_below(_docs(s, d).select(_score().alias("x")), "x", 0.1, 0.3, 0.5)


@_query
def eval_rollup(s, d):
    both = _judged(s, d)
    return evaluation.run_summary(both, "score", mean_proxy="proxy").select(*(r6(c).alias(c) for c in ("mean_score", "std_score", "mean_proxy")))


@_query
def threshold_sweep_binary(s, d):
    return evaluation.threshold_sweep(_judged(s, d), "y", "proxy").select(r6("threshold").alias("threshold"), r6("macro_f1").alias("macro_f1"), r6("accuracy").alias("accuracy"))


@_query
def best_threshold(s, d):
    return evaluation.best_of_grid(evaluation.threshold_sweep(_judged(s, d), "y", "proxy"), "macro_f1", "threshold").select(r6("threshold").alias("threshold"), r6("macro_f1").alias("macro_f1"))


@_query
def threshold_sweep_ternary(s, d):
    return evaluation.ternary_sweep(_judged(s, d), "t", "proxy").select("i", r6("t_low").alias("t_low"), r6("t_high").alias("t_high"), r6("macro_f1").alias("macro_f1"))


@_query
def roc_auc(s, d):
    return evaluation.roc_auc(_judged(s, d), "y", "proxy").select(r6("auc").alias("auc"), "n_pos", "n_neg")


@_query
def macro_f1(s, d):
    z = rows.bucketize(F.col("proxy"), 4)
    return evaluation.macro_f1(_judged(s, d).select(rows.bucketize(F.col("score"), 4).alias("y"), z.alias("z")), "y", "z").select(r6("macro_f1").alias("macro_f1"), r6("accuracy").alias("accuracy"), "n")


def _centres(s: SparkSession, d: str) -> DataFrame:
    return G.centroids(table(s, d, "embeddings"), "embedding", "label").withColumnRenamed("label", "cluster_id")


@_query
def nearest_centroid(s, d):
    near = joins.nearest(table(s, d, "embeddings"), _centres(s, d), "vec_id", "embedding")
    return near.select("vec_id", "cluster_id", F.round("similarity", 5).alias("similarity"))


@_query
def centroid_mean(s, d):
    return _centres(s, d).select("cluster_id", F.posexplode("centroid").alias("pos", "value")).select("cluster_id", "pos", r6("value").alias("value"))


@_query
def pooled_vector(s, d):
    parts = table(s, d, "embeddings").select((F.col("vec_id") % 50).alias("doc"), F.floor(F.col("vec_id") / 50).alias("chunk"), "embedding")
    return G.pooled(parts, "embedding", "doc", "chunk", max_chunks=None).select("doc", F.posexplode("centroid").alias("pos", "value")).select("doc", "pos", F.round("value", 5).alias("value"))


@_query
def medoid(s, d):
    return G.medoids(table(s, d, "embeddings"), "vec_id", "embedding", "label").select("label", "vec_id", F.round("mean_distance", 5).alias("mean_distance"))


@_query
def nearest_to_centroid(s, d):
    e = table(s, d, "embeddings")
    return G.nearest_to_centroid(e, "vec_id", "embedding", "label", G.centroids(e, "embedding", "label")).select("label", "vec_id", F.round("distance", 5).alias("distance"))


@_query
def kmeans_clusters(s, d):
    placed, _ = G.kmeans(table(s, d, "embeddings"), "vec_id", "embedding", 5)
    return placed.groupBy("cluster_id").agg(F.count("*").alias("n"))


@_query
def softmax_decode(s, d):
    p = V.softmax(F.slice("embedding", 1, 4))
    return table(s, d, "embeddings").select("vec_id", p.alias("p")).select("vec_id", F.round(V.expected_value(F.col("p")), 5).alias("expected"), F.round(V.top_probability(F.col("p")), 5).alias("top"), F.round(V.last_probability(F.col("p")), 5).alias("last"))


def _clusters(s: SparkSession, d: str) -> DataFrame:
    """Stand-in clusters of the pair log: one per mutation operator, its template from the earliest prompt."""
    numbered = _pairs(s, d).where("mutation_op is not null").withColumn("cluster_id", F.length("mutation_op"))
    members = numbered.groupBy("cluster_id", F.substring("pair_id", 1, 2).alias("part")).agg(F.collect_set("pair_id").alias("member_pair_ids"))
    first = selection.first_per(numbered.where("output_prompt is not null").select("cluster_id", "rec_id", "output_prompt", "topic"), ["cluster_id"], F.col("rec_id").asc())
    templates = first.select("cluster_id", T.canonical_template("output_prompt", "topic").alias("canonical_template"))
    return members.select("cluster_id", "member_pair_ids", F.lit(None).cast("string").alias("canonical_template")).unionByName(templates.withColumn("member_pair_ids", F.array().cast("array<string>")))


@_query
def cluster_template_join(s, d):
    return joins.pairs_with_templates(_pairs(s, d), _clusters(s, d)).select("rec_id", "cluster_id", F.length("canonical_template").alias("n_chars"))


@_query
def cross_topic_expand(s, d):
    named = joins.pairs_with_templates(selection.distinct_first(_pairs(s, d), "pair_id", "rec_id"), _clusters(s, d))
    pool = table(s, d, "topic_sources").select("topic").where("topic is not null").distinct()
    fresh = joins.rows_without_topics(pool, _pairs(s, d).where("topic is not null"))
    made = joins.cross_topics(named.select("pair_id", "cluster_id", "canonical_template"), fresh, 10)
    return made.select("pair_id", "cluster_id", "new_topic", F.md5(T.fill_placeholder("canonical_template", F.col("new_topic"))).alias("prompt"))


@_query
def topic_source_index(s, d):
    return selection.source_index(table(s, d, "topic_sources")).select("topic", "seq", "slop_score")


@_query
def lookup_fallback(s, d):
    topics = _pairs(s, d).where("topic is not null").select("topic").distinct()
    found = joins.with_passages(topics, selection.source_index(table(s, d, "topic_sources")), "no passage")
    return found.select("topic", F.length("source_passage").alias("n_chars"))


@_query
def topic_anti_join(s, d):
    return joins.rows_without_topics(table(s, d, "topic_sources").where("topic is not null"), _pairs(s, d).where("topic is not null")).select("seq")


@_query
def union_sources(s, d):
    docs = _docs(s, d).select("source", "text", F.lit("documents").alias("origin"))
    both = docs.unionByName(table(s, d, "fool_essays").select("source", "text", "domain").withColumn("origin", F.lit("fool_essays")), allowMissingColumns=True)
    return both.groupBy("origin", "source").agg(F.count("*").alias("n"), F.count("domain").alias("with_domain"))


@_query
def distinct_topics(s, d):
    return _pairs(s, d).agg(F.countDistinct("topic").alias("topics"), F.countDistinct("pair_id").alias("pairs"), F.count("*").alias("n_rows"))


@_query
def set_operations(s, d):
    a, b = _pairs(s, d).where("topic is not null").select("topic"), table(s, d, "topic_sources").where("topic is not null").select("topic")
    return a.intersect(b).withColumn("side", F.lit("both")).unionByName(a.distinct().exceptAll(a.intersect(b)).withColumn("side", F.lit("pairs")))


@_query
def best_per_topic(s, d):
    return selection.best_per(_pairs(s, d).where("topic is not null"), "topic", "output_slop_score", "rec_id").select("topic", "rec_id", "output_slop_score")


@_query
def dedupe_by_output(s, d):
    return selection.best_per(_pairs(s, d).where("output_prompt is not null").withColumn("h", F.md5("output_prompt")), "h", "improvement", "rec_id", largest=True).select("rec_id", "improvement")


@_query
def contrastive_pairs(s, d):
    gap = F.round(F.col("input_slop_score") - F.col("output_slop_score"), 6)
    best = selection.best_per(_pairs(s, d).where("topic is not null").withColumn("gap", gap), "topic", "gap", "rec_id", largest=True)
    return best.where("gap > 0.1").select("topic", "rec_id", "gap")


@_query
def last_per_pair(s, d):
    return selection.distinct_last(_pairs(s, d), "pair_id", "rec_id").select("pair_id", "rec_id", "first_rec_id")


@_query
def topic_minimum(s, d):
    low = _pairs(s, d).where("topic is not null").groupBy("topic").agg(F.min("output_slop_score").alias("best")).where("best is not null")
    return selection.top_k(low, 10, F.col("best").asc(), F.col("topic").asc())


@_query
def fewshot_pool_merge(s, d):
    pool = _pairs(s, d).where("best_essay is not null").select(F.col("best_essay").alias("essay"), F.col("output_slop_score").alias("slop_score"), "round", "topic", F.col("rec_id").alias("ordinal"))
    early, late = pool.where("round < 5"), pool.where("round >= 5")
    return selection.pool_merge(early, late, 50).select("ordinal", "slop_score")


@_query
def fewshot_texts(s, d):
    pool = table(s, d, "fool_essays").select(F.col("text").alias("essay"), (1 - F.col("score")).alias("slop_score"), F.col("rec_id").alias("ordinal"))
    return selection.fewshot_texts(pool, 5).select("ordinal")


@_query
def candidate_agg(s, d):
    e = table(s, d, "fool_essays").where("prompt_id is not null and prompt_id <> '' and text is not null")
    scored = e.select("prompt_id", F.col("score"), (F.length("text") / 10000.0).alias("sim"), (T.word_count("text") >= 30).alias("ok"))
    made = rounds.candidate_means(scored, ["prompt_id"], "score", "score", "sim", "ok")
    return made.select("prompt_id", r6("mean_score").alias("mean_score"), r6("mean_sim").alias("mean_sim"), "ok", r6(V.finite_or_null(F.col("fitness"))).alias("fitness"))


@_query
def topk_fitness(s, d):
    return selection.top_k(candidate_agg(s, d), 12, F.col("fitness").desc_nulls_last(), F.col("prompt_id").asc()).select("prompt_id", "fitness")


@_query
def elite_slice(s, d):
    e = _pairs(s, d).where("output_slop_score is not null")
    return selection.elite(e, 0.2, ["source", "round"], "output_slop_score", "rec_id").select("rec_id")


@_query
def bandit_rewards(s, d):
    return _pairs(s, d).where("improvement is not null").groupBy("mutation_op").agg(F.count("*").alias("tries"), r6(F.avg("improvement")).alias("mean_reward"))


@_query
def epsilon_greedy(s, d):
    ops = ("add_style", "crossover", "paraphrase", "persona", "seed", "shorten")
    chosen = selection.epsilon_greedy(F.lit("persona"), 0.15, 7, F.col("rec_id").cast("string"), ops)
    return _pairs(s, d).select("rec_id", chosen.alias("op"))


@_query
def refill_plan(s, d):
    return selection.refill_plan(_pairs(s, d).select("rec_id"), 11, "rec_id").groupBy("action").agg(F.count("*").alias("n"))


@_query
def hash_sample(s, d):
    return selection.hash_sample(_docs(s, d).select("doc_id"), 50, 42, "doc_id")


@_query
def weighted_mix_sample(s, d):
    weights = F.when(F.col("source") == "alpaca", 0.4).when(F.col("source") == "cross_topic", 0.7).when(F.col("source") == "augmented", 0.3).otherwise(1.0)
    drawn = selection.weighted_sample(_pairs(s, d).select("rec_id", weights.alias("w")), 5000, "w", 42, "rec_id")
    return drawn.join(_pairs(s, d).select("rec_id", "source"), "rec_id").groupBy("source").agg(F.count("*").alias("n"))


@_query
def recency_oversample(s, d):
    return rounds.recency_oversample(table(s, d, "fool_essays").select("rec_id", "round"), "round", "rec_id").select("rec_id", "repeated")


@_query
def mixed_training(s, d):
    organic = _pairs(s, d).where("source = 'organic'").select("pair_id", "rec_id", "source")
    others = [_pairs(s, d).where(F.col("source") == x).select("pair_id", "rec_id", "source") for x in ("alpaca", "augmented", "cross_topic")]
    return joins.mixed_training(organic, selection.unnested_manifest(table(s, d, "rewriter_split_manifest")), *others).groupBy("source").agg(F.count("*").alias("n"))


@_query
def curriculum_rank(s, d):
    p = _pairs(s, d).where("input_slop_score is not null and output_slop_score is not null").withColumn("gap", F.round(F.col("input_slop_score") - F.col("output_slop_score"), 6))
    return rounds.curriculum(p, ["source"], "gap", "rec_id").select("rec_id", "curriculum_rank")


def _runs(s: SparkSession, d: str) -> DataFrame:
    """Best and mean score per source and round: the rounds of a run."""
    return _pairs(s, d).where("source is not null and round is not null and output_slop_score is not null").groupBy("source", "round").agg(r6(F.min("output_slop_score")).alias("best"), r6(F.avg("output_slop_score")).alias("mean"))


@_query
def plateau_stop(s, d):
    return rounds.plateau(_runs(s, d), ["source"], "round", "mean").select("source", "round", "stop")


@_query
def early_stop(s, d):
    return rounds.best_so_far(_runs(s, d), ["source"], ["round"], "mean", 8).select("source", "round", "best", F.col("waited").cast("bigint").alias("waited"), "stop")


@_query
def trajectory_pairs(s, d):
    return rounds.trajectory_pairs(_runs(s, d), ["source"], "round", "round", "mean").select("source", "parent", "child", "kind")


@_query
def ratchet_min(s, d):
    p = _pairs(s, d).where("topic is not null and output_slop_score is not null")
    return rounds.ratchet(p, ["topic"], "rec_id", "output_slop_score").select("rec_id")


@_query
def time_to_result(s, d):
    return rounds.time_to_result(_runs(s, d), ["source"], "round", "mean", (0.7, 0.6, 0.5, 0.4, 0.25, 0.2))


@_query
def best_ever(s, d):
    return rounds.best_ever(_pairs(s, d).where("improvement is not null"), ["source"], "improvement", "rec_id").select("source", "rec_id", "improvement")


@_query
def round_summary(s, d):
    made = rounds.round_summary(_pairs(s, d).where("round is not null"), "round", "output_slop_score", 0.3)
    return made.select("round", r6("best_score").alias("best_score"), r6("mean_score").alias("mean_score"), "n_below", F.col("stats.count").alias("n"), r6("stats.median").alias("median"))


@_query
def fill_metrics(s, d):
    a = _runs(s, d).where("source = 'organic'").select("round", F.when(F.col("round") % 2 == 0, F.col("best")).alias("best"))
    b = _pairs(s, d).where("round is not null").groupBy("round").agg(F.max("input_slop_score").alias("best"))
    return joins.fill_from(a, b, "round", "best")


@_query
def lineage(s, d):
    e = table(s, d, "fool_essays").where("prompt_id <> ''").groupBy("prompt_id").agg(F.min("round").alias("round"), F.min("rec_id").alias("rec_id"))
    roots = e.groupBy("round").agg(F.min("prompt_id").alias("root"))
    child = e.join(roots, "round").withColumn("parent_id", F.when(F.col("root") != F.col("prompt_id"), F.col("root")))
    return joins.with_parent(child, "prompt_id", "parent_id", "rec_id").select("prompt_id", "parent_id", "parent_rec_id")


@_query
def latest_rows(s, d):
    return selection.top_k(_pairs(s, d).where("logged_at is not null").select("rec_id", "logged_at"), 5, F.col("logged_at").desc(), F.col("rec_id").asc())


@_query
def percent_improvement(s, d):
    p = evaluation.percent_improvement(_pairs(s, d), "input_slop_score", "output_slop_score")
    return p.groupBy("source").agg(r6(F.avg("improvement_pct")).alias("mean_pct"), r6((1 - F.avg("output_slop_score") / F.avg("input_slop_score")) * 100).alias("pct_of_means"))


@_query
def instruction_to_topic(s, d):
    lines = _pairs(s, d).select("rec_id", F.posexplode(F.split("input_prompt", "\n")).alias("line_no", "line"))
    return lines.where(T.strip("line") != "").select("rec_id", "line_no", F.md5(T.instruction_topic("line")).alias("topic"))


@_query
def prompt_variants(s, d):
    made = rows.exploded_variants(_pairs(s, d).select("rec_id", "pair_id", "output_prompt"), "output_prompt", "pair_id")
    return made.select("rec_id", "variant_no", F.md5("output_prompt").alias("variant"))


@_query
def template_fill(s, d):
    filled = T.fill_placeholder(T.canonical_template("output_prompt", "topic"), F.coalesce("topic", F.lit("")))
    return _pairs(s, d).where("output_prompt is not null").select("rec_id", F.md5(filled).alias("prompt"))


@_query
def compose_messages(s, d):
    e = _pairs(s, d).where("input_prompt is not null and output_prompt is not null")
    block = T.fewshot_block(F.filter(F.array("baseline_essay"), lambda x: x.isNotNull()), max_chars=None)
    return e.select("rec_id", F.md5(T.compose(F.col("input_prompt"), F.col("output_prompt"), block)).alias("message"), F.md5(T.full_text(F.col("input_prompt"), F.col("output_prompt"), F.lit("plain"))).alias("whole"))


@_query
def lexicon_sentence_ratio(s, d):
    return _docs(s, d).where("text is not null").select("doc_id", r6(T.keyword_sentence_ratio("text", LEXICON)).alias("ratio"))


@_query
def word_tokens(s, d):
    return _docs(s, d).where("text is not null").select("doc_id", F.size(T.word_tokens("text")).cast("bigint").alias("n"), F.size(F.array_distinct(T.word_tokens("text"))).cast("bigint").alias("n_distinct"))


@_query
def json_preview(s, d):
    return _docs(s, d).where("text is not null").select("doc_id", F.md5(T.preview("text")).alias("preview"), V.finite_or_null(F.col("score")).alias("score"))


@_query
def rouge_l_drift(s, d):
    return _pairs(s, d).where("input_prompt is not null and output_prompt is not null").select("rec_id", r6(drift.rouge_l_drift("input_prompt", "output_prompt")).alias("drift"))


@_query
def drift_penalty(s, d):
    p = _pairs(s, d).where("output_slop_score is not null and improvement is not null")
    parts = drift.penalty(V.clamp(F.col("improvement")), V.clamp(F.col("output_slop_score") * 2), V.clamp(F.col("output_slop_score")), F.col("output_slop_score"), 0.42)
    return p.select("rec_id", parts.alias("x"), "output_slop_score").select("rec_id", r6("x.penalty").alias("penalty"), "x.bertscore_applied", r6(drift.objective(F.col("output_slop_score"), F.col("x.penalty"))).alias("objective"))


@_query
def drift_grid(s, d):
    p = _pairs(s, d).where("output_slop_score is not null").select(F.col("output_slop_score").alias("detector_slop"), (F.col("output_slop_score") / 2).alias("drift_semantic"), (F.col("output_slop_score") / 3).alias("drift_rouge_l"), (F.col("output_slop_score") / 5).alias("drift_bertscore"))
    made = search.drift_grid(p, [0.5, 1.0, 1.5], [0.1, 0.35, 0.6], [0.25, 0.5, 0.75])
    return made.select("alpha_semantic", "alpha_rouge", "alpha_bertscore", r6("fool_rate_hard").alias("fool_rate_hard"), r6("fool_rate_approx").alias("fool_rate_approx"))


@_query
def self_bleu(s, d):
    return bleu.self_bleu(table(s, d, "fool_essays"), "rec_id", "text", "source").select("source", "n_docs", r6("self_bleu").alias("self_bleu"))


@_query
def trace_event_stream(s, d):
    from textloom.session import ensure_checkpoint_dir
    from textloom.streaming import trace

    place = f"{ensure_checkpoint_dir(s)}/stream-{s.range(1).select(F.uuid()).first()[0]}"
    counts = trace.windowed_counts(trace.parquet_stream(s, f"{d}/events.parquet"))
    trace.run_to_end(counts, f"{place}/state", lambda batch, n: batch.write.mode("overwrite").parquet(f"{place}/out"), "complete")
    return s.read.parquet(f"{place}/out").select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n", r6("total").alias("total"))


@_query
def cluster_members(s, d):
    members = table(s, d, "embeddings").select("label", F.col("vec_id").alias("vec"))
    return G.member_lists(members, "label", F.col("vec") % G.shards_for(members.count()), "vec").select("label", "shard", "n_organic", F.md5(F.array_join(F.transform("member_vecs", lambda x: x.cast("string")), ",")).alias("members"))


@_query
def score_below(s, d):
    return rows.score_below(_pairs(s, d), "output_slop_score", 0.3).select("rec_id")


@_query
def keyword_filter_first(s, d):
    lines = _pairs(s, d).select("rec_id", F.posexplode(F.split("input_prompt", "\n")).alias("line_no", "instruction"), F.lit("").alias("context"), F.col("best_essay").alias("output"))
    return rows.instruction_filter(lines, "instruction", "context", "output", max_samples=40, order=("rec_id", "line_no")).select("rec_id", "line_no")


@_query
def penalised_scores(s, d):
    e = table(s, d, "fool_essays").where("text is not null and score is not null")
    score, similarity = rows.penalised(T.word_count("text") >= 30, F.col("score"), F.length("text") / 10000.0)
    return e.select("rec_id", r6(score).alias("score"), r6(similarity).alias("similarity"))


@_query
def usable_essays(s, d):
    return rows.usable_essays(_pairs(s, d), ("organic", "augmented")).select("rec_id")


@_query
def with_defaults(s, d):
    filled = rows.with_defaults(table(s, d, "fool_essays").select("rec_id", "score", "domain"), {"score": 0.5, "domain": "none", "lang": "en"})
    return filled.select("rec_id", "score", "domain", "lang")


@_query
def training_record(s, d):
    made = rows.training_record(_pairs(s, d).where("input_prompt is not null"), {"input_prompt": "source_text", "output_prompt": "target_text", "rec_id": "rec_id"}, "rewrite: ")
    return made.select("rec_id", F.md5("source_text").alias("source_text"), F.md5("target_text").alias("target_text"))


@_query
def nested_fields(s, d):
    packed = _docs(s, d).select("doc_id", F.struct("n_chars", "lang", F.struct("round").alias("run")).alias("meta"))
    return rows.nested_fields(packed, n="meta.n_chars", lang="meta.lang", round="meta.run.round").select("doc_id", "n", "lang", "round")


@_query
def routed_rows(s, d):
    scored, built = rows.routed(_pairs(s, d), "baseline_essay", "best_essay")
    return scored.select("rec_id", F.lit("score").alias("route")).unionByName(built.select("rec_id", F.lit("build").alias("route")))


@_query
def assigned_templates(s, d):
    near = joins.nearest(table(s, d, "embeddings"), _centres(s, d), "vec_id", "embedding")
    named = _centres(s, d).select("cluster_id", F.when(F.col("cluster_id") % 3 == 0, " ").otherwise(F.concat(F.lit("Write about "), F.col("cluster_id").cast("string"))).alias("canonical_template"))
    return joins.assigned_templates(near, named, at_least=0.2).select("vec_id", F.col("cluster_id").cast("bigint").alias("cluster_id"), "canonical_template")


@_query
def round_robin(s, d):
    seeds = _pairs(s, d).where("mutation_op is not null").groupBy("mutation_op").agg(F.min("rec_id").alias("rec_id"))
    return rounds.round_robin(s, seeds, 1000, "rec_id").select("place", "mutation_op")


@_query
def semantic_drift(s, d):
    e = table(s, d, "embeddings").select("vec_id", "embedding")
    following = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("following"))
    return e.join(following, "vec_id", "left").select("vec_id", F.round(V.semantic_drift(F.col("embedding"), F.col("following")), 5).alias("drift"))


@_query
def drift_sensitivity(s, d):
    p = _pairs(s, d).where("output_slop_score is not null").select(F.col("output_slop_score").alias("detector_slop"), (F.col("output_slop_score") / 2).alias("drift_semantic"), (F.col("output_slop_score") / 3).alias("drift_rouge_l"), (F.col("output_slop_score") / 5).alias("drift_bertscore"))
    made = search.sensitivity(p, {"semantic": 1.0, "rouge": 0.35, "bertscore": 0.5}, "rouge", [0.0, 0.35, 0.7, 1.05])
    return made.select("alpha_rouge", r6("fool_rate_hard").alias("fool_rate_hard"), r6("fool_rate_approx").alias("fool_rate_approx"))


@_query
def parsed_triplets(s, d):
    block = F.concat(F.lit("SYSTEM: "), "input_prompt", F.lit("\nUSER: "), "output_prompt", F.lit("\nSTYLE: "), F.coalesce("mutation_op", F.lit("")))
    parsed = _pairs(s, d).where("input_prompt is not null and output_prompt is not null").select("rec_id", T.parse_triplet(block).alias("x"))
    return parsed.select("rec_id", F.md5("x.system_prompt").alias("system_prompt"), F.md5("x.user_template").alias("user_template"), F.col("x.style_instructions").alias("style"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_REGISTRY)
