"""Declared schemas of the tables that the readers and sinks deal with."""

from __future__ import annotations

SCORED_TEXT = "text string, score double, domain string, source string, split string, round int"
MIRROR = SCORED_TEXT + ", mirror_idx int, timestamp string"
TRIAL = (
    "topic string, essay string, slop_score double, optimization_slop double, drift_penalty double, constraint_ok boolean, constraint_reason string, "
    "generation int, prompt_id string, mutation_op string, domain string, chunked_scoring boolean"
)
PAIR = (
    "topic string, topic_source string, input_prompt string, output_prompt string, input_slop_score double, output_slop_score double, "
    "improvement double, mutation_op string, round int, timestamp string, best_essay string, baseline_essay string"
)
FEWSHOT = "essay string, slop_score double, round int, topic string"
TOPIC_SOURCE = "topic string, source_passage string, slop_score double, round int"
CLUSTER = "cluster_id int, n_organic int, medoid_prompt string, canonical_template string, member_pair_ids array<string>, member_topics array<string>, centroid array<float>"
MANIFEST = "schema_version int, seed int, source_pairs_path string, source_sha256 string, splits map<string, array<string>>"
ROUND_SUMMARY = (
    "round int, optimizer_best_mean_slop double, mean_fitness double, n_fool int, binary_threshold double, "
    "deslop_slop_stats struct<count:int, mean:double, median:double, min:double, max:double, stdev:double, pct_below:double>, "
    "detector_metrics struct<macro_f1:double, accuracy:double, roc_auc:double>"
)
TRACE = "event string, step int, epoch double, ts string, extras map<string, double>"
