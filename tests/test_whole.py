"""Registered queries over tables longer than the limits of their operators: nothing may be left out."""

import hashlib

import numpy as np
import pytest
from conftest import rows_of

from textloom.functions import text as T
from textloom.operators import vectors as G
from textloom.plans import queries

QUERIES = queries.queries()


def test_pooled_vector_takes_every_embedding(spark, tmp_path):
    rows = [(i, [float(i), 1000.0 - i, 1.0]) for i in range(1000)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {(r.doc, r.pos): r.value for r in QUERIES["pooled_vector"](spark, str(tmp_path)).collect()}
    assert len(got) == 150
    for doc in range(50):
        mean = np.mean([v for i, v in rows if i % 50 == doc], axis=0)
        assert [got[doc, k] for k in range(3)] == pytest.approx((mean / np.linalg.norm(mean)).tolist(), abs=2e-5)


def test_pooled_keeps_its_optional_limit(spark):
    df = spark.createDataFrame([(1, 0, [1.0, 0.0]), (1, 14, [0.0, 1.0])], "doc long, chunk long, e array<double>")
    assert G.pooled(df, "e", "doc", "chunk").first().centroid == [1.0, 0.0]
    assert G.pooled(df, "e", "doc", "chunk", None).first().centroid == pytest.approx([0.5**0.5] * 2)


def test_char_chunks_reach_the_end(spark, tmp_path):
    texts = [(1, "x" * 5600), (2, "y" * 30001), (3, "z" * 399), (4, ""), (5, None)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = rows_of(QUERIES["char_chunks"](spark, str(tmp_path)))
    assert got == [(i, k, min(400, len(t) - 400 * k)) for i, t in texts if t for k in range(-(-len(t) // 400))]
    assert sum(n for _, _, n in got) == sum(len(t or "") for _, t in texts)


def test_compose_messages_hold_whole_examples(spark, tmp_path):
    essays = [(1, "a" * 301), (2, "b" * 4000 + " "), (3, "short"), (4, None)]
    spark.createDataFrame([(i, " s ", "u", e) for i, e in essays], "rec_id long, input_prompt string, output_prompt string, baseline_essay string").write.parquet(str(tmp_path / "prompt_pairs.parquet"))
    block = lambda e: f"{T.FEWSHOT_HEAD}\n\n--- Reference example 1 ---\n{e.strip()}\n\n" if e else ""
    want = [(i, hashlib.md5(f"s\n\n{block(e)}u".encode()).hexdigest()) for i, e in essays]
    assert rows_of(QUERIES["compose_messages"](spark, str(tmp_path)), "rec_id", "message") == want
