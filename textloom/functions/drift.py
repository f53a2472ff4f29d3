"""Drift of a rewritten text from its original, and the objectives built on it."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from textloom.functions.stem import stem

#: Characters of each text that the overlap is computed on.
ROUGE_CHARS = 12_000


@dataclass(frozen=True)
class Weights:
    semantic: float = 1.0
    rouge: float = 0.35
    bertscore: float = 0.5


def lcs(a: list, b: list) -> int:
    """Length of the longest common subsequence: a row of the table is one integer (bit-parallel)."""
    if not a or not b:
        return 0
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | (1 << i)
    row = full = (1 << len(a)) - 1
    for y in b:
        both = row & where.get(y, 0)
        row = ((row + both) | (row - both)) & full
    return len(a) - row.bit_count()


def rouge_l(reference: str, candidate: str) -> float:
    """ROUGE-L F over lower-cased alphanumeric tokens, those of more than three letters stemmed."""
    a, b = ([stem(w) if len(w) > 3 else w for w in re.findall(r"[a-z0-9]+", t.lower())] for t in (reference, candidate))
    if not a or not b:
        return 0.0
    n = lcs(a, b)
    p, r = n / len(b), n / len(a)
    return 2 * p * r / (p + r) if n else 0.0


@F.pandas_udf(DoubleType())
def rouge_l_drift(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """1 - ROUGE-L F, 1 where either text is blank; the first ``ROUGE_CHARS`` characters count."""
    for originals, rewritten in batches:
        out = []
        for a, b in zip(originals, rewritten):
            a, b = (a or "").strip()[:ROUGE_CHARS], (b or "").strip()[:ROUGE_CHARS]
            out.append(1.0 if not a or not b else 1.0 - rouge_l(a, b))
        yield pd.Series(out, dtype=float)


def penalty(semantic: Column, rouge: Column, bertscore: Column | None = None, score: Column | None = None, gate: float | None = None, weights: Weights = Weights()) -> Column:
    """A struct of the weighted sum of drifts and its parts.

    BERTScore counts only where it is given and, with a gate, where the score is at or below the gate.
    """
    applied = F.lit(bertscore is not None)
    if bertscore is not None and gate is not None and score is not None:
        applied = score <= gate
    bert = F.when(applied, bertscore if bertscore is not None else F.lit(0.0)).otherwise(0.0)
    total = F.lit(weights.semantic) * semantic + F.lit(weights.rouge) * rouge + F.lit(weights.bertscore) * bert
    return F.struct(total.alias("penalty"), semantic.alias("drift_semantic"), rouge.alias("drift_rouge_l"), bert.alias("drift_bertscore"), applied.alias("bertscore_applied"))


def fitness(score: Column, similarity: Column, failed: Column, weight: float = 0.3) -> Column:
    """-score + weight * similarity, or -infinity where the candidate failed."""
    return F.when(failed, F.lit(float("-inf"))).otherwise(-score + F.lit(weight) * similarity)


def objective(score: Column, drift: Column) -> Column:
    return score + drift


def drift_options(cfg: dict) -> dict:
    """Weights, switches and reference mode from a configuration, older key names included."""
    mode = cfg.get("alignment_reference_mode")
    if mode not in (None, "topic", "source_passage"):
        raise ValueError("alignment_reference_mode is null, 'topic' or 'source_passage'")
    drift = cfg.get("drift") or {}

    def value(default: float, *names: str) -> float:
        return float(next((drift[n] for n in names if n in drift), default))

    # Fixed key names, the current one first.
    weights = Weights(
        value(1.0, "drift_coef_semantic", "alpha_semantic", "lambda_semantic"),
        value(0.35, "drift_coef_rouge", "alpha_rouge", "lambda_rouge_l"),
        value(0.5, "drift_coef_bertscore", "alpha_bertscore", "lambda_bertscore"),
    )
    gate = drift.get("bertscore_slop_gate")
    passage = str(cfg.get("alignment_source_passage") or "").strip() or None
    return {"mode": mode, "passage": passage, "weights": weights, "use_bertscore": bool(drift.get("use_bertscore", False)), "gate": None if gate is None else float(gate)}
