"""Greedy feature selection.

Relevance is computed once; each further step is one distributed job against
the feature chosen last.  The driver keeps one score per feature and step.
Scores are compared after rounding, ties go to the lowest position.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrystat.operators.common import by_feature, width
from quarrystat.operators.mutual_info import (_INTEGERS, cmi_reverse, cmi_vector, entropy,
                                              mi_vector, packed)

TIE_DIGITS = 10

CRITERIA = ("mid", "miq", "min_redundancy", "chain", "max_total_relevance", "cmim",
            "entropy_over_mi")


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Quotient in which an exhausted denominator counts as infinitely good."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(np.round(b, TIE_DIGITS) <= 0, np.inf, a / b)


def _best(score: np.ndarray, free: np.ndarray) -> int:
    s = np.where(free, np.round(score, TIE_DIGITS), -np.inf)
    return int(np.flatnonzero(free & (s == s[free].max()))[0])


def _score(criterion: str, rel: np.ndarray, steps: np.ndarray) -> np.ndarray:
    if criterion == "mid":
        return rel - steps.mean(0)
    if criterion in ("miq", "entropy_over_mi"):
        return _ratio(rel, steps.mean(0))
    if criterion == "min_redundancy":
        return -steps.mean(0)
    if criterion == "chain":
        return steps[-1]
    if criterion == "max_total_relevance":
        return steps.mean(0)
    return steps.min(0)                                   # cmim


def greedy_trace(df: DataFrame, k: int, criterion: str, label: str | None = "label",
                 bins: str = "bins", weighting: str = "probability"):
    """Chosen positions, their scores, relevance and the per-step vectors."""
    if criterion not in CRITERIA:
        raise ValueError(f"unknown criterion {criterion}")
    d = width(df, bins)
    if not 1 <= k <= d:
        raise ValueError(f"k must lie in 1..{d}")
    keep = [label] if label and criterion != "entropy_over_mi" else []
    if all(t in _INTEGERS for _, t in df.select(*keep).dtypes):
        data = packed(df, *keep, bins=bins).persist()
    else:
        data = df.select(*keep, bins).persist()
    try:
        if criterion == "entropy_over_mi":
            rel, = by_feature(entropy(data, bins), d, "h")
        else:
            rel, = by_feature(mi_vector(data, label, bins), d, "mi")
        free = np.ones(d, bool)
        chosen, scores, steps = [_best(rel, free)], [], []
        scores.append(float(rel[chosen[0]]))
        free[chosen[0]] = False
        while len(chosen) < k:
            last = chosen[-1]
            if criterion == "max_total_relevance":
                step, = by_feature(cmi_vector(data, last, label, bins, weighting), d, "cmi")
                step = step + rel[last]
            elif criterion == "cmim":
                step, = by_feature(cmi_reverse(data, last, label, bins, weighting), d, "cmi")
                step = step + rel[last]
            else:
                step, = by_feature(mi_vector(data, last, bins), d, "mi")
            steps.append(step)
            score = _score(criterion, rel, np.array(steps))
            pick = _best(score, free)
            chosen.append(pick)
            scores.append(float(score[pick]))
            free[pick] = False
    finally:
        data.unpersist()
    return chosen, scores, rel, np.array(steps)


def greedy(df: DataFrame, k: int, criterion: str, label: str | None = "label",
           bins: str = "bins", weighting: str = "probability") -> DataFrame:
    """The k chosen features in order: ``(step, j, score)``.

    The score of step 0 is the relevance.  Criteria:

    * ``mid``: relevance minus mean MI with the chosen ones
    * ``miq``: relevance over that mean
    * ``min_redundancy``: smallest mean MI with the chosen ones
    * ``chain``: largest MI with the feature chosen last
    * ``max_total_relevance``: mean of I(candidate; label | s) + relevance of s
    * ``cmim``: minimum over s of I(s; label | candidate) + relevance of s
    * ``entropy_over_mi``: entropy over mean MI, no label needed
    """
    chosen, scores, _, _ = greedy_trace(df, k, criterion, label, bins, weighting)
    return _picks(df.sparkSession, chosen, scores)


def _picks(spark, chosen, scores) -> DataFrame:
    rows = [(i, int(j), float(s)) for i, (j, s) in enumerate(zip(chosen, scores))]
    return spark.createDataFrame(rows, "step int, j int, score double")


def total_relevance_scores(df: DataFrame, k: int, label: str = "label", bins: str = "bins",
                           weighting: str = "probability") -> DataFrame:
    """Damped step scores of ``max_total_relevance``: ``(step, j, score, shown)``.

    The first score is relevance over (sum x maximum of relevance).  A later
    score is read from the preceding vector; that vector is the masked mean over
    its maximum, times the square of the latest score over the one before.
    ``shown`` is -1 / ln(score).
    """
    chosen, _, rel, steps = greedy_trace(df, k, "max_total_relevance", label, bins, weighting)
    held = rel / (rel.sum() * rel.max())
    free = np.ones(len(rel))
    free[chosen[0]] = 0
    score = [held[chosen[0]]]
    for i in range(1, k):
        score.append(held[chosen[i]])
        free[chosen[i]] = 0
        t = steps[:i].mean(0) * free
        held = t / t.max() * score[i] ** 2 / score[i - 1]
    rows = [(i, int(j), float(s), float(-1.0 / np.log(s)))
            for i, (j, s) in enumerate(zip(chosen, score))]
    return df.sparkSession.createDataFrame(rows, "step int, j int, score double, shown double")


def from_matrix(h: DataFrame, relevance: DataFrame, k: int, form: str = "difference") -> DataFrame:
    """Selection from an MI matrix ``(i, j, mi)`` and relevance ``(j, mi)``.

    ``form`` is difference (relevance - mean redundancy) or quotient.
    """
    if form not in ("difference", "quotient"):
        raise ValueError(f"unknown form {form}")
    f = {r["j"]: r["mi"] for r in relevance.select("j", "mi").collect()}
    d = max(f) + 1
    rel = np.array([f.get(j, -np.inf) for j in range(d)])
    free = np.ones(d, bool)
    chosen = [_best(rel, free)]
    scores = [float(rel[chosen[0]])]
    free[chosen[0]] = False
    h = h.persist()
    try:
        while len(chosen) < k:
            red, = by_feature(h.filter(F.col("j").isin(chosen)).groupBy("i")
                              .agg(F.avg("mi").alias("red")), d, "red", key="i")
            score = rel - red if form == "difference" else _ratio(rel, red)
            pick = _best(score, free)
            chosen.append(pick)
            scores.append(float(score[pick]))
            free[pick] = False
    finally:
        h.unpersist()
    return _picks(h.sparkSession, chosen, scores)


def ranking(scores: DataFrame, col: str) -> DataFrame:
    """All features by score, best first: ``(pos, j, score)``, one row per feature."""
    w = W.orderBy(F.desc(F.round(col, TIE_DIGITS)), "j")
    return scores.select((F.row_number().over(w) - 1).alias("pos"), "j", F.col(col).alias("score"))
