"""Toxicity grades by cumulative-link ordinal regression.

Grades: 0 for documents labelled not toxic; labelled toxic ones are graded 1 to 3 by
how many of the words that mark toxic labels they hold (terciles). Words mark toxic
labels if they are in toxic documents far more often than in the others, counted on
the training rows. The model is P(grade >= k) = sigmoid(w . x - theta_k) with one weight
vector for all thresholds theta_1 < theta_2 < theta_3; x holds log counts of hashed words
and of their beginnings (4 to 8 letters), so that inflected and compound forms of a word
share weight. The expected severity is the sum of those probabilities over k.

Bounds: fitted on about ``SAMPLE`` labelled documents, chosen by a hash of the id, with
``BUCKETS`` hash buckets; every document is scored, over its whole text. One document in
five (crc32 of the id) is held out of all learning.

Defined cases: null and empty texts have no features and get the base severity;
without toxic or without clean labels nothing is learnt and severity is 0; null labels
and ids are not learnt from; repeated rows are scored row by row, and an id counts once
in the sample.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystat.llm.common import held_out
from quarrystat.llm.sampling import about, one_for_each_id, with_text

SAMPLE, BUCKETS, FOLDS, GRADES = 8_000, 1 << 18, 5, 3
#: Lengths of the word beginnings that are features too.
BEGINNINGS = range(4, 9)
#: Buckets in fewer training documents are no features, nor are those whose log odds of
#: a toxic document are nearer to 0.
LEAST_DOCS, LEAST_ODDS = 5, 0.7
_WORD = re.compile(r"[^\W\d_]+")


@lru_cache(1 << 16)
def buckets(word: str) -> tuple[int, ...]:
    """Hash buckets of a word and of its beginnings."""
    parts = [word, *(f"{word[:k]}-" for k in BEGINNINGS if len(word) >= k)]
    return tuple(crc32(p.encode("utf-8", "surrogatepass")) % BUCKETS for p in parts)


def word_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets and log counts of the words of one text and of their beginnings."""
    c: Counter = Counter()
    for w, n in Counter(_WORD.findall((text or "").lower())).items():
        for at in buckets(w):
            c[at] += n
    return np.fromiter(c, np.int64, len(c)), np.log1p(np.fromiter(c.values(), np.float64, len(c)))


def _sample_features(rows: DataFrame):
    """``(row, bucket, value, toxic)`` arrays of a bounded sample, one row for each id."""
    def batches(it):
        for b in it:
            out = [word_counts(t) for t in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array([i.astype(np.int32).tobytes() for i, _ in out], pa.binary()),
                 pa.array([v.astype(np.float32).tobytes() for _, v in out], pa.binary())], ["doc_id", "h", "toxic", "i", "v"])
    src = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "h", F.col("toxic").cast("int").alias("toxic"), "text")
    got = one_for_each_id(src.mapInArrow(batches, "doc_id long, h long, toxic int, i binary, v binary")).toArrow()
    toxic = got.column(0).to_numpy()
    i = [np.frombuffer(x, np.int32) for x in got.column(1).to_pylist()]
    v = [np.frombuffer(x, np.float32) for x in got.column(2).to_pylist()]
    row = np.repeat(np.arange(len(i), dtype=np.int32), [len(x) for x in i])
    return row, np.concatenate([*i, np.zeros(0, np.int32)]), np.concatenate([*v, np.zeros(0, np.float32)]), toxic


def odds(row, col, bad) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per bucket: documents, toxic documents, log odds of a toxic document."""
    n_bad, n_all = max(1, bad.sum()), max(1, len(bad))
    df, df_bad = np.bincount(col, minlength=BUCKETS), np.bincount(col[bad[row]], minlength=BUCKETS)
    return df, df_bad, np.log((df_bad + 0.5) / (n_bad + 1)) - np.log((df - df_bad + 0.5) / (n_all - n_bad + 1))


def grades(row, col, toxic) -> np.ndarray:
    """Ordered grades of the sample's documents."""
    bad = toxic == 1
    _, df_bad, logs = odds(row, col, bad)
    marks = (logs > 2) & (df_bad >= LEAST_DOCS)
    hits = np.bincount(row, weights=marks[col], minlength=len(toxic))
    out = np.zeros(len(toxic), np.int64)
    if bad.any():
        cuts = np.quantile(hits[bad], np.arange(1, GRADES) / GRADES)
        out[bad] = 1 + (hits[bad][:, None] > cuts).sum(axis=1)
    return out


def fit(row, col, val, grade, rounds: int = 200, rate: float = 0.05, l2: float = 3e-4):
    """``(weights over buckets, thresholds)`` by maximum likelihood of the cumulative model."""
    df, _, logs = odds(row, col, grade > 0)
    used = np.flatnonzero((df >= LEAST_DOCS) & (np.abs(logs) >= LEAST_ODDS))
    place = np.full(BUCKETS, -1, np.int64)
    place[used] = np.arange(len(used))
    keep = place[col] >= 0
    row, col, val, n = row[keep], place[col[keep]], val[keep].astype(np.float64), len(grade)
    above = grade[:, None] >= np.arange(1, GRADES + 1)                     # y >= k
    base = np.clip(above.mean(axis=0), 1e-4, 1 - 1e-4)
    theta = np.log((1 - base) / base)
    theta = np.maximum.accumulate(theta + np.arange(GRADES) * 1e-3)
    # Thresholds as a first value and positive steps keep their order.
    z = np.concatenate([np.zeros(len(used)), theta[:1], np.log(np.diff(theta))])
    m, v = np.zeros_like(z), np.zeros_like(z)
    for t in range(1, rounds + 1):
        w, steps = z[:len(used)], np.exp(z[len(used) + 1:])
        theta = z[len(used)] + np.concatenate([[0], np.cumsum(steps)])
        eta = np.bincount(row, weights=w[col] * val, minlength=n)
        up = 1 / (1 + np.exp(-np.clip(eta[:, None] - theta, -30, 30)))      # P(y >= k)
        full = np.hstack([np.ones((n, 1)), up, np.zeros((n, 1))])
        prob = np.maximum(full[np.arange(n), grade] - full[np.arange(n), grade + 1], 1e-9)
        slope = np.hstack([np.zeros((n, 1)), up * (1 - up), np.zeros((n, 1))])
        lo, hi = slope[np.arange(n), grade], slope[np.arange(n), grade + 1]
        g_eta = -(lo - hi) / prob / n
        g_theta = np.zeros(GRADES + 2)
        np.add.at(g_theta, grade, lo / prob / n)
        np.add.at(g_theta, grade + 1, -hi / prob / n)
        g_theta = g_theta[1:-1]
        tail = np.cumsum(g_theta[::-1])[::-1]
        g = np.concatenate([np.bincount(col, weights=g_eta[row] * val, minlength=len(used)) + l2 * w, tail[:1], tail[1:] * steps])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        z -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-9)
    weights = np.zeros(BUCKETS, np.float32)
    weights[used] = z[:len(used)]
    return weights, z[len(used)] + np.concatenate([[0], np.cumsum(np.exp(z[len(used) + 1:]))])


def train(docs: DataFrame, labels: DataFrame):
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"), FOLDS, 0))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    row, col, val, toxic = _sample_features(with_text(about(known, SAMPLE, 31), docs))
    if not (toxic == 1).any() or not (toxic == 0).any():
        return None
    return fit(row, col, val, grades(row, col, toxic))


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, severity, grade, toxic)`` of every document: expected severity
    (0 to 3), the most probable side of each threshold, and 1 where grade 1 or more is likelier
    than not."""
    model = train(docs, labels)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def batches(it):
        for b in it:
            up = np.zeros((b.num_rows, GRADES))
            if sent.value is not None:
                weights, theta = sent.value
                for k, t in enumerate(b.column(2).to_pylist()):
                    at, v = word_counts(t)
                    up[k] = 1 / (1 + np.exp(-np.clip((weights[at] * v).sum() - theta, -30, 30)))
            grade = (up >= 0.5).sum(axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(up.sum(axis=1)), pa.array(grade.astype(np.int32)),
                                              pa.array((grade > 0).astype(np.int32))], ["doc_id", "held_out", "severity", "grade", "toxic"])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id"), FOLDS, 0).alias("held_out"),
                       F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(batches, "doc_id long, held_out boolean, severity double, grade int, toxic int")
