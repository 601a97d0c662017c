"""Quality classifier by positive-unlabelled learning.

Trusted positives are labelled documents of quality 1; documents without a label are
the unlabelled web. A linear logistic model minimises the non-negative unbiased risk

    pi * R_p(+1) + max(0, R_u(-1) - pi * R_p(-1))

where pi, the share of good documents, is estimated from the labelled rows. When the
second part falls below zero the step goes the other way, which keeps the model from
fitting the unlabelled part beyond what the prior allows.

Features describe the whole text: how byte classes follow each other, words, repeats.
Never the label, the language, the source or the id.

The risk and its gradient are sums over all positives and all unlabelled documents: the
features are saved once, and each of ``ROUNDS`` rounds is a scan of them from which a few
hundred sums return. Prior and scores use all rows too; nothing is sampled.

Defined cases: null and empty texts get the score of a text without words, very long texts
are read whole in pieces; without positives or unlabelled documents nothing is learnt and
every score is 0.5; null labels and ids are not learnt from, repeated rows count one by one;
an id with several labels is a positive if one of them is 1; an empty table gives an empty
result; other columns are never looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystat.functions.kernels import list_column
from quarrystat.llm.common import held_out, matched, packed, saved, unpacked
from quarrystat.llm.rules import _repeated_words

#: Scans of all features, step size, and rows of one numpy step.
ROUNDS, RATE, SLICE_ROWS = 40, 0.3, 1024
THRESHOLD = 0.3
#: One document in so many is held out of all learning.
FOLDS = 5
_CLASSES = 16
_GROUPS = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\t\n\x0b\x0c\r", b".", b",",
           b"!?", b"#*$%&<>", b"|", b"\"'()[]{}", b"-_/:;", bytes(range(128, 256)), b"@=+~^\\`")


def _class_table() -> np.ndarray:
    out = np.zeros(256, np.uint8)
    for i, group in enumerate(_GROUPS):
        out[np.frombuffer(group, np.uint8)] = i + 1
    return out


_TABLE = _class_table()
N_FEATURES = _CLASSES * _CLASSES + 6


def features(text: str | None) -> np.ndarray:
    """The features of one whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    out = np.zeros(N_FEATURES, np.float32)
    if len(raw) > 1:
        counts = np.zeros(_CLASSES * _CLASSES, np.int64)
        for at in range(0, len(raw) - 1, 1 << 20):
            c = _TABLE[np.frombuffer(raw, np.uint8, min((1 << 20) + 1, len(raw) - at), at)]
            counts += np.bincount(c[:-1] * np.uint8(_CLASSES) + c[1:], minlength=_CLASSES * _CLASSES)
        out[:counts.size] = np.sqrt(counts / counts.sum())
    tokens = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n = len(tokens)
    out[-6:] = (np.log1p(n), n < 50, _repeated_words(tokens) / max(n, 1), len(set(tokens)) / max(n, 1),
                (len(lines) - len(set(lines))) / max(len(lines), 1), len(raw) / max(n, 1) / 20)
    return out


def block_sums(x: np.ndarray, w: np.ndarray, bias: float) -> np.ndarray:
    """``(rows, sum of log(1 + e^z), sum of p, sum of p x)`` of rows x with z = x w + bias and
    p = 1 / (1 + e^-z)."""
    x = x.astype(np.float64)
    z = np.clip(x @ w + bias, -30, 30)
    p = 1 / (1 + np.exp(-z))
    return np.concatenate([[len(x), np.logaddexp(0, z).sum(), p.sum()], p @ x])


def risk(pos: np.ndarray, unl: np.ndarray, mean_pos: np.ndarray, w: np.ndarray, bias: float, prior: float):
    """``(risk, negative part, gradient, gradient of the negative part)`` from the sums of
    :func:`block_sums` over positives and unlabelled rows; ``mean_pos`` are the positives' means.
    The gradients end with the bias."""
    up, uu = pos[1] / pos[0], unl[1] / unl[0]                   # R_p(-1), R_u(-1)
    own = up - (mean_pos @ w + bias)                            # R_p(+1)
    dp, du = (np.append(s[3:], s[2]) / s[0] for s in (pos, unl))
    part, slope = uu - prior * up, du - prior * dp
    return prior * own + max(0.0, part), part, prior * (dp - np.append(mean_pos, 1.0)) + (slope if part >= 0 else 0.0), slope


def descend(sums, moments, prior: float, rounds: int = ROUNDS, rate: float = RATE, l2: float = 1e-3):
    """``(weights, bias, mean, scale)``: Adam on the risk over scaled features.

    ``sums(w, bias)`` gives the sums of positives and unlabelled rows for weights on the raw
    features; ``moments`` are rows, sums and sums of squares of the two. While the negative part
    is below zero, the step climbs it instead.
    """
    n, total, squares = (moments[0][k] + moments[1][k] for k in range(3))
    mean = total / n
    scale = np.sqrt(np.maximum(squares / n - mean ** 2, 0)) + 0.02
    mean_pos = moments[0][1] / moments[0][0]
    w = np.zeros(len(mean) + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        raw = w[:-1] / scale
        bias = w[-1] - raw @ mean
        _, part, g, slope = risk(*sums(raw, bias), mean_pos, raw, bias, prior)
        g = g if part >= 0 else -slope
        g = np.append((g[:-1] - g[-1] * mean) / scale + l2 * w[:-1], g[-1])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return w[:-1], float(w[-1]), mean, scale


def _moments(x: np.ndarray) -> tuple:
    x = x.astype(np.float64)
    return len(x), x.sum(0), (x * x).sum(0)


def fit(pos: np.ndarray, unl: np.ndarray, prior: float, **how):
    """The same on two arrays of features."""
    return descend(lambda w, b: (block_sums(pos, w, b), block_sums(unl, w, b)), (_moments(pos), _moments(unl)), prior, **how)


def _features(rows: DataFrame) -> DataFrame:
    """``(doc_id, x)`` of rows ``(doc_id, text)``."""
    def batches(it):
        for b in it:
            x = pa.array([features(t).tobytes() for t in b.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), x], ["doc_id", "x"])
    return rows.mapInArrow(batches, "doc_id long, x binary")


def _sums(rows: DataFrame, of, size: int) -> list[np.ndarray]:
    """The sums of ``of(x)`` over the rows ``(good, x)``: of positives and of unlabelled ones."""
    def batches(it):
        out = np.zeros((2, size))
        for b in it:
            x = b.column(1)
            ends = np.frombuffer(x.buffers()[1], np.int32)[x.offset:x.offset + len(x) + 1]
            x = np.frombuffer(x.buffers()[2], np.float32)[ends[0] // 4:ends[-1] // 4].reshape(-1, N_FEATURES)
            good = b.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(x), SLICE_ROWS):
                part, side = x[at:at + SLICE_ROWS], good[at:at + SLICE_ROWS]
                for k, mine in enumerate((side, ~side)):
                    if mine.any():
                        out[k] += of(part[mine])
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), list_column(out)], ["c", "v"])
    sums = rows.select("good", "x").mapInArrow(batches, "c int, v array<double>").select("c", F.posexplode("v").alias("k", "v"))
    got = sums.groupBy("c", "k").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros((2, size))
    out[got["c"].to_numpy(), got["k"].to_numpy()] = got["v"].to_numpy()
    return list(out)


def train(docs: DataFrame, labels: DataFrame):
    """The model, or None if there is nothing to learn from."""
    ids = labels.where(F.col("doc_id").isNotNull()).withColumn("doc_id", F.col("doc_id").cast("long"))
    known = ids.where(F.col("quality").isNotNull() & ~held_out(F.col("doc_id"), FOLDS, 0))
    prior = known.agg(F.avg(F.col("quality").cast("double"))).first()[0]
    if not prior:
        return None
    marks = ids.groupBy("doc_id").agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("mark"))
    web = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), FOLDS, 0)).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marked = matched(saved(_features(web), "quality-features"), marks, ["doc_id"])
    # positives and rows without a label; other labelled rows only tell the prior
    rows = marked.where("mark is null or mark = 1").select(F.col("mark").isNotNull().alias("good"), "x")
    rows = saved(rows, "quality-rows")
    moments = _sums(rows, lambda x: np.concatenate([[len(x)], *_moments(x)[1:]]), 1 + 2 * N_FEATURES)
    if not moments[0][0] or not moments[1][0]:
        return None
    moments = [(m[0], m[1:1 + N_FEATURES], m[1 + N_FEATURES:]) for m in moments]
    return descend(lambda w, b: _sums(rows, lambda x: block_sums(x, w, b), 3 + N_FEATURES), moments, min(prior, 0.98))


def scored(rows: DataFrame, model, text: str = "text", score: str = "score") -> DataFrame:
    """``rows`` with the score of their text; needs columns that Arrow can carry."""
    kept = [c for c in rows.columns if c != text]

    def batches(it):
        for b in it:
            if model is None:
                s = np.full(b.num_rows, 0.5)
            else:
                w, bias, mean, scale = model
                x = np.array([features(t) for t in b.column(b.schema.get_field_index(text)).to_pylist()]).reshape(-1, N_FEATURES)
                s = 1 / (1 + np.exp(-np.clip(((x - mean) / scale) @ w + bias, -30, 30)))
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(c)) for c in kept], pa.array(s, pa.float64())], [*kept, score])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != text)
    return rows.mapInArrow(batches, f"{schema}, {score} double")


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every document."""
    model = train(docs, labels)
    rows = docs.select("doc_id", held_out(F.col("doc_id"), FOLDS, 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    return scored(rows, model).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier accepts, with their own columns."""
    model = train(docs, labels)
    rows = docs.select(packed(docs).alias("row_"), F.col("text").cast("string").alias("text_"))
    kept = scored(rows, model, "text_", "score_").where(F.col("score_") >= THRESHOLD)
    return unpacked(kept, docs.columns)
