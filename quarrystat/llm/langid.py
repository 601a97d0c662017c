"""Language identification by prediction by partial matching.

Every language has a context tree over bytes up to order 3. A node predicts a seen
byte with c / (T + d) (c its count, T the node's total, d its distinct bytes) and leaves
d / (T + d) to the shorter context, with the seen bytes excluded; below order 0 all 256
bytes are equal. Contexts with a small share of the training bytes are cut, so the order
varies. Statistics are frozen after training, and the code length of a text is exact: the
sum of -log2 p over its bytes, each in its longest known context. The language with the
shortest code wins; ``score`` is its share when code lengths are turned into probabilities
at ``SCORE_BYTES`` bytes of evidence.

Counts come from every training document: each task counts four-byte strings, sums are
combined by Spark. What reaches the driver is bounded: contexts above ``LEAST_SHARE`` of a
language's bytes, at most 1 / LEAST_SHARE per order and language.

Defined cases: null text, or a text without a letter, is ``und`` with score 0, as is any
text if nothing was learnt; null languages are not learnt from; a null id is never held out,
so its text is learnt from; ties go to the first language by name; repeated rows are learnt
from and judged row by row; very long texts are read whole, in runs of bounded size; an empty
table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystat.llm.common import held_out, saved

ORDER, LEAST_SHARE, LEAST_COUNT, SCORE_BYTES = 3, 1e-4, 8, 64
FOLDS, HELD = 4, 2
_LETTER = re.compile(r"[^\W\d_]")
_BLOCK = 1 << 21


def _blocks(raws: list[bytes]):
    """Runs of whole texts of about ``_BLOCK`` bytes: ``(positions, texts)``."""
    at, size, ids = [], 0, []
    for k, r in enumerate(raws):
        at.append(r)
        ids.append(k)
        size += len(r)
        if size >= _BLOCK:
            yield ids, at
            at, size, ids = [], 0, []
    if at:
        yield ids, at


def _laid_out(raws: list[bytes]):
    """Bytes with ``ORDER`` zeros before each text, and where each text starts."""
    lens = np.fromiter(map(len, raws), np.int64, len(raws))
    starts = np.concatenate([[0], np.cumsum(lens + ORDER)[:-1]]) + ORDER
    return np.frombuffer(b"".join(b"\0" * ORDER + r for r in raws), np.uint8), starts, lens


def _grams(raws: list[bytes]):
    """Distinct four-byte strings (context and byte) and their counts."""
    b, starts, _ = _laid_out(raws)
    if len(b) <= ORDER:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    g = b.astype(np.uint32)
    g = (g[:-3] << 24) | (g[1:-2] << 16) | (g[2:-1] << 8) | g[3:]
    real = np.ones(len(b), bool)
    for k in range(1, ORDER + 1):
        real[starts - k] = False
    g = np.sort(g[real[3:]])
    new = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, np.int64)
    return g[new], np.diff(np.append(new, len(g)))


def _added(parts):
    g, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(g, kind="stable")
    g, n = g[order], n[order]
    new = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, np.int64)
    return (g[new], np.add.reduceat(n, new)) if len(g) else (g, n)


def gram_counts(docs: DataFrame) -> DataFrame:
    """``(lang, gram, n)`` over all training documents."""
    def batches(it):
        sums: dict = {}
        for b in it:
            by: dict = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                by.setdefault(lang, []).append(text.encode("utf-8", "surrogatepass"))
            for lang, raws in by.items():
                for _, block in _blocks(raws):
                    sums.setdefault(lang, []).append(_grams(block))
                if len(sums[lang]) > 16:
                    sums[lang] = [_added(sums[lang])]
        for lang, parts in sums.items():
            g, n = _added(parts)
            for at in range(0, len(g), 1 << 16):
                k = len(g[at:at + (1 << 16)])
                yield pa.RecordBatch.from_arrays([pa.array([lang] * k), pa.array(g[at:at + k].astype(np.int64)), pa.array(n[at:at + k])],
                                                 ["lang", "gram", "n"])
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"), FOLDS, HELD)).select(
        F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(batches, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _tree_counts(docs: DataFrame):
    """``{order: DataFrame (lang, ctx, byte, n)}`` of the contexts that stay, collected (bounded)."""
    grams = saved(gram_counts(docs), "grams")
    total = grams.groupBy("lang").agg(F.sum("n").alias("total"))
    out = {}
    for k in range(ORDER + 1):
        g = grams.groupBy("lang", F.col("gram").bitwiseAND((1 << (8 * (k + 1))) - 1).alias("g")).agg(F.sum("n").alias("n"))
        ctx = F.shiftright("g", 8)
        sums = (g.groupBy("lang", ctx.alias("ctx")).agg(F.sum("n").alias("t")).join(F.broadcast(total), "lang")
                .where((F.col("t") >= F.col("total") * LEAST_SHARE) & (F.col("t") >= LEAST_COUNT) | F.lit(k == 0)).select("lang", "ctx"))
        out[k] = (g.select("lang", ctx.alias("ctx"), F.col("g").bitwiseAND(255).alias("byte"), "n")
                  .join(sums, ["lang", "ctx"]).toPandas())
    return out


class Model:
    """Code lengths by state and byte: ``cost[state * A + symbol, language]`` in bits."""

    def __init__(self, counts):
        self.langs = sorted(counts[0]["lang"].unique())
        seen = np.union1d(counts[0]["byte"].to_numpy(np.int64), [0])    # 0 also stands before each text
        self.symbol = np.zeros(256, np.int64)              # 0: a byte never seen in training
        self.symbol[seen] = np.arange(1, len(seen) + 1)
        a = self.size = len(seen) + 1
        tables = [self._trees(counts, lang, a) for lang in self.langs]
        # States: the contexts that any language keeps, shortest first.
        states = [()] + [c for k in range(1, ORDER + 1) for c in sorted({c for t in tables for c in t if len(c) == k})]
        number = {c: i for i, c in enumerate(states)}
        cost = np.zeros((len(states), a, len(self.langs)), np.float32)
        for j, t in enumerate(tables):
            for i, c in enumerate(states):
                while c not in t:
                    c = c[1:]
                cost[i, :, j] = -np.log2(t[c])
        self.cost = cost.reshape(-1, len(self.langs))
        go = np.zeros((a,) * ORDER, np.int32)
        for c, i in number.items():                        # longer contexts overwrite shorter ones
            if c:
                go[(slice(None),) * (ORDER - len(c)) + c] = i
        self.go = go.reshape(-1)

    def _trees(self, counts, lang, a):
        uniform = np.full(a, 1 / 256)
        unseen = 256 - (a - 1)                             # bytes that symbol 0 stands for
        trees = {}
        for k in range(ORDER + 1):
            own = counts[k][counts[k]["lang"] == lang]
            for ctx, rows in own.groupby("ctx"):
                c = tuple(int(self.symbol[(int(ctx) >> (8 * (k - 1 - i))) & 255]) for i in range(k))
                low = c[1:] if k else None
                while low is not None and low not in trees:
                    low = low[1:]
                base = trees[low] if low is not None else uniform
                at, n = self.symbol[rows["byte"].to_numpy(np.int64)], rows["n"].to_numpy(np.float64)
                total, distinct = n.sum(), len(n)
                free = base.copy()
                free[at] = 0
                mass = free[1:].sum() + free[0] * unseen
                p = free * (distinct / (total + distinct) / max(mass, 1e-300))
                p[at] = n / (total + distinct)
                trees[c] = p
        return trees

    def code_lengths(self, raws: list[bytes]) -> np.ndarray:
        """Bits of each text under each language."""
        out = np.zeros((len(raws), len(self.langs)))
        for ids, block in _blocks(raws):
            b, starts, lens = _laid_out(block)
            s, a = self.symbol[b], self.size
            if len(s) <= ORDER:
                continue
            state = self.go[(s[:-3] * a + s[1:-2]) * a + s[2:-1]].astype(np.int64)
            bits = np.take(self.cost, state * a + s[3:], axis=0)
            whole = np.concatenate([np.zeros((1, bits.shape[1])), np.cumsum(bits, axis=0, dtype=np.float64)])
            out[ids] = whole[starts - 3 + lens] - whole[starts - 3]
        return out


def predict(model: Model | None, texts: list[str | None]):
    """``(language, score, bits per byte)`` lists."""
    raws = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    known = [model is not None and t is not None and bool(_LETTER.search(t)) for t in texts]
    if model is None:
        return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
    bits = model.code_lengths(raws)
    n = np.maximum(1, np.fromiter(map(len, raws), np.int64, len(raws)))
    best = bits.argmin(axis=1) if len(raws) else np.zeros(0, np.int64)
    more = (bits - bits.min(axis=1, keepdims=True)) / n[:, None] * np.minimum(n, SCORE_BYTES)[:, None]
    score = np.where(known, 1 / np.exp2(-np.minimum(more, 500)).sum(axis=1), 0.0)
    return [model.langs[i] if k else "und" for i, k in zip(best, known)], score, bits.min(axis=1) / n


def train(docs: DataFrame) -> Model | None:
    counts = _tree_counts(docs)
    return Model(counts) if len(counts[0]) else None


def languages(docs: DataFrame) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score, bits_per_byte)`` of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs))

    def batches(it):
        for b in it:
            lang, score, bits = predict(sent.value, b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64()),
                                              pa.array(bits, pa.float64())], ["doc_id", "held_out", "lang_pred", "score", "bits_per_byte"])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id"), FOLDS, HELD).alias("held_out"),
                       F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(batches, "doc_id long, held_out boolean, lang_pred string, score double, bits_per_byte double")
