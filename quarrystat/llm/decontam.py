"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Every three-word string of the benchmark items is counted over all documents (each
task counts, Spark sums). Seeds of an item are its rare ones: in at most
``RARE_SHARE`` of the documents, or among the rarer half of its own. The counts include
the leaks, so the rarest of every ``STRETCH`` strings in a row (six words) is a seed too,
whatever its count: a partial or edited copy with six words in a row keeps one. Documents that hold a seed are aligned
with the item around the seed: words, match +2, mismatch and gap -1. A hit is an
alignment of at least half the item's best score, or of ``LONG`` matching words with
four fifths of the aligned words equal; paraphrases with single words changed,
inserted or dropped stay above that.

The items are the query set. They are handled in blocks of bounded size, each against
all documents, and only a block of items is ever broadcast. Documents never move: the
alignment runs where the text is read, and one document needs memory for itself only.

Defined cases: null and empty texts have no words; items of fewer than three words give
no seeds and no hits; repeated rows are reported row by row, repeated items too; a null
doc_id is reported as null; an item with a null id or text is left out.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystat.llm.common import packed, unpacked

GRAM, RARE_SHARE, MIN_SCORE, LONG, MIN_EQUAL = 3, 0.001, 0.5, 13, 0.8
#: Of so many n-grams in a row the rarest is a seed.
STRETCH = 4
#: Bytes of benchmark text in a block.
BLOCK_BYTES = 8 << 20
_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def align(item: np.ndarray, part: np.ndarray) -> tuple[int, int, int, int, int]:
    """``(score, matches, length, start, end)`` of the best local alignment: word numbers
    of ``item`` and of ``part`` (negative: a word the benchmark does not have)."""
    n = len(part)
    h = np.zeros((len(item) + 1, n + 1), np.int32)
    steps = np.arange(n + 1, dtype=np.int32)
    for i, w in enumerate(item):
        row = np.zeros(n + 1, np.int32)
        row[1:] = np.maximum(h[i, :-1] + np.where(part == w, 2, -1), h[i, 1:] - 1)
        np.maximum(row, 0, out=row)
        h[i + 1] = np.maximum.accumulate(row + steps) - steps          # gaps along the part
    i, j = np.unravel_index(int(h.argmax()), h.shape)
    best, end, matches, length = int(h[i, j]), int(j), 0, 0
    while h[i, j] > 0:
        length += 1
        if i and j and h[i, j] == h[i - 1, j - 1] + (2 if part[j - 1] == item[i - 1] else -1):
            matches += part[j - 1] == item[i - 1]
            i, j = i - 1, j - 1
        elif i and h[i, j] == h[i - 1, j] - 1:
            i -= 1
        else:
            j -= 1
    return best, int(matches), length, int(j), end


class Index:
    """The n-grams of a block of items."""

    def __init__(self, items: list[tuple[int, str]]):
        self.vocab: dict[str, int] = {}
        self.items = []
        for item_id, text in items:
            w = np.array([self.vocab.setdefault(x, len(self.vocab)) for x in words_of(text)], np.int64)
            self.items.append((item_id, w))
        where = {}
        for k, (_, w) in enumerate(self.items):
            for at, code in enumerate(self.codes(w)[0].tolist()):
                where.setdefault(code, []).append((k, at))
        self.grams = np.array(sorted(where), np.int64)
        self.where = [where[c] for c in self.grams.tolist()]
        self.rare = np.ones(len(self.grams), bool)

    def codes(self, w: np.ndarray):
        """Codes of the n-grams made of benchmark words only, and their positions."""
        if len(w) < GRAM:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        a, b, c = w[:-2], w[1:-1], w[2:]
        at = np.flatnonzero((a >= 0) & (b >= 0) & (c >= 0))
        v = len(self.vocab)
        return (a[at] * v + b[at]) * v + c[at], at

    def numbers(self, text: str | None) -> np.ndarray:
        get = self.vocab.get
        return np.fromiter((get(x, -1) for x in words_of(text)), np.int64)

    def seeds(self, w: np.ndarray):
        """Gram numbers in a text and where."""
        code, at = self.codes(w)
        if not len(code) or not len(self.grams):
            return np.zeros(0, np.int64), at[:0]
        g = np.minimum(np.searchsorted(self.grams, code), len(self.grams) - 1)
        hit = self.grams[g] == code
        return g[hit], at[hit]

    def keep_rare(self, df: np.ndarray, n_docs: int) -> None:
        self.rare = df <= max(1, n_docs * RARE_SHARE)
        own: dict[int, set] = {}
        for g, places in enumerate(self.where):
            for k, _ in places:
                own.setdefault(k, set()).add(g)
        for grams in own.values():
            ranked = sorted(grams, key=lambda g: (df[g], g))
            self.rare[ranked[:(len(ranked) + 1) // 2]] = True
        for _, w in self.items:
            g = self.seeds(w)[0].tolist()
            for at in range(max(1, len(g) - STRETCH + 1) if g else 0):
                self.rare[min(g[at:at + STRETCH], key=lambda x: (df[x], x))] = True

    def hits(self, text: str | None):
        """``(item_id, score, matches, first word, last word)`` of every item that the text repeats."""
        w = self.numbers(text)
        g, at = self.seeds(w)
        near: dict[int, list[int]] = {}
        for gram, p in zip(g.tolist(), at.tolist()):
            if self.rare[gram]:
                for k, q in self.where[gram]:
                    near.setdefault(k, []).append(p - q)
        for k, shifts in near.items():
            item_id, item = self.items[k]
            slack, found, last = len(item) // 4 + 8, None, None
            spans = []
            for s in sorted(set(shifts)):                                # one window for seeds that lie together
                if last is None or s - last > slack:
                    spans.append([s, s])
                spans[-1][1] = last = s
            for lo, hi in spans:
                for base in range(lo, hi + 1, len(item) + slack):        # a long run of copies: window by window
                    a, b = max(0, base - slack), min(len(w), min(hi, base + len(item) + slack) + len(item) + slack)
                    score, matches, length, i, j = align(item, w[a:b])
                    good = score >= MIN_SCORE * 2 * len(item) or (matches >= LONG and matches >= MIN_EQUAL * length)
                    if good and (found is None or score > found[1]):
                        found = (item_id, score, matches, a + i, a + j, score / (2 * len(item)))
            if found:
                yield found


def _blocks(benchmark: DataFrame):
    """The items in blocks whose text has a bounded size."""
    items = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(
        F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-2 * size // BLOCK_BYTES))
    for k in range(n if size else 0):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).toArrow().to_pylist()
        yield Index(sorted((r["item_id"], r["text"]) for r in rows))


def _with_rare_seeds(docs: DataFrame, index: Index) -> Index:
    sent = docs.sparkSession.sparkContext.broadcast(index)

    def batches(it):
        ix = sent.value
        df, n = np.zeros(len(ix.grams) + 1, np.int64), 0
        for b in it:
            for t in b.column(0).to_pylist():
                df[np.unique(ix.seeds(ix.numbers(t))[0])] += 1
                n += 1
        df[-1] = n
        g = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(df[g])], ["g", "n"])
    sums = (docs.select(F.col("text").cast("string").alias("text")).mapInArrow(batches, "g long, n long")
            .groupBy("g").agg(F.sum("n").alias("n")).toArrow())
    df = np.zeros(len(index.grams) + 1, np.int64)
    df[sums.column(0).to_numpy()] = sums.column(1).to_numpy()
    index.keep_rare(df[:-1], int(df[-1]))
    return index


_HIT = "item_id long, score int, matches int, first_word int, last_word int, share double"


def _hits(docs: DataFrame, benchmark: DataFrame) -> list[DataFrame]:
    """Per block of items: each row with its hits as ``array<struct>``, rows without any left out."""
    out = []
    for index in _blocks(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(_with_rare_seeds(docs, index))

        def batches(it, sent=sent):
            for b in it:
                rows, found = [], []
                for k, t in enumerate(b.column(1).to_pylist()):
                    for hit in sent.value.hits(t):
                        rows.append(k)
                        found.append(hit)
                if rows:
                    cols = list(zip(*found))
                    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(pa.array(rows)), *[pa.array([x for x in c], k) for c, k in zip(cols, kinds)]],
                        ["doc_id", "item_id", "score", "matches", "first_word", "last_word", "share"])
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        out.append(rows.mapInArrow(batches, "doc_id long, " + _HIT))
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(doc_id, item_id, score, matches, first_word, last_word, share)``: one row for each
    document and item it repeats; ``share`` is the score over the item's best."""
    parts = _hits(docs, benchmark)
    if not parts:
        return docs.sparkSession.createDataFrame([], "doc_id long, " + _HIT)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that repeat no item, with their own columns. The filter runs where
    the text is read, block after block of items."""
    rows = docs.select(packed(docs).alias("row_"), F.col("text").cast("string").alias("text_"))
    for index in _blocks(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(_with_rare_seeds(docs, index))

        def batches(it, sent=sent):
            for b in it:
                clean = [next(sent.value.hits(t), None) is None for t in b.column(1).to_pylist()]
                yield b.filter(pa.array(clean, pa.bool_()))
        rows = rows.mapInArrow(batches, rows.schema)
    return unpacked(rows, docs.columns)
