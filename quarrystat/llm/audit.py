"""Filter interaction audit: what each filter removes, in every order of the filters.

One finite-state pass over the UTF-8 bytes of a text counts words, capitals, code points and
symbols. The pass is driven by a table: a byte's class is looked up, and since a class alone
decides whether the machine is inside a word, all bytes of a slice step at once. Word spans
found by the pass go into an open-addressed hash table whose matches are verified: document,
length and bytes are compared, so that distinct words are exact.

A document's filters are five bits. A batch of documents leaves the pass as a few numbers and a
digest; documents are then counted by part, bits and labels, and the 120 orders are read off
these counts. No text is shuffled and no order looks at a document again.

Defined cases: null text counts as empty (no words: A fails, B, C and D pass); a null id is
after every other for the identity filter, and two null ids never make each other fail; rows
with the same id and text do not make each other fail either; a null source is the empty
string; of several label rows for one id the larger mark counts, null marks are 0; texts longer
than a slice are read piece by piece with the distinct words carried along; an empty table
gives an empty result; other columns are never looked at.
"""

from __future__ import annotations

import hashlib
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystat.llm.common import LAST_ID, matched, saved

FILTERS = "ABCDE"
#: Bytes that the machine reads at once.
SLICE = 1 << 20
#: Classes of bytes, as bits: inside a word, first byte of a code point, capital, symbol.
WORD, POINT, CAPITAL, SYMBOL = 1, 2, 4, 8


def _classes() -> np.ndarray:
    """The class of every byte."""
    b = np.arange(256)
    blank = (b == 0x20) | ((b >= 0x09) & (b <= 0x0D))
    table = np.where(blank, 0, WORD) + np.where(b & 0xC0 == 0x80, 0, POINT)
    table += np.where((b >= 0x41) & (b <= 0x5A), CAPITAL, 0)
    return (table + np.where(np.isin(b, list(b"#$%&*|")), SYMBOL, 0)).astype(np.uint8)


CLASS = _classes()


def word_spans(raw: np.ndarray, edges: np.ndarray):
    """Starts and ends of the words of ``raw``, and the classes of its bytes. Words end at
    ``edges``, the ends of the texts."""
    kind = CLASS[raw]
    inside = (kind & WORD).view(bool)
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cut = edges[(edges > 0) & (edges < len(raw))]
    begins[cut] = inside[cut]
    ends = np.zeros(len(raw) + 1, bool)
    ends[1:] = inside
    ends[1:-1] &= ~inside[1:] | begins[1:]
    return np.flatnonzero(begins), np.flatnonzero(ends), kind


def _same_bytes(eights: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the spans that start at a and b hold the same ``size`` bytes."""
    same, todo, at = np.ones(len(a), bool), np.arange(len(a)), 0
    while len(todo):
        left = size[todo] - at
        mask = np.where(left >= 8, np.uint64(0xFFFFFFFFFFFFFFFF),
                        (np.uint64(1) << (8 * np.clip(left, 0, 7)).astype(np.uint64)) - np.uint64(1))
        same[todo] = (eights[a[todo] + at] ^ eights[b[todo] + at]) & mask == 0
        at += 8
        todo = todo[same[todo] & (size[todo] > at)]
    return same


def _hashes(eights: np.ndarray, start: np.ndarray, size: np.ndarray, doc: np.ndarray) -> np.ndarray:
    h = (doc.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) ^ size.astype(np.uint64)
    todo, at = np.arange(len(start)), 0
    while len(todo):
        left = size[todo] - at
        mask = np.where(left >= 8, np.uint64(0xFFFFFFFFFFFFFFFF),
                        (np.uint64(1) << (8 * np.clip(left, 0, 7)).astype(np.uint64)) - np.uint64(1))
        x = (h[todo] ^ (eights[start[todo] + at] & mask)) * np.uint64(0xD6E8FEB86659FD93)
        h[todo] = x ^ (x >> np.uint64(32))
        at += 8
        todo = todo[size[todo] > at]
    return h


def first_spans(raw: np.ndarray, start: np.ndarray, end: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Numbers of the spans that entered the table: one for each different word of a document."""
    n = len(start)
    if not n:
        return np.zeros(0, np.int64)
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    eights = np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))      # eight bytes from each place on
    size = end - start
    mask = np.int64((1 << int(2 * n - 1).bit_length()) - 1)
    slot = (_hashes(eights, start, size, doc) >> np.uint64(8)).astype(np.int64) & mask
    table, todo, entered = np.full(mask + 1, -1, np.int64), np.arange(n), []
    while len(todo):
        s = slot[todo]
        free = table[s] < 0
        table[s[free]] = todo[free]                         # of several for one slot one wins
        there = table[s]
        entered.append(todo[there == todo])
        same = (doc[there] == doc[todo]) & (size[there] == size[todo])
        at = np.flatnonzero(same)
        same[at] = _same_bytes(eights, start[there[at]], start[todo[at]], size[todo[at]])
        todo = todo[~same]
        slot[todo] = (slot[todo] + 1) & mask
    return np.concatenate(entered)


def _count_slice(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rows ``(words, distinct, capitals, points, symbols)`` of the texts that end at ``ends``."""
    first, last, kind = word_spans(raw, ends)
    doc = np.searchsorted(ends, first, side="right")
    n = len(ends)
    out = np.zeros((n, 5), np.int64)
    out[:, 0] = np.bincount(doc, minlength=n)
    out[:, 1] = np.bincount(doc[first_spans(raw, first, last, doc)], minlength=n)
    for k, bit in ((2, CAPITAL), (3, POINT), (4, SYMBOL)):
        running = np.concatenate([[0], np.cumsum(kind & bit != 0)])[ends]
        out[:, k] = np.diff(running, prepend=0)
    return out


def _count_long(raw: np.ndarray, size: int) -> np.ndarray:
    """The counts of one text, read in pieces that end with a blank where there is one."""
    out, seen, at = np.zeros(5, np.int64), set(), 0
    while at < len(raw):
        end = min(at + size, len(raw))
        while end < len(raw) and CLASS[raw[end - 1]] & WORD:       # to the end of the last word
            more = np.flatnonzero(CLASS[raw[end:end + size]] & WORD == 0)
            end = min(end + size, len(raw)) if not len(more) else end + int(more[0]) + 1
        part = raw[at:end]
        first, last, kind = word_spans(part, np.array([len(part)]))
        out[[0, 2, 3, 4]] += [len(first), *[int((kind & b != 0).sum()) for b in (CAPITAL, POINT, SYMBOL)]]
        own = first_spans(part, first, last, np.zeros(len(first), np.int64))
        seen.update(part[a:b].tobytes() for a, b in zip(first[own].tolist(), last[own].tolist()))
        at = end
    out[1] = len(seen)
    return out


def count_texts(raw: np.ndarray, ends: np.ndarray, size: int = SLICE) -> np.ndarray:
    """The counts of all texts of one buffer; ``ends`` are their ends, in order."""
    out, at, n = np.zeros((len(ends), 5), np.int64), 0, len(ends)
    while at < n:
        base = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + size, side="right")))
        part = raw[base:int(ends[to - 1])]
        if len(part) > size:
            out[at] = _count_long(part, size)
        else:
            out[at:to] = _count_slice(part, ends[at:to] - base)
        at = to
    return out


def failed_bits(counts: np.ndarray) -> np.ndarray:
    """Bits of the filters A to D."""
    words, distinct, capitals, points, symbols = counts.T
    tests = (words < 200, 100 * distinct < 50 * words, 100 * capitals > 2 * points, symbols > 0)
    return sum(t.astype(np.int32) << k for k, t in enumerate(tests))


def ledger(docs: DataFrame, size: int = SLICE) -> DataFrame:
    """``(d, part, words, distinct_words, capitals, points, symbols, bits, digest)``."""
    names = ["words", "distinct_words", "capitals", "points", "symbols"]

    def batches(it):
        for b in it:
            text = b.column(2).cast(pa.large_binary())
            offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset:text.offset + len(text) + 1]
            data = text.buffers()[2]
            raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
            counts = count_texts(raw[offsets[0]:offsets[-1]], offsets[1:] - offsets[0], size)
            digests = [hashlib.sha256(raw[a:z]).digest() for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), *[pa.array(np.ascontiguousarray(counts[:, k])) for k in range(5)],
                 pa.array(failed_bits(counts)), pa.array(digests, pa.binary())],
                names=["d", "part", *names, "bits", "digest"])
    src = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("d"),
                      F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
                      F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return src.mapInArrow(batches, "d long, part string, " + ", ".join(f"{n} long" for n in names)
                          + ", bits int, digest binary")


def _marks(labels: DataFrame) -> DataFrame:
    """``(d, good, toxic)`` of the ids that have a mark."""
    def mark(c):
        return F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c)
    return (labels.where("doc_id is not null and (quality = 1 or toxic = 1)")
            .groupBy(F.col("doc_id").cast("long").alias("d")).agg(mark("quality"), mark("toxic")))


def cells(docs: DataFrame, labels: DataFrame, size: int = SLICE) -> DataFrame:
    """``(part, bits, n, good, toxic)``: documents by part and failed filters, E included."""
    book = ledger(docs, size).select("d", "part", "bits", "digest")
    # rows of one id, text and part are one row with a count
    book = saved(book.groupBy("d", "part", "bits", "digest").agg(F.count("*").alias("n")), "audit-ledger")
    book = saved(matched(book, _marks(labels), ["d"]), "audit-marked")
    marks = [F.sum(F.col("n") * F.coalesce(c, F.lit(0))).alias(c) for c in ("quality", "toxic")]
    sums = [F.sum("n").alias("n"), *marks]
    firsts = book.groupBy("digest").agg(F.min("d").alias("d"))
    free = book.join(firsts, ["digest", "d"]).groupBy("part", "bits").agg(*sums)
    everyone = book.groupBy("part", "bits").agg(*sums)
    minus = free.select("part", "bits", *[(-F.col(c)).alias(c) for c in ("n", "quality", "toxic")])
    rest = everyone.unionByName(minus).groupBy("part", "bits").agg(*[F.sum(c).alias(c) for c in ("n", "quality", "toxic")])
    fifth = F.lit(1 << FILTERS.index("E"))
    return free.unionByName(rest.select("part", F.col("bits").bitwiseOR(fifth).alias("bits"), "n", "quality", "toxic")
                            ).withColumnRenamed("quality", "good")


def _steps() -> list[tuple[str, int, int, int]]:
    """``(order, step, bit of the step's filter, bits of the filters before it)`` of all orders."""
    out = []
    for order in permutations(range(len(FILTERS))):
        name, before = "".join(FILTERS[k] for k in order), 0
        for step, k in enumerate(order, 1):
            out.append((name, step, 1 << k, before))
            before |= 1 << k
    return out


def interactions(counts: DataFrame) -> DataFrame:
    """The counts of every part, order and step, from the documents by failed filters.

    A filter is the first to fail in ``120 / k`` of the orders for a document that fails k.
    """
    steps = F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(s).alias("step"), F.lit(f).alias("f"),
                               F.lit(p).alias("p")) for o, s, f, p in _steps()])
    rows = counts.select("part", "bits", "n", "good", "toxic", F.inline(steps))
    bits, f, p = F.col("bits"), F.col("f"), F.col("p")
    fails, earlier = bits.bitwiseAND(f) != 0, bits.bitwiseAND(p) != 0

    def total(test, what="n"):
        return F.sum(F.when(test, F.col(what)).otherwise(0))
    orders = len(_steps()) // len(FILTERS)
    return rows.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~earlier).alias("kept"), total(fails & ~earlier).alias("removed"),
        total(fails & earlier).alias("redundant"), total(bits == f).alias("unique_fails"),
        total(fails & ~earlier, "good").alias("good_lost"), total(fails & ~earlier, "toxic").alias("toxic_lost"),
        F.sum(F.when(fails, F.col("n") * F.expr(f"{orders} div bit_count(bits)")).otherwise(0)).alias("shapley"))


def filter_audit(docs: DataFrame, labels: DataFrame, size: int = SLICE) -> DataFrame:
    """``(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley)``: 600 rows for each part."""
    return interactions(saved(cells(docs, labels, size), "audit-cells"))


AUDIT_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, part, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
x AS (SELECT doc_id, part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w),
    100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text), regexp_matches(text, '[#$%&*|]'),
    doc_id > min(doc_id) OVER (PARTITION BY text)] AS fails FROM w),
l AS (SELECT doc_id, max((quality = 1)::INTEGER) AS good, max((toxic = 1)::INTEGER) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, fails, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
      FROM x LEFT JOIN l USING (doc_id) GROUP BY ALL),
f AS (SELECT unnest(range(1, 6)) AS k),
p AS (SELECT [a.k, b.k, c.k, d.k, e.k] AS o FROM f a, f b, f c, f d, f e
      WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
s AS (SELECT array_to_string(list_transform(o, lambda k: chr((64 + k)::INTEGER)), '') AS filter_order, step, o[step] AS k,
        o[1:step - 1] AS before FROM p, unnest(range(1, 6)) t(step)),
r AS (SELECT part, filter_order, step, n, good, toxic, fails[k] AS hit,
        len(list_filter(before, lambda b: fails[b])) > 0 AS earlier,
        len(list_filter(fails, lambda b: b)) AS k_fails FROM c, s)
SELECT part, filter_order, step::INTEGER AS step,
  coalesce(sum(n) FILTER (WHERE NOT hit AND NOT earlier), 0)::BIGINT AS kept,
  coalesce(sum(n) FILTER (WHERE hit AND NOT earlier), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (WHERE hit AND earlier), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (WHERE hit AND k_fails = 1), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (WHERE hit AND NOT earlier), 0)::BIGINT AS good_lost,
  coalesce(sum(toxic) FILTER (WHERE hit AND NOT earlier), 0)::BIGINT AS toxic_lost,
  coalesce(sum(n * 120 // greatest(k_fails, 1)) FILTER (WHERE hit), 0)::BIGINT AS shapley
FROM r GROUP BY ALL
"""
