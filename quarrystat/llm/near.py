"""Near duplicates by exact Jaccard similarity of word shingles, after SimHash if wanted.

Two documents are linked when the Jaccard similarity of their sets of five-word shingles
is at least 0.8; groups are the connected components of the links.

Fingerprints. With ``prints`` the search begins with SimHash: documents are also linked when
their fingerprints are, by the links of ``simhash``. Every text counts there, not one of each
set. What these links join is not compared any more; the exact search finds the similar pairs
whose fingerprints lie farther apart.

Search. Of a set of n shingles in one order for all sets, the first ``n - ceil(0.8 n) + 1``
are its keys: sets that similar share a key, whatever the order is. The order puts the
shingles that a sample found in several sets last, the commonest at the end (a hint about
speed only), then goes by hash. A pair on a key must allow the overlap by the places of the
key in both sets, and then by their bitmaps: a bit is the parity of the shingles that fall in
it, so that two bitmaps differ in no more bits than the sets do in shingles. What is left is
compared in full, so no link is lost and none is wrong. Texts are shingled once; only those
of pairs that pass are read again.

Skew. Equal sets are one from the start. Of a key with more than ``PAIR_LIMIT`` sets not
all pairs are formed: each set meets the first, the last and the one before it in a block of
the key, and after that only the sets of the same key in other components. These meet block
against block, bitmaps against bitmaps, and only the pairs that pass leave the task.

Defined cases: null or wordless texts are one group; fewer words than a shingle: all words
make one; A-Z and ASCII blanks count as in the fingerprints; sets are told apart by a
128-bit digest; very long texts are hashed in pieces and count whole; an empty table gives
an empty result; columns that clash with names used here are carried in one struct.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrystat.llm.common import matched, one_row_of_each, row_digest, row_id, saved
from quarrystat.llm.simhash import _signed, components, fingerprint, links, shingle_hashes

WORDS = 5
#: The least similarity as a fraction.
OVER, UNDER = 4, 5
#: Above so many sets on one key, not all pairs are formed at once.
PAIR_LIMIT = 16
#: The hint: one set in so many, shingles in so many of these, and how many shingles at most.
HINT_EVERY, HINT_LEAST, HINT_MOST = 16, 3, 500_000
#: Bitmaps: bits for each shingle, and the least and the largest number of bits.
BIT_SHARE, LEAST_BITS, MOST_BITS = 4, 512, 1 << 17
#: Sets of a key in one block, and three-number rows that may be broadcast.
BLOCK_SETS, BROADCAST_ROWS = 512, 1_000_000


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct shingle hashes."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(text, words)])).view(np.int64)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return UNDER * both >= OVER * (len(a) + len(b) - both)


def bitmap(h: np.ndarray) -> np.ndarray:
    """Parities of the shingles by their low bits, packed; the number of bits is a power of two."""
    bits = LEAST_BITS
    while bits < min(BIT_SHARE * len(h), MOST_BITS):
        bits *= 2
    return np.packbits(np.bincount(h & (bits - 1), minlength=bits).astype(np.uint8) & 1, bitorder="little")


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """A bitmap of ``size`` bytes of the same shingles (rows of bitmaps too)."""
    while bits.shape[-1] > size:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def may_be_similar(differ, n, m):
    """Whether sets of n and m shingles that differ in at least ``differ`` can be similar."""
    return differ * (UNDER + OVER) <= (n + m) * (UNDER - OVER)


def key_count(n: int) -> int:
    return n + OVER * -n // UNDER + 1 if n else 0


class _Order:
    """Shingles in the order of all sets: unknown ones by hash, then the common, rarest first."""

    def __init__(self, late: np.ndarray):
        by_hash = np.argsort(late, kind="stable")
        self.hashes, self.rank = late[by_hash], by_hash

    def first(self, h: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return h[:key_count(len(h))]
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        known = self.hashes[at] == h
        last = h[known][np.argsort(self.rank[at[known]], kind="stable")]
        return np.concatenate([h[~known], last])[:key_count(len(h))]


def _late(docs: DataFrame, words: int) -> np.ndarray:
    """Common shingles of a sample of the texts, rarest first."""
    def batches(it):
        for b in it:
            for t in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t, words))], ["key"])
    rows = docs.select(F.col("text").cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    sample = rows.where(F.pmod(F.col("h"), F.lit(HINT_EVERY)) == 0).dropDuplicates(["h"]).select("text")
    seen = sample.mapInArrow(batches, "key long").groupBy("key").count().where(F.col("count") >= HINT_LEAST)
    common = seen.orderBy(F.desc("count"), "key").limit(HINT_MOST).select("key").toArrow()
    return common.column(0).to_numpy()[::-1].copy()


def _texts(docs: DataFrame, words: int, prints: int | None = None) -> DataFrame:
    """``(d, r, g1, g2, n, keys, bits)``: id, row digest, digest and size of the set, keys, bitmap.
    With ``prints``, the number of words of a fingerprint's shingles, the fingerprint ``f`` too."""
    sent = docs.sparkSession.sparkContext.broadcast(_late(docs, words))

    def batches(it):
        order = _Order(sent.value)
        for b in it:
            g1, g2, n, keys, bits, f = [], [], [], [], [], []
            for t in b.column(2).to_pylist():
                if prints:
                    f.append(_signed(fingerprint(t, prints)))
                h = shingle_set(t, words)
                g = np.frombuffer(xxhash.xxh3_128_digest(h.tobytes()), np.int64)
                g1.append(g[0])
                g2.append(g[1])
                n.append(len(h))
                keys.append(order.first(h))
                bits.append(bitmap(h).tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), *[pa.array(c, pa.int64()) for c in (g1, g2, n)],
                 pa.array(keys, pa.list_(pa.int64())), pa.array(bits, pa.binary()), *([pa.array(f, pa.int64())] if prints else [])],
                ["d", "r", "g1", "g2", "n", "keys", "bits", *(["f"] if prints else [])])
    rows = docs.select(row_id().alias("d"), row_digest(docs).alias("r"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(batches, "d long, r long, g1 long, g2 long, n long, keys array<long>, bits binary"
                           + ", f long" * bool(prints))


def _print_links(texts: DataFrame, sets: DataFrame) -> DataFrame:
    """``(a, b)``: links between sets that hold texts of equal or linked fingerprints."""
    held = saved(texts.select("f", "g1", "g2").distinct().join(sets.select("g1", "g2", "no"), ["g1", "g2"]).select("f", "no"),
                 "near-prints")
    first = saved(held.groupBy("f").agg(F.min("no").alias("low")), "near-prints-first")
    one, two = (first.select(F.col("f").alias(k), F.col("low").alias("l" + k)) for k in "ab")
    across = links(first.select("f")).join(one, "a").join(two, "b").select(*_ordered("la", "lb"))
    inside = held.join(first, "f").select(F.col("low").alias("a"), F.col("no").alias("b"))
    return inside.unionByName(across).where("a < b").distinct()


def _passing(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of the pairs ``(a, b)`` those whose bitmaps allow the similarity."""
    def batches(it):
        for t in it:
            a, b, n, m, x, y = [c.to_pylist() for c in t.columns]
            ok = []
            for k in range(len(a)):
                p, q = np.frombuffer(x[k], np.uint8), np.frombuffer(y[k], np.uint8)
                size = min(len(p), len(q))
                differ = int(np.bitwise_count((folded(p, size) ^ folded(q, size)).view(np.uint64)).sum())
                ok.append(may_be_similar(differ, n[k], m[k]))
            yield t.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))
    one = sets.select(F.col("no").alias("a"), "n", F.col("bits").alias("x"))
    two = sets.select(F.col("no").alias("b"), F.col("n").alias("m"), F.col("bits").alias("y"))
    rows = pairs.join(one, "a").join(two, "b").select("a", "b", "n", "m", "x", "y")
    return rows.mapInArrow(batches, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """``(a, b)`` of the pairs that are similar, by their texts."""
    def batches(it):
        known: dict[int, np.ndarray] = {}

        def get(no, text):
            if no not in known:
                if len(known) >= 256:
                    known.clear()
                known[no] = shingle_set(text, words)
            return known[no]
        for t in it:
            c = [x.to_pylist() for x in t.columns]
            ok = [similar(get(a, x), get(b, y)) for a, b, x, y in zip(*c)]
            yield t.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))
    need = pairs.select(F.col("a").alias("no")).unionByName(pairs.select(F.col("b").alias("no"))).distinct()
    need = saved(sets.select("no", "d", "r").join(need, "no"), "near-need")
    need = F.broadcast(need) if need.count() <= BROADCAST_ROWS else need
    rows = docs.select(row_id().alias("d"), row_digest(docs).alias("r"), F.col("text").cast("string").alias("text"))
    # the row that stands for a set; rows equal throughout are one
    texts = rows.join(need, ["d", "r"]).groupBy("no").agg(F.first("text").alias("text"))
    texts = saved(texts, "near-verify")
    one, two = (texts.select(F.col("no").alias(k), F.col("text").alias("t" + k)) for k in "ab")
    return pairs.join(one, "a").join(two, "b").select("a", "b", "ta", "tb").mapInArrow(batches, "a long, b long")


def _fits(n, m, i=None, j=None):
    """Sizes, and places of a shared key, that allow the similarity: no more than the key, what
    is before it in both and what is behind it in both can be shared."""
    ok = F.least(n, m) * UNDER >= F.greatest(n, m) * OVER
    if i is None:
        return ok
    most = F.least(i, j) + 1 + F.least(n - i, m - j) - 1
    return ok & (most * (UNDER + OVER) >= (n + m) * OVER)


def _ordered(x: str, y: str):
    return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")


def _cell_pairs(table: pa.Table) -> pa.Table:
    """The pairs of a cell (two blocks of one key and bitmap size) in different components that
    pass sizes and bitmaps."""
    c = {k: table.column(k).to_numpy() for k in ("blk", "no", "n", "root", "own")}
    p, q = table.column("p")[0].as_py(), table.column("q")[0].as_py()
    size = table.column("size")[0].as_py()
    bits = np.stack([folded(np.frombuffer(x, np.uint8), size) for x in table.column("bits").to_pylist()]).view(np.uint64)
    left, right, out = np.flatnonzero(c["blk"] == p), np.flatnonzero(c["blk"] == q), []
    n, no, root, own = c["n"], c["no"], c["root"], c["own"].astype(bool)
    for i in left.tolist():
        ok = right[(root[right] != root[i]) & (own[right] | own[i]) & (no[right] < no[i] if p == q else True)
                   & (np.minimum(n[right], n[i]) * UNDER >= np.maximum(n[right], n[i]) * OVER)]
        differ = np.bitwise_count(bits[ok] ^ bits[i]).sum(1)
        ok = ok[may_be_similar(differ.astype(np.int64), n[ok], n[i])]
        out.append(np.column_stack([np.full(len(ok), no[i]), no[ok]]))
    pairs = np.concatenate(out) if out else np.zeros((0, 2), np.int64)
    return pa.table({"a": pairs.min(1) if len(pairs) else pairs[:, 0], "b": pairs.max(1) if len(pairs) else pairs[:, 1]})


def _across(inside: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs of sets of one key in different components ``(key, no, n, root)`` that bitmaps allow.

    Sets meet at one size of bitmap: each at its own, and those small enough to be similar to a
    set of the next smaller size there too, folded.
    """
    rows = inside.join(sets.select("no", "bits"), "no").withColumn("size", F.octet_length("bits"))
    # a set of the size below has at most 8 * size / 2 / BIT_SHARE shingles
    reach = (F.col("size") * 8 > LEAST_BITS) & (F.col("n") * OVER * BIT_SHARE <= F.col("size") * 4 * UNDER)
    both = F.when(reach, F.array(F.struct("size", F.lit(True).alias("own")),
                                 F.struct((F.col("size") / 2).cast("int").alias("size"), F.lit(False).alias("own")))
                  ).otherwise(F.array(F.struct("size", F.lit(True).alias("own"))))
    rows = rows.select("key", "no", "n", "root", "bits", F.inline(both))
    blocks = rows.groupBy("key", "size").agg((F.expr(f"count(*) div {BLOCK_SETS}") + 1).cast("int").alias("blocks"))
    rows = rows.join(blocks, ["key", "size"]).withColumn("blk", F.pmod(F.xxhash64("no"), F.col("blocks")).cast("int"))
    cells = (rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .withColumn("p", F.greatest("blk", "o")).withColumn("q", F.least("blk", "o")).drop("o", "blocks"))
    return cells.groupBy("key", "size", "p", "q").applyInArrow(_cell_pairs, "a long, b long").distinct()


def groups(sets: DataFrame, docs: DataFrame, words: int = WORDS, linked: DataFrame | None = None) -> DataFrame:
    """``(node, root)`` of the sets ``(no, d, r, n, keys, bits)`` that are linked to another;
    ``linked`` are links ``(a, b)`` known before."""
    keys = sets.select("no", "n", F.posexplode("keys").alias("i", "key"))
    counts = keys.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    keyed = saved(keys.join(counts, "key"), "near-keys")
    few, hot = keyed.where(F.col("c") <= PAIR_LIMIT), keyed.where(F.col("c") > PAIR_LIMIT)
    x = few.select("key", F.col("no").alias("a"), "n", "i")
    y = few.select("key", F.col("no").alias("b"), F.col("n").alias("m"), F.col("i").alias("j"))
    pairs = x.join(y, "key").where((F.col("a") < F.col("b")) & _fits(*map(F.col, "nmij"))).select("a", "b")
    ends = hot.groupBy("key").agg(F.min(F.struct("n", "no")).alias("low"), F.max(F.struct("n", "no")).alias("high"))
    block = F.pmod(F.xxhash64("no"), F.expr(f"c div {BLOCK_SETS}") + 1)
    before = F.lag(F.struct("n", "no")).over(Window.partitionBy("key", block).orderBy("n", "no")).alias("prev")
    met = (hot.select("key", "no", "n", before).join(ends, "key")
           .select("no", "n", F.explode(F.array("low", "high", "prev")).alias("o")).where("o is not null")
           .where((F.col("o.no") != F.col("no")) & _fits(F.col("n"), F.col("o.n"))).withColumn("h", F.col("o.no")))
    met = pairs.unionByName(met.select(*_ordered("no", "h"))).distinct()
    if linked is not None:
        met = met.join(linked, ["a", "b"], "left_anti")
    tried = saved(_passing(met, sets), "near-pairs")
    found = saved(_verified(tried, sets, docs, words), "near-links")
    if linked is not None:
        found = found.unionByName(linked)
    roots = saved(components(found), "near-roots")
    inside = (hot.select("key", "no", "n").join(roots, F.col("no") == F.col("node"), "left")
              .select("key", "no", "n", F.coalesce("root", "no").alias("root")))
    apart = inside.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    rest = _across(saved(inside.join(apart, "key"), "near-apart"), sets)
    rest = saved(rest.join(tried, ["a", "b"], "left_anti"), "near-rest")
    more = saved(_verified(rest, sets, docs, words), "near-links")
    return roots if more.isEmpty() else saved(components(found.unionByName(more)), "near-roots")


def one_of_each_group(docs: DataFrame, words: int = WORDS, prints: int | None = None) -> DataFrame:
    """One row of each group: the one with the smallest id, then the smallest row digest.
    ``prints``: documents whose SimHash of so many words is linked are of one group too."""
    texts = saved(_texts(docs, words, prints), "near-texts")
    sets = saved(texts.dropDuplicates(["g1", "g2"]).withColumn("no", F.monotonically_increasing_id()), "near-sets")
    rows = matched(texts.select("d", "r", "g1", "g2"), sets.select("g1", "g2", "no"), ["g1", "g2"])
    linked = saved(_print_links(texts, sets), "near-linked") if prints else None
    marks = rows.join(groups(sets, docs, words, linked), F.col("no") == F.col("node"), "left")
    return one_row_of_each(docs, marks.select("d", "r", F.coalesce("root", "no").alias("g")))
