"""SimHash near-dedup with pigeonring filtering.

A document's fingerprint has bit b set when more than half of its shingle hashes
have it. Fingerprints at most two bits apart are linked; groups are the connected
components of the links.

Search. The 64 bits are six segments on a ring. If two fingerprints differ in at
most two bits, some segment starts a chain whose first l segments differ in at most
``l * 2 / 6`` bits together, for every l (the strong form of the pigeonhole rule on a
ring). So the first two segments of the chain are equal, and of the next two at most
one differs: two 32-bit keys per start, twelve per fingerprint. Rows that share a key
must pass every budget of the chain before the full Hamming check.

Skew. Equal fingerprints are one row from the start (combined before the shuffle).
Where a key is shared by more than ``PAIR_LIMIT`` fingerprints, pairs are not formed:
two fingerprints are at most two bits apart exactly when they have a fingerprint at
most one bit from both, so each gives its 65 neighbours, and those that share one are
linked to the smallest of them. A neighbour has at most 65 givers: no group can grow,
and no link is lost.

Components. Alternating rounds of edges to the smaller neighbour (large and small
stars), saved each round, until nothing changes.

Defined cases: null or wordless text has fingerprint zero and is linked like any
other; fewer words than a shingle: all words make one; rows with the same id and
different texts each keep their row and count as separate documents; a null id is
read as the largest id and returned as null when it names a component.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystat.llm.common import LAST_ID, one_row_of_each, row_digest, row_id, saved

SEGMENTS, MAX_BITS = 6, 2
#: Above so many fingerprints on one key, neighbours take the place of pairs.
PAIR_LIMIT = 16
_CUTS = [round(i * 64 / SEGMENTS) for i in range(SEGMENTS + 1)]
_MASKS = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(_CUTS, _CUTS[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shingle_hashes(text: str | None, words: int):
    """The hashes of a text's shingles, repeats too, in blocks of bounded size."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()    # bytes: A-Z and ASCII blanks only
    if not tokens:
        return
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(tokens) - words + 1)
    first, last = starts[:n].tolist(), ends[min(words, len(tokens)) - 1:].tolist()
    joined, digest = memoryview(b" ".join(tokens)), xxhash.xxh64_intdigest
    for at in range(0, n, 1 << 16):                                           # very long texts: bounded blocks
        yield np.fromiter([digest(joined[a:b], 42) for a, b in zip(first[at:at + (1 << 16)], last[at:at + (1 << 16)])],
                          np.uint64)


def fingerprint(text: str | None, words: int = 3) -> int:
    """The 64-bit fingerprint of one text, unsigned."""
    ones, n = np.zeros(64, np.int64), 0
    for h in shingle_hashes(text, words):
        n += len(h)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 3, digest: Column | None = None) -> DataFrame:
    """``(doc_id, d, f)`` of every document; d is the id with null last, f signed. With
    ``digest``, a number of each row, also that as ``r``."""
    more = [] if digest is None else [digest.alias("r")]

    def batches(it):
        for b in it:
            f = [_signed(fingerprint(t, words)) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(f, pa.int64()), *b.columns[3:]],
                                             ["doc_id", "d", "f", *b.schema.names[3:]])
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_id().alias("d"), F.col("text").cast("string").alias("text"), *more)
    return src.mapInArrow(batches, "doc_id long, d long, f long" + ", r long" * len(more))


def _keys(fps: DataFrame) -> DataFrame:
    """``(key, start, f)``: twelve keys of each fingerprint."""
    kinds = []
    for i in range(SEGMENTS):
        for step in (2, 3):
            mask = _MASKS[i] | _MASKS[(i + 1) % SEGMENTS] | _MASKS[(i + step) % SEGMENTS]
            kinds.append(F.struct(F.lit(i).alias("start"),
                                  F.xxhash64(F.lit(i * 4 + step), F.col("f").bitwiseAND(F.lit(_signed(mask)))).alias("key")))
    return fps.select("f", F.inline(F.array(*kinds))).select("key", "start", "f")


def _chain_holds(diff, start):
    """Every chain prefix from ``start`` within its share of ``MAX_BITS``."""
    def at(i):
        total, ok = F.lit(0), F.lit(True)
        for step in range(SEGMENTS):
            total = total + F.bit_count(diff.bitwiseAND(F.lit(_signed(_MASKS[(i + step) % SEGMENTS]))))
            ok = ok & (total <= (step + 1) * MAX_BITS // SEGMENTS)
        return ok
    out = F.lit(False)
    for i in range(SEGMENTS):
        out = F.when(start == i, at(i)).otherwise(out)
    return out


def links(fps: DataFrame) -> DataFrame:
    """``(a, b)``, a < b: links between distinct fingerprints ``f`` that connect whatever
    is at most two bits apart (crowded keys: through the smallest, not pair by pair)."""
    keys = _keys(fps)
    counts = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    keyed = saved(keys.join(counts, "key"), "simhash-keys")
    few = keyed.where(F.col("n") <= PAIR_LIMIT)
    x, y = few.select("key", "start", F.col("f").alias("a")), few.select("key", F.col("f").alias("b"))
    diff = F.col("a").bitwiseXOR(F.col("b"))
    pairs = (x.join(y, "key").where((F.col("a") < F.col("b")) & _chain_holds(diff, F.col("start"))
                                    & (F.bit_count(diff) <= MAX_BITS)).select("a", "b"))
    flips = F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << b)) for b in range(64)])
    near = (keyed.where(F.col("n") > PAIR_LIMIT).select("f").distinct()
            .select("f", F.explode(F.transform(flips, lambda m: m.bitwiseXOR(F.col("f")))).alias("near")))
    stars = (near.groupBy("near").agg(F.min("f").alias("a"), F.collect_list("f").alias("fs"))      # 65 at most
             .select("a", F.explode("fs").alias("b")).where("a < b"))
    return pairs.unionByName(stars).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` of every node with an edge: the smallest node it can reach."""
    def both(e):
        return e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def state(e):
        r = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return tuple(r)
    e = saved(edges, "links")
    before = state(e)
    while before[0]:
        # Large star: larger neighbours of a node go to its smallest neighbour.
        m = both(e)
        low = m.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = (m.where("b > a").join(low, "a").select(F.col("low").alias("a"), "b").where("a < b").distinct())
        # Small star: a node and its smaller neighbours go to the smallest of them.
        low = large.groupBy("b").agg(F.min("a").alias("low"))
        small = (large.join(low, "b").select("low", F.explode(F.array("a", "b")).alias("b"))
                 .select(F.col("low").alias("a"), "b").where("a < b").distinct())
        e = saved(small, "links")
        now = state(e)
        if now == before:
            break
        before = now
    return e.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(
        e.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def _components_of(prints: DataFrame) -> DataFrame:
    """``(f, d, root)`` of each fingerprint: its smallest id and its component."""
    fps = saved(prints.groupBy("f").agg(F.min("d").alias("d")), "simhash-distinct")
    roots = saved(components(links(fps)), "simhash-roots")
    return fps.join(roots, fps["f"] == roots["node"], "left").select("f", "d", F.coalesce("root", "f").alias("root"))


def _grouped(prints: DataFrame) -> DataFrame:
    """``(f, component)``: the smallest id reachable from each fingerprint."""
    rooted = _components_of(prints)
    small = rooted.groupBy("root").agg(F.min("d").alias("component"))
    return saved(rooted.join(small, "root").select("f", "component"), "simhash-groups")


def near_duplicates(docs: DataFrame, words: int = 3) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` of every document."""
    prints = saved(fingerprints(docs, words), "simhash")
    out = prints.join(_grouped(prints), "f")
    return out.select("doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"),
                      F.when(F.col("component") < LAST_ID, F.col("component")).alias("component_id"))


def one_of_each_group(docs: DataFrame, words: int = 3) -> DataFrame:
    """One row of each component: the one with the smallest id, then the smallest row digest."""
    prints = saved(fingerprints(docs, words, row_digest(docs)), "simhash")
    roots = _components_of(prints).select("f", "root")
    return one_row_of_each(docs, prints.join(roots, "f").select("d", "r", F.col("root").alias("g")))
