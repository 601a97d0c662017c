"""Hard-negative mining with exact integer scores from float32 products.

Scores are inner products of integer vectors. Each vector is kept as its residues modulo a few
primes below 256. For each prime a float32 matrix product is exact (residues are at most half
the prime, so sums of 1,024 products stay below 2^24; longer vectors are taken in stretches),
and the signed score is put together again by Chinese remaindering: balanced mixed-radix
digits. The number of primes follows from the largest component, so no score can wrap.

Anchors (the stated query set) meet all rows block against block: a task sees one block of
anchors and one of rows, both of bounded size, and sends on the best few for each anchor. Two
rounds: positives (anchors meet rows of their own label), then negatives (rows of other labels
whose score lies in the window of a positive). Blocks are dealt by row number, so that no label
or id makes one larger.

Defined cases: rows with a null label, a null vector or a null or non-finite component take no
part; vectors of different widths meet as if the shorter ended in zeros; a null id is no anchor,
sorts after every other and is returned as null; other rows are those of another id, every
repeated row counts, equal anchors (id, label and vector) are one anchor; a label outside 0 to 9
is moved like any other (``(label + 1) % 10``); components so large that a score could pass
2^60 raise an error; an empty table gives an empty result; other columns are never looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrystat.llm.common import LAST_ID, saved

#: Components are floor(SCALE * x).
SCALE = 256
#: Rows and anchors of a block, and scores that a task holds at once.
ROWS, ANCHORS, SCORES = 16_384, 2_048, 2_000_000
#: Products summed in float32 before a reduction.
STRETCH = 1024
#: Stands for no score.
NONE = -(1 << 62)


def odd_primes(below: int = 256) -> list[int]:
    """Odd primes, largest first."""
    sieve = np.ones(below, bool)
    for p in range(2, int(below ** 0.5) + 1):
        sieve[p * p::p] = False
    return [int(p) for p in np.flatnonzero(sieve) if p > 2][::-1]


def primes_for(bound: int) -> list[int]:
    """Primes whose product passes ``2 * bound``: they tell all scores up to ``bound`` apart."""
    out, product = [], 1
    for p in odd_primes():
        out.append(p)
        product *= p
        if product > 2 * bound:
            return out
    raise ValueError(f"scores up to {bound} need more primes")


def balanced(x: np.ndarray, p: int) -> np.ndarray:
    """The residues of integers modulo p that are at most p / 2 in size."""
    half = p // 2
    return (x + half) % p - half


def residues(x: np.ndarray, primes: list[int]) -> list[np.ndarray]:
    return [balanced(x, p).astype(np.float32) for p in primes]


def _product(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """a b' modulo p, balanced."""
    out = np.zeros((len(a), len(b)), np.int64)
    for at in range(0, a.shape[1], STRETCH):
        out += (a[:, at:at + STRETCH] @ b[:, at:at + STRETCH].T).astype(np.int64)
    return balanced(out, p)


def scores(a: list[np.ndarray], b: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """Exact inner products of all rows of two residue lists."""
    digits: list[np.ndarray] = []
    for k, p in enumerate(primes):
        x = _product(a[k], b[k], p)
        base = 1                               # take the digits found so far off, divide by their base
        for q, digit in zip(primes[:k], digits):
            x = x - digit * (base % p)
            base *= q
        digits.append(balanced(balanced(x, p) * pow(base, -1, p), p))
    out, base = np.zeros_like(digits[0]), 1
    for p, digit in zip(primes, digits):
        out += digit * base if base < 1 << 62 else 0       # such a digit is 0: scores are below 2^60
        base *= p
    return out


def _best(s: np.ndarray, k: int):
    """``(row, column, score)`` of the k largest of each row of ``s``, ties by column. ``s`` is used up."""
    rows = np.arange(len(s))
    for _ in range(min(k, s.shape[1])):
        col = s.argmax(1)                      # the first of equal ones
        top = s[rows, col]
        good = top > NONE
        yield rows[good], col[good], top[good]
        s[rows, col] = NONE
        if not good.any():
            return


def _block(table: pa.Table, width: int):
    """``(number, id, label, vectors)`` of the rows of one side, in the order of their ids."""
    vectors = table.column("v").combine_chunks()
    sizes = np.diff(vectors.offsets.to_numpy())
    x = np.zeros((len(vectors), width), np.int64)
    x[np.arange(width) < sizes[:, None]] = vectors.flatten().to_numpy()
    order = np.lexsort((table.column("no").to_numpy(), table.column("id").to_numpy()))
    return [table.column(c).to_numpy()[order] for c in ("no", "id", "label")] + [x[order]], order


def _cells(width: int):
    """The two sides of a cell, anchors cut so that the scores of one part are bounded."""
    def sides(table):
        side = table.column("anchor").to_numpy(zero_copy_only=False)
        rows, _ = _block(table.filter(pa.array(~side)), width)
        mine = table.filter(pa.array(side))
        anchors, order = _block(mine, width)
        return anchors, rows, mine.take(pa.array(order))
    return sides


def _positives(width: int, primes: list[int], k: int):
    """For a cell: the best ``k`` rows of each anchor's own label."""
    sides = _cells(width)

    def run(table):
        (no, ids, label, x), (_, rid, rlabel, y), _ = sides(table)
        out = []
        for one in np.unique(label):
            mine, theirs = np.flatnonzero(label == one), np.flatnonzero(rlabel == one)
            if not len(theirs):
                continue
            right = residues(y[theirs], primes)
            step = max(1, SCORES // len(theirs))
            for at in range(0, len(mine), step):
                a = mine[at:at + step]
                s = scores(residues(x[a], primes), right, primes)
                s[ids[a][:, None] == rid[theirs][None, :]] = NONE
                out += [(no[a[r]], rid[theirs[c]], v) for r, c, v in _best(s, k)]
        return _table(out, ("no", "id", "score"))
    return run


def _negatives(width: int, primes: list[int], k: int):
    """For a cell: the best ``k`` rows of other labels in each window ``(low, score)`` of an anchor."""
    sides = _cells(width)

    def run(table):
        (no, _, label, x), (_, rid, rlabel, y), mine = sides(table)
        right, out = residues(y, primes), []
        windows = mine.column("windows").to_pylist()
        step = max(1, SCORES // max(1, len(rid)))
        for at in range(0, len(no), step):
            a = np.arange(at, min(at + step, len(no)))
            s = scores(residues(x[a], primes), right, primes)
            s[label[a][:, None] == rlabel[None, :]] = NONE
            for turn in range(max(len(windows[i]) for i in a)):
                have = np.array([i - at for i in a if len(windows[i]) > turn])
                high = np.array([windows[at + i][turn] for i in have])
                low = -((-4 * high) // 5)                     # the least whole number of 80 percent or more
                w = s[have]
                w[(w > high[:, None]) | (w < low[:, None])] = NONE
                out += [(no[a[have[r]]], high[r], rid[c], v) for r, c, v in _best(w, k)]
        return _table(out, ("no", "high", "id", "score"))
    return run


def _table(parts: list[tuple], names: tuple) -> pa.Table:
    cols = [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(len(names))]
    return pa.table({n: pa.array(c.astype(np.int64)) for n, c in zip(names, cols)})


def prepared(vectors: DataFrame) -> DataFrame:
    """``(no, id, label, v)``: the rows that take part, numbered, with whole components."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    inf = F.lit(float("inf"))
    fine = F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < inf), F.lit(False)))
    rows = vectors.where(F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(fine)
    vec_id, label = F.col("vec_id").cast("long"), F.col("label").cast("long")
    moved = F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)
    big = F.lit(float(1 << 60))
    whole = F.transform(x, lambda c: F.when(F.abs(c * SCALE) < big, F.floor(c * SCALE)).otherwise(
        F.raise_error(F.lit("a component is too large for exact scores")).cast("long")))
    return rows.select(F.monotonically_increasing_id().alias("no"), F.coalesce(vec_id, F.lit(LAST_ID)).alias("id"),
                       moved.alias("label"), whole.alias("v"))


def _meet(rows: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int, kernel, schema: str) -> DataFrame:
    """``kernel`` over every pair of an anchor block and a row block."""
    tasks = 2 * rows.sparkSession.sparkContext.defaultParallelism
    rb = max(1, -(-n_rows // ROWS), min(tasks, n_rows // 1024))
    ab = max(1, -(-n_anchors // ANCHORS))

    def dealt(df, own, blocks, other, others):
        return (df.withColumn(own, F.pmod(F.xxhash64("no"), F.lit(blocks)).cast("int"))
                .withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1)))))
    left = dealt(anchors, "ab", ab, "rb", rb).withColumn("anchor", F.lit(True))
    right = dealt(rows, "rb", rb, "ab", ab).withColumn("anchor", F.lit(False))
    both = right.unionByName(left, allowMissingColumns=True)
    return both.groupBy("ab", "rb").applyInArrow(kernel, schema)


def _first(df: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The first k of each key: higher scores, then smaller ids. Spark limits before the shuffle too."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return df.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def hard_negatives(vectors: DataFrame, positives: int = 5, negatives: int = 5, every: int = 100) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` for the
    rows whose id is divisible by ``every``."""
    rows = saved(prepared(vectors), "vectors")
    size = F.size("v")
    stat = rows.agg(F.count("*"), F.max(size), F.max(F.array_max(F.transform("v", F.abs)))).first()
    n, width, most = stat[0], max(stat[1] or 1, 1), stat[2] or 0
    bound = width * most * most
    if bound >= 1 << 60:
        raise ValueError(f"components up to {most} in {width} columns: scores could pass 2^60")
    primes = primes_for(max(1, bound))
    chosen = rows.where((F.col("id") % every == 0) & (F.col("id") != LAST_ID))
    anchors = saved(chosen.groupBy("id", "label", "v").agg(F.min("no").alias("no")).select(*rows.columns), "anchors")
    m = anchors.count()
    found = _meet(rows, anchors, n, m, _positives(width, primes, positives), "no long, id long, score long")
    found = saved(_first(found, ["no"], positives).select("no", F.col("id").alias("positive"), F.col("score").alias("high"),
                                                          "place"), "positives")
    windows = found.where("high >= 0").groupBy("no").agg(F.collect_set("high").alias("windows"))
    armed = anchors.join(windows, "no")                   # at most `positives` windows for each anchor
    hits = _meet(rows, armed, n, m, _negatives(width, primes, negatives), "no long, high long, id long, score long")
    hits = _first(hits, ["no", "high"], negatives)
    out = found.join(hits, ["no", "high"]).join(anchors.select("no", F.col("id").alias("anchor_id")), "no")

    def back(c):
        return F.when(F.col(c) != LAST_ID, F.col(c))
    return out.select("anchor_id", back("positive").alias("positive_id"), hits["place"].cast("int").alias("rank"),
                      back("id").alias("negative_id"), F.col("high").alias("positive_score"),
                      F.col("score").alias("negative_score"))


NEGATIVES_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [floor(256 * x::DOUBLE)::BIGINT for x in embedding] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same,
    list_sum([x * b.v[i] for x, i in a.v])::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 WHERE a.vec_id <> b.vec_id OR a.label <> b.label),
p AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS k FROM s WHERE same),
n AS (SELECT p.a, p.b AS p, p.score AS ps, s.b AS n, s.score AS ns,
    row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS rank
  FROM p JOIN s ON p.a = s.a AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score WHERE p.k <= 5)
SELECT a AS anchor_id, p AS positive_id, rank::INTEGER AS rank, n AS negative_id, ps AS positive_score, ns AS negative_score
FROM n WHERE rank <= 5
"""
