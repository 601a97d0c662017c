"""Fingerprints and components against plain counting and a full comparison."""
import random

import xxhash
from oddities import nothing, odd  # noqa: F401
from pyspark.sql import functions as F

from quarrystat.llm import simhash


def plain(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(w[i:i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def roots(fs):
    up = {f: f for f in fs}
    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    fs = sorted(fs)
    for i, a in enumerate(fs):
        for b in fs[:i]:
            if (a ^ b).bit_count() <= 2:
                up[find(a)] = find(b)
    return {f: find(f) for f in fs}


def test_fingerprint_and_spark_hash(spark):
    for t in (None, "", "A", "a b", "A b c D", "ÄB c\x0bd e  f\n g", "x " * 500 + "y"):
        assert simhash.fingerprint(t) == plain(t)
    assert spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0] % 2 ** 64 == xxhash.xxh64_intdigest(b"a b c", 42)


def test_links_connect_all_that_is_close(spark):
    rnd = random.Random(3)
    fs = set()
    for _ in range(60):                                     # chains, pairs and single ones
        f = rnd.getrandbits(64)
        fs.add(f)
        for _ in range(rnd.choice([0, 1, 3, 8])):
            for b in rnd.sample(range(64), rnd.choice([1, 2, 2, 3])):
                f ^= 1 << b
            fs.add(f)
    centre = rnd.getrandbits(64)                            # a crowded neighbourhood
    fs |= {centre ^ (1 << a) ^ (1 << b) for a in range(40) for b in range(a)} | {centre}
    signed = {simhash._signed(f): f for f in fs}
    df = spark.createDataFrame([(s,) for s in signed], "f long")
    got = {signed[r["node"]]: signed[r["root"]] for r in simhash.components(simhash.links(df)).collect()}
    want, groups, found = roots(fs), {}, {}
    for f in fs:
        groups.setdefault(want[f], set()).add(f)
        found.setdefault(got.get(f, f), set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, found.values()))


def test_pairs_of_every_distance(spark):
    """Few sharers: the chain filter itself, on every pair of bit positions."""
    base = 0x0123456789ABCDEF
    pairs = [(base ^ (0xF << 58), x) for x in ()] + [(a, b) for a in range(64) for b in range(a)]
    rows = [(simhash._signed(d), 0) for d in [0] + [1 << a for a in range(64)] + [(1 << a) | (1 << b) for a, b in pairs]]
    diff = spark.createDataFrame(rows, "diff long, x int").select("diff", F.explode(F.array(*map(F.lit, range(6)))).alias("start"))
    ok = diff.groupBy("diff").agg(F.max(simhash._chain_holds(F.col("diff"), F.col("start"))).alias("ok"))
    assert ok.where("not ok").count() == 0
    far = spark.createDataFrame([(simhash._signed((1 << 63) | (1 << 30) | 1),)], "diff long")
    assert not far.select(simhash._chain_holds(F.col("diff"), F.lit(0)).alias("x")).first()["x"]


def test_odd_rows(odd, nothing):
    got = simhash.near_duplicates(odd).collect()
    rows = odd.collect()
    assert sorted(r["fingerprint"] for r in got) == sorted(f"{plain(r['text']):016x}" for r in rows)
    want = roots({plain(r["text"]) for r in rows})
    low = {}
    for r in rows:
        k = want[plain(r["text"])]
        low[k] = min(low.get(k, 2 ** 63), 2 ** 63 - 1 if r["doc_id"] is None else r["doc_id"])
    assert all(r["component_id"] == (None if low[want[int(r["fingerprint"], 16)]] == 2 ** 63 - 1 else low[want[int(r["fingerprint"], 16)]]) for r in got)
    kept = simhash.one_of_each_group(odd)
    assert kept.columns == odd.columns and kept.count() <= len(low)
    assert simhash.near_duplicates(nothing).count() == 0 and simhash.one_of_each_group(nothing).count() == 0


def test_one_row_of_each_component_without_and_with_repeated_ids(spark):
    rnd = random.Random(8)
    def text(): return " ".join(rnd.choice("abcdefgh") + str(rnd.randrange(10 ** 6)) for _ in range(40))
    texts = [text() for _ in range(40)]
    rows = [(None, t) for t in texts[:20]] + [(7, t) for t in texts[20:30]] + [(i, t) for i, t in enumerate(texts[30:], 100)]
    rows += [(3, texts[0]), (None, texts[1]), (7, texts[21]), (8, texts[22]), (1, texts[23]), (7, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = [tuple(r) for r in simhash.one_of_each_group(docs).collect()]
    assert set(kept) <= set(rows)
    assert sorted(plain(t) for _, t in kept) == sorted({plain(t) for _, t in rows})
    assert (3, texts[0]) in kept and (1, texts[23]) in kept and (7, texts[22]) in kept
