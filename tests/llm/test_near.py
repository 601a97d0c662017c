"""Near duplicates against a comparison of all pairs of documents."""
import random

import corpus_pipeline
import pytest
from oddities import SF, nothing, odd  # noqa: F401

from quarrystat.llm import near


def plain(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(texts):
    """The group of each text, by all pairs."""
    sets = [plain(t) for t in texts]
    root = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or a and b and min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and 5 * len(a & b) >= 4 * len(a | b):
                x, y = root[i], root[j]
                root = [y if r == x else r for r in root]
    return root


@pytest.mark.parametrize("limit", [near.PAIR_LIMIT, 2])
def test_stage_leaves_one_of_each_group(spark, monkeypatch, limit):
    monkeypatch.setattr(near, "PAIR_LIMIT", limit)
    rnd = random.Random(4)
    def words(n): return [rnd.choice("abcdefghij") + str(rnd.randrange(400)) for _ in range(n)]
    texts = ["", None, "one two", "One  two", "three"]
    for k in range(40):                                     # near copies on both sides of 0.8, chains too
        w = words(rnd.randrange(20, 400))
        texts.append(" ".join(w))
        for _ in range(rnd.choice([1, 2, 3, 25 if k % 10 == 0 else 3])):
            v = list(w)
            for _ in range(rnd.randrange(0, 1 + len(w) // 35)):
                v[rnd.randrange(len(v))] = "changed" + str(rnd.randrange(99))
            texts.append(" ".join(v))
            w = rnd.choice([w, v])
    rows = [(None if i % 7 == 0 else i % 90, t, "s") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    kept = [tuple(r) for r in corpus_pipeline.near_dedup_stage(spark, docs, None).collect()]
    group = brute(texts)
    of = {}
    for g, row in zip(group, rows):
        of.setdefault(row, g)
    assert sorted(of[r] for r in kept) == sorted(set(group))
    low = {}
    for g, (i, _, _) in zip(group, rows):
        low[g] = min(low.get(g, 2 ** 63), 2 ** 63 if i is None else i)
    assert all((2 ** 63 if r[0] is None else r[0]) == low[of[r]] for r in kept)


@pytest.mark.parametrize("limit,block", [(near.PAIR_LIMIT, near.BLOCK_SETS), (2, 7)])
def test_common_passages_do_not_explode(spark, monkeypatch, limit, block):
    """Documents of three of twelve passages each: pairs that share one or two are not compared."""
    monkeypatch.setattr(near, "PAIR_LIMIT", limit)
    monkeypatch.setattr(near, "BLOCK_SETS", block)
    rnd = random.Random(8)
    passages = [" ".join(f"w{rnd.randrange(3000)}" for _ in range(120)) for _ in range(12)]
    texts = [" ".join(rnd.sample(passages, 3)) for _ in range(500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    compared, plainly = [], near._verified
    monkeypatch.setattr(near, "_verified", lambda pairs, *a: compared.append(pairs.count()) or plainly(pairs, *a))
    kept = {r["doc_id"] for r in near.one_of_each_group(docs).collect()}
    group = brute(texts)
    first = {}
    for i, g in enumerate(group):
        first.setdefault(g, i)
    assert kept == set(first.values())
    assert sum(compared) < 3000                        # of 124,750 pairs


def test_bitmaps_and_places_never_lose_a_pair():
    """Any two sets: bits that differ are no more than shingles that do; the bounds hold on every key."""
    import numpy as np
    rng = np.random.default_rng(5)
    order = near._Order(rng.integers(-2 ** 62, 2 ** 62, 50))
    for _ in range(300):
        n = int(rng.integers(1, 700))
        a = np.unique(np.concatenate([rng.integers(-2 ** 63, 2 ** 63 - 1, n), rng.choice(order.hashes, 20)]))
        b = np.unique(np.concatenate([rng.choice(a, int(len(a) * rng.uniform(0.5, 1)), replace=False),
                                      rng.integers(-2 ** 63, 2 ** 63 - 1, int(rng.integers(0, 1 + n // 6)))]))
        x, y = near.bitmap(a), near.bitmap(b)
        size = min(len(x), len(y))
        differ = int(np.bitwise_count(near.folded(x, size) ^ near.folded(y, size)).sum())
        assert differ <= len(np.setxor1d(a, b))
        if near.similar(a, b):
            assert near.may_be_similar(differ, len(a), len(b))
            p, q = order.first(a).tolist(), order.first(b).tolist()
            shared = set(p) & set(q)
            assert shared
            for k in shared:
                i, j = p.index(k), q.index(k)
                most = min(i, j) + 1 + min(len(a) - i, len(b) - j) - 1
                assert most * 9 >= (len(a) + len(b)) * 4
        assert near.folded(x, 64).tolist() == np.packbits(np.bincount(a & 511, minlength=512).astype(np.uint8) & 1, bitorder="little").tolist()


def test_odd_rows(odd, nothing):
    kept = near.one_of_each_group(odd)
    assert kept.columns == odd.columns and kept.count() == len(set(brute([r["text"] for r in odd.collect()])))
    assert near.one_of_each_group(nothing).count() == 0


def test_stage_links_fingerprints_too(spark, monkeypatch):
    """A change in every fifth word leaves no five-word shingle in common: only SimHash can link such texts."""
    from quarrystat.llm import simhash
    base = " ".join(f"w{i}" for i in range(400))
    far = " ".join(("x" if i % 5 == 0 else "w") + str(i) for i in range(400))
    texts = [base, far, "something else altogether here", "x " + base]
    real = simhash.fingerprint
    monkeypatch.setattr(near, "fingerprint", lambda t, words: real(base, words) ^ 5 if t == far else real(t, words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert not near.similar(near.shingle_set(base), near.shingle_set(far))
    assert {r["doc_id"] for r in near.one_of_each_group(docs).collect()} == {0, 1, 2}
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup_stage(spark, docs, None).collect()} == {0, 2}


def test_stage_keeps_the_links_of_op1(spark):
    """Whatever op1 puts in one component leaves one document at most."""
    from quarrystat.llm import simhash
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    of = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    kept = [of[r["doc_id"]] for r in corpus_pipeline.near_dedup_stage(spark, docs, None).collect()]
    assert len(kept) == len(set(kept))
