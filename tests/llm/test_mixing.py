"""Mixing against a plain water-filling and Pareto order sample."""
import hashlib

import pytest
from pyspark.sql import functions as F

from quarrystat.llm import mixing


def fill(budget, cap, weight):
    """Targets by repeated sharing, as the contract words it."""
    full, got = set(), {}
    while True:
        open_ = [k for k in cap if k not in full]
        if not open_:
            return {k: float(cap[k]) for k in cap}
        level = (budget - sum(cap[k] for k in full)) / sum(weight[k] for k in open_)
        over = [k for k in open_ if level * weight[k] > cap[k]]
        if not over:
            got = {k: float(cap[k]) if k in full else level * weight[k] for k in cap}
            return got
        full.update(over)


def brute(rows):
    size = [len((t or "").split(" ")) if t else 0 for _, _, t in rows]
    names = sorted({s for _, s, _ in rows if s is not None}) + ([None] if any(s is None for _, s, _ in rows) else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    own = {s: sum(n for n, r in zip(size, rows) if r[1] == s) for s in names}
    target = fill(1.5 * sum(size), {s: 2 * own[s] for s in names}, weight)
    taken = [0] * len(rows)
    for s in names:
        mine = [k for k, r in enumerate(rows) if r[1] == s and size[k]]
        frag = {k: size[k] < 50 for k in mine}
        words = {f: sum(size[k] for k in mine if frag[k] == f) for f in (False, True)}
        words = {f: n for f, n in words.items() if n}
        cell = fill(target[s], {f: 2 * n for f, n in words.items()}, {f: n * (0.5 if f else 1) for f, n in words.items()})
        copies = {f: min(2.0, cell[f] / words[f]) for f in words}
        left = target[s] - sum(int(copies[f]) * words[f] for f in words)
        order = []
        for k in mine:
            c = copies[frag[k]]
            taken[k] = int(c) * size[k]
            part = c - int(c)
            if part > 0:
                u = (int(hashlib.md5(f"{rows[k][0]}:11".encode()).hexdigest()[:13], 16) + 0.5) / 2 ** 52
                q = (u / (1 - u)) / (part / (1 - part))
                order.append((q, rows[k][0], size[k], k))
        before = 0
        for _, _, n, k in sorted(order):
            if before + n / 2 <= left:
                taken[k] += n
            before += n
    return target, own, taken


def test_against_brute_force(spark, rng):
    rows = [(i, [None, "b", "a", "hot", "hot", "c"][i % 6], " ".join(["w"] * int(rng.integers(0, 300)))) for i in range(900)]
    rows += [(900 + i, "tiny", "one two") for i in range(3)] + [(950, "a", None), (951, None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {r["doc_id"]: r for r in mixing.mix_report(docs).collect()}
    target, own, taken = brute(rows)
    for k, (i, s, _) in enumerate(rows):
        assert got[i]["target"] == pytest.approx(target[s], rel=1e-12) and got[i]["source_size"] == own[s]
        assert got[i]["taken"] == taken[k] and got[i]["taken"] <= 2 * got[i]["size"]
    for s in target:
        words = sum(got[i]["taken"] for i, src, _ in rows if src == s)
        assert abs(words - target[s]) <= 300
    assert abs(sum(target.values()) - 1.5 * sum(own.values())) < 1e-6


def test_small_and_odd_tables(spark):
    kind = "doc_id long, source string, text string, size string, taken int, v int"
    assert mixing.mix_report(spark.createDataFrame([], kind)).count() == 0
    one = spark.createDataFrame([(None, None, "a b c", "x", 1, 2), (1, "s", None, None, 1, 2), (1, "s", None, None, 1, 2)], kind)
    rows = mixing.mix_report(one).collect()
    assert sorted(r["taken"] for r in rows) in ([0, 0, 3], [0, 0, 6])
    assert mixing.mixed(one).select("row_.size").count() == 3
    full = spark.range(50).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("a b").alias("text"))
    assert {r["target"] for r in mixing.mix_report(full).collect()} == {150.0}


@pytest.mark.parametrize("case", ["one id", "no id", "equal rows", "mixed"])
def test_ties_stop_at_the_target(spark, case):
    """A third of the rows with one id and size, or equal throughout."""
    word = " ".join(["w"] * 59)
    tied = {"one id": [(7, "s", f"{word} {k}") for k in range(400)], "no id": [(None, "s", f"{word} {k}") for k in range(400)],
            "equal rows": [(7, "s", word + " x")] * 400, "mixed": [(7, "s", f"{word} {k % 3}") for k in range(400)]}[case]
    rows = tied + [(1000 + k, "s", " ".join(["v"] * (60 + k % 50))) for k in range(50)]
    rows += [(5000 + k, "t", " ".join(["v"] * 120)) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(6)
    for seed in range(11, 15):
        got = mixing.mixed(docs, seed=seed).select("row_.*", "size", "target", "taken").collect()
        assert sorted((r["doc_id"] or 0, r["text"]) for r in got) == sorted((i or 0, t) for i, _, t in rows)
        for s in "st":
            mine = [r for r in got if r["source"] == s]
            assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 120 / 2 + 1e-6
    if case != "no id":
        got = sorted(r["taken"] for r in mixing.mix_report(docs).collect())
        assert got == sorted(brute(rows)[2])
