"""Hard negatives against plain integers."""
import math

import numpy as np
import pytest

from quarrystat.llm import negatives as N

SCHEMA = "vec_id long, embedding array<double>, label int, no int, v string"


def brute(rows):
    """``rows`` are (vec_id, vector, label)."""
    ok = []
    for i, v, y in rows:
        if y is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        ok.append((i, (y + 1) % 10 if i is not None and i % 7 == 0 else y, [math.floor(256 * x) for x in v]))
    last, out = 1 << 63, []
    anchors = {(i, y, tuple(v)) for i, y, v in ok if i is not None and i % 100 == 0}
    for i, y, v in anchors:
        s = sorted(((-sum(a * b for a, b in zip(v, w)), last if k is None else k, z) for k, z, w in ok))
        pos = [(k, -n) for n, k, z in s if z == y and k != i][:5]
        for k, p in pos:
            neg = [(j, -n) for n, j, z in s if z != y and 80 * p <= -100 * n <= 100 * p][:5]
            out += [(i, None if k == last else k, r, None if j == last else j, p, n) for r, (j, n) in enumerate(neg, 1)]
    return sorted(out, key=repr)


def result(spark, rows):
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], SCHEMA)
    return sorted(map(tuple, N.hard_negatives(df).collect()), key=repr)


def test_ties_nulls_and_repeats(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=6), 1)], int(rng.integers(0, 4))) for i in range(420)]
    rows += [(1000 + i, rows[0][1], i % 3) for i in range(60)]                    # ties
    rows += [(None, rows[0][1], 1), (None, [1.0] * 6, 2), (500, None, 1), (501, [1.0, None], 1), (502, [math.nan] * 6, 1),
             (503, [math.inf] * 6, 1), (504, [1.0] * 6, None), (600, [], 1), (601, [3.0], 2), (602, [2.0] * 9, 0), (700, [1.0] * 6, 2)]
    rows += [rows[0], rows[0], rows[3]]
    # distinct results: equal positives repeat rows
    assert sorted(set(result(spark, rows)), key=repr) == sorted(set(brute(rows)), key=repr)
    assert len(result(spark, rows[:420])) == len(brute(rows[:420]))


def test_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(N, "ROWS", 50)
    monkeypatch.setattr(N, "ANCHORS", 2)
    monkeypatch.setattr(N, "SCORES", 70)
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=5)], int(rng.integers(0, 3))) for i in range(0, 1500, 2)]
    assert result(spark, rows) == brute(rows)


def test_empty_and_too_large(spark):
    assert result(spark, []) == [] and result(spark, [(1, [1.0], 1)]) == [] and result(spark, [(0, [], 1), (1, [], 1)]) == []
    with pytest.raises(ValueError, match="2\\^60"):
        result(spark, [(0, [1e9], 1), (1, [1e9], 1)])


@pytest.mark.parametrize("most", [1, 100, 1 << 15, 1 << 26])
def test_scores_are_exact(most):
    rng = np.random.default_rng(1)
    a, b = rng.integers(-most, most + 1, (7, 1500)), rng.integers(-most, most + 1, (9, 1500))
    a[0], b[0] = most, most
    a[1], b[1] = -most, most
    bound = 1500 * most * most
    if bound >= 1 << 60:
        a, b, bound = a[:, :200], b[:, :200], 200 * most * most
    primes = N.primes_for(bound)
    want = a.astype(object) @ b.T.astype(object)
    assert (N.scores(N.residues(a, primes), N.residues(b, primes), primes) == want).all()
    assert all(p < 256 for p in primes) and np.prod([float(p) for p in primes]) > 2 * bound
