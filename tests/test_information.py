"""MI family and selection against numpy."""

import itertools

import numpy as np
import pytest

from quarrystat.operators import mutual_info as I
from quarrystat.operators import selection as S


def mi(x, y):
    n, out = len(x), 0.0
    for a, b in itertools.product(set(x.tolist()), set(y.tolist())):
        c = ((x == a) & (y == b)).sum()
        if c:
            out += c / n * np.log2(c * n / ((x == a).sum() * (y == b).sum()))
    return out


def cmi(x, y, z, uniform=False):
    out = 0.0
    for s in set(z.tolist()):
        m = z == s
        out += mi(x[m], y[m]) * (1.0 if uniform else m.mean())
    return out


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    n, d = 400, 7
    y = rng.integers(0, 3, n)
    b = np.array([(y + rng.integers(0, 1 + j, n)) % (3 + j % 2) for j in range(d)]).T
    df = spark.createDataFrame([(i, int(y[i]), b[i].tolist()) for i in range(n)],
                               "id bigint, label int, bins array<smallint>").repartition(4)
    return df, b, y


def vector(df, col):
    return np.array([r[col] for r in sorted(df.collect(), key=lambda r: r["j"])])


def test_hand_computed(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 1), (1, 1)], "x int, y int")
    assert I.mi_pair(df, "x", "y").first()["mi"] == pytest.approx(1.0)
    flat = spark.createDataFrame([(0, 0), (0, 1), (1, 0), (1, 1)], "x int, y int")
    assert I.mi_pair(flat, "x", "y").first()["mi"] == pytest.approx(0.0)


def test_vectors(data):
    df, b, y = data
    assert vector(I.mi_vector(df, "label"), "mi") == pytest.approx([mi(y, b[:, j]) for j in range(7)])
    assert vector(I.mi_vector(df, 2), "mi") == pytest.approx([mi(b[:, 2], b[:, j]) for j in range(7)])
    assert vector(I.entropy(df), "h") == pytest.approx([mi(b[:, j], b[:, j]) for j in range(7)])


def test_packed_and_text_labels(spark, data):
    df, b, y = data
    p = I.packed(df, "label")
    assert vector(I.mi_vector(p, "label"), "mi") == pytest.approx([mi(y, b[:, j]) for j in range(7)])
    assert vector(I.cmi_vector(p, 1), "cmi") == pytest.approx([cmi(b[:, j], y, b[:, 1]) for j in range(7)])
    worded = df.selectExpr("concat('class ', label) as label", "bins")
    assert vector(I.mi_vector(worded, "label"), "mi") == pytest.approx([mi(y, b[:, j]) for j in range(7)])
    assert vector(I.cmi_reverse(worded, 1), "cmi") == pytest.approx(
        [cmi(b[:, 1], y, b[:, j]) for j in range(7)])
    negative = df.selectExpr("label - 2 as label", "bins")
    assert vector(I.cmi_vector(negative, 1), "cmi") == pytest.approx(
        [cmi(b[:, j], y, b[:, 1]) for j in range(7)])
    assert [r["j"] for r in S.greedy(worded, 3, "mid").orderBy("step").collect()] == brute_greedy(b, y, 3, "mid")


@pytest.mark.parametrize("branches", [1, 2, 7])
def test_matrix_with_tiles(data, branches):
    df, b, _ = data
    got = {(r["i"], r["j"]): r["mi"] for r in I.mi_matrix(df, 4, branches=branches).collect()}
    assert len(got) == 49
    for i, j in got:
        assert got[i, j] == pytest.approx(mi(b[:, i], b[:, j]), abs=1e-12)
    low = {(r["i"], r["j"]) for r in I.mi_matrix(df, 4, "strict_lower").collect()}
    assert low == {(i, j) for i in range(7) for j in range(i)}
    assert np.allclose(I.mi_matrix_local(df, 4), [[got[i, j] for j in range(7)] for i in range(7)])


@pytest.mark.parametrize("weighting", ["probability", "uniform"])
def test_conditional(data, weighting):
    df, b, y = data
    u = weighting == "uniform"
    assert vector(I.cmi_vector(df, 1, weighting=weighting), "cmi") == pytest.approx(
        [cmi(b[:, j], y, b[:, 1], u) for j in range(7)])
    assert vector(I.cmi_reverse(df, 1, weighting=weighting), "cmi") == pytest.approx(
        [cmi(b[:, 1], y, b[:, j], u) for j in range(7)])


def test_chain_rule(data):
    df, b, y = data
    assert vector(I.joint_mi(df, 3), "jmi") == pytest.approx(
        [mi(b[:, 3] * 100 + b[:, j], y) for j in range(7)])


def brute_greedy(b, y, k, criterion):
    d = b.shape[1]
    rel = np.array([mi(b[:, j], b[:, j]) if criterion == "entropy_over_mi" else mi(y, b[:, j])
                    for j in range(d)])
    chosen = [int(np.round(rel, 10).argmax())]
    while len(chosen) < k:
        score = {}
        for j in set(range(d)) - set(chosen):
            red = np.mean([mi(b[:, s], b[:, j]) for s in chosen])
            score[j] = {"mid": rel[j] - red, "miq": rel[j] / red, "entropy_over_mi": rel[j] / red,
                        "min_redundancy": -red, "chain": mi(b[:, chosen[-1]], b[:, j]),
                        "max_total_relevance": np.mean([cmi(b[:, j], y, b[:, s]) + rel[s] for s in chosen]),
                        "cmim": min(cmi(b[:, s], y, b[:, j]) + rel[s] for s in chosen)}[criterion]
        chosen.append(min(score, key=lambda j: (-round(score[j], 10), j)))
    return chosen


@pytest.mark.parametrize("criterion", S.CRITERIA)
def test_greedy(data, criterion):
    df, b, y = data
    got = [r["j"] for r in S.greedy(df, 5, criterion).orderBy("step").collect()]
    assert got == brute_greedy(b, y, 5, criterion)


@pytest.mark.parametrize("form,criterion", [("difference", "mid"), ("quotient", "miq")])
def test_from_matrix_agrees_with_steps(data, form, criterion):
    df, b, y = data
    got = S.from_matrix(I.mi_matrix(df, 4), I.mi_vector(df, "label"), 4, form)
    assert [r["j"] for r in got.orderBy("step").collect()] == brute_greedy(b, y, 4, criterion)


def test_bad_arguments(data):
    df = data[0]
    with pytest.raises(Exception, match="nulls in"):
        I.mi_vector(df.selectExpr("nullif(label, 1) as label", "bins"), "label").collect()
    with pytest.raises(ValueError):
        S.greedy(df, 8, "mid")
    with pytest.raises(ValueError):
        S.greedy(df, 2, "other")
    with pytest.raises(ValueError):
        I.cmi_vector(df, 0, weighting="other")


def batch_of(b, **refs):
    import pyarrow as pa

    from quarrystat.functions.kernels import list_column
    return pa.RecordBatch.from_arrays([list_column(np.asarray(b)), *[pa.array(np.asarray(v)) for v in refs.values()]],
                                      names=["bins", *refs])


def total(batches, *keys):
    out = {}
    for t in batches:
        cols = [t.column(c).to_pylist() for c in keys] + [t.column("cnt").to_pylist()]
        for *k, c in zip(*cols):
            out[tuple(k)] = out.get(tuple(k), 0) + c
    return out


@pytest.mark.parametrize("most", [10 ** 6, 500, 40, 1])
def test_counts_are_sent_on_when_the_table_is_full(most):
    """Whatever the bound, parts of a cell add up to its count."""
    from quarrystat.functions import kernels
    rng = np.random.default_rng(8)
    b, y = rng.integers(0, 5, (900, 4)), rng.integers(-300, 300, 900)
    parts = [batch_of(b[a:a + 100].astype(np.int16), y=y[a:a + 100].astype(np.int32)) for a in range(0, 900, 100)]
    got = list(kernels.count_kernel("bins", 4, None, ["y"], most)(iter(parts)))
    want = {}
    for i in range(900):
        for j in range(4):
            k = (j, int(y[i]), 0, int(b[i, j]))
            want[k] = want.get(k, 0) + 1
    assert total(got, "j", "s", "y", "b") == want
    assert len(got) == 1 if most == 10 ** 6 else len(got) > 1


@pytest.mark.parametrize("most", [10 ** 6, 100, 1])
@pytest.mark.parametrize("states", [5, 300, 40000])
def test_pair_counts_do_not_depend_on_bounds(most, states):
    from quarrystat.functions import kernels
    rng = np.random.default_rng(9)
    b = rng.integers(0, states, (60, 5)) // rng.integers(1, 4, 5)
    parts = [batch_of(b[a:a + 20].astype(np.int32)) for a in range(0, 60, 20)]
    got = {}
    for rows in ((0, 2), (2, 5)):
        got.update(total(kernels.pair_count_kernel("bins", 5, rows, states, most)(iter(parts)), "i", "j", "bi", "bj"))
    want = {}
    for r in b.tolist():
        for i in range(5):
            for j in range(i, 5):
                want[i, j, r[i], r[j]] = want.get((i, j, r[i], r[j]), 0) + 1
    assert got == want


def test_one_scan_counts_all_pairs(spark):
    wide = spark.createDataFrame([(0, [0] * 1000)], "id long, bins array<smallint>")
    for branches in (1, 4):
        plan = I.mi_matrix(wide, 200, branches=branches)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInArrow") == branches
    with pytest.raises(Exception, match="outside 0..1"):
        I.mi_matrix(wide.selectExpr("id", "array(cast(2 as smallint)) as bins"), 2).collect()


def test_label_of_a_million_states(spark):
    n = 1_000_000
    df = spark.range(0, n, 1, 4).selectExpr("cast(id as int) as label", "array(cast(id % 8 as smallint), cast(0 as smallint)) as bins")
    assert vector(I.mi_vector(df, "label"), "mi") == pytest.approx([3.0, 0.0], abs=1e-9)
    plan = I.mi_pair(df.selectExpr("label as x", "label as y"), "x", "y")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan
    assert I.mi_pair(df.selectExpr("label as x", "label % 4 as y"), "x", "y").first()["mi"] == pytest.approx(2.0, abs=1e-9)
    assert I.mi_pair(df.where("false").selectExpr("label as x", "label as y"), "x", "y").count() == 0
