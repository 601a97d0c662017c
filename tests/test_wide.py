"""Tables of 5,000 columns, and sparse rows, against numpy."""
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from quarrystat.functions import products as K
from quarrystat.operators import decomposition as D
from quarrystat.operators import gram
from quarrystat.operators import supervised as M
from quarrystat.operators.products import RowProducts
from quarrystat.plans import sparse as sparse_plans
from quarrystat.sources import sparse, text
from quarrystat.sources.text import from_rows

N, WIDE = 120, 5000


@pytest.fixture(scope="module")
def x():
    rng = np.random.default_rng(11)
    low = rng.standard_normal((N, 12)) * (20.0 * 0.7 ** np.arange(12)) @ rng.standard_normal((12, WIDE)) / 50
    return low + 0.05 * rng.standard_normal((N, WIDE)) + 3.0


@pytest.fixture(scope="module")
def df(spark, x):
    return from_rows(spark, list(zip(x[:, 0] * 2 - x[:, 77], x.tolist()))).repartition(4).persist()


def same(a, b):
    return np.allclose(np.abs((a * b).sum(0)), 1, atol=1e-6)


def test_wide_svd_and_eigenpairs(df, x):
    _, s, vt = np.linalg.svd(x, full_matrices=False)
    m = D.svd(df, 5)
    assert np.allclose(m.s, s[:5]) and same(m.v, vt[:5].T)
    lam, vec = D.top_eigen(df, 5)
    assert np.allclose(lam, s[:5] ** 2) and same(vec, vt[:5].T)


def test_wide_pca_and_covariance(df, x):
    c = x - x.mean(0)
    _, s, vt = np.linalg.svd(c, full_matrices=False)
    m = D.pca(df, 4)
    assert np.allclose(m.variance, s[:4] ** 2 / (N - 1)) and np.allclose(m.ratio, s[:4] ** 2 / (s ** 2).sum())
    assert same(m.pc, vt[:4].T) and np.allclose(m.mean, x.mean(0))
    assert np.allclose(D.covariance_svd(df, 4).s, s[:4] ** 2 / N)


@pytest.mark.parametrize("k", [6, None])
def test_wide_ipca(df, x, k):
    state = None
    for b in range(2):
        state = D.ipca_fit(df.where(F.col("id") % 2 == b), state, k=k)
    _, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert state.n == N and np.allclose(state.mu, x.mean(0))
    if k is None:                                    # kept whole, the two halves are the table
        assert np.allclose(state.d[:100], s[:100], rtol=1e-5) and same(state.u[:, :4], vt[:4].T)
    else:
        assert len(state.d) == 6 and np.allclose(state.d[:3], s[:3], rtol=1e-2)


def test_wide_least_squares_is_the_one_of_least_norm(df, x):
    y = x[:, 0] * 2 - x[:, 77]
    w = M.least_squares(df)
    assert np.allclose(x @ w, y, atol=1e-6 * np.abs(y).max())
    assert np.allclose(w, np.linalg.lstsq(x, y, rcond=None)[0], atol=1e-5)


def test_conjugate_gradients_agree_with_the_direct_way(spark):
    rng = np.random.default_rng(12)
    x = rng.standard_normal((300, 20)) * (1 + np.arange(20)) + 5
    y = x @ rng.standard_normal(20) + rng.standard_normal(300)
    t = from_rows(spark, list(zip(y, x.tolist()))).repartition(3).persist()
    want = np.linalg.lstsq(x, y, rcond=None)[0]
    assert np.allclose(M.least_squares(t), want) and np.allclose(M.least_squares(t, direct=4), want, atol=1e-7)
    assert not M.least_squares(t.withColumn("label", F.lit(0.0)), direct=4).any()
    with pytest.raises(RuntimeError):
        M.least_squares(t, direct=4, max_iter=2)


def test_basis_stays_bounded(monkeypatch):
    """A slow spectrum takes many rounds; the projected matrix never passes the blocks allowed."""
    d, rounds, sizes = 400, [], []
    lam = 1.0 / (1 + 0.02 * np.arange(d))
    q = np.linalg.qr(np.random.default_rng(0).standard_normal((d, d)))[0]
    a = q * lam @ q.T
    monkeypatch.setattr(D, "BLOCK", 6)
    eigh = np.linalg.eigh
    monkeypatch.setattr(D.np.linalg, "eigh", lambda t: sizes.append(len(t)) or eigh(t))
    got, vec = D.leading_pairs(lambda v: rounds.append(v.shape[1]) or a @ v, d, 3)
    assert np.allclose(got, lam[:3], rtol=1e-9) and same(vec, q[:, :3])
    assert len(rounds) > 3 * D.BLOCKS and max(sizes) <= D.BLOCKS * 7 and set(rounds) <= set(range(1, 8))


def test_zero_and_deficient_operators():
    assert np.allclose(D.leading_pairs(lambda v: 0 * v, 500, 2)[0], 0)
    u = np.linalg.qr(np.random.default_rng(1).standard_normal((500, 3)))[0]
    lam, vec = D.leading_pairs(lambda v: u @ (np.array([[3.0], [2.0], [1.0]]) * (u.T @ v)), 500, 5)
    assert np.allclose(lam, [3, 2, 1, 0, 0], atol=1e-9) and same(vec[:, :3], u)


@pytest.fixture(scope="module")
def holes(spark):
    """Sparse rows (a third of the cells), their dense form, and the same as a matrix."""
    rng = np.random.default_rng(13)
    x = np.where(rng.random((200, 30)) < 0.3, rng.integers(1, 9, (200, 30)), 0).astype(float)
    x[:, 7] = 0
    entries = spark.createDataFrame([(i, j, float(x[i, j])) for i in range(200) for j in range(30) if x[i, j] or j == 29],
                                    "i long, j int, value double").repartition(4)
    return sparse.from_entries(entries, 30), from_rows(spark, x.tolist(), label=False).repartition(3), x


@pytest.mark.parametrize("shift", [None, "mean"])
def test_sparse_products(holes, shift):
    rows, dense, x = holes
    shift = None if shift is None else x.mean(0)
    c = x if shift is None else x - shift
    right = np.random.default_rng(2).standard_normal((30, 4))
    for t in (rows, dense):
        p = RowProducts(t, 30, shift)
        assert np.allclose(p.times(right), c.T @ (c @ right)) and p.n == 200 and p.total == pytest.approx((c ** 2).sum())
        assert np.allclose(p.means(), c.mean(0))


def test_sparse_decompositions_and_least_squares(holes):
    rows, dense, x = holes
    assert np.allclose(D.svd(rows, 4).s, np.linalg.svd(x)[1][:4])
    model = D.pca(rows, 4)
    assert np.allclose(model.variance, D.pca(dense, 4).variance)
    for centred in (False, True):
        a, b = ({r["id"]: r["scores"] for r in D.pca_project(t, model, centred).collect()} for t in (rows, dense))
        assert all(np.allclose(a[i], b[i]) for i in b)
    u = D.svd(rows, 2, compute_u=True).u
    assert np.allclose(sum(np.outer(r["u"], r["u"]) for r in u.collect()), np.eye(2))
    y = rows.withColumn("label", F.col("id") % 7 * 1.0)
    want = np.linalg.lstsq(x, np.arange(200) % 7, rcond=None)[0]
    assert np.allclose(M.least_squares(y, direct=4), want, atol=1e-8)


def entries(df):
    return {(r["i"], r["j"]): r["value"] for r in df.collect()}


def test_sparse_cosine_and_covariance(holes):
    rows, dense, x = holes
    full = entries(gram.cosine(dense))
    got = entries(gram.cosine(rows))
    assert all(got[k] == pytest.approx(full[k]) for k in got) and all(full[k] == 0 for k in set(full) - set(got))
    assert entries(gram.cosine_sampled(rows, 1e9)) == pytest.approx(got)
    c = np.cov(x.T, ddof=0)
    cov = entries(gram.covariance_sampled(rows))
    assert all(v == pytest.approx(c[k]) for k, v in cov.items()) and (7, 7) not in cov


def test_covariance_without_gamma_keeps_every_cell(holes):
    """Norms far above the square root of 10 ln(d) / 1e-6, as a table of many rows has them."""
    rows, dense, x = holes
    long = dense.select("id", F.transform("features", lambda v: v * 1e5).alias("features"))
    c = np.cov(1e5 * x.T, ddof=0)
    vectors = long.select("id", array_to_vector("features").alias("features"))
    for t in (long, vectors):
        got = entries(gram.covariance_sampled(t))
        assert all(v == pytest.approx(c[k], rel=1e-9, abs=1e-3) for k, v in got.items())


def test_cov_sparse_is_exact_where_norms_are_large(spark, tmp_path):
    rng = np.random.default_rng(11)
    t = pa.table({"l_orderkey": np.repeat(np.arange(300), 4), "l_partkey": rng.integers(0, 6, 1200),
                  "l_quantity": rng.integers(1, 51, 1200) * 1e4})
    pq.write_table(t, f"{tmp_path}/lineitem.parquet")
    x = np.zeros((300, 6))
    np.add.at(x, (t["l_orderkey"].to_numpy(), t["l_partkey"].to_numpy()), t["l_quantity"].to_numpy())
    got, c = entries(sparse_plans.cov_sparse(spark, str(tmp_path))), np.cov(x.T, ddof=0)
    assert len(got) == 21 and all(v == pytest.approx(c[k]) for k, v in got.items())


def test_sparse_and_dense_rows_are_drawn_alike(holes):
    rows, dense, _ = holes
    a, b = (entries(gram.cosine_sampled(t, 9.0, seed=3)) for t in (rows, dense))
    assert a == pytest.approx({k: v for k, v in b.items() if k in a}) and all(b[k] == 0 for k in set(b) - set(a))
    draws = [entries(gram.covariance_sampled(rows, s, gamma=600.0))[0, 1] for s in range(12)]
    x = np.array([r["features"] for r in dense.collect()])
    assert np.std(draws) > 0 and np.mean(draws) == pytest.approx(np.cov(x.T, ddof=0)[0, 1], abs=0.6)


def test_no_dense_row_in_the_plan_and_less_work_for_less_gamma(holes):
    rows, _, _ = holes
    plan = gram.cosine_sampled(rows, 9.0)._jdf.queryExecution().optimizedPlan().toString()
    assert "vector_to_array" not in plan and "array<double>" not in plan.split("MapInArrow")[0]
    norms = gram._column_norms(rows, 30)

    def pairs(gamma):
        p = np.minimum(1.0, np.sqrt(gamma) / norms)
        kept = gram._drawn(gram._cells(gram._with_draw(rows, 0)), p, p)
        return kept.select(F.sum(F.size("at") * (F.size("at") + 1) / 2)).first()[0]
    every, few = pairs(1e9), pairs(norms.max() ** 2 / 16)
    assert few < every / 8                          # a quarter of the cells, a sixteenth of the pairs


@pytest.mark.parametrize("most", [10 ** 6, 50, 4])
def test_pair_kernel_bounds(holes, most):
    import pyarrow as pa
    _, _, x = holes
    at = [np.flatnonzero(r).astype(np.int32) for r in x]
    batch = pa.RecordBatch.from_arrays([pa.array(at, pa.list_(pa.int32())), pa.array([r[a] for r, a in zip(x, at)], pa.list_(pa.float64()))],
                                       names=["at", "v"])
    sums = np.zeros((30, 30))
    for b in K.pair_kernel(30, most)(iter([batch])):
        np.add.at(sums, (b.column("i").to_numpy(), b.column("j").to_numpy()), b.column("value").to_numpy())
        assert most > 1000 or b.num_rows <= 2 * most + 30
    assert np.allclose(sums, np.triu(x.T @ x))


def test_libsvm_of_many_columns_trains_without_dense_rows(spark, tmp_path):
    docs = spark.createDataFrame([(i, ("good fine " if i % 2 else "bad poor ") * 3 + f"word{i % 9}") for i in range(60)], "doc_id long, text string")
    rows = sparse.from_entries(sparse.word_entries(docs, 47_000), 47_000).withColumn("label", F.col("id") % 2)
    text.write_libsvm(rows, str(tmp_path / "f"))
    t = text.read_libsvm(spark, str(tmp_path / "f"), 47_000)
    model = M.logistic(t, reg=0.01)
    pred = M.predict(model, t)
    assert model.numFeatures == 47_000 and pred.where("label <> prediction").count() == 0
    assert "vector_to_array" not in pred._jdf.queryExecution().optimizedPlan().toString()
    assert (tmp_path / "f").is_dir() and t.count() == 60


def test_vectors_refuse_positions_outside(spark):
    bad = spark.createDataFrame([(1, [0, 5], [1.0, 2.0])], "id long, at array<int>, v array<double>")
    with pytest.raises(Exception, match="outside 0..3"):
        sparse.to_vectors(bad, 4).collect()


def test_auc_of_predicted_classes(spark):
    rng = np.random.default_rng(5)
    rows = [(i, float(i % 2), [float(i % 2 + rng.normal()), float(rng.normal())]) for i in range(400)]
    t = spark.createDataFrame(rows, "id long, label double, features array<double>")
    got = M.logistic_sweep(t, (0.01,), classes=True).first()["auc"]
    train, test = M.split(t)
    pred = M.predict(M.logistic(train, reg=0.01), test).collect()
    right = [np.mean([r["prediction"] == r["label"] for r in pred if r["label"] == y]) for y in (0.0, 1.0)]
    assert got == pytest.approx(np.mean(right)) and got != M.logistic_sweep(t, (0.01,)).first()["auc"]


@pytest.mark.parametrize("d,bound", [(997, 60), (40_000, 160)])
def test_pair_kernel_holds_no_more_for_more_rows(d, bound):
    """Memory (MB) over 6 million pairs, in a matrix and in sorted runs."""
    import tracemalloc

    import pyarrow as pa

    def batches():
        rng = np.random.default_rng(3)
        for _ in range(60):
            at = np.sort(np.array([rng.choice(997, 4, replace=False) for _ in range(100)]), axis=1).astype(np.int32)
            at = np.tile(at, (100, 1))
            yield pa.RecordBatch.from_arrays([pa.array(list(at), pa.list_(pa.int32())),
                                              pa.array(list(np.ones(at.shape)), pa.list_(pa.float64()))], names=["at", "v"])
    tracemalloc.start()
    total = sum(b.column("value").to_numpy().sum() for b in K.pair_kernel(d)(batches()))
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert total == 60 * 10_000 * 10 and peak < bound


def test_pairs_whose_sum_is_zero_have_a_row():
    import pyarrow as pa
    b = pa.RecordBatch.from_arrays([pa.array([[0, 2], [0, 2]], pa.list_(pa.int32())),
                                    pa.array([[1.0, 1.0], [1.0, -1.0]], pa.list_(pa.float64()))], names=["at", "v"])
    rows = [r for o in K.pair_kernel(3)(iter([b])) for r in o.to_pylist()]
    assert {"i": 0, "j": 2, "value": 0.0} in rows and len(rows) == 3


def test_all_pairs_of_sparse_rows_come_from_their_cells(holes, monkeypatch):
    """As many eigenpairs as columns: no product with a d x d matrix, the same values."""
    rows, _, x = holes
    monkeypatch.setattr(RowProducts, "times", lambda *a: pytest.fail("the rows are multiplied by a d x d matrix"))
    lam, vec = D.top_eigen(rows, 30)
    assert np.allclose(lam, np.linalg.eigvalsh(x.T @ x)[::-1]) and np.allclose(vec @ np.diag(lam) @ vec.T, x.T @ x)
