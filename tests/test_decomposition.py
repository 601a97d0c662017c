import numpy as np
import pytest

from quarrystat.operators import decomposition as D
from quarrystat.operators import gram, supervised
from quarrystat.sources import synthetic
from quarrystat.sources.text import from_rows
from quarrystat.streaming.ipca import StreamingPca, load_state, save_state


@pytest.fixture(scope="module")
def x():
    rng = np.random.default_rng(6)
    return rng.standard_normal((120, 8)) @ np.diag([9, 7, 5, 4, 3, 2, 1, 0.5]) + 2


@pytest.fixture(scope="module")
def df(spark, x):
    return from_rows(spark, x.tolist(), label=False).repartition(4)


def same_up_to_sign(a, b):
    return np.allclose(np.abs((a * b).sum(0)), 1, atol=1e-6)


@pytest.mark.parametrize("mode", ["local", "distributed"])
def test_svd(df, x, mode):
    m = D.svd(df, 3, compute_u=True, mode=mode)
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(m.s, s[:3]) and same_up_to_sign(m.v, vt[:3].T)
    got = {r["id"]: r["u"] for r in m.u.collect()}
    mine = np.array([got[i] for i in range(120)])
    assert np.allclose(mine * m.s @ m.v.T, (u[:, :3] * s[:3]) @ vt[:3])


def test_svd_drops_small_values(spark):
    x = np.outer(np.arange(1.0, 6), [1, 2, 3])
    assert len(D.svd(from_rows(spark, x.tolist(), label=False), 3, r_cond=1e-6).s) == 1


def test_top_eigen_exhausts_small_space(df, x):
    lam, vec = D.top_eigen(df, 7)
    assert np.allclose(lam, np.linalg.eigvalsh(x.T @ x)[::-1][:7])
    assert np.allclose(x.T @ x @ vec, vec * lam)
    assert np.allclose(D.top_eigen(df, 8)[0], np.linalg.eigvalsh(x.T @ x)[::-1])
    with pytest.raises(ValueError):
        D.top_eigen(df, 9)


def test_pca(df, x):
    m = D.pca(df, 3)
    lam = np.linalg.eigvalsh(np.cov(x.T))[::-1]
    assert np.allclose(m.ratio, lam[:3] / lam.sum()) and D.pca(df, 8).ratio.sum() == pytest.approx(1)
    raw = {r["id"]: r["scores"] for r in D.pca_project(df, m).collect()}
    cen = {r["id"]: r["scores"] for r in D.pca_project(df, m, centred=True).collect()}
    assert np.allclose([raw[i] for i in range(120)], x @ m.pc)
    assert np.allclose([cen[i] for i in range(120)], (x - x.mean(0)) @ m.pc)


def test_qr_literal_and_random(spark, df, x):
    lit = np.array([[0, 1, 2], [3, 4, 5], [6, 7, 8], [9, 0, 1.0]])
    for table, a in ((from_rows(spark, lit.tolist(), label=False), lit), (df, x)):
        q, r = D.tall_skinny_qr(table)
        got = {row["id"]: row["q"] for row in q.collect()}
        qm = np.array([got[i] for i in range(len(a))])
        assert np.abs(qm @ r - a).sum() < 1e-6
        assert np.abs(np.abs(qm) - np.abs(np.linalg.qr(a)[0])).sum() < 1e-6
        assert (np.diag(r) >= 0).all()


def stacked(u, d, mu, n, batch, ff):
    """One update through the SVD of the stacked rows."""
    m = len(batch)
    mu1 = batch.mean(0)
    rows = np.vstack([(u * d).T, batch - mu1, np.sqrt(m * n / (m + n)) * (mu - mu1)])
    _, s, vt = np.linalg.svd(rows, full_matrices=False)
    total = m + ff * n
    return vt.T, s, (ff * n * mu + m * mu1) / total, total


@pytest.mark.parametrize("ff,k", [(1.0, None), (0.9, 4)])
def test_ipca_updates(spark, x, ff, k):
    state, ref = None, None
    for at in range(0, 120, 30):
        b = x[at:at + 30]
        state = D.ipca_fit(from_rows(spark, b.tolist(), label=False), state, ff=ff, k=k)
        if ref is None:
            c = b - b.mean(0)
            _, s, vt = np.linalg.svd(c, full_matrices=False)
            ref = (vt.T[:, :k], s[:k], b.mean(0), 30.0)
        else:
            u, s, mu, n = stacked(*ref, b, ff)
            ref = (u[:, :k], s[:k], mu, n)
        assert np.allclose(state.d, ref[1]) and np.allclose(state.mu, ref[2])
        assert state.n == pytest.approx(ref[3]) and same_up_to_sign(state.u, ref[0])
    if ff == 1.0:
        assert np.allclose(state.d, np.linalg.svd(x - x.mean(0))[1])


def test_ipca_scaled_variant_differs(spark, x):
    s0 = D.ipca_fit(from_rows(spark, x[:40].tolist(), label=False))
    b = from_rows(spark, x[40:80].tolist(), label=False)
    assert D.ipca_fit(b, s0, ff=0.5, scale_d0=True).d[0] < D.ipca_fit(b, s0, ff=0.5).d[0]


def test_stream_skips_replays(spark, x, tmp_path):
    job = StreamingPca(str(tmp_path / "state"))
    first, second = (from_rows(spark, x[a:a + 60].tolist(), label=False) for a in (0, 60))
    job(first, 0)
    job(second, 1)
    job(second, 1)
    s = job.latest(spark, 1)
    assert s.n == 120 and np.allclose(s.d, np.linalg.svd(x - x.mean(0))[1])
    job(second.limit(0), 2)
    assert job.latest(spark, 2).n == 120
    save_state(spark, s, str(tmp_path / "copy"))
    assert np.array_equal(load_state(spark, str(tmp_path / "copy")).u, s.u)
    assert load_state(spark, str(tmp_path / "none")) is None


def test_stream_over_files(spark, x, tmp_path):
    for k in range(4):
        from_rows(spark, x[k * 30:k * 30 + 30].tolist(), label=False).coalesce(1).write.parquet(
            str(tmp_path / "in" / f"part={k}"))
    rows = (spark.readStream.schema("id bigint, features array<double>")
            .option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*")))
    state = StreamingPca(str(tmp_path / "state")).run(rows, str(tmp_path / "ck"))
    assert state.n == 120 and np.allclose(state.d, np.linalg.svd(x - x.mean(0))[1])


def test_least_squares(spark, x):
    w = np.arange(1.0, 9)
    y = x @ w + 0.1 * np.random.default_rng(1).standard_normal(120)
    df = from_rows(spark, list(zip(y, x.tolist())))
    got = supervised.least_squares(df)
    assert np.allclose(got, np.linalg.lstsq(x, y, rcond=None)[0])
    assert np.allclose(x.T @ (y - x @ got), 0, atol=1e-6)


def test_models_learn(spark):
    w = [3.0, -2.0, 0.0, 1.0]
    df = synthetic.regression_table(spark, 600, 4, w, noise=0.01, binary=True, seed=9).selectExpr(
        "id", "features", "cast(label > 0 as int) as label").persist()
    from quarrystat.operators.stats import error_rate
    assert error_rate(supervised.predict(supervised.logistic(df), df)).first()["accuracy"] > 0.97
    assert error_rate(supervised.predict(supervised.linear_svm(df, 10), df)).first()["accuracy"] > 0.9
    sweep = {r["reg"]: r["auc"] for r in supervised.logistic_sweep(df).collect()}
    assert set(sweep) == set(supervised.REG_PARAMS) and sweep[0.01] > 0.97
    imp = supervised.forest_importance(df).orderBy("pos").collect()
    assert imp[-1]["j"] == 0 and sum(r["importance"] for r in imp) == pytest.approx(1)


def test_auc_with_ties(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (0, 0), (1, 1)], "s int, y int")
    # of 6 pairs 4 are won and 2 are tied
    assert supervised.auc(df, "s", "y") == pytest.approx((4 + 2 * 0.5) / 6)


def test_wide_matrix_is_refused_on_the_driver_only(spark):
    with pytest.raises(ValueError):
        gram.local_moments(from_rows(spark, [[0.0] * 4097], label=False))
