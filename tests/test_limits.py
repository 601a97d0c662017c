"""What does not fit is refused, and digits survive far from zero."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrystat.functions import kernels
from quarrystat.operators import binning, blocks, decomposition, gram, missing, reshape, stats
from quarrystat.operators.supervised import least_squares
from quarrystat.streaming.ipca import StreamingPca


def test_levels_beyond_16_bits_are_plain_integers(spark):
    t = spark.createDataFrame([(0, [1.0]), (1, [50000.0])], "id long, features array<double>")
    b = binning.equal_frequency_bins(t, 40001, cuts=np.arange(40000.0)[None, :])
    assert dict(b.dtypes)["bins"] == "array<int>" and {r["id"]: r["bins"] for r in b.collect()} == {0: [1], 1: [40000]}


def test_collinear_features_share_their_weight(spark):
    rows = [(i, float(2 * i), [float(i), float(i)]) for i in range(1, 30)]
    w = least_squares(spark.createDataFrame(rows, "id long, label double, features array<double>"))
    assert w == pytest.approx([1.0, 1.0], abs=1e-6)


def test_lost_stream_state_is_an_error(spark, tmp_path):
    batch = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "id long, features array<double>")
    with pytest.raises(RuntimeError, match="gone"):
        StreamingPca(str(tmp_path / "s"), 1)(batch, 1)
    fresh = StreamingPca(str(tmp_path / "t"), 1)
    fresh(batch.where(F.lit(False)), 0)
    fresh(batch, 1)


def test_distances_far_from_zero(spark):
    x = 1e8 + np.random.default_rng(2).random((4, 3))
    t = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, features array<double>")
    for r in blocks.squared_distances(t).collect():
        assert r["value"] == pytest.approx(((x[r["r"]] - x[r["s"]]) ** 2).sum(), rel=1e-6)


@pytest.mark.parametrize("odd", [None, [1.0]])
def test_null_and_ragged_rows_are_errors(spark, odd):
    t = spark.createDataFrame([(0, [1.0, 2.0]), (1, odd), (2, [3.0, 4.0])], "id long, features array<double>").coalesce(1)
    for run in (stats.col_means, stats.col_summary, missing.nan_counts, missing.nan_row_counts, stats.unit_norm,
                lambda x: missing.drop_rows(x, 0)[0]):
        with pytest.raises(Exception, match="null array or width other than 2"):
            run(t).collect()


@pytest.mark.parametrize("ids", [[1, 1, 2], [1, 2, None]])
def test_ordinal_refuses_repeated_and_null_keys(spark, ids):
    t = spark.createDataFrame([(i, 0) for i in ids], "id long, v int")
    with pytest.raises(ValueError, match="distinct keys"):
        reshape.with_ordinal(t)


def test_no_singular_value_out_of_noise(spark):
    x = np.random.default_rng(4)
    m = x.random((50, 2)) @ x.random((2, 5))
    t = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(m)], "id long, features array<double>")
    assert len(decomposition.svd(t, 5).s) == 2


def test_covariance_does_not_hang_on_the_first_rows(spark):
    x = np.random.default_rng(5).random((600, 3)) + np.where(np.arange(600) < 250, 0.0, 1e8)[:, None] * [0, 1, 0]
    t = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, features array<double>")
    got = {(r["i"], r["j"]): r["value"] for r in gram.covariance(t).collect()}
    assert got[0, 2] == pytest.approx(np.cov(x.T)[0, 2], rel=1e-9)


def test_distances_of_clusters_keep_their_digits(spark):
    """Rows near 0 and near 10^8 in one block."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.integers(0, 5, (30, 4)) * 0.25, 1e8 + rng.integers(0, 5, (30, 4)) * 0.25])
    t = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, features array<double>")
    for rows in (512, 7):
        got = {(r["r"], r["s"]): r["value"] for r in blocks.squared_distances(t, rows, grid=1).collect()}
        assert len(got) == 60 * 61 // 2
        for (r, s), v in got.items():
            assert v == pytest.approx(((x[r] - x[s]) ** 2).sum(), rel=1e-12, abs=0)


def test_near_pairs_only(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(120, 3)) + 40 * rng.integers(0, 3, (120, 1))
    t = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, features array<double>")
    got = {(r["r"], r["s"]): r["value"] for r in blocks.squared_distances(t, 10, grid=2, most=2.5).collect()}
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    assert set(got) == {(r, s) for r in range(120) for s in range(r + 1) if d[r, s] <= 2.5}
    assert all(v == pytest.approx(d[k], abs=1e-9) for k, v in got.items())


def test_far_sub_blocks_are_not_multiplied(monkeypatch):
    import pyarrow as pa
    calls = []
    plain = kernels.squared_distances
    monkeypatch.setattr(kernels, "squared_distances", lambda a, b: calls.append(1) or plain(a, b))
    x = np.repeat([0.0, 1000.0, 2000.0], 10)[:, None] + np.linspace(0, 1, 30)[:, None]
    batch = pa.RecordBatch.from_arrays([pa.array(np.zeros(30, np.int32)), pa.array(np.arange(30)), kernels.list_column(x)],
                                       names=["blk", "id", "features"])
    key = (pa.scalar(0), pa.scalar(0))
    for most, products in ((None, 6), (4.0, 3)):
        calls.clear()
        out = list(kernels.row_pair_kernel("distance", 10, None, most)(key, iter([batch])))
        assert len(calls) == products and sum(b.num_rows for b in out) == (465 if most is None else 165)


def test_rows_are_sent_as_often_as_the_grid_is_wide(spark):
    assert [blocks.grid_size(n, 64, tasks) for n, tasks in ((10**6, 8), (10**6, 5000), (5, 100), (10**9, 8))] == [8, 100, 5, 7630]
    t = spark.createDataFrame([(i, [float(i)]) for i in range(1000)], "id long, features array<double>")
    g = blocks.grid_size(1000, 1, spark.sparkContext.defaultParallelism)
    cells = blocks._cells(t, None)
    assert g * (g + 1) // 2 >= spark.sparkContext.defaultParallelism
    assert cells.groupBy("id").count().select("count").distinct().collect() == [(g,)]


def test_appended_tables_must_have_the_same_ids(spark):
    def t(*ids):
        return spark.createDataFrame([(i, [1.0]) for i in ids], "id long, features array<double>")
    assert sorted(r["features"] for r in reshape.append_columns(t(1, 2), t(2, 1)).collect()) == [[1.0, 1.0]] * 2
    for a, b in ((t(1, 1), t(1, 2)), (t(1, 2), t(1, None)), (t(1, 2), t(2, 2))):
        with pytest.raises(ValueError, match="distinct keys"):
            reshape.append_columns(a, b)
    for a, b in ((t(1, 2), t(1)), (t(1), t(1, 2))):
        with pytest.raises(Exception, match="id without a partner: 2"):
            reshape.append_columns(a, b).collect()


def test_tiles_of_a_transpose_are_bounded_in_cells(spark):
    x = np.random.default_rng(7).random((90, 11))
    t = spark.createDataFrame([(int(i) * 3, x[i].tolist()) for i in np.random.default_rng(1).permutation(90)],
                              "id long, features array<double>").repartition(4)
    tiles = reshape.transpose_tiles(t, rows=20, cells=60)
    plan = tiles._jdf.queryExecution().optimizedPlan().toString()
    assert "slice(features" in plan
    rows = tiles.collect()
    assert len(rows) == 5 * 11 and all(len(r["values"]) <= 20 and r["ids"] == sorted(r["ids"]) for r in rows)
    cells = reshape.transpose_sorted(t, rows=20, cells=60).collect()
    assert [(r["j"], r["pos"], r["id"], r["v"]) for r in cells] == [(j, i, 3 * i, x[i, j]) for j in range(11) for i in range(90)]
