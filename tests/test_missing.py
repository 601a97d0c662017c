import numpy as np
import pytest

from quarrystat.operators import missing as X
from quarrystat.sources.text import from_rows

NAN = float("nan")
ROWS = [[1.0, NAN, NAN, 4.0], [NAN, 2.0, NAN, 5.0], [3.0, 2.0, NAN, NAN], [5.0, 6.0, 7.0, 8.0]]


@pytest.fixture(scope="module")
def df(spark):
    return from_rows(spark, ROWS, label=False)


def feats(df):
    return {r["id"]: r["features"] for r in df.collect()}


def test_drop_columns(df):
    out, gone = X.drop_columns(df, 1)
    assert gone == [2] and len(feats(out)[0]) == 3
    assert X.drop_columns(df, 1, inclusive=False)[1] == [0, 1, 2, 3]
    assert X.drop_columns(df, 3, inclusive=False)[1] == [2]


def test_drop_rows(df):
    kept, gone = X.drop_rows(df, 1)
    assert sorted(feats(kept)) == [3] and sorted(r["id"] for r in gone.collect()) == [0, 1, 2]


def test_impute_mean_and_empty_column(spark, df):
    got = feats(X.impute_mean(df))
    assert got[1][0] == 3.0 and got[0][1] == pytest.approx(10 / 3) and got[0][2] == 7.0
    alone = from_rows(spark, [[NAN, 1.0], [NAN, 3.0]], label=False)
    assert np.isnan(feats(X.impute_mean(alone))[0][0])


def test_column_check_is_strict_at_half(df):
    got = feats(X.column_check(df))
    assert all(len(v) == 3 for v in got.values()) and got[2][2] == pytest.approx(17 / 3)


def test_column_row_check_uses_means_of_all_rows(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((60, 12))
    x[rng.random(x.shape) < 0.15] = np.nan
    x[:, 4] = np.nan
    keep = [j for j in range(12) if (~np.isnan(x[:, j])).sum() > 30]
    mean = np.nanmean(x[:, keep], axis=0)
    want = {i: np.where(np.isnan(x[i, keep]), mean, x[i, keep]) for i in range(60)
            if np.isnan(x[i, keep]).sum() < len(keep) // 4}
    got = feats(X.column_row_check(from_rows(spark, x.tolist(), label=False).repartition(4)))
    assert sorted(got) == sorted(want)
    assert all(np.allclose(got[i], want[i]) for i in want)


def test_clean_table(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((80, 10))
    x[rng.random(x.shape) < 0.12] = np.nan
    x[:, 2], x[:50, 6], x[:25, 8] = np.nan, np.nan, np.nan
    first = [j for j in range(10) if np.isnan(x[:, j]).sum() <= 40]
    rows = [i for i in range(80) if np.isnan(x[i, first]).sum() <= 2]
    last = [j for j in first if np.isnan(x[rows][:, j]).sum() <= 20]
    mean = np.nanmean(x[rows][:, last], axis=0)
    out, kept = X.clean_table(from_rows(spark, x.tolist(), label=False).repartition(3))
    got = feats(out)
    assert kept == last and sorted(got) == rows
    assert all(np.allclose(got[i], np.where(np.isnan(x[i, last]), mean, x[i, last])) for i in rows)


def test_filter_long_labels(spark, df):
    a = spark.createDataFrame([(0,), (3,)], "id bigint")
    b = spark.createDataFrame([(1,), (3,), (3,)], "id bigint")
    # kept columns 0, 1, 3: no gap per row allowed
    got = {(r["id"], r["j"]): (r["label"], r["v"]) for r in X.filter_long(df, a, b).collect()}
    assert got == {(3, 0): (1, 5.0), (3, 1): (1, 6.0), (3, 3): (1, 8.0)}
