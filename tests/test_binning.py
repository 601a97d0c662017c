"""Order statistics and bins against brute force, on both ways to find them."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarrystat.functions.kernels import sortable, unsortable
from quarrystat.operators import binning
from quarrystat.sources.text import from_rows


def brute_cuts(x, levels):
    step = len(x) // levels
    return np.sort(x, axis=0)[[k * step - 1 for k in range(1, levels + 1)]].T


def table(spark, x):
    return from_rows(spark, x.tolist(), label=False).repartition(5)


def skewed(rng):
    """Heavy ties, huge range, negatives, zeros of both signs, near-equal values."""
    n = 1000
    tied = np.where(rng.random(n) < 0.4, 7.25, rng.standard_normal(n))
    close = 1.0 + rng.integers(0, 50, n) * 2.0 ** -52
    wide = rng.standard_normal(n) * 10.0 ** rng.integers(-200, 200, n)
    zeros = np.where(rng.random(n) < 0.5, 0.0, -0.0)
    return np.column_stack([tied, close, wide, zeros, np.full(n, -3.0), rng.random(n)])


@pytest.mark.parametrize("limit", [10 ** 6, 40, 1])
@pytest.mark.parametrize("levels", [1, 10])
def test_cuts_match_sorting(spark, rng, limit, levels):
    x = skewed(rng)
    got = binning.equal_frequency_cuts(table(spark, x), levels, sort_limit=limit)
    assert np.array_equal(got, brute_cuts(x, levels))


def test_many_features_in_tiles(spark, rng, monkeypatch):
    monkeypatch.setattr(binning, "HISTOGRAM_CELLS", 5000)
    x = rng.standard_normal((300, 9))
    got = binning.equal_frequency_cuts(table(spark, x), 4, sort_limit=10)
    assert np.array_equal(got, brute_cuts(x, 4))


def test_bins_count_cuts_below(spark, rng):
    x = skewed(rng)
    rows = binning.equal_frequency_bins(table(spark, x), 7).collect()
    cuts = brute_cuts(x, 7)
    for r in rows:
        assert r["bins"] == [int((cuts[j] < x[r["id"], j]).sum()) for j in range(x.shape[1])]


def test_clamp_folds_the_rest(spark, rng):
    x = rng.standard_normal((103, 2))
    df = table(spark, x)
    top = max(max(r["bins"]) for r in binning.equal_frequency_bins(df, 10).collect())
    clamped = max(max(r["bins"]) for r in binning.equal_frequency_bins(df, 10, clamp=True).collect())
    assert (top, clamped) == (10, 9)


def test_more_levels_than_rows(spark):
    with pytest.raises(ValueError):
        binning.equal_frequency_cuts(from_rows(spark, [[1.0], [2.0]], label=False), 3)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.floats(allow_nan=False), min_size=1, max_size=30))
def test_sort_keys_keep_order(values):
    v = np.array(values) + 0.0
    k = sortable(v)
    assert np.array_equal(np.argsort(k, kind="stable"), np.argsort(v, kind="stable"))
    assert np.array_equal(unsortable(k), v)
