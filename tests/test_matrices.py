"""Gram family, blocks, products, reshapes against numpy."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quarrystat.operators import blocks, gram, reshape
from quarrystat.sources.text import from_rows


@pytest.fixture(scope="module")
def x():
    rng = np.random.default_rng(4)
    m = rng.standard_normal((90, 6)) * [1, 2, 3, 0.1, 5, 1] + [0, 1e6, 0, 0, 3, 0]
    m[:, 5] = 0.0
    return m


@pytest.fixture(scope="module")
def df(spark, x):
    return from_rows(spark, x.tolist(), label=False).repartition(5)


def dense(entries, d=6):
    out = np.full((d, d), np.nan)
    for r in entries.collect():
        out[r["i"], r["j"]] = r["value"]
    return out


@pytest.mark.parametrize("tile", [2048, 4, 1])
def test_gram_tiles(df, x, tile):
    got = dense(gram.gram(df, tile=tile))
    assert np.allclose(got[np.triu_indices(6)], (x.T @ x)[np.triu_indices(6)])
    assert np.isnan(got[np.tril_indices(6, -1)]).all()


def test_gram_of_more_tasks_than_buckets(df, x):
    got = dense(gram.gram(df.repartition(2 * gram.FAN + 5)))
    assert np.allclose(got[np.triu_indices(6)], (x.T @ x)[np.triu_indices(6)])


def test_gram_counts_rows_and_scans_once_a_band(df):
    assert {r["n"] for r in gram.gram(df, count=True).collect()} == {90}
    for tile, scans in ((None, 1), (2, 3)):
        plan = gram.gram(df, tile=tile)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInArrow") == scans
        assert "Repartition" not in plan.split("MapInArrow")[0]


def test_splits_are_merged_where_sums_are_large(df, x, monkeypatch):
    from quarrystat.operators import products
    cores = df.sparkSession.sparkContext.defaultParallelism
    assert products.merged(df, 21) is df
    monkeypatch.setattr(products, "SHUFFLE_BYTES", 1)
    many = df.repartition(5 * cores)
    assert products.merged(many, 21).rdd.getNumPartitions() == cores
    assert np.allclose(dense(gram.gram(many))[np.triu_indices(6)], (x.T @ x)[np.triu_indices(6)])
    assert np.allclose(gram.gram_times_matrix(many, np.eye(6)), x.T @ x)


def test_covariance_survives_large_means(df, x):
    assert np.allclose(dense(gram.covariance(df)), np.cov(x.T), rtol=1e-9, atol=1e-9)
    up = dense(gram.covariance(df, ddof=0, triangle="upper"))
    iu = np.triu_indices(6)
    assert np.allclose(up[iu], np.cov(x.T, ddof=0)[iu], rtol=1e-9, atol=1e-9)


def test_second_moment(df, x):
    assert np.allclose(dense(gram.second_moment(df)), x.T @ x / 89)


def test_cosine_and_zero_column(df, x):
    n = np.linalg.norm(x, axis=0)
    n[n == 0] = 1
    want = (x / n).T @ (x / n)
    iu = np.triu_indices(6, 1)
    assert np.allclose(dense(gram.cosine(df))[iu], want[iu])
    assert np.allclose(dense(gram.cosine_sampled(df, 1e15))[iu], want[iu])
    with pytest.raises(ValueError):
        gram.cosine(df, -0.1)
    with pytest.raises(ValueError):
        gram.cosine_sampled(df, 1.0)


def test_sampling_is_unbiased_and_repeatable(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((400, 3))
    x[:, 1] += x[:, 0]
    df = from_rows(spark, x.tolist(), label=False)
    c = np.cov(x.T, ddof=0)
    iu = np.triu_indices(3)
    draws = [dense(gram.covariance_sampled(df, s, gamma=200.0), 3)[iu] for s in range(12)]
    assert np.std(draws) > 0 and np.allclose(np.mean(draws, 0), c[iu], atol=0.15)
    again = dense(gram.covariance_sampled(df.repartition(7), 3, gamma=200.0), 3)[iu]
    assert np.allclose(again, draws[3])


def test_products(spark, df, x):
    w = np.arange(12.0).reshape(6, 2)
    got = {r["id"]: r["features"] for r in gram.multiply_local(df, w).collect()}
    assert np.allclose([got[i] for i in range(90)], x @ w)
    right = gram.entry_table(spark, w)
    for limit in (100, 0):
        e = gram.multiply_entries(gram.as_entries(df), right, salt=3, broadcast_limit=limit)
        out = np.zeros((90, 2))
        for r in e.collect():
            out[r["i"], r["j"]] = r["value"]
        assert np.allclose(out, x @ w)
    assert np.allclose(gram.gram_times_matrix(df, w), x.T @ (x @ w))
    gv = {r["j"]: r["value"] for r in gram.gram_times(df, range(6)).collect()}
    assert np.allclose([gv[j] for j in range(6)], x.T @ (x @ np.arange(6)))


@pytest.mark.parametrize("rows_per_block", [7, 40, 1000])
def test_row_pairs_once_each(df, x, rows_per_block):
    x = x - x.mean(0)
    centred = df.withColumn("features", F.col("features"))
    got = [(r["r"], r["s"], r["value"]) for r in
           blocks.row_gram(centred, center=True, rows_per_block=rows_per_block).collect()]
    assert sorted((r, s) for r, s, _ in got) == [(r, s) for r in range(90) for s in range(r + 1)]
    assert np.allclose([v for _, _, v in got], [x[r] @ x[s] for r, s, _ in got], atol=1e-6)


def test_triangles_and_distances(df, x):
    full = blocks.row_gram(df, triangle="full", rows_per_block=30)
    assert full.count() == 90 * 90
    assert blocks.row_gram(df, triangle="upper").filter("r > s").count() == 0
    small = df.withColumn("features", F.transform("features", lambda v: v % 10))
    rows = {r["id"]: np.array(r["features"]) for r in small.collect()}
    for r in blocks.squared_distances(small, 25).collect():
        assert r["value"] == pytest.approx(((rows[r["r"]] - rows[r["s"]]) ** 2).sum(), abs=1e-9)


@pytest.mark.parametrize("kind", ["gram", "distance"])
def test_written_pairs_take_little_more_than_their_values(spark, tmp_path, kind):
    """Rows arrive in no order; ids leave in runs, else two of them take two bytes a pair."""
    rng = np.random.default_rng(2)
    x = {int(i): rng.normal(size=4) for i in rng.permutation(1200)}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in x.items()], "id bigint, features array<double>")
    pairs = (blocks.row_gram if kind == "gram" else blocks.squared_distances)(df, rows_per_block=256, grid=2)
    pairs.write.parquet(str(tmp_path / "pairs"))
    tables = [pq.ParquetFile(f) for f in (tmp_path / "pairs").glob("*.parquet")]
    groups = [t.metadata.row_group(g) for t in tables for g in range(t.metadata.num_row_groups)]
    n = 1200 * 1201 // 2
    assert sum(g.num_rows for g in groups) == n
    assert sum(g.column(c).total_compressed_size for g in groups for c in (0, 1)) < 0.6 * n
    found = pa.concat_tables(t.read() for t in tables).to_pydict()
    r, s = (np.array([x[i] for i in found[c]]) for c in "rs")
    assert len({*zip(found["r"], found["s"])}) == n and min(np.subtract(found["r"], found["s"])) == 0
    assert np.allclose(found["value"], (r * s).sum(1) if kind == "gram" else ((r - s) ** 2).sum(1))


def test_ordinal_is_contiguous(spark):
    ids = np.random.default_rng(0).choice(10 ** 12, 500, replace=False)
    df = spark.createDataFrame([(int(i),) for i in ids], "id bigint").repartition(6)
    for size in (1000, 37):
        got = {r["id"]: r["ordinal"] for r in reshape.with_ordinal(df, bucket_rows=size).collect()}
        assert [got[i] for i in sorted(got)] == list(range(500))


def test_transpose_chunks_keeps_order(df, x):
    for chunk in (1000, 25):
        parts = {}
        for r in reshape.transpose_chunks(df, chunk).collect():
            assert len(r["values"]) <= chunk
            parts.setdefault(r["j"], {})[r["chunk"]] = r["values"]
        for j in range(6):
            assert np.allclose(np.concatenate([parts[j][c] for c in sorted(parts[j])]), x[:, j])


def test_blocks_pairs_and_partitions(df):
    pairs = reshape.consecutive_pairs(df.select("id"), "id", 9).collect()
    assert len(pairs) == 80 and all(r["cur"] == r["prev"] + 1 for r in pairs)
    parts = reshape.block_partition(df, 20, 3).withColumn("p", F.spark_partition_id())
    assert parts.groupBy("blk").agg(F.countDistinct("p").alias("k")).filter("k > 1").count() == 0


def test_ragged_rows_are_refused(spark):
    bad = from_rows(spark, [[1.0, 2.0], [1.0]], label=False)
    for table in (bad, bad.coalesce(1)):
        with pytest.raises(Exception, match="differ in width"):
            gram.gram(table).collect()
    from quarrystat.operators.common import check_width
    with pytest.raises(ValueError):
        check_width(bad)


def test_hash_rows_do_not_depend_on_layout(df):
    a = {(r["id"], r["copy"]) for r in reshape.replicate(df.select("id")).collect()}
    b = {(r["id"], r["copy"]) for r in reshape.replicate(df.select("id").coalesce(1)).collect()}
    train, test = reshape.split(df.select("id"))
    assert a == b and train.count() + test.count() == 90
    assert train.join(test, "id").count() == 0
