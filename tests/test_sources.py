import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrystat.operators import stats
from quarrystat.sources import metadata, sparse, synthetic, text


def test_lines_pair_across_files_and_splits(spark, tmp_path):
    x = np.random.default_rng(0).standard_normal((3000, 4))
    (tmp_path / "f").mkdir()
    for k in range(3):
        lines = [" , ".join(repr(float(v)) for v in r) for r in x[k * 1000:(k + 1) * 1000]]
        (tmp_path / "f" / f"part-{k}.csv").write_text("\n".join(lines) + "\n")
    (tmp_path / "label.csv").write_text("\n".join(str(i % 3 + 1) for i in range(3000)) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        got = {r["id"]: (r["label"], r["features"]) for r in
               text.read_pair(spark, str(tmp_path / "f"), str(tmp_path / "label.csv")).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(got) == list(range(3000))
    assert all(got[i][0] == i % 3 + 1 and np.array_equal(got[i][1], x[i]) for i in got)


def test_libsvm_bz2(spark, tmp_path):
    import bz2
    (tmp_path / "a.bz2").write_bytes(bz2.compress(b"1 1:0.5 3:2.0\n-1 2:1.5\n"))
    rows = text.read_libsvm(spark, str(tmp_path / "a.bz2"), 3, dense=True).collect()
    assert sorted((r["label"], r["features"]) for r in rows) == [(-1.0, [0.0, 1.5, 0.0]), (1.0, [0.5, 0.0, 2.0])]
    cells = sparse.to_entries(text.read_libsvm(spark, str(tmp_path / "a.bz2"), 3, ids=True), "label").collect()
    assert sorted(map(tuple, cells)) == [(-1.0, 1, 1.5), (1.0, 0, 0.5), (1.0, 2, 2.0)]


def test_synthetic_is_repeatable_and_gaussian(spark):
    a = synthetic.gaussian_rows(spark, 4000, 5, seed=1, partitions=3)
    b = synthetic.gaussian_rows(spark, 4000, 5, seed=1, partitions=8)
    assert a.exceptAll(b).count() == 0
    x = np.array([r["features"] for r in a.collect()])
    assert np.abs(x.mean(0)).max() < 0.08 and np.abs(x.std(0) - 1).max() < 0.08
    assert np.abs(np.corrcoef(x.T) - np.eye(5)).max() < 0.08


def test_support_and_nan(spark):
    df = synthetic.regression_table(spark, 500, 6, [1, 0, 0, 0, 2, 0], support=[0, 4], seed=2)
    x = np.array([r["features"] for r in df.collect()])
    y = np.array([r["label"] for r in df.collect()])
    assert x[:, 1].min() >= 0 and x[:, 1].max() > 50 and np.abs(x[:, 0]).max() < 6
    assert np.allclose(y, x[:, 0] + 2 * x[:, 4])
    gaps = synthetic.inject_nan(df, 0.1, seed=2)
    z = np.array([r["features"] for r in gaps.collect()])
    assert np.isnan(z[:, 3]).all() and 0.05 < np.isnan(z[:, 0]).mean() < 0.15
    assert not any(np.isnan(r["label"]) for r in gaps.collect())


def test_metadata(spark):
    df = text.from_rows(spark, [(0, [1, 2.0]), (1, [0, 3.0])])
    m = metadata.set_metadata(df, {0: 2}, 2, 2)
    attr = m.schema["features"].metadata["ml_attr"]["attrs"]
    assert attr["nominal"][0]["vals"] == ["0", "1"] and attr["numeric"][0]["idx"] == 1
    assert metadata.set_metadata(df, {}, 0, 2).schema["label"].metadata["ml_attr"]["type"] == "numeric"


def test_crosstab_nulls_and_backticks(spark):
    df = spark.createDataFrame([("x", "a`b"), ("x", None), (None, "a`b"), ("x", "a`b")], "a string, b string")
    out = stats.crosstab(df, "a", "b")
    assert sorted(out.columns) == ["a", "ab", "null"]
    assert {r["a"]: (r["ab"], r["null"]) for r in out.collect()} == {"x": (2, 1), "null": (1, 0)}


def test_zero_column_normalises_to_zero(spark):
    df = text.from_rows(spark, [(1, [0.0, -4.0]), (2, [0.0, 2.0])])
    got = sorted(r["features"] for r in stats.unit_norm(df, label="first").collect())
    assert got == [[1.0, 0.0, -1.0], [2.0, 0.0, 0.5]]


def test_too_many_label_states(spark):
    with pytest.raises(ValueError):
        stats.label_states(spark.range(10002).select(F.col("id").alias("y")), "y")


def test_no_local_scratch_on_a_cluster():
    from types import SimpleNamespace as Bag

    from quarrystat.session import shared_dir
    cluster = Bag(conf=Bag(get=lambda *_: None),
                  sparkContext=Bag(master="spark://host:7077", getCheckpointDir=lambda: None))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(cluster)


def test_hashed_terms_fall_in_murmur_buckets(spark):
    """Words of whole 4-byte blocks: their buckets are Spark's own hash of the word."""
    from quarrystat.operators.supervised import term_frequencies
    words = ["word", "bucketed", "term", "frequencies.", "abcd"]
    df = spark.createDataFrame([(i, f"{w} {w} {w.upper()}") for i, w in enumerate(words)], "id long, text string")
    got = {r["id"]: dict(zip(r["features"].indices.tolist(), r["features"].values.tolist())) for r in term_frequencies(df, 1000).collect()}
    at = df.select("id", F.pmod(F.hash(F.split("text", " ")[0]), F.lit(1000)).alias("b")).collect()
    assert got == {r["id"]: {r["b"]: 3.0} for r in at}


def test_text_model_tells_unseen_documents(spark):
    from quarrystat.operators import supervised
    from quarrystat.operators.reshape import split
    rows = [(i, f"{'alpha beta' if i % 2 else 'gamma delta'} filler{i % 5}", float(i % 2)) for i in range(200)]
    train, test = split(spark.createDataFrame(rows, "id long, text string, label double"))
    out = supervised.text_model(train, buckets=(100,), regs=(0.01,)).transform(test)
    assert out.count() > 20 and out.where("prediction <> label").count() == 0


def test_text_model_reads_texts_once(spark, monkeypatch):
    """One pass of the tokenizer, whatever the grid; the choice is that of a grid over the whole chain."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.feature import HashingTF, Tokenizer
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    from quarrystat.operators import supervised
    rows = [(i, f"{'alpha beta' if i % 3 else 'gamma delta'} w{i % 7} w{i % 11}", float(i % 2)) for i in range(120)]
    t = spark.createDataFrame(rows, "id long, text string, label double").coalesce(2).persist()
    tok, tf = Tokenizer(inputCol="text", outputCol="words"), HashingTF(inputCol="words", outputCol="features")
    lr = LogisticRegression(maxIter=10)
    grid = ParamGridBuilder().addGrid(tf.numFeatures, [10, 40]).addGrid(lr.regParam, [0.1]).build()
    want = CrossValidator(estimator=Pipeline(stages=[tok, tf, lr]), estimatorParamMaps=grid, evaluator=BinaryClassificationEvaluator(),
                          numFolds=2, seed=0).fit(t).bestModel.stages[-1]
    passes, plainly = [], Tokenizer._transform
    monkeypatch.setattr(Tokenizer, "_transform", lambda self, df: passes.append(1) or plainly(self, df))
    got = supervised.text_model(t, buckets=(10, 40), regs=(0.1,)).stages[-1]
    assert len(passes) == 1
    assert got.numFeatures == want.numFeatures and got.coefficients.toArray().tolist() == pytest.approx(want.coefficients.toArray().tolist())


def test_words_are_counted_in_bounded_tasks(spark, monkeypatch):
    """One shuffle, of texts by id, into as many partitions as their bytes ask for; ids that repeat are added up."""
    monkeypatch.setattr(sparse, "TEXT_BYTES", 100)
    docs = spark.createDataFrame([(i % 50, "one two two") for i in range(100)] + [(None, "x"), (7, None)], "doc_id long, text string")
    cells = sparse.word_entries(docs, 1000)
    assert cells.rdd.getNumPartitions() == 11
    assert sorted(r["value"] for r in cells.collect()) == [2.0] * 50 + [4.0] * 50
