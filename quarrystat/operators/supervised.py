"""Supervised jobs: least squares, Spark ML classifiers, forests, text model."""

from __future__ import annotations

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import HashingTF, Tokenizer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystat.operators.common import width
from quarrystat.operators.products import RowProducts, is_vector
from quarrystat.operators.reshape import split, with_label

REG_PARAMS = (0.01, 0.1, 1.0, 10.0, 100.0)
#: Features up to which least squares is solved from one pass.
DIRECT = 512


def as_ml(df: DataFrame) -> DataFrame:
    """Features as an ML vector, label as double. Vectors, sparse ones too, stay as they are."""
    if not is_vector(df):
        df = df.withColumn("features", array_to_vector("features"))
    return df.withColumn("label", F.col("label").cast("double"))


def least_squares(df: DataFrame, tol: float = 1e-12, max_iter: int | None = None,
                  direct: int = DIRECT) -> np.ndarray:
    """Weights of label ~ features without intercept. Collinear features share their weight:
    the solution of least norm.

    Up to ``direct`` features the normal equations are solved from one pass. Wider tables take
    conjugate gradients on them, a scan a round: each scan gives the product with the search
    direction and, from the rows themselves, the gradient X'(y - Xw) anew, so that rounding in
    the recurrence does not add up. The driver holds vectors of one number a feature and no
    state lies in the table. It ends when the gradient is below ``tol`` times that of w = 0 (or
    times |X| |y - Xw|), or the rest below ``tol`` times y. Starting from 0 it stays in the row
    space, which is the solution of least norm.
    """
    d = width(df)
    if d <= direct:
        g = RowProducts(with_label(df), d + 1).times(np.eye(d + 1))
        g = (g + g.T) / 2
        if np.linalg.cond(g[:-1, :-1]) > 1e13:
            return np.linalg.lstsq(g[:-1, :-1], g[:-1, -1], rcond=1e-12)[0]
        return np.linalg.solve(g[:-1, :-1], g[:-1, -1])
    rows = RowProducts(df, d, target="label")
    w, p, start, goal, norm = np.zeros(d), np.zeros(d), None, None, 0.0
    for _ in range(max_iter or 10 * d):
        m = rows.times(np.column_stack([p, w]))
        q, gradient, rest = m[:, 0], m[:, 1], np.sqrt(rows.total)      # X'Xp, X'(y - Xw), |y - Xw|
        if start is None:
            start, goal, p = float(np.linalg.norm(gradient)), rest, gradient
            if start == 0.0:
                return w
            continue
        curve, slope = float(p @ q), float(p @ gradient)
        norm = max(norm, np.sqrt(max(curve, 0.0) / float(p @ p)))
        if np.linalg.norm(gradient) <= tol * max(start, norm * rest) or rest <= tol * goal or curve <= 0.0:
            return w
        w = w + p * (slope / curve)
        gradient = gradient - q * (slope / curve)
        p = gradient - p * (float(gradient @ q) / curve)
        if not p.any():
            return w
    raise RuntimeError("no convergence: raise max_iter or tol")


def auc(df: DataFrame, score: str, label: str) -> float:
    """Exact area under the ROC curve, ties counted half."""
    data = df.select(F.col(score).cast("double").alias("score"),
                     F.col(label).cast("double").alias("label"))
    return BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label",
                                         numBins=0).evaluate(data)


def _auc_of(pred: DataFrame) -> float:
    return BinaryClassificationEvaluator(numBins=0).evaluate(pred)


def logistic(df: DataFrame, reg: float = 0.0, max_iter: int = 100, tol: float = 1e-6, standardize: bool = True):
    """Binary logistic regression on a table with 0/1 labels, rows dense or sparse."""
    return LogisticRegression(regParam=reg, maxIter=max_iter, tol=tol, standardization=standardize).fit(as_ml(df))


def predict(model, df: DataFrame) -> DataFrame:
    return model.transform(as_ml(df))


def logistic_sweep(df: DataFrame, regs=REG_PARAMS, share: float = 0.8, seed: int = 0,
                   max_iter: int = 100, classes: bool = False) -> DataFrame:
    """Held-out AUC per regularisation: ``(reg, auc)``; with ``classes`` that of the predicted
    classes instead of the scores."""
    train, test = split(as_ml(df), share, seed=seed)
    train, test = train.persist(), test.persist()
    try:
        rows = []
        for r in regs:
            pred = LogisticRegression(regParam=r, maxIter=max_iter).fit(train).transform(test)
            rows.append((float(r), float(auc(pred, "prediction", "label") if classes else _auc_of(pred))))
    finally:
        train.unpersist()
        test.unpersist()
    return df.sparkSession.createDataFrame(rows, "reg double, auc double")


def linear_svm(df: DataFrame, max_iter: int = 2):
    return LinearSVC(maxIter=max_iter).fit(as_ml(df))


def forest(df: DataFrame, trees: int = 20, depth: int = 5, seed: int = 123, bootstrap: bool = True,
           features: str = "auto"):
    """Random-forest regression (variance impurity); ``features`` names how many a split tries."""
    return RandomForestRegressor(numTrees=trees, maxDepth=depth, seed=seed, bootstrap=bootstrap,
                                 featureSubsetStrategy=features).fit(as_ml(df))


def forest_importance(df: DataFrame, trees: int = 20, depth: int = 5, seed: int = 123) -> DataFrame:
    """Features by importance, least important first: ``(pos, j, importance)``."""
    imp = forest(df, trees, depth, seed).featureImportances.toArray()
    order = sorted(range(len(imp)), key=lambda j: (imp[j], j))
    return df.sparkSession.createDataFrame(
        [(p, j, float(imp[j])) for p, j in enumerate(order)], "pos int, j int, importance double")


def tokens(df: DataFrame, text: str = "text") -> DataFrame:
    """Lower-cased whitespace tokens in ``words``."""
    return Tokenizer(inputCol=text, outputCol="words").transform(df)


def term_frequencies(df: DataFrame, buckets: int, text: str = "text") -> DataFrame:
    """Hashed term frequencies in ``features``."""
    return HashingTF(inputCol="words", outputCol="features",
                     numFeatures=buckets).transform(tokens(df, text))


def text_model(train: DataFrame, buckets=(10, 100, 1000), regs=(0.1, 0.01), folds: int = 2,
               seed: int = 0, parallelism: int = 2):
    """Cross-validated tokenizer, hashing and logistic regression, chosen by AUC.

    Texts are tokenized and hashed once for every number of buckets; the folds and all fits read
    these sparse rows, which are kept, and choose among them by the column of features.
    """
    tok = Tokenizer(inputCol="text", outputCol="words")
    tfs = {f"features_{n}": HashingTF(inputCol="words", outputCol=f"features_{n}", numFeatures=n) for n in buckets}
    rows = PipelineModel([tok, *tfs.values()]).transform(train.select("text", "label")).select("label", *tfs).persist()
    lr = LogisticRegression(maxIter=10)
    grid = ParamGridBuilder().addGrid(lr.featuresCol, list(tfs)).addGrid(lr.regParam, list(regs)).build()
    try:
        chosen = CrossValidator(estimator=lr, estimatorParamMaps=grid, evaluator=BinaryClassificationEvaluator(),
                                numFolds=folds, seed=seed, parallelism=parallelism).fit(rows).bestModel
    finally:
        rows.unpersist()
    return PipelineModel([tok, tfs[chosen.getFeaturesCol()], chosen])
