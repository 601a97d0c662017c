"""Missing values."""

from pyspark.sql import functions as F

from quarrystat.functions import arrays as A
from quarrystat.operators import missing as X
from quarrystat.operators import stats
from quarrystat.operators.reshape import to_long
from quarrystat.plans.registry import M, gappy, query, r6

_CELL = f"{r6('v')} AS v"
_N = "(SELECT count(*) FROM embeddings)"


def _cells(df):
    return to_long(df).select("id", "j", A.neat(F.col("v")).alias("v"))


@query("nan_counts", f"WITH {M} SELECT j, count(*) FILTER (isnan(v)) AS nans, count(*) AS n FROM m GROUP BY j")
def nan_counts(spark, sf):
    return X.nan_counts(gappy(spark, sf))


@query("nan_row_counts", f"WITH {M} SELECT id, (count(*) FILTER (isnan(v)))::INTEGER AS nans FROM m GROUP BY id")
def nan_row_counts(spark, sf):
    return X.nan_row_counts(gappy(spark, sf))


def _drop_cols_sql(op):
    return f"""WITH {M}, c AS (SELECT j, count(*) FILTER (isnan(v)) AS k FROM m GROUP BY j),
t AS (SELECT max(k) FILTER (j NOT IN (3, 5)) AS t FROM c),
kept AS (SELECT j, (row_number() OVER (ORDER BY j) - 1)::INTEGER AS nj FROM c, t WHERE k {op} t)
SELECT nj AS j, count(*) FILTER (isnan(v)) AS nans, {r6('avg(v) FILTER (NOT isnan(v))')} AS mean
FROM m JOIN kept USING (j) GROUP BY nj"""


def _drop_cols(spark, sf, inclusive):
    df = gappy(spark, sf)
    limit = X.nan_counts(df).filter("j not in (3, 5)").agg(F.max("nans")).first()[0]
    out, _ = X.drop_columns(df, limit, inclusive)
    return stats._per_feature(out, F.sum(F.isnan("v").cast("bigint")).alias("nans"),
                              A.neat(stats.mean_ignoring_nan(F.col("v"))).alias("mean"))


@query("drop_cols", _drop_cols_sql("<="))
def drop_cols(spark, sf):
    return _drop_cols(spark, sf, True)


@query("drop_cols_strict", _drop_cols_sql("<"))
def drop_cols_strict(spark, sf):
    return _drop_cols(spark, sf, False)


_ROW_NAN = f"WITH {M}, c AS (SELECT id, count(*) FILTER (isnan(v)) AS k FROM m GROUP BY id)"


@query("drop_rows", f"{_ROW_NAN} SELECT id, j, {_CELL} FROM m WHERE id IN (SELECT id FROM c WHERE k <= 16)")
def drop_rows(spark, sf):
    return _cells(X.drop_rows(gappy(spark, sf), 16)[0])


@query("drop_rows_strict", f"{_ROW_NAN} SELECT id FROM c WHERE k < 12")
def drop_rows_strict(spark, sf):
    return X.drop_rows(gappy(spark, sf), 12, inclusive=False)[0].select("id")


@query("dropped_rows", f"{_ROW_NAN} SELECT id FROM c WHERE k > 16")
def dropped_rows(spark, sf):
    return X.drop_rows(gappy(spark, sf), 16)[1]


@query("mean_ignoring_nan", f"""WITH {M} SELECT j,
  coalesce({r6('avg(v) FILTER (NOT isnan(v))')}, 'NaN'::DOUBLE) AS mean FROM m GROUP BY j""")
def mean_ignoring_nan(spark, sf):
    return (stats.col_means_ignoring_nan(gappy(spark, sf))
            .select("j", A.neat(F.col("mean")).alias("mean")))


@query("impute_mean", f"""WITH {M}, mu AS (SELECT j, coalesce(avg(v) FILTER (NOT isnan(v)), 'NaN'::DOUBLE) AS mean
  FROM m GROUP BY j)
SELECT id, j, {r6('CASE WHEN isnan(v) THEN mean ELSE v END')} AS v FROM m JOIN mu USING (j)""")
def impute_mean(spark, sf):
    return _cells(X.impute_mean(gappy(spark, sf)))


_HALF = f"""WITH {M}, c AS (SELECT j, count(*) FILTER (NOT isnan(v)) AS good,
  avg(v) FILTER (NOT isnan(v)) AS mean FROM m GROUP BY j),
kept AS (SELECT j, mean, (row_number() OVER (ORDER BY j) - 1)::INTEGER AS nj FROM c
  WHERE good > {_N} / 2.0),
f AS (SELECT id, nj AS j, v, mean, count(*) FILTER (isnan(v)) OVER (PARTITION BY id) AS k
  FROM m JOIN kept USING (j))"""


@query("column_check", f"{_HALF} SELECT id, j, {r6('CASE WHEN isnan(v) THEN mean ELSE v END')} AS v FROM f")
def column_check(spark, sf):
    return _cells(X.column_check(gappy(spark, sf)))


@query("column_row_check", f"""{_HALF} SELECT id, j, {r6('CASE WHEN isnan(v) THEN mean ELSE v END')} AS v
  FROM f WHERE k < (SELECT count(*) FROM kept) // 4""")
def column_row_check(spark, sf):
    return _cells(X.column_row_check(gappy(spark, sf)))


@query("filter_long", f"""WITH {M}, c AS (SELECT j, count(*) FILTER (isnan(v)) AS k,
  avg(v) FILTER (NOT isnan(v)) AS mean FROM m GROUP BY j),
kept AS (SELECT j, mean, (row_number() OVER (ORDER BY j) - 1)::INTEGER AS nj FROM c
  WHERE k <= {_N} // 2),
f AS (SELECT id, label, m.j, v, mean, count(*) FILTER (isnan(v)) OVER (PARTITION BY id) AS rk
  FROM m JOIN kept USING (j))
SELECT id, CASE WHEN label <= 2 THEN 1 WHEN label <= 5 THEN 2 ELSE -1 END AS label, j,
  {r6('CASE WHEN isnan(v) THEN mean ELSE v END')} AS v
FROM f WHERE rk <= (SELECT count(*) FROM kept) // 4""")
def filter_long(spark, sf):
    df = gappy(spark, sf)
    out = X.filter_long(df.drop("label"), df.filter("label <= 2"), df.filter("label between 3 and 5"))
    return out.select("id", "label", "j", A.neat(F.col("v")).alias("v"))


@query("clean_table", f"""WITH {M}, c1 AS (SELECT j, count(*) FILTER (isnan(v)) AS k FROM m GROUP BY j),
k1 AS (SELECT j FROM c1 WHERE k <= {_N} // 2),
r1 AS (SELECT id FROM m WHERE j IN (SELECT j FROM k1) GROUP BY id HAVING count(*) FILTER (isnan(v)) <= 16),
m2 AS (SELECT * FROM m WHERE id IN (SELECT id FROM r1) AND j IN (SELECT j FROM k1)),
k2 AS (SELECT j, avg(v) FILTER (NOT isnan(v)) AS mean,
  (row_number() OVER (ORDER BY j) - 1)::INTEGER AS nj FROM m2 GROUP BY j
  HAVING count(*) FILTER (isnan(v)) <= {_N} // 4)
SELECT id, nj AS j, {r6('CASE WHEN isnan(v) THEN mean ELSE v END')} AS v FROM m2 JOIN k2 USING (j)""")
def clean_table(spark, sf):
    return _cells(X.clean_table(gappy(spark, sf))[0])
