"""Mutual information."""

from pyspark.sql import functions as F

from quarrystat.functions import arrays as A
from quarrystat.operators import binning
from quarrystat.operators import mutual_info as I
from quarrystat.operators.gram import entry_table
from quarrystat.operators.stats import index_labels, mean_shift, unit_norm
from quarrystat.plans.registry import (E, L, against, bins_cte, cmi_cte, embeddings, lineitem,
                                       mi_cte, query, r6, table)

LEVELS = 5
_B = f"WITH {E}, {bins_cte(LEVELS)}"
_LB = f"WITH {L}, {bins_cte(LEVELS)}"


def binned(spark, sf):
    return binning.equal_frequency_bins(embeddings(spark, sf), LEVELS)


def binned_lineitem(spark, sf):
    t = index_labels(lineitem(spark, sf), "label").select("label", "features")
    return binning.equal_frequency_bins(t, LEVELS)


def _neat(df, *keys, value="mi"):
    return df.select(*keys, A.neat(F.col(value)).alias(value))


@query("mi_pair", f"""WITH {mi_cte('r', 'SELECT 0 AS k, l_returnflag AS x, l_linestatus AS y FROM lineitem', 'k')}
SELECT {r6('mi', 9)} AS mi FROM r""")
def mi_pair(spark, sf):
    m = I.mi_pair(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus")
    return m.select(A.neat(F.col("mi"), 9).alias("mi"))


@query("mi_vector", f"{_B}, {mi_cte('r', 'SELECT j, label AS x, b AS y FROM b')} SELECT j, {r6('mi')} AS mi FROM r")
def mi_vector(spark, sf):
    return _neat(I.mi_vector(binned(spark, sf), "label"), "j")


@query("mi_vector_lineitem", f"{_LB}, {mi_cte('r', 'SELECT j, label AS x, b AS y FROM b')} SELECT j, {r6('mi')} AS mi FROM r")
def mi_vector_lineitem(spark, sf):
    return _neat(I.mi_vector(binned_lineitem(spark, sf), "label"), "j")


@query("mi_vector_feature", f"{_B}, {mi_cte('r', against('24'))} SELECT j, {r6('mi')} AS mi FROM r")
def mi_vector_feature(spark, sf):
    return _neat(I.mi_vector(binned(spark, sf), 24), "j")


_PAIRS = mi_cte("r", "SELECT a.j AS i, b.j AS j, a.b AS x, b.b AS y FROM b a JOIN b ON a.id = b.id AND a.j >= b.j", "i, j")


@query("mi_matrix", f"""{_B}, {_PAIRS} SELECT i, j, {r6('mi')} AS mi FROM r
  UNION ALL SELECT j, i, {r6('mi')} FROM r WHERE i > j""")
def mi_matrix(spark, sf):
    return _neat(I.mi_matrix(binned(spark, sf), LEVELS + 1), "i", "j")


@query("mi_matrix_lower", f"{_B}, {_PAIRS} SELECT i, j, {r6('mi')} AS mi FROM r")
def mi_matrix_lower(spark, sf):
    return _neat(I.mi_matrix(binned(spark, sf), LEVELS + 1, "lower"), "i", "j")


@query("mi_matrix_strict_lower", f"{_LB}, {_PAIRS} SELECT i, j, {r6('mi')} AS mi FROM r WHERE i > j")
def mi_matrix_strict_lower(spark, sf):
    return _neat(I.mi_matrix(binned_lineitem(spark, sf), LEVELS + 1, "strict_lower"), "i", "j")


@query("mi_matrix_local", f"""{_B}, {_PAIRS} SELECT i, j, {r6('mi')} AS mi FROM r
  UNION ALL SELECT j, i, {r6('mi')} FROM r WHERE i > j""")
def mi_matrix_local(spark, sf):
    """The matrix on the driver, made a table again."""
    m = I.mi_matrix_local(binned(spark, sf), LEVELS + 1)
    return _neat(entry_table(spark, m).withColumnRenamed("value", "mi"), "i", "j")


@query("transform_chain", f"""WITH {E}, mu AS (SELECT j, avg(v) AS m FROM e GROUP BY j),
c AS (SELECT id, label, j, v - m AS v FROM e JOIN mu USING (j)), t AS (SELECT j, max(abs(v)) AS top FROM c GROUP BY j),
{bins_cte(LEVELS).replace("FROM e)", "FROM s)").replace("FROM e JOIN", "FROM s e JOIN").replace("cuts AS", "s AS MATERIALIZED (SELECT id, label, j, v / top AS v FROM c JOIN t USING (j)), cuts AS", 1)}
SELECT j, b, count(*) AS n FROM b GROUP BY j, b""")
def transform_chain(spark, sf):
    """Operators as steps of ``df.transform``: centred, normalised, binned, counted."""
    return (embeddings(spark, sf).transform(mean_shift).transform(unit_norm)
            .transform(binning.equal_frequency_bins, LEVELS).transform(binning.bins_long, "id")
            .groupBy("j", F.col("b").cast("int").alias("b")).agg(F.count("*").alias("n")))


# candidate b, selected s, label y
_TRIPLE = "SELECT b.j, b.b, s.b AS s, b.label AS y FROM b JOIN b s ON s.id = b.id AND s.j = 24"
_FORWARD = f"SELECT j, b AS x, y, s AS z FROM ({_TRIPLE})"
_REVERSE = f"SELECT j, s AS x, y, b AS z FROM ({_TRIPLE})"


@query("cmi_vector", f"{_B}, {cmi_cte('r', _FORWARD)} SELECT j, {r6('mi')} AS cmi FROM r")
def cmi_vector(spark, sf):
    return _neat(I.cmi_vector(binned(spark, sf), 24), "j", value="cmi")


@query("cmi_vector_uniform", f"{_B}, {cmi_cte('r', _FORWARD, 'uniform')} SELECT j, {r6('mi')} AS cmi FROM r")
def cmi_vector_uniform(spark, sf):
    return _neat(I.cmi_vector(binned(spark, sf), 24, weighting="uniform"), "j", value="cmi")


@query("cmi_reverse", f"{_B}, {cmi_cte('r', _REVERSE)} SELECT j, {r6('mi')} AS cmi FROM r")
def cmi_reverse(spark, sf):
    return _neat(I.cmi_reverse(binned(spark, sf), 24), "j", value="cmi")


_JOINT = mi_cte("r", f"SELECT j, (s * 100 + b) AS x, y FROM ({_TRIPLE})")


@query("joint_mi", f"{_B}, {_JOINT} SELECT j, {r6('mi')} AS jmi FROM r")
def joint_mi(spark, sf):
    """I(selected, candidate; label): the chain rule gives the twin."""
    return _neat(I.joint_mi(binned(spark, sf), 24), "j", value="jmi")


@query("joint_mi_reverse", f"""{_B}, {cmi_cte('r', _REVERSE)},
{mi_cte('q', 'SELECT j, label AS x, b AS y FROM b')}
SELECT j, {r6('mi + (SELECT mi FROM q WHERE j = 24)')} AS jmi FROM r""")
def joint_mi_reverse(spark, sf):
    return _neat(I.joint_mi(binned(spark, sf), 24, reverse=True), "j", value="jmi")
