"""Greedy feature selection, three or four steps on the embeddings."""

from pyspark.sql import functions as F

from quarrystat.functions import arrays as A
from quarrystat.operators import mutual_info as I
from quarrystat.operators import selection as S
from quarrystat.operators import supervised
from quarrystat.plans.information import LEVELS, _B, _LB, binned, binned_lineitem
from quarrystat.plans.registry import (against, cmi_cte, embeddings, mi_cte, query, r6)

K = 4


def _pick(name, source, score, order="DESC", taken=()):
    cond = " AND ".join(f"j <> (SELECT j FROM {t})" for t in taken) or "true"
    return (f"{name} AS MATERIALIZED (SELECT j, {score} AS score FROM {source} WHERE {cond} "
            f"ORDER BY round({score}, 10) {order}, j LIMIT 1)")


def _triple(pick, reverse):
    t = (f"SELECT b.j, b.b, s.b AS s, b.label AS y FROM b JOIN b s ON s.id = b.id "
         f"AND s.j = (SELECT j FROM {pick})")
    return (f"SELECT j, s AS x, y, b AS z FROM ({t})" if reverse
            else f"SELECT j, b AS x, y, s AS z FROM ({t})")


def greedy_sql(criterion: str, head: str = _B, k: int = K) -> str:
    """The k steps of :func:`selection.greedy` written out."""
    if criterion == "entropy_over_mi":
        rel = ("rel AS MATERIALIZED (SELECT j, -sum(c / n * log2(c / n)) AS mi FROM (SELECT j, c, "
               "sum(c) OVER (PARTITION BY j) AS n FROM (SELECT j, b, count(*)::DOUBLE AS c "
               "FROM b GROUP BY j, b)) GROUP BY j)")
    else:
        rel = mi_cte("rel", "SELECT j, label AS x, b AS y FROM b")
    parts = [rel, _pick("s0", "rel", "mi")]
    for t in range(1, k):
        last = f"s{t - 1}"
        if criterion in ("max_total_relevance", "cmim"):
            parts.append(cmi_cte(f"q{t}", _triple(last, criterion == "cmim")))
            gain = f" + (SELECT mi FROM rel WHERE j = (SELECT j FROM {last}))"
        else:
            parts.append(mi_cte(f"q{t}", against(f"SELECT j FROM {last}")))
            gain = ""
        steps = " UNION ALL ".join(
            f"SELECT {u} AS t, j, mi{_gain(criterion, u)} AS mi FROM q{u}" for u in range(1, t + 1))
        agg = {"chain": f"max(mi) FILTER (t = {t})", "cmim": "min(mi)"}.get(criterion, "avg(mi)")
        parts.append(f"a{t} AS MATERIALIZED (SELECT j, red, rel.mi AS rel FROM (SELECT j, {agg} AS red "
                     f"FROM ({steps}) GROUP BY j) JOIN rel USING (j))")
        score = {"mid": "rel - red", "miq": "rel / red", "entropy_over_mi": "rel / red",
                 "min_redundancy": "-red"}.get(criterion, "red")
        parts.append(_pick(f"s{t}", f"a{t}", f"({score})", taken=[f"s{u}" for u in range(t)]))
    out = " UNION ALL ".join(f"SELECT {t}::INTEGER AS step, j, {r6('score')} AS score FROM s{t}"
                             for t in range(k))
    return f"{head}, " + ",\n".join(parts) + f"\n{out}"


def _gain(criterion, u):
    if criterion in ("max_total_relevance", "cmim"):
        return f" + (SELECT mi FROM rel WHERE j = (SELECT j FROM s{u - 1}))"
    return ""


def _neat(df):
    return df.select("step", "j", A.neat(F.col("score")).alias("score"))


def _register(name, criterion):
    @query(name, greedy_sql(criterion))
    def run(spark, sf):
        return _neat(S.greedy(binned(spark, sf), K, criterion))
    return run


for _name, _criterion in (("mrmr_mid", "mid"), ("mrmr_miq", "miq"),
                          ("min_redundancy", "min_redundancy"), ("mi_chain", "chain"),
                          ("max_total_relevance", "max_total_relevance"), ("cmim", "cmim"),
                          ("entropy_over_mi", "entropy_over_mi")):
    _register(_name, _criterion)


@query("mrmr_mid_lineitem", greedy_sql("mid", _LB, 3))
def mrmr_mid_lineitem(spark, sf):
    return _neat(S.greedy(binned_lineitem(spark, sf), 3, "mid"))


@query("mrmr_label_in_matrix", greedy_sql("mid", _B, 3))
def mrmr_label_in_matrix(spark, sf):
    """The label sits in front of the features as one more binned column."""
    df = binned(spark, sf).withColumn("bins", F.concat(
        F.array(F.col("label").cast("smallint")), "bins"))
    split = df.select(F.get("bins", F.lit(0)).alias("label"),
                      F.slice("bins", F.lit(2), F.size("bins") - 1).alias("bins"))
    return _neat(S.greedy(split, 3, "mid"))


def _matrix_sql(form):
    h = mi_cte("h", "SELECT a.j AS i, b.j AS j, a.b AS x, b.b AS y FROM b a JOIN b ON a.id = b.id", "i, j")
    parts = [h, mi_cte("rel", "SELECT j, label AS x, b AS y FROM b"), _pick("s0", "rel", "mi")]
    for t in range(1, K):
        taken = " UNION ALL ".join(f"SELECT j FROM s{u}" for u in range(t))
        parts.append(f"a{t} AS MATERIALIZED (SELECT h.i AS j, avg(h.mi) AS red, max(rel.mi) AS rel FROM h "
                     f"JOIN rel ON rel.j = h.i WHERE h.j IN ({taken}) GROUP BY h.i)")
        score = "(rel - red)" if form == "difference" else "(rel / red)"
        parts.append(_pick(f"s{t}", f"a{t}", score, taken=[f"s{u}" for u in range(t)]))
    out = " UNION ALL ".join(f"SELECT {t}::INTEGER AS step, j, {r6('score')} AS score FROM s{t}"
                             for t in range(K))
    return f"{_B}, " + ",\n".join(parts) + f"\n{out}"


def _from_matrix(spark, sf, form):
    df = binned(spark, sf).select("label", "bins").persist()
    try:
        return _neat(S.from_matrix(I.mi_matrix(df, LEVELS + 1), I.mi_vector(df, "label"), K, form))
    finally:
        df.unpersist()


@query("mrmr_from_matrix", _matrix_sql("difference"))
def mrmr_from_matrix(spark, sf):
    return _from_matrix(spark, sf, "difference")


@query("miq_from_matrix", _matrix_sql("quotient"))
def miq_from_matrix(spark, sf):
    return _from_matrix(spark, sf, "quotient")


def _total_scores_sql():
    # scores of the first three picks; held vectors follow the chosen features
    head = greedy_sql("max_total_relevance", k=3).rsplit("\nSELECT 0::INTEGER", 1)[0]
    return head + f""",
z0 AS (SELECT (SELECT score FROM s0) / ((SELECT sum(mi) FROM rel) * (SELECT max(mi) FROM rel)) AS s),
z1 AS (SELECT (SELECT mi FROM rel WHERE j = (SELECT j FROM s1))
  / ((SELECT sum(mi) FROM rel) * (SELECT max(mi) FROM rel)) AS s),
t1 AS (SELECT j, CASE WHEN j IN (SELECT j FROM s0 UNION ALL SELECT j FROM s1) THEN 0 ELSE red END AS t FROM a1),
z2 AS (SELECT (SELECT t FROM t1 WHERE j = (SELECT j FROM s2)) / (SELECT max(t) FROM t1)
  * (SELECT s FROM z1) ** 2 / (SELECT s FROM z0) AS s),
o AS (SELECT 0::INTEGER AS step, j, s FROM s0, z0 UNION ALL SELECT 1, j, s FROM s1, z1
  UNION ALL SELECT 2, j, s FROM s2, z2)
SELECT step, j, {r6('s')} AS score, {r6('-1 / ln(s)')} AS shown FROM o"""


@query("total_relevance_scores", _total_scores_sql())
def total_relevance_scores(spark, sf):
    out = S.total_relevance_scores(binned(spark, sf), 3)
    return out.select("step", "j", *[A.neat(F.col(c)).alias(c) for c in ("score", "shown")])


@query("forest_importance")
def forest_importance(spark, sf):
    return supervised.forest_importance(embeddings(spark, sf))
