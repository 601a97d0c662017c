"""Where the queries are registered, and the tables they read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystat.operators.reshape import wide_table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query ``(spark, sf_dir) -> DataFrame`` and its SQL twin."""
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, label, features)``, 64 features and a label of ten states."""
    return wide_table(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four numeric columns with the return flag as a label of three states."""
    t = table(spark, sf_dir, "lineitem")
    return wide_table(t, "l_orderkey",
                      ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "l_returnflag")


def gappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings with NaN where the rule of the fixtures says so."""
    i = F.col("id")

    def gone(j):
        return (((i * 31 + j * 17) % 7 == 0) | (j == 3) | ((i % 10 == 0) & (j % 3 == 0))
                | ((j == 5) & (i % 3 != 0)) | ((j == 7) & (i % 3 == 0)))
    return embeddings(spark, sf_dir).withColumn("features", F.transform(
        "features", lambda x, j: F.when(gone(j), F.lit(float("nan"))).otherwise(x)))


# --- SQL building blocks -------------------------------------------------------

# cells of the embeddings
E = """e AS MATERIALIZED (SELECT vec_id AS id, label,
  unnest(generate_series(0, len(embedding) - 1))::INTEGER AS j,
  unnest(embedding)::DOUBLE AS v FROM embeddings)"""

# cells with the NaN rule
M = E + """, m AS MATERIALIZED (SELECT id, label, j,
  CASE WHEN (id * 31 + j * 17) % 7 = 0 OR j = 3 OR (id % 10 = 0 AND j % 3 = 0)
    OR (j = 5 AND id % 3 <> 0) OR (j = 7 AND id % 3 = 0)
  THEN 'NaN'::DOUBLE ELSE v END AS v FROM e)"""

# cells of lineitem, row numbers stand for ids
L = """lw AS MATERIALIZED (SELECT row_number() OVER () AS id, l_returnflag,
  dense_rank() OVER (ORDER BY l_returnflag) - 1 AS label,
  [l_quantity, l_extendedprice, l_discount, l_tax] AS f FROM lineitem),
e AS MATERIALIZED (SELECT id, label, unnest(generate_series(0, 3))::INTEGER AS j,
  unnest(f)::DOUBLE AS v FROM lw)"""


def bins_cte(levels: int) -> str:
    """``b(id, label, j, b)`` from ``e``: equal-frequency bins."""
    return f"""cuts AS MATERIALIZED (SELECT j, list(v ORDER BY v) AS cs FROM (
  SELECT j, v, row_number() OVER (PARTITION BY j ORDER BY v) AS rn,
    count(*) OVER (PARTITION BY j) // {levels} AS step FROM e)
  WHERE rn % step = 0 AND rn <= {levels} * step GROUP BY j),
b AS MATERIALIZED (SELECT e.id, e.label, e.j, len(list_filter(cs, lambda x: x < e.v))::INTEGER AS b
  FROM e JOIN cuts USING (j))"""


def mi_cte(name: str, source: str, keys: str = "j") -> str:
    """``name(keys, mi)`` from ``source`` giving keys, x, y."""
    return f"""{name}_c AS (SELECT {keys}, x, y, count(*)::DOUBLE AS c FROM ({source}) GROUP BY ALL),
{name}_m AS (SELECT *, sum(c) OVER (PARTITION BY {keys}, x) AS rx,
  sum(c) OVER (PARTITION BY {keys}, y) AS ry, sum(c) OVER (PARTITION BY {keys}) AS n FROM {name}_c),
{name} AS MATERIALIZED (SELECT {keys}, sum(c * log2(c * n / (rx * ry))) / max(n) AS mi
  FROM {name}_m GROUP BY {keys})"""


def cmi_cte(name: str, source: str, weighting: str = "probability") -> str:
    """``name(j, mi)``: I(x; y | z) from ``source`` giving j, x, y, z."""
    over = "n" if weighting == "probability" else "rz"
    return f"""{name}_c AS (SELECT j, x, y, z, count(*)::DOUBLE AS c FROM ({source}) GROUP BY ALL),
{name}_m AS (SELECT *, sum(c) OVER (PARTITION BY j, z) AS rz, sum(c) OVER (PARTITION BY j, z, x) AS rx,
  sum(c) OVER (PARTITION BY j, z, y) AS ry, sum(c) OVER (PARTITION BY j) AS n FROM {name}_c),
{name} AS MATERIALIZED (SELECT j, sum(c * log2(c * rz / (rx * ry)) / {over}) AS mi
  FROM {name}_m GROUP BY j)"""


def against(pick: str) -> str:
    """Source of feature pairs against the feature ``pick`` selects."""
    return (f"SELECT b.j, s.b AS x, b.b AS y FROM b JOIN b s ON s.id = b.id "
            f"AND s.j = ({pick})")


def r6(expr: str, digits: int = 6) -> str:
    return f"(round({expr}, {digits}) + 0.0)"


GRAM = E + """, g AS MATERIALIZED (SELECT a.j AS i, b.j AS j, sum(a.v * b.v) AS value
  FROM e a JOIN e b ON a.id = b.id GROUP BY ALL)"""

COV = E + """, mu AS (SELECT j, avg(v) AS mean, count(*) AS n FROM e GROUP BY j),
x AS MATERIALIZED (SELECT id, j, v - mean AS v, n FROM e JOIN mu USING (j)),
g AS MATERIALIZED (SELECT a.j AS i, b.j AS j, sum(a.v * b.v) AS css, max(a.n) AS n
  FROM x a JOIN x b ON a.id = b.id GROUP BY ALL)"""


def leading_cte(source: str, k: int, squarings: int = 18) -> str:
    """``lead(comp, j, v, lam)``: k leading eigenpairs of ``source(i, j, value)``.

    Repeated squaring of the matrix, scaled to trace 1, leaves the projector on
    the leading vector; it is then taken out of the matrix.
    """
    out, cur = [f"h0 AS MATERIALIZED (SELECT i, j, value FROM {source})"], "h0"
    for c in range(k):
        p = f"p{c}_0"
        out.append(f"{p} AS MATERIALIZED (SELECT i, j, value / (SELECT sum(value) FROM {cur} "
                   f"WHERE i = j) AS value FROM {cur})")
        for s in range(1, squarings + 1):
            q = f"p{c}_{s}"
            out.append(f"{q}r AS MATERIALIZED (SELECT a.i, b.j, sum(a.value * b.value) AS value "
                       f"FROM {p} a JOIN {p} b ON a.j = b.i GROUP BY ALL)")
            out.append(f"{q} AS MATERIALIZED (SELECT i, j, value / (SELECT sum(value) FROM {q}r "
                       f"WHERE i = j) AS value FROM {q}r)")
            p = q
        out.append(f"top{c} AS (SELECT i, value FROM {p} WHERE i = j ORDER BY round(value, 10) DESC, i LIMIT 1)")
        out.append(f"v{c} AS MATERIALIZED (SELECT {p}.i AS j, {p}.value / sqrt(top{c}.value) AS v "
                   f"FROM {p}, top{c} WHERE {p}.j = top{c}.i)")
        out.append(f"l{c} AS MATERIALIZED (SELECT sum({cur}.value * {p}.value) AS lam "
                   f"FROM {cur} JOIN {p} USING (i, j))")
        nxt = f"h{c + 1}"
        out.append(f"{nxt} AS MATERIALIZED (SELECT {cur}.i, {cur}.j, {cur}.value - lam * a.v * b.v AS value "
                   f"FROM {cur} JOIN v{c} a ON a.j = {cur}.i JOIN v{c} b ON b.j = {cur}.j, l{c})")
        cur = nxt
    out.append("lead AS (" + " UNION ALL ".join(
        f"SELECT {c}::INTEGER AS comp, j, v, lam FROM v{c}, l{c}" for c in range(k)) + ")")
    return ",\n".join(out)
