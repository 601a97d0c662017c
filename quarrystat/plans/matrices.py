"""Gram, covariance, similarity, products and row pairs."""

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from quarrystat.functions import arrays as A
from quarrystat.functions.draws import WORD, draw_sql, row_sql
from quarrystat.operators import blocks, gram, reshape
from quarrystat.plans.registry import COV, E, GRAM, L, embeddings, lineitem, query, r6

def _value():
    return A.neat(F.col("value")).alias("value")


def _entries(df):
    return df.select("i", "j", _value())


@query("gram", f"WITH {GRAM} SELECT i, j, {r6('value')} AS value FROM g WHERE i <= j")
def gram_upper(spark, sf):
    return _entries(gram.gramian(embeddings(spark, sf)))


@query("gram_full", f"WITH {GRAM} SELECT i, j, {r6('value')} AS value FROM g")
def gram_full(spark, sf):
    return _entries(gram.gramian(embeddings(spark, sf), full=True))


@query("gram_times_vector", f"""WITH {E}, a AS (SELECT id, sum(v * (j + 1)) AS a FROM e GROUP BY id)
SELECT j, {r6('sum(a * v)')} AS value FROM e JOIN a USING (id) GROUP BY j""")
def gram_times_vector(spark, sf):
    return gram.gram_times(embeddings(spark, sf), range(1, 65)).select("j", _value())


@query("second_moment", f"""WITH {GRAM} SELECT i, j,
  {r6('value / ((SELECT count(*) FROM embeddings) - 1)')} AS value FROM g""")
def second_moment(spark, sf):
    return _entries(gram.second_moment(embeddings(spark, sf)))


@query("cov_sample", f"WITH {COV} SELECT i, j, {r6('css / (n - 1)')} AS value FROM g")
def cov_sample(spark, sf):
    return _entries(gram.covariance(embeddings(spark, sf)))


@query("cov_population_upper", f"WITH {COV} SELECT i, j, {r6('css / n')} AS value FROM g WHERE i <= j")
def cov_population_upper(spark, sf):
    return _entries(gram.covariance(embeddings(spark, sf), ddof=0, triangle="upper"))


@query("cov_sample_lineitem", f"""WITH {L}, c AS (SELECT a.j AS i, b.j AS j, covar_samp(a.v, b.v) AS c
  FROM e a JOIN e b ON a.id = b.id GROUP BY ALL)
SELECT c.i, c.j, {r6('c.c / sqrt(p.c * q.c)')} AS value FROM c
  JOIN c p ON p.i = c.i AND p.j = c.i JOIN c q ON q.i = c.j AND q.j = c.j""")
def cov_sample_lineitem(spark, sf):
    """Covariances over the product of standard deviations, so that they compare."""
    c = gram.covariance(lineitem(spark, sf))
    own = F.when(F.col("i") == F.col("j"), F.sqrt("value"))
    sd = [F.max(own).over(Window.partitionBy(k)) for k in ("i", "j")]
    return _entries(c.select("i", "j", (F.col("value") / (sd[0] * sd[1])).alias("value")))


@query("cov_sampled", f"WITH {COV} SELECT i, j, {r6('css / n')} AS value FROM g WHERE i <= j")
def cov_sampled(spark, sf):
    """Without gamma every cell is kept, so this is exact."""
    return _entries(gram.covariance_sampled(embeddings(spark, sf), seed=7))


# u: the draw of a cell, from the md5 of its row's id and the number of its column
_DRAWN = f"""{E}, r AS (SELECT vec_id AS id, {row_sql('vec_id', 7)} AS r FROM embeddings),
u AS (SELECT id, j, v, {draw_sql('r', 'j')} / {WORD}.0::DOUBLE AS u FROM e JOIN r USING (id)),
c AS (SELECT j, avg(v) AS mean, sqrt(sum(v * v)) AS norm, count(*) AS n FROM e GROUP BY j)"""


@query("cov_sampled_thin", f"""WITH {_DRAWN}, p AS (SELECT *, least(1, 2 / norm) AS p FROM c),
k AS MATERIALIZED (SELECT id, j, n, p, (v - mean) / p AS v FROM u JOIN p USING (j) WHERE u < p)
SELECT a.j AS i, b.j AS j, {r6('sum(a.v * b.v) * max(CASE WHEN a.j = b.j THEN a.p ELSE 1 END) / max(a.n)')} AS value
  FROM k a JOIN k b ON a.id = b.id AND a.j <= b.j GROUP BY ALL""")
def cov_sampled_thin(spark, sf):
    return _entries(gram.covariance_sampled(embeddings(spark, sf), seed=7, gamma=4.0))


_COSINE = f"""WITH {GRAM}, d AS (SELECT i, sqrt(value) AS s FROM g WHERE i = j)
SELECT g.i, g.j, {r6('value / (a.s * b.s)')} AS value FROM g JOIN d a ON a.i = g.i
  JOIN d b ON b.i = g.j WHERE g.i < g.j"""


@query("cosine_cols", _COSINE)
def cosine_cols(spark, sf):
    return _entries(gram.cosine(embeddings(spark, sf)))


@query("cosine_dimsum_exact", _COSINE)
def cosine_dimsum_exact(spark, sf):
    """gamma above every squared norm: nothing is sampled away."""
    return _entries(gram.cosine_sampled(embeddings(spark, sf), gamma=1e6))


def _dimsum_sql(gamma: str) -> str:
    return f"""WITH {_DRAWN}, p AS (SELECT *, sqrt({gamma}) AS root FROM c),
k AS MATERIALIZED (SELECT id, j, v / least(root, norm) AS v FROM u JOIN p USING (j) WHERE u < root / norm)
SELECT a.j AS i, b.j AS j, {r6('sum(a.v * b.v)')} AS value FROM k a JOIN k b ON a.id = b.id AND a.j < b.j GROUP BY ALL"""


@query("cosine_dimsum", _dimsum_sql("10 * ln(64) / 0.5"))
def cosine_dimsum(spark, sf):
    return _entries(gram.cosine(embeddings(spark, sf), threshold=0.5, seed=7))


@query("cosine_dimsum_thin", _dimsum_sql("4"))
def cosine_dimsum_thin(spark, sf):
    """gamma small enough to sample columns of these norms."""
    return _entries(gram.cosine_sampled(embeddings(spark, sf), gamma=4.0, seed=7))


_W = np.array([[((j + 1) * (c + 2)) % 5 - 2.0 for c in range(3)] for j in range(64)])
_PRODUCT = f"""WITH {E}, w AS (SELECT j, c, ((j + 1) * (c + 2)) % 5 - 2.0 AS w
  FROM generate_series(0, 63) t(j), generate_series(0, 2) u(c))
SELECT id AS i, c::INTEGER AS j, {r6('sum(v * w)')} AS value FROM e JOIN w USING (j) GROUP BY ALL"""


@query("mat_mul", _PRODUCT)
def mat_mul(spark, sf):
    out = gram.multiply_local(embeddings(spark, sf), _W)
    return _entries(gram.as_entries(out))


@query("mat_mul_entries", _PRODUCT)
def mat_mul_entries(spark, sf):
    right = gram.entry_table(spark, _W)
    return _entries(gram.multiply_entries(gram.as_entries(embeddings(spark, sf)), right))


@query("mat_mul_entries_salted", _PRODUCT)
def mat_mul_entries_salted(spark, sf):
    right = gram.entry_table(spark, _W)
    return _entries(gram.multiply_entries(gram.as_entries(embeddings(spark, sf)), right,
                                          salt=4, broadcast_limit=0))


def _rows_sql(expr, source="e", cond="a.id >= b.id", names=("r", "s")):
    return f"""SELECT a.id AS {names[0]}, b.id AS {names[1]}, {r6(expr)} AS value
FROM {source} a JOIN {source} b ON a.j = b.j AND {cond} GROUP BY ALL"""


_CENTRED = E + ", mu AS (SELECT j, avg(v) AS m FROM e GROUP BY j), x AS (SELECT id, j, v - m AS v FROM e JOIN mu USING (j))"


def _pairs(df):
    return df.select("r", "s", _value())


@query("row_gram", f"WITH {E} {_rows_sql('sum(a.v * b.v)')}")
def row_gram(spark, sf):
    return _pairs(blocks.row_gram(embeddings(spark, sf), rows_per_block=256))


@query("row_gram_centred_upper", f"WITH {_CENTRED} {_rows_sql('sum(a.v * b.v)', 'x', 'a.id <= b.id')}")
def row_gram_centred_upper(spark, sf):
    return _pairs(blocks.row_gram(embeddings(spark, sf), center=True, triangle="upper",
                                  rows_per_block=256))


@query("sq_distance", f"WITH {E} {_rows_sql('sum((a.v - b.v) ** 2)')}")
def sq_distance(spark, sf):
    return _pairs(blocks.squared_distances(embeddings(spark, sf), rows_per_block=256))


@query("block_partition", """SELECT (o // 128)::BIGINT AS blk, count(*) AS n, min(vec_id) AS first_id,
  max(vec_id) AS last_id FROM (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS o FROM embeddings)
  GROUP BY 1""")
def block_partition(spark, sf):
    b = reshape.block_partition(embeddings(spark, sf), 128)
    return b.groupBy("blk").agg(F.count("*").alias("n"), F.min("id").alias("first_id"),
                                F.max("id").alias("last_id"))


@query("entries_to_dense", f"WITH {GRAM} SELECT i, j, {r6('value')} AS value FROM g")
def entries_to_dense(spark, sf):
    """A small entry table as one matrix on the driver, mirrored there."""
    m = gram.local_matrix(gram.gramian(embeddings(spark, sf)), 64)
    return _entries(gram.entry_table(spark, m))
