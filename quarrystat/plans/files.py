"""Sources and sinks, written to and read back from the shared folder."""

from pyspark.sql import functions as F

from quarrystat.functions import arrays as A
from quarrystat.functions.draws import WORD, draw_sql, row_sql
from quarrystat.operators import gram
from quarrystat.operators.reshape import to_long
from quarrystat.plans.registry import E, GRAM, embeddings, query, r6, table
from quarrystat.session import scratch_path
from quarrystat.sources import metadata, sparse, synthetic, text

_LINES = f"""WITH {E}, o AS (SELECT vec_id AS id, row_number() OVER (ORDER BY vec_id) - 1 AS o FROM embeddings)"""


@query("csv_pair", f"{_LINES} SELECT o AS id, label::DOUBLE AS label, j, v FROM e JOIN o USING (id)")
def csv_pair(spark, sf):
    base = scratch_path(spark, "csv-pair")
    df = embeddings(spark, sf)
    text.write_matrix(df, f"{base}/features")
    text.write_labels(df.withColumn("label", F.col("label").cast("double")), f"{base}/labels")
    return to_long(text.read_pair(spark, f"{base}/features", f"{base}/labels"), "id", "label")


@query("csv_matrix", f"{_LINES} SELECT o AS id, j, v FROM e JOIN o USING (id)")
def csv_matrix(spark, sf):
    path = scratch_path(spark, "csv-matrix")
    text.write_matrix(embeddings(spark, sf), path)
    return to_long(text.read_matrix(spark, path))


@query("libsvm_table", f"""WITH {E} SELECT label::DOUBLE AS label, j, count(*) AS n, {r6('avg(v)')} AS mean
FROM e GROUP BY ALL""")
def libsvm_table(spark, sf):
    path = scratch_path(spark, "libsvm")
    text.write_libsvm(embeddings(spark, sf), path)
    cells = sparse.to_entries(text.read_libsvm(spark, path, 64), "label")
    return cells.groupBy("label", "j").agg(F.count("*").alias("n"), A.neat(F.avg("v")).alias("mean"))


@query("entry_sink", f"WITH {GRAM} SELECT i, j, {r6('value')} AS value FROM g WHERE i <= j")
def entry_sink(spark, sf):
    path = scratch_path(spark, "entries")
    text.write_entries(gram.gramian(embeddings(spark, sf)), path)
    return spark.read.parquet(path).select("i", "j", A.neat(F.col("value")).alias("value"))


@query("stringify_entries", """SELECT l_linenumber::VARCHAR AS "line", l_returnflag AS flag, count(*)::VARCHAR AS n,
  coalesce(NULLIF(l_linestatus, 'F'), 'null') AS status FROM lineitem GROUP BY ALL""")
def stringify_entries(spark, sf):
    t = table(spark, sf, "lineitem").select(
        F.col("l_linenumber").alias("`line`"), F.col("l_returnflag").alias("flag"),
        F.when(F.col("l_linestatus") != "F", F.col("l_linestatus")).alias("status"))
    counts = t.groupBy(*[F.col("```line```"), "flag", "status"]).agg(F.count("*").alias("n"))
    return text.stringify(counts)


@query("ml_metadata", """SELECT label, count(*) AS n, 2 AS nominal, 62 AS numeric, 10 AS classes FROM embeddings GROUP BY label""")
def ml_metadata(spark, sf):
    df = metadata.set_metadata(embeddings(spark, sf), {0: 3, 5: 4}, 10, 64)
    attrs = df.schema["features"].metadata["ml_attr"]["attrs"]
    classes = df.schema["label"].metadata["ml_attr"]["vals"]
    return df.groupBy("label").agg(F.count("*").alias("n")).select(
        "label", "n", F.lit(len(attrs["nominal"])).alias("nominal"),
        F.lit(len(attrs["numeric"])).alias("numeric"), F.lit(len(classes)).alias("classes"))


@query("linear_labels", f"""WITH {E} SELECT id, {r6('sum(v * ((j * 3) % 7 - 3)) + 0.25')} AS label FROM e GROUP BY id""")
def linear_labels(spark, sf):
    w = [(j * 3) % 7 - 3 for j in range(64)]
    return synthetic.linear_labels(embeddings(spark, sf), w, intercept=0.25).select(
        "id", A.neat(F.col("label")).alias("label"))


def _streams(seed):
    """SQL of a row's numbers in the streams of a seed."""
    return ", ".join(f"{row_sql('id', seed * 8 + k)} AS r{k}" for k in range(6))


def _gauss_sql(a, b, j):
    u, v = (f"(({draw_sql(r, j)}) + 0.5) / {WORD}.0::DOUBLE" for r in (a, b))
    return f"sqrt(-2 * ln({u})) * cos(2 * pi() * {v})"


@query("inject_nan", f"""WITH {E}, r AS (SELECT id, {_streams(5)} FROM (SELECT vec_id AS id FROM embeddings))
SELECT id, j, CASE WHEN j IN (3, 9) OR {draw_sql('r5', 'j')} / {WORD}.0::DOUBLE < 0.2 THEN 1 ELSE 0 END AS gap
FROM e JOIN r USING (id)""")
def inject_nan(spark, sf):
    df = synthetic.inject_nan(embeddings(spark, sf), 0.2, always=[3, 9], seed=5)
    return to_long(df).select("id", "j", F.isnan("v").cast("int").alias("gap"))


@query("gaussian_rows", f"""WITH r AS (SELECT id, {_streams(3)} FROM (SELECT vec_id AS id FROM embeddings)),
c AS (SELECT *, unnest([0, 1, 2, 3]) AS j FROM r)
SELECT id, j, {r6(f"CASE WHEN j IN (0, 2) THEN {_gauss_sql('r0', 'r1', 'j')} ELSE 100 * {draw_sql('r2', 'j')} / {WORD}.0::DOUBLE END")} AS v FROM c""")
def gaussian_rows(spark, sf):
    """Generated features for the ids of a table, two of four columns in the support."""
    ids = embeddings(spark, sf).select("id")
    return to_long(synthetic.gaussian_features(ids, 4, seed=3, support=[0, 2])).select("id", "j", A.neat(F.col("v")).alias("v"))


@query("regression_table", f"""WITH r AS (SELECT id, {_streams(3)} FROM (SELECT vec_id AS id FROM embeddings)),
x AS (SELECT *, {_gauss_sql('r0', 'r1', '0')} AS x0, {_gauss_sql('r0', 'r1', '1')} AS x1, {_gauss_sql('r3', 'r4', '0')} AS e FROM r)
SELECT id, {r6('2 * x0 - 3 * x1 + 0.5 + 0.1 * e')} AS label FROM x""")
def regression_table(spark, sf):
    """Labels of generated rows: weights 2 and -3, intercept 0.5, noise 0.1."""
    rows = synthetic.gaussian_features(embeddings(spark, sf).select("id"), 2, seed=3)
    return synthetic.linear_labels(rows, [2, -3], 0.5, 0.1, seed=3).select("id", A.neat(F.col("label")).alias("label"))


@query("rows_in_memory", f"""WITH {E}, m AS (SELECT label, j, avg(v) AS v FROM e GROUP BY ALL)
SELECT label::DOUBLE AS label, j, {r6('v')} AS v FROM m""")
def rows_in_memory(spark, sf):
    """The mean row of each label, held on the driver and made a table again."""
    cells = to_long(embeddings(spark, sf), "label").groupBy("label", "j").agg(F.avg("v").alias("v"))
    means = cells.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("j", "v"))).alias("c")).collect()   # a row for each label
    df = text.from_rows(spark, [(r["label"], [c["v"] for c in r["c"]]) for r in means])
    return to_long(df, "label").select("label", "j", A.neat(F.col("v")).alias("v"))
