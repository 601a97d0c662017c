"""Mixing sources to target weights by Pareto order sampling.

Sources get shares of the word budget by weight, at most ``ceiling`` times their
own words; the excess is shared again. Inside a source each document has expected
copies: the source's rate, less for fragments. Whole expected copies are certain.
The fraction left is an inclusion probability p: documents are ranked by
``(u / (1-u)) / (p / (1-p))`` with u a hash of the id, and taken in that order until
the source's remaining words are reached, to the nearest document.

The cut in that order is found by histogram digits of the rank (map-side combined
sums per source and bucket), then within one bucket of 2^-24 of the order, where rows
of one id and size are one with a count, so no source is ever sorted whole. If the cut
goes through such rows, it is found among their row digests in the same way, and of
rows that are equal throughout only as many are drawn as reach the target. Documents meet only small tables of sources.

Defined cases: null text has size 0; null sources are one source, last by code
point; documents of size 0 are taken for 0 words; rows with the same id share u and
are ordered by size, then by a digest of the whole row; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystat.llm.common import LAST_ID, WORD, packed, row_digest, row_id, saved

#: Documents of fewer words are fragments, wanted so much as a whole document.
FRAGMENT_WORDS, FRAGMENT_RATE = 50, 0.5
DIGITS = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _fill(cells: DataFrame, budget: Column, cap: Column, weight: Column, order: list, by: list, out: str) -> DataFrame:
    """Water filling: the level at which ``min(cap, level * weight)`` sums to ``budget``.

    ``order`` sorts by cap over weight: whoever is full at all is full first. The level
    is the one at the first that is not full; taking later ones as full lowers it.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    before, rest = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(0, Window.unboundedFollowing)
    level = (budget - F.coalesce(F.sum(cap).over(before), F.lit(0))) / F.sum(weight).over(rest)
    return (cells.withColumn("level", level).withColumn("full", (F.col("level") * weight >= cap))
            .withColumn("level", F.max(F.when(~F.col("full"), F.col("level"))).over(Window.partitionBy(*by)))
            .withColumn(out, F.when(F.col("full") | F.col("level").isNull(), cap.cast("double"))
                        .otherwise(F.col("level") * weight)).drop("level", "full"))


def source_plan(sizes: DataFrame, weights: list[int], share: float, ceiling: int) -> DataFrame:
    """``(source, fragment, source_size, target, copies, left)`` per source and kind.

    One row per source goes through one window task, never one per document.
    """
    kind = sizes.groupBy("source", "fragment").agg(F.sum("size").alias("words"))
    src = (kind.groupBy("source").agg(F.sum("words").alias("source_size"))
           .withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
           .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1)))
           .withColumn("total", F.sum("source_size").over(Window.partitionBy())))
    size, weight = F.col("source_size"), F.col("weight")
    src = _fill(src, F.col("total") * share, size * ceiling, weight,
                [size * ceiling / weight, "rank"], [], "target").select("source", "source_size", "target")
    cells = kind.join(src, kind["source"].eqNullSafe(src["source"])).drop(src["source"])
    rate = F.when(F.col("fragment"), F.lit(FRAGMENT_RATE)).otherwise(F.lit(1.0))
    cells = _fill(cells.where("words > 0"), F.col("target"), F.col("words") * ceiling, rate * F.col("words"),
                  [F.col("fragment")], ["source"], "cell_target")
    whole = F.floor("copies") * F.col("words")
    return (cells.withColumn("copies", F.least(F.col("cell_target") / F.col("words"), F.lit(float(ceiling))))
            .withColumn("left", F.col("target") - F.sum(whole).over(Window.partitionBy("source")))
            .select("source", "fragment", "source_size", "target", "copies", "left"))


def _ranked(sizes: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """Sizes with their source's plan and the rank ``v`` in (0, 1); null: nothing to draw."""
    p = plan.withColumnRenamed("source", "s_").withColumnRenamed("fragment", "f_")
    joined = sizes.join(p, sizes["source"].eqNullSafe(p["s_"]) & (sizes["fragment"] == p["f_"]), "left")
    text = F.concat(F.when(F.col("id") == LAST_ID, F.lit("null")).otherwise(F.col("id").cast("string")), F.lit(f":{seed}"))
    u = (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)
    part = F.col("copies") - F.floor("copies")
    q = (F.col("u") / (1 - F.col("u"))) / (part / (1 - part))
    return (joined.withColumn("u", u).withColumn("v", F.when((part > 0) & (F.col("size") > 0), q / (1 + q)))
            .withColumn("cell", F.floor(F.col("v") * (DIGITS * DIGITS))).drop("s_", "f_", "u"))


def _crossing(ranked: DataFrame, digit: Column, base: Column) -> DataFrame:
    """Per source the bucket in which the words reach ``left``, and the words before it."""
    w = Window.partitionBy("source").orderBy("digit")
    return (ranked.groupBy("source", digit.alias("digit"))
            .agg(F.sum("size").alias("n"), F.first("left").alias("left"), F.first(base).alias("base"))
            .withColumn("end", F.sum("n").over(w) + F.col("base"))
            .where((F.col("end") - F.col("n") <= F.col("left")) & (F.col("left") < F.col("end")))
            .select("source", "digit", (F.col("end") - F.col("n")).alias("start")))


def _taken(start: Column) -> Column:
    """How many of ``c`` rows of one size are in, the first with ``start`` words before it."""
    left, size = F.col("left"), F.col("size")

    def holds(j):
        return start + j * size + size / 2 <= left
    k = F.greatest(F.lit(0), F.floor((left - start - size / 2) / size) + 1)
    k = F.when(holds(k), k + 1).when((k > 0) & ~holds(k - 1), k - 1).otherwise(k)
    return F.least(k, F.col("c"))


def _cuts(drawn: DataFrame, order: list[str]) -> DataFrame:
    """``(source, cut_cell, cut, k, c, start, left)``: rows before the cell are in, and in it
    those before ``cut``, the last ``order`` of which a row is in. Of the ``c`` rows equal to
    it, which have ``start`` words before them, ``k`` are in. Rows equal in ``order`` are one with a count."""
    def inside(rows, found, digit):
        f = found.withColumnRenamed("source", "s_").withColumnRenamed("start", "before")
        return rows.join(f, rows["source"].eqNullSafe(f["s_"]) & (digit == f["digit"])).drop("s_", "digit")
    drawn = drawn.select("source", "left", "cell", *dict.fromkeys(["size", *order]))
    high = F.floor(F.col("cell") / DIGITS)
    first = saved(_crossing(drawn, high, F.lit(0)), "mix-cut")
    rows = saved(inside(drawn, first, high), "mix-bucket")
    second = saved(_crossing(rows, F.col("cell"), F.col("before")), "mix-cut")
    rows = inside(rows.drop("before"), second, F.col("cell"))
    alike = rows.groupBy("source", "cell", "left", "before", *dict.fromkeys(["size", *order])).agg(F.count("*").alias("c"))
    w = Window.partitionBy("source").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum(F.col("size") * F.col("c")).over(w), F.lit(0))
    alike = alike.withColumn("start", start).withColumn("k", _taken(F.col("start")))
    last = F.max(F.when(F.col("k") > 0, F.struct(F.struct(*order).alias("cut"), "k", "c", "start")))
    found = alike.groupBy("source", F.col("cell").alias("cut_cell")).agg(last.alias("x"), F.first("left").alias("left"))
    return saved(found.select("source", "cut_cell", "x.*", "left"), "mix-cut")


def _tie_cuts(ranked: DataFrame, cuts: DataFrame) -> DataFrame:
    """``(t_, tie_cell, tie, tie_k, tie_c)`` of the sources whose cut goes through rows of the
    same id and size: these are in by the order of their digests."""
    part = cuts.where("k < c").select(F.col("source").alias("t_"), "cut", F.col("left").alias("all"), "start")
    rows = ranked.drop("left").join(part, ranked["source"].eqNullSafe(part["t_"]) & (F.struct("v", "id", "size") == part["cut"]))
    rows = rows.withColumn("left", F.col("all") - F.col("start")).withColumn("cell", _digest_cell())
    return _cuts(rows, ["r"]).select(F.col("source").alias("t_"), F.col("cut_cell").alias("tie_cell"), F.col("cut.r").alias("tie"),
                                     F.col("k").alias("tie_k"), F.col("c").alias("tie_c"))


def _digest_cell() -> Column:
    return F.shiftright("r", 40) + F.lit(DIGITS * DIGITS // 2)


def mixed(docs: DataFrame, weights: list[int] = (5, 2, 1), share: float = 1.5, ceiling: int = 2,
          seed: int = 11) -> DataFrame:
    """``(row_ struct, doc_id, size, source_size, target, copies, taken)`` of every document;
    ``copies`` is how often the mix takes it, ``taken`` its words times that."""
    def narrow(*more):
        return (docs.select(*more, row_id().alias("id"), row_digest(docs).alias("r"), F.col("source").cast("string").alias("source"),
                            word_count(F.col("text")).alias("size"))
                .withColumn("fragment", F.col("size") < FRAGMENT_WORDS))
    sizes = saved(narrow(), "mix-sizes")
    plan = saved(source_plan(sizes, list(weights), share, ceiling), "mix-plan")
    ranked = _ranked(sizes, plan, seed).where("v is not null")
    cuts = _cuts(ranked, ["v", "id", "size"])
    per_source = plan.groupBy("source").agg(F.first("source_size").alias("full_size"), F.first("target").alias("goal"))
    per_source = (per_source.join(cuts.withColumnRenamed("source", "c_").drop("left", "start"), F.col("source").eqNullSafe(F.col("c_")), "left")
                  .drop("c_").withColumnRenamed("source", "p_"))
    none = "cast(null as string) t_, 0L tie_cell, 0L tie, 0L tie_k, 0L tie_c"
    ties = cuts.sparkSession.range(0).selectExpr(none.split(", ")) if cuts.where("k < c").isEmpty() else _tie_cuts(ranked, cuts)
    per_source = saved(per_source.join(ties.withColumn("tied", F.lit(True)), F.col("p_").eqNullSafe(F.col("t_")), "left").drop("t_"), "mix-sources")
    rows = narrow(packed(docs).alias("row_"))
    all_rows = _ranked(rows, plan, seed).join(per_source, F.col("source").eqNullSafe(F.col("p_")), "left")
    here, at = F.struct("v", "id", "size"), _digest_cell()
    tie_in = (at < F.col("tie_cell")) | ((at == F.col("tie_cell")) & F.coalesce(F.col("r") <= F.col("tie"), F.lit(False)))
    at_cut = F.when(here == F.col("cut"), F.col("tied").isNull() | tie_in).otherwise(here < F.col("cut"))
    drawn = F.col("v").isNotNull() & (F.col("cut_cell").isNull() | (F.col("cell") < F.col("cut_cell"))
                                      | ((F.col("cell") == F.col("cut_cell")) & F.coalesce(at_cut, F.lit(False))))
    all_rows = all_rows.withColumn("drawn", drawn)
    if not per_source.where("tie_k < tie_c").isEmpty():
        # Rows that are equal throughout, of which some are in: one with a count, then written out.
        cut_here = F.coalesce(F.col("drawn") & (here == F.col("cut")) & (F.col("r") == F.col("tie")) & (F.col("tie_k") < F.col("tie_c")), F.lit(False))
        names = all_rows.columns
        equal = (all_rows.where(cut_here).groupBy(F.col("p_").alias("s_"), F.col("r").alias("d_"))
                 .agg(F.first(F.struct(*names)).alias("x"), F.count("*").alias("times")))
        blocks = equal.select("x", "s_", "times", F.explode(F.expr("sequence(0L, (times - 1) div 1024)")).alias("b")).repartition("s_", "b")
        one = blocks.select("x.*", F.explode(F.expr("sequence(b * 1024 + 1, least(times, (b + 1) * 1024))")).alias("no"))
        all_rows = all_rows.where(~cut_here).unionByName(one.withColumn("drawn", F.col("no") <= F.col("tie_k")).select(*names))
    n = F.coalesce(F.floor("copies"), F.lit(0)) + F.col("drawn").cast("long")
    return all_rows.withColumn("n_", n).select(
        "row_", F.col("row_.doc_id").alias("doc_id"), "size", F.coalesce("full_size", F.lit(0)).cast("long").alias("source_size"),
        F.coalesce("goal", F.lit(0.0)).alias("target"), F.col("n_").cast("long").alias("copies"),
        (F.col("n_") * F.col("size")).cast("long").alias("taken"))


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)`` of every document."""
    return mixed(docs, **options).select("doc_id", "size", "source_size", "target", "taken")


MIXING_SQL = """
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size
           FROM documents),
s AS (SELECT *, size < 50 AS fragment FROM d),
k AS (SELECT source, fragment, sum(size)::BIGINT AS words FROM s GROUP BY ALL),
r AS (SELECT source, sum(words)::BIGINT AS source_size,
        row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM k GROUP BY source),
w AS (SELECT *, [5, 2, 1][(rank - 1) % 3 + 1] AS weight, sum(source_size) OVER ()::BIGINT AS total FROM r),
l AS (SELECT *, (total * 1.5::DOUBLE - coalesce(sum(source_size * 2) OVER (ORDER BY source_size * 2 / weight, rank
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)
        / sum(weight) OVER (ORDER BY source_size * 2 / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT
        AS level FROM w),
f AS (SELECT *, level * weight >= source_size * 2 AS isfull FROM l),
t AS (SELECT source, source_size, CASE WHEN isfull OR lv IS NULL THEN (source_size * 2)::DOUBLE ELSE lv * weight END AS target
      FROM (SELECT *, max(CASE WHEN NOT isfull THEN level END) OVER () AS lv FROM f)),
c AS (SELECT k.*, t.source_size, t.target, CASE WHEN fragment THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END * words AS want
      FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source WHERE words > 0),
cl AS (SELECT *, (target - coalesce(sum(words * 2) OVER (PARTITION BY source ORDER BY fragment
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)
        / sum(want) OVER (PARTITION BY source ORDER BY fragment ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
cf AS (SELECT *, level * want >= words * 2 AS isfull FROM cl),
ct AS (SELECT *, least((CASE WHEN isfull OR lv IS NULL THEN (words * 2)::DOUBLE ELSE lv * want END) / words, 2.0::DOUBLE) AS copies
       FROM (SELECT *, max(CASE WHEN NOT isfull THEN level END) OVER (PARTITION BY source) AS lv FROM cf)),
p AS (SELECT *, target - sum((floor(copies)::BIGINT * words)) OVER (PARTITION BY source)::BIGINT AS remainder FROM ct),
j AS (SELECT s.*, p.copies, p.remainder, (('0x' || substr(md5(s.doc_id::VARCHAR || ':11'), 1, 13))::BIGINT + 0.5::DOUBLE)
        / 4503599627370496.0::DOUBLE AS u, copies - floor(copies) AS part
      FROM s LEFT JOIN p ON s.source IS NOT DISTINCT FROM p.source AND s.fragment = p.fragment),
q AS (SELECT *, CASE WHEN part > 0 AND size > 0 THEN (u / (1 - u)) / (part / (1 - part)) END AS q FROM j),
v AS (SELECT *, q / (1 + q) AS v FROM q),
o AS (SELECT *, CASE WHEN v IS NOT NULL THEN coalesce(sum(size) OVER (PARTITION BY source, v IS NULL ORDER BY v, doc_id, size
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size / 2 END AS middle FROM v)
SELECT o.doc_id, o.size, coalesce(t.source_size, 0)::BIGINT AS source_size, coalesce(t.target, 0)::DOUBLE AS target,
  ((coalesce(floor(copies), 0)::BIGINT + coalesce(middle <= remainder, false)::INT) * o.size)::BIGINT AS taken
FROM o LEFT JOIN t ON o.source IS NOT DISTINCT FROM t.source
"""
