"""Entropy-based dependence between binned features, in bits.

Input is a table with ``bins`` (array of small ints, one per feature) and
discrete columns such as a label.  Counting is a map-side combined aggregate:
a task emits at most one row per feature and pair of states.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrystat.functions import kernels
from quarrystat.operators.common import log2, union_all, width, with_width
from quarrystat.operators.gram import local_matrix
from quarrystat.operators.products import merged
from quarrystat.operators.reshape import mirror

def _c_log_c(c: Column) -> Column:
    return c * log2(c)


def _margins(counts: DataFrame, keys: list[str], *sets: tuple[str, ...]) -> DataFrame:
    """``(*keys, g, *columns, c)``: the counts summed over each of ``sets``, numbered by g.

    Every margin cell is a group of its own, so that neither a feature nor a pair with many
    states becomes one task's group.
    """
    names = list(dict.fromkeys(c for s in sets for c in s))
    kinds = dict(counts.dtypes)
    rows = F.inline(F.array(*[F.struct(F.lit(g).alias("g"), *[
        (F.col(c) if c in s else F.lit(None).cast(kinds[c])).alias(c) for c in names]) for g, s in enumerate(sets)]))
    return (counts.select(*keys, F.col("cnt").cast("double").alias("c"), rows)
            .groupBy(*keys, "g", *names).agg(F.sum("c").alias("c")))


def _mi(counts: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """MI per key from joint counts ``(*keys, x, y, cnt)``: log n + (S(x, y) - S(x) - S(y)) / n,
    S being the sum of c log c over the cells."""
    g, c = F.col("g"), F.col("c")
    sign = F.when(g == 0, 1.0).otherwise(-1.0)
    n = F.sum(F.when(g == 0, c))
    out = _margins(counts, keys, (x, y), (x,), (y,)).groupBy(*keys).agg(
        (log2(n) + F.sum(sign * _c_log_c(c)) / n).alias("mi"))
    return out if keys else out.where("mi is not null")


def mi_pair(df: DataFrame, x: str, y: str) -> DataFrame:
    """MI of two discrete columns, one row."""
    return _mi(df.groupBy(x, y).agg(F.count("*").alias("cnt")), [], x, y)


_INTEGERS = ("tinyint", "smallint", "int")


def packed(df: DataFrame, *keep: str, bins: str = "bins") -> DataFrame:
    """Columns ``keep`` and the bins as bytes, two per feature.

    For tables that are cached and counted many times; the functions that
    count in numpy take either form.
    """
    types = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema]
    out = df.select(*keep, bins).mapInArrow(
        kernels.pack_kernel(bins, list(keep)), ", ".join(types + [f"`{bins}` binary"]))
    return with_width(out, bins, width(df, bins))


def _counted(df: DataFrame, sel: int | None, refs: list[str], bins: str) -> DataFrame:
    d = width(df, bins)
    parts = df.select(*dict.fromkeys(refs), bins).mapInArrow(
        kernels.count_kernel(bins, d, sel, refs), "j int, s bigint, y bigint, b int, cnt bigint")
    return parts.groupBy("j", "s", "y", "b").agg(F.sum("cnt").alias("cnt"))


def joint_counts(df: DataFrame, sel: str | int, label: str | None = None,
                 bins: str = "bins") -> DataFrame:
    """Counts ``(j, s, y, b, cnt)``: s the reference, y the label or 0, b the bin.

    The reference is a column name or the position of a feature.  Integer
    columns are counted in numpy, batch by batch; others in the JVM.
    """
    refs = ([sel] if isinstance(sel, str) else []) + ([label] if label else [])
    if all(t in _INTEGERS for _, t in df.select(*refs).dtypes):
        return _counted(df, sel if isinstance(sel, int) else None, refs, bins)
    s = F.get(F.col(bins), F.lit(sel)) if isinstance(sel, int) else F.col(sel)
    y = F.col(label) if label else F.lit(0)
    return (df.select(s.alias("s"), y.alias("y"), F.posexplode(bins).alias("j", "b"))
            .groupBy("j", "s", "y", "b").agg(F.count("*").alias("cnt")))


def entropy(df: DataFrame, bins: str = "bins") -> DataFrame:
    """Entropy of every binned feature in bits: ``(j, h)``."""
    c, n = F.col("cnt").cast("double"), F.sum("cnt")
    return _counted(df, None, [], bins).groupBy("j").agg(
        (log2(n) - F.sum(c * log2(c)) / n).alias("h"))


def mi_vector(df: DataFrame, ref: str | int, bins: str = "bins") -> DataFrame:
    """MI of one column (label name or feature position) with every feature."""
    return _mi(joint_counts(df, ref, bins=bins), ["j"], "s", "b")


def pair_counts(df: DataFrame, states: int, bins: str = "bins", branches: int = 1) -> DataFrame:
    """Joint counts of every feature pair ``(i, j, bi, bj, cnt)``, i <= j.

    One scan counts all pairs. ``branches`` cuts the features i into so many tile rows, a scan
    each, for tables with fewer splits than cores. Where the cells of all tasks would be too
    many to shuffle, splits are merged.
    """
    d = width(df, bins)
    tile = max(1, -(-d // branches))
    src = merged(df.select(bins), 3 * (d * (d + 1) // 2) * states * states)
    parts = [src.mapInArrow(kernels.pair_count_kernel(bins, d, (a, min(a + tile, d)), states),
                                        "i int, j int, bi int, bj int, cnt bigint") for a in range(0, d, tile)]
    return union_all(parts).groupBy("i", "j", "bi", "bj").agg(F.sum("cnt").alias("cnt"))


def mi_matrix(df: DataFrame, states: int, triangle: str = "full", bins: str = "bins",
              branches: int = 1) -> DataFrame:
    """MI of all feature pairs ``(i, j, mi)``.

    ``states`` is the number of bins (largest bin + 1).  The diagonal holds the
    entropies.  ``triangle``: full, lower (i >= j) or strict_lower (i > j). The margins of a
    pair are the diagonal's counts: a pair needs but its own sum of c log c.
    """
    if triangle not in ("full", "lower", "strict_lower"):
        raise ValueError(f"unknown triangle {triangle}")
    c = F.col("cnt").cast("double")
    pairs = pair_counts(df, states, bins, branches).groupBy("i", "j").agg(
        F.sum(_c_log_c(c)).alias("s"), F.sum(c).alias("n"))
    own = F.when(F.col("i") == F.col("j"), F.col("s"))
    pairs = (pairs.withColumn("si", F.max(own).over(W.partitionBy("i")))
             .withColumn("sj", F.max(own).over(W.partitionBy("j"))))
    n, s, si, sj = (F.col(k) for k in ("n", "s", "si", "sj"))
    upper = pairs.select("i", "j", (log2(n) + (s - si - sj) / n).alias("mi"))
    if triangle == "full":
        return mirror(upper)
    if triangle == "strict_lower":
        upper = upper.filter("i <> j")
    return upper.select(F.col("j").alias("i"), F.col("i").alias("j"), "mi")


def mi_matrix_local(df: DataFrame, states: int, bins: str = "bins"):
    """The MI matrix as a numpy array; the number of features is bounded."""
    return local_matrix(mi_matrix(df, states, "lower", bins)
                        .withColumnRenamed("mi", "value"), width(df, bins))


def _conditional(df, sel, label, bins, given, weighting):
    """Sum over the states z of the condition of I(x; y | z), weighted by probability or not."""
    if weighting not in ("probability", "uniform"):
        raise ValueError(f"unknown weighting {weighting}")
    z, x = ("s", "b") if given == "selected" else ("b", "s")
    g, c = F.col("g"), F.col("c")
    sign = F.when(g.isin(0, 3), 1.0).otherwise(-1.0)
    states = (_margins(joint_counts(df, sel, label, bins), ["j"], (z, x, "y"), (z, x), (z, "y"), (z,))
              .groupBy("j", z).agg(F.sum(sign * _c_log_c(c)).alias("t"), F.sum(F.when(g == 3, c)).alias("n")))
    if weighting == "uniform":
        return states.groupBy("j").agg(F.sum(F.col("t") / F.col("n")).alias("cmi"))
    return states.groupBy("j").agg((F.sum("t") / F.sum("n")).alias("cmi"))


def cmi_vector(df: DataFrame, sel: str | int, label: str = "label", bins: str = "bins",
               weighting: str = "probability") -> DataFrame:
    """I(candidate; label | selected) for every candidate feature.

    ``weighting="uniform"`` adds the states of the condition up unweighted.
    """
    return _conditional(df, sel, label, bins, "selected", weighting)


def cmi_reverse(df: DataFrame, sel: str | int, label: str = "label", bins: str = "bins",
                weighting: str = "probability") -> DataFrame:
    """I(selected; label | candidate) for every candidate feature."""
    return _conditional(df, sel, label, bins, "candidate", weighting)


def joint_mi(df: DataFrame, sel: int, label: str = "label", bins: str = "bins",
             reverse: bool = False, weighting: str = "probability") -> DataFrame:
    """Conditional MI plus the relevance of the selected feature.

    With probability weights the forward form is I(selected, candidate; label).
    """
    fn = cmi_reverse if reverse else cmi_vector
    rel = mi_vector(df.select(label, F.array(F.get(F.col(bins), F.lit(sel))).alias("one")),
                    label, "one")
    gain = rel.first()["mi"]
    return (fn(df, sel, label, bins, weighting)
            .select("j", (F.col("cmi") + F.lit(gain)).alias("jmi")))
