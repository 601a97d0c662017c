import math

import pytest
from pyspark.sql import functions as F

from quarrystat.functions import arrays as A


def one(spark, expr, **cols):
    df = spark.range(1).select(*[v.alias(k) for k, v in cols.items()])
    return df.select(expr.alias("x")).first()["x"]


def arr(*v):
    return F.array(*[F.lit(x) for x in v])


def test_elementwise(spark):
    a, b = arr(0.0, -3.0, 8.25), arr(4.0, -1.5, 0.25)
    assert one(spark, A.add(a, b)) == pytest.approx([4.0, -4.5, 8.5])
    assert one(spark, A.subtract(a, b)) == pytest.approx([-4.0, -1.5, 8.0])
    assert one(spark, A.multiply(a, b)) == pytest.approx([0.0, 4.5, 2.0625])
    assert one(spark, A.divide(a, b)) == pytest.approx([0.0, 2.0, 33.0])
    assert one(spark, A.add_scalar(a, 2)) == pytest.approx([2.0, -1.0, 10.25])


def test_division_by_zero_is_ieee(spark):
    got = one(spark, A.divide(arr(1.0, -1.0, 0.0), arr(0.0, 0.0, 0.0)))
    assert got[:2] == [math.inf, -math.inf] and math.isnan(got[2])


def test_unequal_lengths_raise(spark):
    with pytest.raises(Exception, match="differ in length"):
        one(spark, A.add(arr(1.0), arr(1.0, 2.0)))


def test_integer_division_truncates(spark):
    assert one(spark, A.divide_int(arr(7, -7, 9), 2)) == [3, -3, 4]


def test_pairs(spark):
    def pairs(*ps):
        return F.array(*[F.struct(F.lit(t).alias("total"), F.lit(n).alias("n")) for t, n in ps])
    s = A.pair_add(pairs((7.5, 4), (-2.25, 0)), pairs((0.5, 1), (2.25, 0)))
    got = one(spark, s)
    assert [(r["total"], r["n"]) for r in got] == [(8.0, 5), (0.0, 0)]
    ratio = one(spark, A.pair_ratio(s))
    assert ratio[0] == 1.6 and math.isnan(ratio[1])


def test_pick_any_order_and_gaps(spark):
    a = arr(10.0, 11.0, 12.0, 13.0)
    assert one(spark, A.pick(a, [3, 0, 0])) == [13.0, 10.0, 10.0]
    assert one(spark, A.pick(a, [1, 3])) == [11.0, 13.0]
    assert one(spark, A.pick(a, [])) == []


def test_literal_array_round_trips(spark):
    v = [0.1, -1e-300, float("inf"), 3.0, 1 / 3]
    assert one(spark, A.literal_array(v)) == v
    assert math.isnan(one(spark, A.literal_array([float("nan")]))[0])


def test_nan_helpers(spark):
    a = arr(1.0, float("nan"), 3.0)
    assert one(spark, A.nan_count(a)) == 1
    assert one(spark, A.fill_nan(a, arr(9.0, 8.0, 7.0))) == [1.0, 8.0, 3.0]


def test_list_product(spark):
    got = one(spark, A.list_product(arr(1, 2), arr(6, 7, 8)))
    assert [(r["x"], r["y"]) for r in got] == [(1, 6), (1, 7), (1, 8), (2, 6), (2, 7), (2, 8)]


def test_operand_is_computed_once(spark):
    """A chain of element-wise steps must not multiply the work."""
    c = arr(*[float(i) for i in range(64)])
    for _ in range(12):
        c = A.add(c, A.literal_array(range(64)))
    assert one(spark, c) == [13.0 * i for i in range(64)]


def test_nulls_become_nan(spark):
    df = spark.sql("select array(1D, cast(null as double)) as f")
    got = df.select(A.clean_double(F.col("f")).alias("x")).first()["x"]
    assert got[0] == 1.0 and math.isnan(got[1])
