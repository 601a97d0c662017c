"""Element-wise column functions over arrays.

All of them are built-in Spark expressions and stay in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value, f) -> Column:
    """``f`` of a value computed once.

    Catalyst inlines a column into every place that names it; inside a lambda
    that would compute it once per element.  A lambda variable is bound once.
    """
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _paired(a, b, f) -> Column:
    """``zip_with`` that refuses operands of unequal length."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return let(F.struct(a.alias("a"), b.alias("b")), lambda s: F.when(
        F.size(s["a"]) == F.size(s["b"]), F.zip_with(s["a"], s["b"], f)).otherwise(
        F.raise_error(F.lit("arrays differ in length"))))


def add(a: Column, b: Column) -> Column:
    return _paired(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return _paired(a, b, lambda x, y: x - y)


def multiply(a: Column, b: Column) -> Column:
    return _paired(a, b, lambda x, y: x * y)


def divide(a: Column, b: Column) -> Column:
    """Quotient per element with IEEE results: x/0 is infinite, 0/0 is NaN."""
    return _paired(a, b, _ieee_ratio)


def _ieee_ratio(x: Column, y: Column) -> Column:
    special = (F.when(F.isnan(x) | (x == 0), F.lit(float("nan")))
               .when(x > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf"))))
    return F.when(y == 0, special).otherwise(x / y)


def add_scalar(a: Column, s) -> Column:
    return F.transform(a, lambda x: x + s)


def multiply_scalar(a: Column, s) -> Column:
    return F.transform(a, lambda x: x * s)


def divide_scalar(a: Column, s) -> Column:
    return F.transform(a, lambda x: x / s)


def divide_int(a: Column, s: int) -> Column:
    """Integer quotient, truncated towards zero."""
    return F.transform(a, lambda x: F.call_function("div", x, F.lit(s)).cast("int"))


def nested_add(a: Column, b: Column) -> Column:
    """Sum of two arrays of arrays, inner element by inner element."""
    return _paired(a, b, lambda x, y: _paired(x, y, lambda p, q: p + q))


def nested_divide(a: Column, s) -> Column:
    return F.transform(a, lambda x: F.transform(x, lambda p: p / s))


def pair_add(a: Column, b: Column) -> Column:
    """Sum of two arrays of two-field structs ``(total, n)``."""
    return _paired(a, b, lambda x, y: F.struct((x["total"] + y["total"]).alias("total"),
                                               (x["n"] + y["n"]).alias("n")))


def pair_ratio(a: Column) -> Column:
    """``total / n`` of every pair; NaN where nothing was counted."""
    return F.transform(a, lambda p: F.when(p["n"] == 0, F.lit(float("nan")))
                       .otherwise(p["total"] / p["n"]))


def pair_divide(a: Column, s) -> Column:
    """Both fields of every pair divided by a scalar."""
    return F.transform(a, lambda p: F.struct((p["total"] / s).alias("total"),
                                             (p["n"] / s).alias("n")))


def to_float(a) -> Column:
    return F.transform(a, lambda x: x.cast("float"))


def clean_double(a: Column) -> Column:
    """Doubles with nulls turned into NaN, the one missing-value marker."""
    return F.transform(a.cast("array<double>"),
                       lambda x: F.coalesce(x, F.lit(float("nan"))))


def take_first(a: Column, k: int) -> Column:
    return F.slice(a, 1, k)


def pick(a, idx) -> Column:
    """Elements at the given 0-based positions, in that order."""
    idx = [int(i) for i in idx]
    if idx and idx == sorted(set(idx)):
        keep = set(idx)
        mask = literal_array([i in keep for i in range(idx[-1] + 1)], "int")
        return F.filter(a, lambda x, i: F.coalesce(F.get(mask, i), F.lit(0)) == 1)
    return let(a, lambda v: F.transform(literal_array(idx, "int"), lambda i: F.get(v, i)))


def append(a: Column, b: Column) -> Column:
    return F.concat(a, b)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(_paired(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def nan_count(a: Column) -> Column:
    return F.size(F.filter(a, lambda x: F.isnan(x)))


def fill_nan(a: Column, b: Column) -> Column:
    """``a`` with every NaN replaced by the element of ``b`` at its position."""
    return _paired(a, b, lambda x, y: F.when(F.isnan(x), y).otherwise(x))


def list_product(a: Column, b: Column) -> Column:
    """All pairs of two short arrays of one row, first array outermost."""
    return F.flatten(F.transform(a, lambda x: F.transform(
        b, lambda y: F.struct(x.alias("x"), y.alias("y")))))


def literal_array(values, kind: str = "double") -> Column:
    """A constant array as one folded literal, however long it is."""
    values = list(values)
    if not values:
        return F.array().cast(f"array<{kind}>")
    text = ",".join(repr(float(v)) if kind == "double" else str(int(v)) for v in values)
    return F.split(F.lit(text), ",").cast(f"array<{kind}>")


def neat(c: Column, digits: int = 6) -> Column:
    """Rounded for reports, never negative zero."""
    return F.round(c, digits) + F.lit(0.0)
