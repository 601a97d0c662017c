"""Draws for cells that depend on (row id, column, seed) alone.

A row has a 32-bit number (of the md5 of its id and the seed); a cell's draw mixes it with the
column. A retried task, another layout and SQL get the same numbers.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: 32-bit numbers; odd multipliers, the second leaves products below 2**63.
WORD, MIX, MIX_AGAIN = 1 << 32, 2654435761, 2146121005


def row_number(seed: int, key: str = "id") -> Column:
    """The row's 32-bit number."""
    text = F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def cell_word(row: Column, j: Column) -> Column:
    """A 32-bit number of a cell from its row's number and its column."""
    h = row.bitwiseXOR((j.cast("bigint") + 1) * MIX % WORD) * MIX_AGAIN % WORD
    return h.bitwiseXOR(F.shiftright(h, 16)) * MIX_AGAIN % WORD


def cell_unit(row: Column, j: Column) -> Column:
    """A number in [0, 1)."""
    return cell_word(row, j) / F.lit(float(WORD))


def cell_gauss(row: Column, other: Column, j: Column) -> Column:
    """A number of N(0, 1), from the row's numbers of two seeds."""
    u, v = ((cell_word(r, j) + 0.5) / F.lit(float(WORD)) for r in (row, other))
    return F.sqrt(-2.0 * F.log(u)) * F.cos(2.0 * math.pi * v)


def draw_sql(row: str, j: str) -> str:
    """:func:`cell_word` in SQL."""
    h = f"(xor({row}, ({j}::BIGINT + 1) * {MIX} % {WORD}) * {MIX_AGAIN} % {WORD})"
    return f"(xor({h}, {h} >> 16) * {MIX_AGAIN} % {WORD})"


def row_sql(key: str, seed: int) -> str:
    """:func:`row_number` in SQL."""
    return f"('0x' || substr(md5({key}::VARCHAR || ':{seed}'), 1, 8))::BIGINT"
