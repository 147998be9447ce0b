"""Row-local grid expressions.

A grid is text: rows joined by newlines, one symbol per cell.  Everything here
is a native column expression over one grid, so a tile-level job that only
uses these functions is map-only: no explode and no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VOID = "."


def rows_of(grid: Column) -> Column:
    """Grid text -> array of rows; trailing blanks trimmed, blank rows dropped."""
    return F.filter(F.transform(F.split(grid, "\n"), F.rtrim), lambda r: r != "")


def cells_of(text: Column) -> Column:
    """A row (or a whole grid without newlines) -> array of one-symbol strings."""
    return F.split(text, "")


def grid_text(rows: Column) -> Column:
    return F.array_join(rows, "\n")


def rotate_rows(rows: Column, k: int) -> Column:
    """Clockwise quarter turns of an array of rows."""
    k %= 4
    if k == 0:
        return rows
    if k == 2:
        return F.transform(F.reverse(rows), F.reverse)
    width = F.length(rows[0])
    columns = F.sequence(F.lit(1), width) if k == 1 else F.sequence(width, F.lit(1), F.lit(-1))
    source = F.reverse(rows) if k == 1 else rows
    return F.transform(
        columns,
        lambda c: F.array_join(F.transform(source, lambda r: F.substring(r, c, F.lit(1))), ""),
    )


def flip_rows(rows: Column, axis: str) -> Column:
    """Mirror left-right (``h``) or top-bottom (``v``)."""
    return F.transform(rows, F.reverse) if axis == "h" else F.reverse(rows)


def equal_cells(a: Column, b: Column) -> Column:
    """Number of positions at which two equally long symbol strings agree."""
    marks = F.zip_with(cells_of(a), cells_of(b), lambda x, y: F.when(x == y, "1").otherwise("0"))
    agree = F.length(F.replace(F.array_join(marks, ""), F.lit("0"), F.lit("")))
    return F.when(F.length(a) == 0, 0).otherwise(agree)


def count_symbol(text: Column, sym: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, sym, F.lit("")))


def run_count(rows: Column) -> Column:
    """Horizontal runs of equal symbols, summed over all rows: one expression over the joined rows."""
    marks = F.length(F.regexp_replace(F.array_join(rows, "\n"), r"([^\n])\1*", "x"))
    return marks - F.greatest(F.size(rows) - 1, F.lit(0))  # less the line ends
