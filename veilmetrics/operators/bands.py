"""Joins of intervals and rectangles by real coordinates, without a line or row number.

An axis is cut into cells. Both sides are posted in every cell that their interval reaches, and a pair is made in one cell
alone, the first that both reach (its owner), so that it needs no later removal of duplicates. The join is an equi-join on
the keys and cells: a page is never a product of its rows, and a hot page is dealt out by its cells. An interval makes
a row for each cell that it reaches; pages have bounded edges, so that these are few.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROW_PT, COLUMN_PT = 72.0, 288.0


@dataclass(frozen=True)
class Axis:
    """An interval of the left and one of the right side, whose pairs touch at least, and the length of a cell.

    Ends are columns of the side's own; a condition that reaches beyond an interval is met by widening it.
    """

    left: tuple[Column, Column]
    right: tuple[Column, Column]
    cell: float


def _posted(df: DataFrame, ends: list[tuple[Column, Column]], cells: list[float], side: str) -> DataFrame:
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    for k, ((a, b), cell) in enumerate(zip(ends, cells)):
        a, b = a.cast("double"), b.cast("double")
        df = df.where(finite(a) & finite(b)).withColumns({f"_{side}{k}": F.floor(F.least(a, b) / cell), f"_last{k}": F.floor(F.greatest(a, b) / cell)})
    for k in range(len(ends)):
        df = df.withColumn(f"_cell{k}", F.explode(F.sequence(f"_{side}{k}", f"_last{k}"))).drop(f"_last{k}")
    return df


def grid_join(left: DataFrame, right: DataFrame, on: list[str], axes: list[Axis], where: Column) -> DataFrame:
    """Pairs of rows equal in `on` whose intervals touch on every axis and that the condition holds for, each pair once.

    The sides have no column names in common but `on`. Rows with a null or non-finite end are in no pair.
    """
    cells = [a.cell for a in axes]
    l, r = _posted(left, [a.left for a in axes], cells, "l"), _posted(right, [a.right for a in axes], cells, "r")
    at = [f"_cell{k}" for k in range(len(axes))]
    joined = l.join(r, [*on, *at])
    for k, c in enumerate(at):
        joined = joined.where(F.col(c) == F.greatest(f"_l{k}", f"_r{k}"))
    return joined.where(where).drop(*at, *[f"_{s}{k}" for s in "lr" for k in range(len(axes))])


def rows(l0, l1, r0, r1, cell: float = ROW_PT) -> Axis:
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return Axis((c(l0), c(l1)), (c(r0), c(r1)), cell)


def columns(l0, l1, r0, r1) -> Axis:
    return rows(l0, l1, r0, r1, COLUMN_PT)
