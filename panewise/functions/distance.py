"""Euclidean distance and grid cells as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells are this much wider (or narrower) than a range, so that rounding never puts a neighbour two cells off.
SLACK = 1e-9


def euclid(a: str | Column, b: str | Column, width: int | None = None) -> Column:
    """Distance over the components that both have; of `width` components if all points have so many (faster)."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    if width is not None and width <= 8:
        total = F.lit(0.0)
        for i in range(width):
            total = total + (a[i] - b[i]) * (a[i] - b[i])
        return F.sqrt(total)
    squares = F.zip_with(a, b, lambda x, y: F.coalesce((x - y) * (x - y), F.lit(0.0)))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, v: s + v))


def widths(points: DataFrame) -> tuple[int, int]:
    """Fewest and most components of the points' values; (1, 1) for none."""
    low, high = points.agg(F.min(F.size("value")), F.max(F.size("value"))).first()
    return (1, 1) if low is None else (low, high)


def cell(value: str | Column, side: float, axes: int) -> Column:
    """The grid cell of a point: an array of whole numbers, of its first components."""
    value = F.col(value) if isinstance(value, str) else value
    return F.array(*[F.floor(value[i] / side).cast("long") for i in range(axes)])


def cells(value: str | Column, r: float, axes: int) -> list[Column]:
    """The cell of a point in a grid twice as wide as a range, a column for each of its first components."""
    value = F.col(value) if isinstance(value, str) else value
    return [F.floor(value[i] / (2 * r * (1 + SLACK))).cast("long") for i in range(axes)]


def touched(value: str | Column, r: float, axes: int) -> list[Column]:
    """For each component the array of cells of the grid of cells() that a point's range touches: one or two."""
    value, reach = F.col(value) if isinstance(value, str) else value, r * (1 + SLACK)
    edge = lambda x: F.floor(x / (2 * reach)).cast("long")
    return [F.sequence(edge(value[i] - reach), edge(value[i] + reach)) for i in range(axes)]


def combinations(parts: dict[str, Column]) -> Column:
    """Array of structs: every choice of one element from each named array."""
    out, done = F.array(F.struct(F.lit(0).alias("_"))), []
    for name, part in parts.items():
        out = _extended(out, tuple(done), name, part)
        done.append(name)
    return out


def _extended(found: Column, done: tuple[str, ...], name: str, part: Column) -> Column:
    return F.flatten(F.transform(found, lambda t: F.transform(part, lambda x: F.struct(*[t[d].alias(d) for d in done], x.alias(name)))))


def dense_side(r: float, width: int) -> float:
    """Cell side with which any two points of a cell lie within r."""
    return r / math.sqrt(width) * (1 - SLACK)
