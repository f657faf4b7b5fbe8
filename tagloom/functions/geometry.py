"""Box expressions. Boxes are x0, y0, x1, y1 with the origin bottom-left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tagloom.functions.numbers import half_even

#: Sides of the square cells of each level; a box belongs to the first level whose cells are at least as large as it is.
CELL_SIDES = (32.0, 128.0, 512.0, 2048.0, 16384.0)


def area(prefix: str = "") -> Column:
    return F.abs((F.col(prefix + "x1") - F.col(prefix + "x0")) * (F.col(prefix + "y1") - F.col(prefix + "y0")))


def contains(prefix: str, x: Column, y: Column, tolerance: float = 0.0) -> Column:
    return (x.between(F.col(prefix + "x0") - tolerance, F.col(prefix + "x1") + tolerance)
            & y.between(F.col(prefix + "y0") - tolerance, F.col(prefix + "y1") + tolerance))


def cover(a: str, b: str) -> Column:
    """Share of box ``a`` under box ``b``; touching edges share nothing."""
    ix = F.least(a + "x1", b + "x1") - F.greatest(a + "x0", b + "x0")
    iy = F.least(a + "y1", b + "y1") - F.greatest(a + "y0", b + "y0")
    return F.when((ix <= 0) | (iy <= 0), 0.0).otherwise(ix * iy / F.greatest(area(a), F.lit(1e-6)))


def band_of(y: Column, size: float) -> Column:
    return F.floor(y / size)


def _cell(level: int, x: Column, y: Column) -> Column:
    """One number per cell; should two cells far apart share one, the exact test that follows tells them apart."""
    return F.shiftleft(x.cast("long"), 33) + y.cast("long") * len(CELL_SIDES) + level


def with_box_cells(df: DataFrame, prefix: str = "", tolerance: float = 0.0) -> DataFrame:
    """One row per cell of its level that a box touches, at most four for boxes up to the largest side.

    Together with ``with_point_cells`` this gives point-in-box joins a key in both directions: a point meets the boxes
    of each level in one cell, so only boxes near it and, level by level, of like size.
    """
    x0, y0, x1, y1 = (F.col(prefix + c) for c in ("x0", "y0", "x1", "y1"))
    size = F.greatest(x1 - x0, y1 - y0) + 2 * tolerance

    def cells(level: int) -> Column:
        side = CELL_SIDES[level]

        def reach(low: Column, high: Column) -> Column:
            first = F.floor((low - tolerance) / side)
            return F.sequence(first, F.greatest(first, F.floor((high + tolerance) / side)))
        return F.flatten(F.transform(reach(x0, x1), lambda x: F.transform(reach(y0, y1), lambda y: _cell(level, x, y))))

    of_size = F.when(size <= CELL_SIDES[0], cells(0))
    for level, side in enumerate(CELL_SIDES[1:-1], 1):
        of_size = of_size.when(size <= side, cells(level))
    return df.withColumn("_cell", F.explode(of_size.otherwise(cells(len(CELL_SIDES) - 1))))


def box_level(prefix: str = "", tolerance: float = 0.0) -> Column:
    """The level a box belongs to, as ``with_box_cells`` sees it."""
    size = F.greatest(F.col(prefix + "x1") - F.col(prefix + "x0"), F.col(prefix + "y1") - F.col(prefix + "y0")) + 2 * tolerance
    level = F.when(size <= CELL_SIDES[0], 0)
    for number, side in enumerate(CELL_SIDES[1:-1], 1):
        level = level.when(size <= side, number)
    return level.otherwise(len(CELL_SIDES) - 1)


def with_point_cells(df: DataFrame, x: Column, y: Column, levels: Column | None = None) -> DataFrame:
    """One row per level, or per level in the array ``levels``: the cell a point lies in."""
    cells = [_cell(level, F.floor(x / side), F.floor(y / side)) for level, side in enumerate(CELL_SIDES)]
    if levels is not None:
        cells = [F.when(F.array_contains(levels, level), cell) for level, cell in enumerate(cells)]
    return df.withColumn("_cell", F.explode(F.array(*cells))).filter(F.col("_cell").isNotNull())


def flip(y0: Column, y1: Column, page_height: Column) -> tuple[Column, Column]:
    """Bottom-left y range of a top-left one, and the other way round."""
    return page_height - y1, page_height - y0


def fraction_box(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> list[Column]:
    """Fractions of the page (top-left origin), clamped, to points (bottom-left origin)."""
    def clamp(c: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    return [half_even(clamp(x0) * width, 2), half_even((1.0 - clamp(y1)) * height, 2),
            half_even(clamp(x1) * width, 2), half_even((1.0 - clamp(y0)) * height, 2)]


def prefixed(df: DataFrame, prefix: str, *keep: str) -> DataFrame:
    """Box columns under a prefix beside the columns to keep."""
    return df.select(*keep, *[F.col(c).alias(prefix + c) for c in ("x0", "y0", "x1", "y1")])
