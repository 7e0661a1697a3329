"""Spatial joins of boxes and points; masks are joined in operators.masks.

Boxes are dealt to grid cells, so that each is an equi-join on (section, cell).

A pair that meets in several cells is kept in one: that of the larger lower corner.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import div, intersects

CELL = 32


def in_cells(boxes: DataFrame, cell: int = CELL) -> DataFrame:
    """Boxes once for every cell they touch."""
    return boxes.withColumn("cx", F.explode(F.sequence(div(F.col("x0"), cell), div(F.col("x1") - 1, cell)))).withColumn("cy", F.explode(F.sequence(div(F.col("y0"), cell), div(F.col("y1") - 1, cell))))


def box_join(a: DataFrame, b: DataFrame, dz: int = 0, cell: int = CELL) -> DataFrame:
    """Rows (aliases a, b) of boxes that overlap, b in section a.z + dz."""
    left, right = in_cells(a, cell).withColumn("on_z", F.col("z") + dz).alias("a"), in_cells(b, cell).alias("b")
    home = (F.col("a.cx") == div(F.greatest("a.x0", "b.x0"), cell)) & (F.col("a.cy") == div(F.greatest("a.y0", "b.y0"), cell))
    return left.join(right, (F.col("a.on_z") == F.col("b.z")) & (F.col("a.cx") == F.col("b.cx")) & (F.col("a.cy") == F.col("b.cy")) & intersects("a", "b") & home)


def exceeds(pairs: DataFrame, least: int) -> DataFrame:
    """Pairs with more than `least` pixels in common; the slices' sizes, which bound that, are looked at first."""
    return pairs.where((F.least("a_sz", "b_sz") > least) & (F.col("o") > least))


def radius_join(points: DataFrame, radius: float, keys: tuple[str, ...] = ("z",), squared: bool = True) -> DataFrame:
    """Pairs a_id < b_id of points (id, cx, cy and keys) nearer than `radius`.

    squared: the squared distance is compared with the radius as it is; else the distance is.
    """
    reach = radius**0.5 if squared else radius
    cell = max(1.0, reach)
    p = points.withColumn("gx", F.floor(F.col("cx") / cell)).withColumn("gy", F.floor(F.col("cy") / cell))
    near = p.withColumn("gx", F.explode(F.sequence(F.col("gx") - 1, F.col("gx") + 1))).withColumn("gy", F.explode(F.sequence(F.col("gy") - 1, F.col("gy") + 1)))
    cond: Column = (F.col("a.gx") == F.col("b.gx")) & (F.col("a.gy") == F.col("b.gy")) & (F.col("a.id") < F.col("b.id"))
    for k in keys:
        cond = cond & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    d2 = (F.col("a.cx") - F.col("b.cx")) ** 2 + (F.col("a.cy") - F.col("b.cy")) ** 2
    j = p.alias("a").join(near.alias("b"), cond & (d2 < (radius if squared else radius**2)))
    return j.select(F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"), *(F.col(f"a.{k}").alias(k) for k in keys), d2.alias("d2"))
