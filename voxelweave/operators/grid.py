"""Blocks and cores: cells of an even grid over the volume."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import div


def fraction(text: str) -> tuple[int, int]:
    """Numerator and denominator of "n/d"."""
    found = re.fullmatch(r"\s*(\d+)\s*/\s*(\d+)\s*", text)
    if not found or int(found[2]) == 0:
        raise ValueError(f"{text!r} is no fraction n/d")
    return int(found[1]), int(found[2])


def ceil_of(v: int, n: int, d: int) -> int:
    """v * n / d, rounded up."""
    return -(-v * n // d)


@dataclass(frozen=True)
class Grid:
    block: tuple[int, int, int]
    volume: tuple[int, int, int]
    core: tuple[int, int, int] = (1, 1, 1)

    @classmethod
    def of_fraction(cls, volume: tuple[int, int, int], block: str = "2/5", core: str = "1/1") -> "Grid":
        """Blocks of a fraction "n/d" of the volume in x and y, rounded up, and of half its depth and one section; cores of a fraction of the blocks."""
        n, d = fraction(block)
        size = (ceil_of(volume[0], n, d), ceil_of(volume[1], n, d), volume[2] // 2 + 1)
        n, d = fraction(core)
        return cls(size, volume, tuple(ceil_of(e, n, d) for e in (-(-v // b) for v, b in zip(volume, size))))

    @property
    def extent(self) -> tuple[int, int, int]:
        """Blocks along each axis."""
        return tuple(-(-v // b) for v, b in zip(self.volume, self.block))


def all_blocks(spark: SparkSession, g: Grid) -> DataFrame:
    nx, ny, nz = g.extent
    i = F.col("id")
    return spark.range(nx * ny * nz).select((i % nx).alias("bx"), (div(i, nx) % ny).alias("by"), div(i, nx * ny).alias("bz"))


def with_box(blocks: DataFrame, g: Grid) -> DataFrame:
    """Adds each block's box; it may stick out of the volume."""
    for a, n in zip("xyz", g.block):
        blocks = blocks.withColumn(f"min_{a}", F.col(f"b{a}") * n).withColumn(f"max_{a}", (F.col(f"b{a}") + 1) * n)
    return blocks


def core_box(cores: DataFrame, g: Grid) -> DataFrame:
    for a, n, m in zip("xyz", g.block, g.core):
        cores = cores.withColumn(f"min_{a}", F.col(f"c{a}") * (n * m)).withColumn(f"max_{a}", (F.col(f"c{a}") + 1) * (n * m))
    return cores


def block_at(x: Column, y: Column, z: Column, g: Grid) -> list[Column]:
    return [div(v, n).alias(f"b{a}") for v, n, a in zip((x, y, z), g.block, "xyz")]


def valid(g: Grid) -> Column:
    out = F.lit(True)
    for a, n in zip("xyz", g.extent):
        out = out & (F.col(f"b{a}") >= 0) & (F.col(f"b{a}") < n)
    return out


def blocks_in(boxes: DataFrame, g: Grid) -> DataFrame:
    """Blocks that each box (min_x .. max_z, upper bounds exclusive) touches, inside the volume; keeps the boxes' columns."""
    for a, n in zip("xyz", g.block):
        boxes = boxes.withColumn(f"b{a}", F.explode(F.sequence(div(F.col(f"min_{a}"), n), div(F.col(f"max_{a}") - 1, n))))
    return boxes.where(valid(g))


def slice_blocks(slices: DataFrame, g: Grid) -> DataFrame:
    """id, bx, by, bz: every block whose rectangle a slice's rectangle touches, in its section's layer."""
    boxes = slices.select("id", F.col("x0").alias("min_x"), F.col("x1").alias("max_x"), F.col("y0").alias("min_y"), F.col("y1").alias("max_y"), F.col("z").alias("min_z"), (F.col("z") + 1).alias("max_z"))
    return blocks_in(boxes, g).select("id", "bx", "by", "bz")


def expand(blocks: DataFrame, by: tuple[int, int, int], g: Grid) -> DataFrame:
    """Blocks and their neighbours up to `by` along each axis, corners included, inside the volume."""
    out = blocks.select("bx", "by", "bz")
    for a, k in zip("xyz", by):
        out = out.withColumn(f"b{a}", F.explode(F.sequence(F.col(f"b{a}") - k, F.col(f"b{a}") + k)))
    return out.where(valid(g)).distinct()


def core_blocks(cores: DataFrame, g: Grid, padding: int = 0) -> DataFrame:
    """cx, cy, cz, bx, by, bz: blocks of each core and of `padding` blocks around it."""
    out = cores.select("cx", "cy", "cz")
    for a, m in zip("xyz", g.core):
        out = out.withColumn(f"b{a}", F.explode(F.sequence(F.col(f"c{a}") * m - padding, (F.col(f"c{a}") + 1) * m - 1 + padding)))
    return out.where(valid(g))


def missing(requested: DataFrame, flags: DataFrame, flag: str) -> DataFrame:
    """Requested blocks whose flag isn't set, or that have none."""
    f = flags.select("bx", "by", "bz", F.col(flag).alias("__flag"))
    return requested.join(f, ["bx", "by", "bz"], "left").where(~F.coalesce("__flag", F.lit(False))).select("bx", "by", "bz")


def numbered(g: Grid) -> Column:
    """Number of the block bx, by, bz."""
    nx, ny, _ = g.extent
    return (F.col("bz") * ny + F.col("by")) * nx + F.col("bx")


def cores_grid(g: Grid) -> Grid:
    """The grid whose blocks are g's cores."""
    return Grid(tuple(b * m for b, m in zip(g.block, g.core)), g.volume)


def bounding_box(blocks: DataFrame, g: Grid) -> DataFrame:
    """One row, the box around blocks; of no blocks all are 0."""
    b = with_box(blocks, g)
    return b.agg(*(F.coalesce(f(f"{k}_{a}"), F.lit(0).cast("long")).alias(f"{k}_{a}") for a in "xyz" for k, f in (("min", F.min), ("max", F.max))))


def segment_blocks(segments: DataFrame, slices: DataFrame, g: Grid, padding: int = 0, name: str = "b") -> DataFrame:
    """key and the blocks that each segment (key, isi, sl, sr) belongs to: a slice's rectangle meets the block, or `padding` voxels (x, y, z) around it,
    and the interval is in the block's sections, both ends included.
    """
    pad = padding if isinstance(padding, tuple) else (padding,) * 3
    m = segments.select("key", "isi", F.explode(F.concat("sl", "sr")).alias("id")).join(slices.select("id", "x0", "y0", "x1", "y1"), "id")
    lo = {"x": F.col("x0") - pad[0], "y": F.col("y0") - pad[1]}
    hi = {"x": F.col("x1") + pad[0] - 1, "y": F.col("y1") + pad[1] - 1}
    for a, n, e in zip("xy", g.block, g.extent):
        m = m.withColumn(f"b{a}", F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), F.floor(lo[a] / n)), F.least(F.lit(e - 1).cast("long"), F.floor(hi[a] / n)))))
    n, e = g.block[2], g.extent[2]
    first, last = F.ceil((F.col("isi") - pad[2]) / n) - 1, F.floor((F.col("isi") + pad[2]) / n)
    m = m.withColumn("bz", F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), first), F.least(F.lit(e - 1).cast("long"), last))))
    return m.select("key", *(F.col(f"b{a}").alias(f"{name}{a}") for a in "xyz")).distinct()


def cell_of(side: int = 4) -> Column:
    """Name of the cell of side**3 blocks that the block bx, by, bz is in: what stored tables are partitioned by."""
    return F.concat(F.lit("c"), F.concat_ws("_", *(F.floor(F.col(f"b{a}") / side).cast("string") for a in "zyx")))


def home_of(g: Grid, side: int = 4) -> Column:
    """The cell of a slice's lower corner (x0, y0, z); the same whatever request it came by."""
    w, h, d = g.block
    return F.concat(F.lit("c"), F.concat_ws("_", *(F.floor(F.col(c) / (n * side)).cast("string") for c, n in (("z", d), ("y0", h), ("x0", w)))))
