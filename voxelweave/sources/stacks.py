"""Stacks: scans by section, crops, tiles and their addresses, configuration, weights.

The pixel table is (z, y, x, value), stored by z, so that a section is a partition and a crop
is a pushed-down range.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import div


class UsageError(ValueError):
    pass


class NoImage(RuntimeError):
    pass


@dataclass(frozen=True)
class StackDescription:
    width: int = 0
    height: int = 0
    depth: int = 0
    resolution: tuple[float, float, float] = (1.0, 1.0, 1.0)
    scale: int = 0
    base: str = ""
    extension: str = "png"
    tile: tuple[int, int] = (256, 256)
    source_type: int = 1


@dataclass(frozen=True)
class ProjectConfiguration:
    """Grid, weights and backend; a dataclass, so it pickles whole."""

    backend: str = "parquet"
    path: str = ""
    block: tuple[int, int, int] = (256, 256, 10)
    core: tuple[int, int, int] = (1, 1, 1)
    volume: tuple[int, int, int] = (0, 0, 0)
    weights: tuple[float, ...] = ()
    stacks: dict[str, StackDescription] = field(default_factory=dict)


def section_range(pixels: DataFrame, z0: int, z1: int) -> DataFrame:
    """Sections z0 <= z < z1."""
    return pixels.where((F.col("z") >= z0) & (F.col("z") < z1))


def crop(pixels: DataFrame, x0: int, y0: int, x1: int, y1: int) -> DataFrame:
    """Pixels in the box; nothing outside the image is made up."""
    return pixels.where((F.col("x") >= x0) & (F.col("x") < x1) & (F.col("y") >= y0) & (F.col("y") < y1))


def require_image(pixels: DataFrame) -> DataFrame:
    if not pixels.take(1):
        raise NoImage("the request has no pixels")
    return pixels


def numbered_files(spark: SparkSession, paths: str | list[str], pattern: str = "*") -> DataFrame:
    """source (the folder's name), z, path of the files of folders, in order of their names; z counts within each.  Only names are gathered, no contents."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(paths).select("path")
    name = F.regexp_extract("path", r"/([^/]+)/[^/]+$", 1)
    return files.withColumn("source", name).withColumn("z", (F.row_number().over(W.partitionBy("source").orderBy("path")) - 1).cast("long")).select("source", "z", "path")


def directory_sections(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """z, path, content of the files of a directory, in order of their names."""
    content = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")
    return content.join(numbered_files(spark, path, pattern).select("z", "path"), "path").select("z", "path", "content")


def directories(spark: SparkSession, paths: list[str]) -> DataFrame:
    """source, z, content of several directories of sections; z counts within each."""
    content = spark.read.format("binaryFile").load(paths).select("path", "content")
    return content.join(numbered_files(spark, paths), "path").select("source", "z", "content")


def tiles_of(request: DataFrame, tile: tuple[int, int]) -> DataFrame:
    """Columns and rows of tiles that a request (x0, y0, x1, y1) touches, with source and destination offsets of each."""
    w, h = tile
    c = F.explode(F.sequence(div(F.col("x0"), w), div(F.col("x1") - 1, w)))
    r = F.explode(F.sequence(div(F.col("y0"), h), div(F.col("y1") - 1, h)))
    t = request.withColumn("col", c).withColumn("row", r)
    return (
        t.withColumn("beg_x", F.greatest(F.col("x0") - F.col("col") * w, F.lit(0).cast("long")))
        .withColumn("end_x", F.least(F.col("x1") - F.col("col") * w, F.lit(w).cast("long")))
        .withColumn("dst_x", F.greatest(F.col("col") * w - F.col("x0"), F.lit(0).cast("long")))
        .withColumn("beg_y", F.greatest(F.col("y0") - F.col("row") * h, F.lit(0).cast("long")))
        .withColumn("end_y", F.least(F.col("y1") - F.col("row") * h, F.lit(h).cast("long")))
        .withColumn("dst_y", F.greatest(F.col("row") * h - F.col("y0"), F.lit(0).cast("long")))
    )


def tile_url(kind: int, base: str, ext: str, scale: int, tile: tuple[int, int], z, row, col) -> Column:
    """Address of a tile.  The five kinds are the tile source conventions 1, 4, 5, 6 and 8."""
    s = lambda c: (F.col(c) if isinstance(c, str) else c).cast("string")
    z, r, c = s(z), s(row), s(col)
    w, h = tile
    b, e, k = F.lit(base), F.lit(f".{ext}"), F.lit(str(scale))
    t = F.lit("/")
    u = F.lit("_")
    if kind == 1:
        return F.concat(b, z, t, r, u, c, u, k, e)
    if kind == 4:
        return F.concat(b, z, t, k, t, r, u, c, e)
    if kind == 5:
        return F.concat(b, k, t, z, t, r, t, c, e)
    if kind == 6:  # addressed by pixels
        px, py = (F.col(col) if isinstance(col, str) else col) * w, (F.col(row) if isinstance(row, str) else row) * h
        return F.concat(b, F.lit(f"{w}_{h}"), t, s(px), u, s(py), u, z, t, F.lit(ext))
    if kind == 8:
        return F.concat(b, F.lit("xy/"), k, t, c, u, r, u, z)
    raise NotImplementedError(f"tile source type {kind}")


def fetch_tiles(tiles: DataFrame, fetch, required: bool) -> DataFrame:
    """Reads each tile's pixels by `fetch(url) -> (rows, columns) array or None` on the executors.

    tiles: url and the columns of tiles_of with z.  A missing tile is empty, or an error if the stack must be whole.
    """
    import numpy as np
    import pandas as pd

    def run(batches):
        for b in batches:
            for t in b.itertuples():
                image = fetch(t.url)
                if image is None:
                    if required:
                        raise NoImage(t.url)
                    continue
                part = image[t.beg_y : t.end_y, t.beg_x : t.end_x]
                y, x = np.indices(part.shape)
                yield pd.DataFrame({"z": t.z, "y": (y + t.y0 + t.dst_y).ravel(), "x": (x + t.x0 + t.dst_x).ravel(), "value": part.ravel().astype(float)})

    return tiles.mapInPandas(run, "z long, y long, x long, value double")


def check_volume(stack: StackDescription, volume: tuple[int, int, int], block: tuple[int, int, int]) -> None:
    """The stack at its scale must be the configured volume, up to a block."""
    have = (stack.width >> stack.scale, stack.height >> stack.scale, stack.depth)
    for a, v, b in zip(have, volume, block):
        if not v - b < a < v + b:
            raise UsageError(f"stack {have} and volume {volume} differ by a block or more")


def stack_table(stack: DataFrame, project_stack: DataFrame, segmentation_stack: DataFrame, grid: DataFrame) -> DataFrame:
    """Stack descriptions with their grids: dimension '(w,h,d)' taken apart, volume = blocks times block size, depth not over the stack's."""
    n = lambda k: F.regexp_extract("dimension", r"\((\d+),(\d+),(\d+)\)", k).cast("long")
    got = segmentation_stack.join(project_stack, "project_stack_id").join(stack, "stack_id").join(grid, "configuration_id")
    return got.select(
        "type", "stack_id", n(1).alias("width"), n(2).alias("height"), n(3).alias("depth"),
        (F.col("num_x") * F.col("block_x")).alias("volume_x"), (F.col("num_y") * F.col("block_y")).alias("volume_y"),
        F.least(F.col("num_z") * F.col("block_z"), n(3)).alias("volume_z"),
    )


def weights_of(table: DataFrame, configuration: int, size: int | None = None) -> list[float]:
    """The feature weights (configuration_id, weights array) of a configuration, which must be there, and of `size` if given."""
    rows = table.where(F.col("configuration_id") == configuration).select("weights").limit(2).collect()
    if len(rows) != 1:
        raise UsageError(f"{'no' if not rows else 'several'} weights for configuration {configuration}")
    if size is not None and len(rows[0].weights) != size:
        raise UsageError(f"{len(rows[0].weights)} weights, {size} features")
    return [float(w) for w in rows[0].weights]


def read_weights(spark: SparkSession, path: str) -> list[float]:
    """Numbers of a small text file, in order."""
    rows = spark.read.text(path, wholetext=True).collect()
    return [float(x) for r in rows for x in r.value.split()]
