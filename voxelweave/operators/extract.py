"""Slices and cliques out of images: a component tree of thresholds for each section.

A section is cut into tiles; a task labels one tile's regions at each threshold, and regions that meet at tiles' borders
are put together as connected components of a table, so no task sees a section.  Its joins are merged, as those of components are.  The tree's kernel is a choice of this package: foreground at each of `levels` thresholds, 4-connected
regions, a region's parent the region of the next lower threshold that holds it.  Regions
outside the size bounds leave the tree (their children move up), as do those above `height`
merges; equal regions on adjacent levels are one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import slice_hash
from .graph import components, dropped, leaf_paths, nearest_stop, settled


def regions(on: np.ndarray) -> np.ndarray:
    """Numbers (from 1) of the 4-connected regions of a mask; 0 outside.  Runs of rows joined by union-find."""
    h, w = on.shape
    out = np.zeros((h, w), np.int64)
    up = [0]

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for y in range(h):
        d = np.diff(np.concatenate([[0], on[y].astype(np.int8), [0]]))
        for a, b in zip(np.flatnonzero(d == 1), np.flatnonzero(d == -1)):
            near = {find(i) for i in np.unique(out[y - 1, a:b]).tolist() if i} if y else set()
            if near:
                i = min(near)
                for j in near:
                    up[j] = i
            else:
                i = len(up)
                up.append(i)
            out[y, a:b] = i
    roots = np.array([find(i) for i in range(len(up))])
    _, number = np.unique(roots, return_inverse=True)
    return number[out]


LOCAL = """node string, up string, z long, level int, size long, x0 long, y0 long, x1 long, y1 long, sx long, sy long,
    border array<struct<axis: int, line: long, along: long, low: boolean>>, runs array<struct<y: long, x0: long, x1: long>>"""


def _ends(ys: np.ndarray, xs: np.ndarray) -> np.ndarray:
    """Where runs of pixels, in the order of y and x, start."""
    return np.flatnonzero(np.concatenate([[True], (np.diff(ys) != 0) | (np.diff(xs) != 1)]))


def _of_tile(pdf: pd.DataFrame, side: int, thresholds: np.ndarray) -> pd.DataFrame:
    """Regions of a tile at each threshold, each with the region of the next lower one that holds it, and its pixels at the tile's borders."""
    z, tx, ty = (int(pdf[c].iloc[0]) for c in ("z", "tx", "ty"))
    ox, oy = tx * side, ty * side
    image = np.full((side, side), -np.inf)
    image[pdf["y"] - oy, pdf["x"] - ox] = pdf["value"]
    out, below = [], None
    for level, value in enumerate(thresholds):
        lab = regions(image > value)
        order = np.argsort(lab, axis=None, kind="stable")
        name = lambda lev, k: f"{z}:{ty}:{tx}:{lev}:{k}"
        for k, at in enumerate(np.split(order, np.cumsum(np.bincount(lab.ravel()))[:-1])[1:], 1):
            ys, xs = np.divmod(at, side)
            border = []
            for axis, line, along in ((0, xs, ys), (1, ys, xs)):  # a border is named by its first line behind it
                for edge, low in ((side - 1, True), (0, False)):
                    border += [(axis, (ox, oy)[axis] + (side if low else 0), int(v) + (oy, ox)[axis], low) for v in along[line == edge]]
            cut = _ends(ys, xs)
            runs = [(int(ys[a]) + oy, int(xs[a]) + ox, int(xs[b - 1]) + ox + 1) for a, b in zip(cut, [*cut[1:], len(ys)])]
            up = name(level - 1, below[ys[0], xs[0]]) if below is not None else None
            box = (int(xs.min()) + ox, int(ys.min()) + oy, int(xs.max()) + ox + 1, int(ys.max()) + oy + 1)
            out.append((name(level, k), up, z, level, len(ys), *box, int(xs.sum()) + len(xs) * ox, int(ys.sum()) + len(ys) * oy, border, runs))
        below = lab
    return pd.DataFrame(out, columns=["node", "up", "z", "level", "size", "x0", "y0", "x1", "y1", "sx", "sy", "border", "runs"])


@dataclass
class Sections:
    """What extraction gives: slices (id, z, value, size, box, sx, sy, parent; null at a root), their runs (id, z, y, x0, x1), and cliques (clique, id, depth)."""

    slices: DataFrame
    runs: DataFrame
    cliques: DataFrame


def merged_regions(pixels: DataFrame, thresholds: list[float], side: int) -> tuple[DataFrame, DataFrame]:
    """Regions (region, up, z, level, size, box, sx, sy) of whole sections at each threshold, and the parts they are made of (node, region, z, runs)."""
    levels = np.asarray(thresholds)
    tile = lambda c: F.floor(F.col(c) / side).cast("long")
    seen = pixels.where(F.col("value") > float(levels.min())).select("z", "y", "x", "value", tile("x").alias("tx"), tile("y").alias("ty"))
    local = settled(seen.groupBy("z", "ty", "tx").applyInPandas(lambda pdf: _of_tile(pdf, side, levels), LOCAL))
    edge = local.select("node", "z", "level", F.inline("border"))
    on = ["z", "level", "axis", "line", "along"]
    met = edge.where("low").select(*on, F.col("node").alias("a")).join(edge.where(~F.col("low")).select(*on, F.col("node").alias("b")).hint("merge"), on)
    joined = components(met.select("a", "b").distinct())
    part = local.join(joined.withColumnRenamed("id", "node").hint("merge"), "node", "left").withColumn("region", F.coalesce("component", "node"))
    part = settled(part.drop("component", "border"))
    box = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
    whole = part.groupBy("region", "z", "level").agg(F.sum("size").alias("size"), *box, F.sum("sx").alias("sx"), F.sum("sy").alias("sy"), F.min("up").alias("part_up"))
    above = part.select(F.col("node").alias("part_up"), F.col("region").alias("up"))
    whole = settled(whole.join(above.hint("merge"), "part_up", "left").drop("part_up"))
    dropped(local)
    return whole, part.select("node", "region", "z", "runs")


def sections(pixels: DataFrame, levels: int = 8, least: int = 10, most: int = 10_000, height: int = 3, side: int = 256, downsample: bool = False, dark: bool = False) -> Sections:
    """Slices, runs and cliques of sections given as pixels (z, y, x, value from 0 to 1), whose coordinates may be negative.

    The result doesn't depend on `side`, the tiles' width and height.  downsample: a region that is the only one in its
    parent leaves the tree, its children move up.  dark: slices are dark on bright ground.  A slice's id is a hash of
    its section and its runs.  Rows with a null take no part; of several values of a pixel the largest counts.
    """
    value = (1 - F.col("value")) if dark else F.col("value")
    clean = pixels.select("z", "y", "x", value.alias("value")).dropna().groupBy("z", "y", "x").agg(F.max("value").alias("value"))
    thresholds = ((np.arange(levels) + 0.5) / levels).tolist()
    whole, part = merged_regions(clean, thresholds, side)
    # one region at several thresholds is one node, the lowest; its value is the highest of them
    size_of = whole.select(F.col("region").alias("up"), F.col("size").alias("up_size"))
    known = whole.join(size_of.hint("merge"), "up", "left")
    fits = F.col("size").between(least, most)
    stops = fits & (F.col("up_size").isNull() | (F.col("up_size") != F.col("size")))
    near = nearest_stop(known.select(F.col("region").alias("node"), "up", stops.alias("stops")))
    named = known.join(near.withColumnRenamed("node", "region").hint("merge"), "region")
    top = named.where(F.col("stop") == F.col("region"))
    same = whole.select(F.col("region").alias("stop"), F.col("size").alias("stop_size"))
    level = named.join(same.hint("merge"), "stop").where("size = stop_size").groupBy(F.col("stop").alias("region")).agg(F.max("level").alias("last"))
    parent = near.select(F.col("node").alias("up"), F.col("stop").alias("parent"))
    nodes = settled(top.drop("stop", "up_size", "level").join(level.hint("merge"), "region").join(parent.hint("merge"), "up", "left").drop("up"))
    links = nodes.select(F.col("region").alias("node"), F.col("parent"))
    if downsample:
        n = links.where("parent is not null").groupBy("parent").agg(F.count("*").alias("children"))
        single = links.join(n.hint("merge"), "parent", "left").select("node", F.col("parent").alias("up"), (F.coalesce("children", F.lit(0)) != 1).alias("stops"))
        up = nearest_stop(single)
        links = links.join(up.select(F.col("node").alias("parent"), F.col("stop").alias("kept")).hint("merge"), "parent", "left").select("node", F.col("kept").alias("parent"))
        links = settled(links.join(up.where("stop = node").select("node").hint("merge"), "node", "left_semi"))
    paths = settled(leaf_paths(links))
    tall = paths.groupBy("clique").agg(F.max("depth").alias("last"))
    rise = paths.join(tall.hint("merge"), "clique").groupBy("node").agg(F.max(F.col("last") - F.col("depth")).alias("rise"))
    kept = rise.where(F.col("rise") < height).select(F.col("node").alias("region"))
    kept = settled(kept.join(links.select(F.col("node").alias("region"), "parent").hint("merge"), "region").join(nodes.drop("parent").hint("merge"), "region"))
    lines = joined_runs(part.join(kept.select("region").hint("merge"), "region", "left_semi").select("region", "z", F.inline("runs")))
    runs = lines.groupBy("region", "z").agg(F.sort_array(F.collect_list(F.struct("y", "x0", "x1"))).alias("runs"))  # at most `most` pixels
    runs = runs.withColumn("id", slice_hash(F.array_join(F.transform("runs", _run_text), ","), "z"))
    ids = settled(runs.select("region", "id", "z", "runs"))
    name = ids.select("region", "id")
    value = ((F.col("last") + 0.5) / levels).alias("value")
    box = ["size", "x0", "y0", "x1", "y1", "sx", "sy"]
    slices = kept.join(name.hint("merge"), "region").join(name.select(F.col("region").alias("parent"), F.col("id").alias("__up")).hint("merge"), "parent", "left").select("id", "z", value, *box, F.col("__up").alias("parent"))
    held = paths.join(name.withColumnRenamed("region", "node").hint("merge"), "node").join(name.select(F.col("region").alias("clique"), F.col("id").alias("leaf")).hint("merge"), "clique")
    first = held.groupBy("leaf").agg(F.min("depth").alias("first"))
    cliques = held.join(first.hint("merge"), "leaf").select(F.col("leaf").alias("clique"), "id", (F.col("depth") - F.col("first")).alias("depth"))
    return Sections(slices, ids.select("id", "z", F.inline("runs")), cliques)


def _run_text(r: Column) -> Column:
    return F.concat(r["y"].cast("string"), F.lit(":"), r["x0"].cast("string"), F.lit("-"), r["x1"].cast("string"))


def joined_runs(runs: DataFrame) -> DataFrame:
    """Runs (region, z, y, x0, x1) with those that touch, as at tiles' borders, put together."""
    line = W.partitionBy("region", "z", "y").orderBy("x0")
    starts = runs.withColumn("new", F.coalesce(F.lag("x1").over(line) < F.col("x0"), F.lit(True)).cast("int"))
    numbered = starts.withColumn("n", F.sum("new").over(line))
    return numbered.groupBy("region", "z", "y", "n").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("n")
