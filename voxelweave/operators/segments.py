"""Segment hypotheses: ends, continuations and branches between neighbouring sections.

segments(key, type, isi, sl, sr): isi i lies between sections i - 1 and i; sl and sr are the
slice ids on its two sides.  key is a text made of the type and the ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import likeness
from .numbering import numbered

LIKE = 0.5


def _ids(*cols) -> Column:
    return F.array(*(F.col(c) if isinstance(c, str) else c for c in cols))


NONE = "cast(array() as array<bigint>)"


def end_segments(slices: DataFrame) -> DataFrame:
    """Each slice may end to the right (interval after it) and to the left (interval before it)."""
    right = slices.select(F.concat_ws(":", F.lit("E"), "id", F.lit("R")).alias("key"), F.lit(0).alias("type"), (F.col("z") + 1).alias("isi"), _ids("id").alias("sl"), F.expr(NONE).alias("sr"))
    left = slices.select(F.concat_ws(":", F.lit("E"), "id", F.lit("L")).alias("key"), F.lit(0).alias("type"), F.col("z").alias("isi"), F.expr(NONE).alias("sl"), _ids("id").alias("sr"))
    return right.unionByName(left)


def continuations(pairs: DataFrame, like: float = LIKE) -> DataFrame:
    """Overlapping pairs with a likeness of at least `like`."""
    return pairs.withColumn("like", likeness("o", "a_sz", "b_sz")).where(F.col("like") >= like)


def continuation_segments(pairs: DataFrame, like: float = LIKE) -> DataFrame:
    c = continuations(pairs, like)
    return c.select(F.concat_ws(":", F.lit("C"), "a_id", "b_id").alias("key"), F.lit(1).alias("type"), (F.col("z") + 1).alias("isi"), _ids("a_id").alias("sl"), _ids("b_id").alias("sr"))


def min_partners(pairs: DataFrame, k: int, like: float = LIKE) -> DataFrame:
    """Continuations, and for slices with fewer than k of them the best of the rest until they have k, on both sides; adds `rank`s.

    Partners are sorted on both sides: more overlap first, then the larger id.
    """
    c = pairs.withColumn("like", likeness("o", "a_sz", "b_sz")).withColumn("ok", F.col("like") >= like)
    by = lambda s, t: F.row_number().over(W.partitionBy(s).orderBy(F.desc("ok"), F.desc("o"), F.desc(t)))
    return c.withColumn("a_rank", by("a_id", "b_id")).withColumn("b_rank", by("b_id", "a_id")).where(F.col("ok") | (F.col("a_rank") <= k) | (F.col("b_rank") <= k))


def branches(pairs: DataFrame, conflicts: DataFrame, to: str = "right", like: float = LIKE, ratio: float = 0.5) -> DataFrame:
    """source, t1 > t2, z, o, sizes and like of branches with two targets to the right (or left) that don't exclude each other."""
    s, t = ("a", "b") if to == "right" else ("b", "a")
    p = pairs.select(F.col(f"{s}_id").alias("source"), F.col(f"{t}_id").alias("t"), "z", "o", F.col(f"{s}_sz").alias("s_sz"), F.col(f"{t}_sz").alias("t_sz"))
    # what a second target can add at most: the source whole, or a target as large as `ratio` allows; pairs that fall short even then are in no branch
    best = F.col("o") + (F.least(F.col("s_sz").cast("double"), F.col("t_sz") / ratio) if ratio > 0 else F.col("s_sz"))
    p = p.where(best >= (like - 1e-9) * (F.col("s_sz") + F.col("t_sz") - F.col("o")))
    j = p.alias("p").join(p.alias("q"), (F.col("p.source") == F.col("q.source")) & (F.col("p.t") > F.col("q.t")))
    of = {c: F.coalesce(f"p.{c}", f"q.{c}").alias(c) for c in ("z", "s_sz")}  # p's; with all columns in use on both sides, pairs are shuffled once for both
    j = j.select("p.source", F.col("p.t").alias("t1"), F.col("q.t").alias("t2"), of["z"], (F.col("p.o") + F.col("q.o")).alias("o"), of["s_sz"], F.col("p.t_sz").alias("sz1"), F.col("q.t_sz").alias("sz2"))
    j = j.withColumn("like", likeness("o", "s_sz", "sz1", "sz2"))
    even = F.least("sz1", "sz2") / F.greatest("sz1", "sz2")
    return j.where((F.col("like") >= like) & (even >= ratio)).join(conflicts.select(F.col("a_id").alias("t2"), F.col("b_id").alias("t1")), ["t1", "t2"], "left_anti")


def branch_segments(pairs: DataFrame, conflicts: DataFrame, **options) -> DataFrame:
    out = []
    for to in ("right", "left"):
        b = branches(pairs, conflicts, to, **options)
        one, two = _ids("source"), _ids("t2", "t1")
        out.append(b.select(F.concat_ws(":", F.lit("B"), "source", "t2", "t1", F.lit(to[0].upper())).alias("key"), F.lit(2).alias("type"), (F.col("z") + 1).alias("isi"), (one if to == "right" else two).alias("sl"), (two if to == "right" else one).alias("sr")))
    return out[0].unionByName(out[1])


def all_segments(slices: DataFrame, pairs: DataFrame, conflicts: DataFrame, with_branches: bool = True) -> DataFrame:
    out = end_segments(slices).unionByName(continuation_segments(pairs))
    return out.unionByName(branch_segments(pairs, conflicts)) if with_branches else out


def members(segments: DataFrame) -> DataFrame:
    """key, id, is_left: a row for each slice of each segment."""
    side = lambda c, left: segments.select("key", "type", "isi", F.explode(c).alias("id"), F.lit(left).alias("is_left"))
    return side("sl", True).unionByName(side("sr", False))


def centers(segments: DataFrame, slices: DataFrame) -> DataFrame:
    """key, type, isi, cx, cy: size-weighted mean of the slices' centres, that is the mean place of all their pixels."""
    j = members(segments).join(slices.select("id", "sz", "sx", "sy"), "id")
    mean = lambda c: F.sum(c).cast("double") / F.sum("sz")
    return j.groupBy("key", "type", "isi").agg(mean("sx").alias("cx"), mean("sy").alias("cy"))


def segment_boxes(segments: DataFrame, slices: DataFrame) -> DataFrame:
    """key, type, isi and the box around the segment's slices."""
    j = members(segments).join(slices.select("id", "x0", "y0", "x1", "y1"), "id")
    return j.groupBy("key", "type", "isi").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def in_box(segments: DataFrame, slices: DataFrame, box: tuple[int, int, int, int, int, int]) -> DataFrame:
    """Segments with min.z <= isi <= max.z (both included) and a slice whose rectangle meets the box."""
    x0, y0, z0, x1, y1, z1 = box
    near = slices.where((F.col("x0") < x1) & (F.col("x1") > x0) & (F.col("y0") < y1) & (F.col("y1") > y0)).select("id")
    hit = members(segments.where(F.col("isi").between(z0, z1))).join(near, "id", "left_semi").select("key").distinct()
    return segments.join(hit, "key", "left_semi")


def required_slices(slices: DataFrame, cliques: DataFrame, x0: int, y0: int, x1: int, y1: int) -> DataFrame:
    """Ids of slices that meet the rectangle, and of all that share a clique (clique, id) with one of them."""
    near = slices.where((F.col("x0") < x1) & (F.col("x1") > x0) & (F.col("y0") < y1) & (F.col("y1") > y0)).select("id")
    touched = cliques.join(near, "id", "left_semi").select("clique").distinct()
    return near.union(cliques.join(touched, "clique", "left_semi").select("id")).distinct()


def grown_region(slices_in, requested: tuple[int, int, int, int], grid, rounds: int = 1000) -> tuple[DataFrame, tuple[int, int, int, int]]:
    """Ids of the slices that requested blocks (bx0, by0, bx1, by1; upper ones exclusive) need whole, and the blocks they were looked for in.

    slices_in(rectangle) gives (slices, cliques) as far as an image of that rectangle shows them.  The blocks are expanded by
    one; where a required slice touches a side of the rectangle, the blocks beyond that side are added, until no side moves.
    A required slice meets the requested blocks, or shares a clique with one that does.
    """
    (w, h, _), (ex, ey, _) = grid.block, grid.extent
    bound = (max(0, requested[0] - 1), max(0, requested[1] - 1), min(ex, requested[2] + 1), min(ey, requested[3] + 1))
    for _ in range(rounds):
        x0, y0, x1, y1 = bound[0] * w, bound[1] * h, bound[2] * w, bound[3] * h
        slices, cliques = slices_in((x0, y0, x1, y1))
        ids = required_slices(slices, cliques, requested[0] * w, requested[1] * h, requested[2] * w, requested[3] * h)
        side = slices.join(ids, "id", "left_semi").agg(F.min("x0"), F.min("y0"), F.max("x1"), F.max("y1")).first()
        if side[0] is None:
            return ids, bound
        grown = (max(0, bound[0] - (side[0] <= x0)), max(0, bound[1] - (side[1] <= y0)), min(ex, bound[2] + (side[2] >= x1)), min(ey, bound[3] + (side[3] >= y1)))
        if grown == bound:
            return ids, bound
        bound = grown
    raise RuntimeError(f"the region did not settle in {rounds} rounds")


def rank_continuations(pairs: DataFrame, slices: DataFrame) -> DataFrame:
    """Pairs with `place` (from 1) in their section: more overlap first, then nearer centres, then by ids."""
    from .masks import center

    s = slices.select("id", "sz", "sx", "sy")
    j = pairs.join(s.alias("a"), F.col("a_id") == F.col("a.id")).join(s.alias("b"), F.col("b_id") == F.col("b.id"))
    d2 = (center("x", "a") - center("x", "b")) ** 2 + (center("y", "a") - center("y", "b")) ** 2
    ranked = numbered(j.select(*pairs.columns, d2.alias("d2")), [F.desc("o"), "d2", "a_id", "b_id"], "place", groups=["z"])
    return ranked.withColumn("place", F.col("place") + 1)
