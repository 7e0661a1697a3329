"""Feature vectors of segments, in a fixed order: 16 of geometry, 40 of histograms, 3 of type.

0 end size; 1 squared centre distance; 2, 3 set difference and its ratio; 4, 5 the same aligned;
6 mean size; 7 size difference; 8, 9 overlap and its ratio; 10, 11 aligned overlap and its ratio;
12, 13 mean and largest distance; 14, 15 the same aligned; 16-25 and 26-35 an end's histogram and
normalised histogram; 36-45 and 46-55 a continuation's or branch's differences of them, where both
targets of a branch count as one; 56-58 type.  What a type doesn't have is 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import abs_difference, bin_of, normalised
from .masks import distances, moved_overlap

NAMES = (
    ["e size", "center distance", "set difference", "set difference ratio", "aligned set difference", "aligned set difference ratio", "size", "absolute size difference", "overlap", "overlap ratio", "aligned overlap", "aligned overlap ratio"]
    + ["average slice distance", "max slice distance", "aligned average slice distance", "aligned max slice distance"]
    + [f"{k} {i}" for k in ("e histogram", "e normalized histogram", "c&b histogram", "c&b normalized histogram") for i in range(10)]
    + ["is end", "is continuation", "is branch"]
)
BINS = 10


def relations(segments: DataFrame) -> DataFrame:
    """key, type, s, t1, t2 (null in continuations): source and targets of segments that aren't ends; a branch's source is its single slice."""
    one = F.size("sl") == 1
    s, t = F.when(one, F.col("sl")).otherwise(F.col("sr")), F.when(one, F.col("sr")).otherwise(F.col("sl"))
    r = segments.where("type > 0").select("key", "type", s.alias("s"), F.array_sort(t).alias("t"))
    return r.select("key", "type", F.col("s")[0].alias("s"), F.element_at("t", -1).alias("t1"), F.when(F.size("t") > 1, F.col("t")[0]).alias("t2"))


def geometry(rel: DataFrame, slices: DataFrame, runs: DataFrame, pairs: DataFrame) -> DataFrame:
    """rel with dx, dy (whole pixels from the targets' centre to the source's) and f1 to f11; both targets of a branch count as one."""
    part = lambda k: slices.select(F.col("id").alias(k), *(F.col(c).alias(f"{k}_{c}") for c in ("sz", "sx", "sy")))
    j = rel.join(part("s"), "s").join(part("t1"), "t1").join(part("t2"), "t2", "left")
    for c in ("sz", "sx", "sy"):
        j = j.withColumn(f"t_{c}", F.col(f"t1_{c}") + F.coalesce(f"t2_{c}", F.lit(0).cast("long")))
    gap = {k: F.col(f"s_s{k}").cast("double") / F.col("s_sz") - F.col(f"t_s{k}").cast("double") / F.col("t_sz") for k in "xy"}
    j = j.select(*rel.columns, "s_sz", "t_sz", (gap["x"] * gap["x"] + gap["y"] * gap["y"]).alias("f1"), *(gap[k].cast("long").alias(f"d{k}") for k in "xy"))
    edge = j.select("key", "dx", "dy", F.col("s").alias("a_id"), F.explode(F.filter(F.array("t1", "t2"), lambda t: t.isNotNull())).alias("b_id"))
    both = pairs.select("a_id", "b_id", "o").unionByName(pairs.select(F.col("b_id").alias("a_id"), F.col("a_id").alias("b_id"), "o"))
    plain = edge.join(both, ["a_id", "b_id"], "left").groupBy("key").agg(F.coalesce(F.sum("o"), F.lit(0).cast("long")).alias("o"))
    moved = moved_overlap(edge, runs).groupBy("key").agg(F.sum("moved").alias("al"))
    j = j.join(plain, "key").join(moved, "key")
    t, o, al = F.col("s_sz") + F.col("t_sz"), F.col("o"), F.col("al")
    d = lambda c: c.cast("double")
    return j.select(
        *rel.columns, "dx", "dy", "f1", d(t - 2 * o).alias("f2"), (d(t - 2 * o) / t).alias("f3"), d(t - 2 * al).alias("f4"), (d(t - 2 * al) / t).alias("f5"),
        (d(t) / F.when(F.col("type") == 1, 2).otherwise(3)).alias("f6"), d(F.abs(F.col("s_sz") - F.col("t_sz"))).alias("f7"), d(o).alias("f8"), (d(o) / F.greatest(t - o, F.lit(1))).alias("f9"),
        d(al).alias("f10"), (d(al) / F.greatest(t - F.when(F.col("type") == 1, o).otherwise(al), F.lit(1))).alias("f11"),  # a continuation's is over the plain overlap's union
    )


def histograms(values: DataFrame, bins: int = 10) -> DataFrame:
    """id, h (array of counts) of values (id, value): one pass, combined before the shuffle."""
    b = bin_of("value", bins)
    return values.groupBy("id").agg(*(F.sum((b == k).cast("long")).alias(f"h{k}") for k in range(bins))).select("id", F.array(*(f"h{k}" for k in range(bins))).alias("h"))


def histogram_differences(rel: DataFrame, hist: DataFrame, bins: int = BINS) -> DataFrame:
    """key, d and dn: absolute differences of the source's and the targets' summed histograms, and of the normalised ones.

    The slices of all sides are rows of one table, so histograms are made and joined once.
    """
    part = lambda c, k: F.struct(F.col(c).alias("id"), F.lit(k).alias("side"))
    parts = F.array(part("s", "a"), part("t1", "b"), part("t2", "b"))
    j = rel.select("key", F.explode(F.filter(parts, lambda x: x["id"].isNotNull() | (x["side"] == "a"))).alias("p")).select("key", "p.id", "p.side")
    j = j.join(hist.select("id", "h"), "id", "left")
    total = lambda side, k: F.coalesce(F.sum(F.when(F.col("side") == side, F.col("h")[k])), F.lit(0).cast("long")).alias(f"{side}{k}")
    g = j.groupBy("key").agg(*(total(side, k) for side in "ab" for k in range(bins)))
    g = g.select("key", *(F.array(*(f"{side}{k}" for k in range(bins))).alias(side) for side in "ab"))
    a, b = F.col("a"), F.col("b")
    return g.select("key", abs_difference(a, b).alias("d"), abs_difference(normalised(a), normalised(b)).alias("dn"))


def vector(segments: DataFrame, slices: DataFrame, runs: DataFrame, pairs: DataFrame, hist: DataFrame, cap: float = 50.0) -> DataFrame:
    """key, type, features (array of 59) of every segment (pairs: overlaps of neighbouring sections; hist: id, h)."""
    zeros = lambda n: F.array_repeat(F.lit(0.0), n)
    real = lambda c: F.transform(c, lambda x: x.cast("double"))
    kind = F.array(*((F.col("type") == k).cast("double") for k in range(3)))
    ends = segments.where("type = 0").select("key", "type", F.coalesce(F.get("sl", F.lit(0)), F.get("sr", F.lit(0))).alias("id")).join(slices.select("id", "sz"), "id").join(hist, "id", "left")
    ends = ends.withColumn("h", F.coalesce("h", F.array_repeat(F.lit(0).cast("long"), BINS)))
    ends = ends.select("key", "type", F.concat(F.array(F.col("sz").cast("double")), zeros(15), real("h"), normalised(F.col("h")), zeros(2 * BINS), kind).alias("features"))
    rel = geometry(relations(segments), slices, runs, pairs)
    far = distances(rel.select("key", "s", "t1", "t2", (-F.col("dx")).alias("dx"), (-F.col("dy")).alias("dy")), runs, cap)
    both = rel.join(far, "key").join(histogram_differences(rel, hist), "key")
    both = both.select("key", "type", F.concat(zeros(1), F.array(*(f"f{k}" for k in range(1, 16))), zeros(2 * BINS), real("d"), F.col("dn"), kind).alias("features"))
    return ends.unionByName(both)
