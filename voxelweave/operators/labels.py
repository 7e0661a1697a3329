"""Label volumes, edits, ground truth, and text dumps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import masks
from .graph import components, forest, settled


def paint(runs: DataFrame, assembly_of: DataFrame) -> DataFrame:
    """z, y, x0, x1, label: each pixel run of each slice with its assembly; where runs meet, the larger label wins (see `pixels`)."""
    return runs.join(assembly_of, "id").select("z", "y", "x0", "x1", F.col("assembly").alias("label"))


def pixels(painted: DataFrame) -> DataFrame:
    """z, y, x, label of every painted pixel; background has none."""
    p = painted.withColumn("x", F.explode(F.sequence(F.col("x0"), F.col("x1") - 1)))
    return p.groupBy("z", "y", "x").agg(F.max("label").alias("label"))


def visible_runs(painted: DataFrame, tile: int = 64) -> DataFrame:
    """z, y, x0, x1, label: the painted volume as disjoint runs, none longer than `tile`; at each pixel the largest label.

    Places are not negative.  Lines are cut into tiles and tiles where a run starts or ends, so a run meets at most `tile`
    stretches of each, and seldom more than a few; all steps share the key (z, y, tile).
    """
    key = ["z", "y", "tile"]
    t = painted.withColumn("tile", F.explode(F.sequence(F.expr(f"x0 div {tile}"), F.expr(f"(x1 - 1) div {tile}"))))
    t = t.select(*key, "label", F.greatest("x0", F.col("tile") * tile).alias("a"), F.least("x1", (F.col("tile") + 1) * tile).alias("b")).repartition(*key)
    cuts = t.select(*key, F.explode(F.array("a", "b")).alias("x0")).distinct()
    parts = cuts.withColumn("x1", F.lead("x0").over(W.partitionBy(*key).orderBy("x0"))).where("x1 is not null")
    inside = parts.join(t, key).where("a <= x0 and x1 <= b")
    return inside.groupBy(*key, "x0", "x1").agg(F.max("label").alias("label")).drop("tile")


def visible(slices: DataFrame, width: int = 8192, height: int = 1024) -> DataFrame:
    """z, y, x0, x1, label: the volume painted with whole masks (id, z, box, lines, label) as disjoint runs; at each pixel the largest label.

    A mask goes to the cells of width x height pixels of its section that its box meets; a cell's lines are cut where runs start
    and end, and a cut's stretches are painted in its task.  Rows without a label or a section paint nothing.
    """
    near = lambda lo, hi, n: F.explode(F.sequence(F.floor(F.col(lo) / n), F.floor((F.col(hi) - 1) / n)))
    s = slices.where("label is not null and z is not null").withColumn("gx", near("x0", "x1", width)).withColumn("gy", near("y0", "y1", height))

    def run(key, t):
        z, gx, gy = (k.as_py() for k in key)
        r, of = masks._flat(t.column("lines").combine_chunks())
        left, top, label = (t.column(c).to_numpy()[of] for c in ("x0", "y0", "label"))
        y, a = r[:, 0] + top - gy * height, r[:, 1] + left - gx * width
        a, b = np.maximum(a, 0), np.minimum(a + r[:, 2], width)
        here = (y >= 0) & (y < height) & (a < b)
        a, b, label = (y * (width + 1) + a)[here], (y * (width + 1) + b)[here], label[here]
        cut = np.unique(np.concatenate((a, b)))
        low = np.searchsorted(cut, a)
        n = np.searchsorted(cut, b) - low
        part = np.arange(n.sum()) + np.repeat(low - np.cumsum(n) + n, n)
        seen, top = np.zeros(len(cut), bool), np.full(len(cut), np.iinfo(np.int64).min)
        seen[part] = True
        np.maximum.at(top, part, np.repeat(label, n))
        at = np.flatnonzero(seen)
        line, x0 = np.divmod(cut[at], width + 1)
        x1 = x0 + cut[at + 1] - cut[at] if len(at) else x0
        columns = (np.full(len(at), z, np.int64), line + gy * height, x0 + gx * width, x1 + gx * width, top[at])
        return pa.table([pa.array(c) for c in columns], names=["z", "y", "x0", "x1", "label"])

    return s.select("z", "gx", "gy", "x0", "y0", "lines", "label").groupBy("z", "gx", "gy").applyInArrow(run, "z long, y long, x0 long, x1 long, label long")


def runs_of(slices: DataFrame) -> DataFrame:
    """id, z, y, x0, x1 of full rectangles."""
    return slices.select("id", "z", F.explode(F.sequence(F.col("y0"), F.col("y1") - 1)).alias("y"), "x0", "x1")


def brush(strokes: DataFrame) -> DataFrame:
    """id, x, y: pixels within r of each stroke's centre (id, cx, cy, r), not below 0."""
    s = strokes.withColumn("x", F.explode(F.sequence(F.col("cx") - F.col("r"), F.col("cx") + F.col("r")))).withColumn("y", F.explode(F.sequence(F.col("cy") - F.col("r"), F.col("cy") + F.col("r"))))
    return s.where(((F.col("x") - F.col("cx")) ** 2 + (F.col("y") - F.col("cy")) ** 2 <= F.col("r") ** 2) & (F.col("x") >= 0) & (F.col("y") >= 0)).select("id", "x", "y")


def exact_matches(old: DataFrame, new: DataFrame) -> DataFrame:
    """a_id, b_id: slices of both (runs, or masks in their rows) that are the same pixels: equal boxes and sizes, then as many shared pixels as each has.

    Masks are joined once, each as one row, and runs are met within the pair.
    """
    key = ["z", "x0", "y0", "x1", "y1", "sz"]

    def side(d: DataFrame, s: str) -> DataFrame:
        m = d if "lines" in d.columns else masks.with_masks(d)
        return m.select(*key, F.col("id").alias(f"{s}_id"), F.col("lines").alias(f"{s}_lines"))

    j = side(old, "a").join(side(new, "b"), key)
    for s in "ab":
        j = j.withColumn(f"{s}_at_x", F.col("x0")).withColumn(f"{s}_at_y", F.col("y0"))
    j = j.withColumn("dx", F.lit(0).cast("long")).withColumn("dy", F.lit(0).cast("long"))
    return masks._with_moved(j, ["a_id", "b_id", "sz"], "o").where("o = sz").select("a_id", "b_id")


def edits(old: DataFrame, new: DataFrame) -> DataFrame:
    """old_ids, new_ids: groups of old slices (runs, or masks in their rows) and the new ones that replace them; groups that stayed the same are left out."""
    same = settled(exact_matches(old, new))

    def rest(d: DataFrame, k: str) -> DataFrame:
        left = d.join(same.select(F.col(k).alias("id")), "id", "left_anti")
        return masks.runs_of(left) if "lines" in d.columns else left

    o, n = rest(old, "a_id"), rest(new, "b_id")
    j = masks.overlaps(masks.tiles(o), masks.tiles(n), keep=())
    c = components(j.select(F.concat(F.lit("o"), "a_id").alias("a"), F.concat(F.lit("n"), "b_id").alias("b")))
    side = lambda k: F.array_sort(F.collect_set(F.when(F.col("id").startswith(k), F.substring("id", 2, 30).cast("long"))))
    return c.groupBy("component").agg(side("o").alias("old_ids"), side("n").alias("new_ids")).drop("component")


def label_links(labelled: DataFrame) -> DataFrame:
    """label, a, b, o: slices of one label in neighbouring sections that overlap (runs with a label)."""
    t = masks.tiles(labelled, "label")
    return masks.overlaps(t, t, 1, keep=(), on=("label",)).select("label", F.col("a_id").alias("a"), F.col("b_id").alias("b"), "o")


def spanning_forest(labelled: DataFrame) -> DataFrame:
    return forest(label_links(labelled))


def open_ends(slices: DataFrame, links: DataFrame) -> DataFrame:
    """id, left, right: ends of slices without a link to the left or the right."""
    l_ = links.select(F.col("b").alias("id"), F.lit(1).alias("has_left")).distinct()
    r_ = links.select(F.col("a").alias("id"), F.lit(1).alias("has_right")).distinct()
    return slices.select("id").join(l_, "id", "left").join(r_, "id", "left").where("has_left is null or has_right is null").select("id", F.col("has_left").isNull().cast("int").alias("left_end"), F.col("has_right").isNull().cast("int").alias("right_end"))


#: fixed values: codes of relations in text dumps
RELATIONS = {"<=": 0, ">=": 1, "=": 2}


def slice_lines(slices: DataFrame, values: DataFrame | None = None) -> DataFrame:
    """line: id, section, box (x, then y), value, centre and size of each slice; value is 0 where there is none."""
    s = slices.join(values.select("id", "value"), "id", "left") if values is not None else slices.withColumn("value", F.lit(None).cast("double"))
    number = lambda c: F.format_string("%.3f", c)
    center = [number(masks.center(k)) for k in "xy"]
    return s.select(F.concat_ws(" ", *(F.col(c).cast("string") for c in ("id", "z", "x0", "x1", "y0", "y1")), number(F.coalesce("value", F.lit(0.0))), *center, F.col("sz").cast("string")).alias("line"))


def conflict_lines(pairs: DataFrame) -> DataFrame:
    """line: the two slices of each conflict."""
    return pairs.select(F.concat_ws(" ", F.col("a_id").cast("string"), F.col("b_id").cast("string")).alias("line"))


def row_text(pos: str, neg: str, relation: Column, value: Column) -> Column:
    """'value relation n ids -ids' of a constraint with these numbers (arrays) of coefficient 1 and -1."""
    text = lambda c: F.transform(c, lambda x: x.cast("string"))
    terms = F.concat(text(pos), F.transform(text(neg), lambda x: F.concat(F.lit("-"), x)))
    return F.concat_ws(" ", F.format_string("%.1f", value.cast("double")), F.when(relation == "=", "==").otherwise(relation), F.size(terms).cast("string"), F.array_join(terms, " "))


def protocol_lines(variables: DataFrame, coefs: DataFrame, rows: DataFrame) -> DataFrame:
    """window, part, item, line: subproblems as text.

    variables: window, number, cost; coefs: row, number, coef, relation, value; rows: row, window (what fits a window whole).
    """
    pick = lambda sign: F.array_sort(F.collect_list(F.when(F.col("coef") * sign > 0, F.col("number"))))
    g = coefs.groupBy("row", "relation", "value").agg(pick(1).alias("pos"), pick(-1).alias("neg"))
    return window_lines(variables, rows.join(g.select("row", row_text("pos", "neg", F.col("relation"), F.col("value")).alias("text")), "row"))


def window_lines(variables: DataFrame, held: DataFrame) -> DataFrame:
    """window, part, item, line: subproblems as text, of variables (window, number, cost) and the constraints of each window (window, row, text).

    Of each window: the number of segments, a line 'id cost' for each, the number of constraints, and the text of each.
    `part` orders them; the first line of all is the number of windows.  Lines are one row each, so no window is gathered.
    """
    name = lambda c: F.col(c).cast("string")
    put = lambda df, part, order, line: df.select("window", F.lit(part).alias("part"), order.cast("string").alias("item"), line.alias("line"))
    n = lambda df: df.groupBy("window").agg(F.count("*").alias("n"))
    every = n(variables)
    head = every.agg(F.count("*").cast("string").alias("line")).select(F.lit(-1).cast("long").alias("window"), F.lit(0).alias("part"), F.lit("").alias("item"), "line")
    out = head.unionByName(put(every, 1, F.lit(""), name("n")))
    out = out.unionByName(put(variables, 2, F.lpad(name("number"), 20, "0"), F.concat_ws(" ", name("number"), F.format_string("%.6f", "cost"))))
    rows = every.select("window").join(n(held), "window", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.unionByName(put(rows, 3, F.lit(""), name("n"))).unionByName(put(held, 4, F.col("row"), F.col("text")))


def problem_lines(segments: DataFrame) -> DataFrame:
    """line: one a segment: key, type, and up to three slices, '-1 -1' for a missing one."""
    slot = lambda k: F.coalesce(F.concat_ws(" ", F.get("ids", F.lit(k)).cast("string"), F.get("sides", F.lit(k)).cast("string")), F.lit("-1 -1"))
    ids = F.concat("sl", "sr")
    sides = F.concat(F.transform("sl", lambda _: F.lit(0)), F.transform("sr", lambda _: F.lit(1)))
    s = segments.withColumn("ids", ids).withColumn("sides", sides)
    some = lambda k: F.when(F.size("ids") > k, slot(k)).otherwise("-1 -1")
    return s.select(F.concat_ws(" ", "key", F.col("type").cast("string"), some(0), some(1), some(2)).alias("line"))


def constraint_lines(rows: DataFrame) -> DataFrame:
    """line: value, relation, number of positive keys, those, number of negative keys, those; of rows (row, key, coef, relation, value)."""
    pick = lambda sign: F.array_sort(F.collect_set(F.when(F.col("coef") * sign > 0, F.col("key"))))
    g = rows.groupBy("row", "relation", "value").agg(pick(1).alias("pos"), pick(-1).alias("neg"))
    code = F.coalesce(*(F.when(F.col("relation") == k, str(v)) for k, v in RELATIONS.items()))
    return g.select("row", F.concat_ws(" ", F.col("value").cast("string"), code, F.size("pos").cast("string"), F.array_join("pos", " "), F.size("neg").cast("string"), F.array_join("neg", " ")).alias("line"))
