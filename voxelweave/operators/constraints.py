"""The 0/1 programme over segments as rows: coefficients (row, key, coef), rows (row, relation, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numbering import numbered
from .segments import members


def variables(segments: DataFrame) -> DataFrame:
    """key, number: dense from 0 in the order of type, interval and key."""
    return numbered(segments.select("key", "type", "isi"), ["type", "isi", "key"]).select("key", "number")


def with_numbers(segments: DataFrame) -> DataFrame:
    """segments with `number` as `variables` has it, in their rows, so that what is in a row needs no join with the numbers."""
    return numbered(segments, ["type", "isi", "key"])


def _by(segments: DataFrame) -> list[str]:
    """Segments may be of several programmes, told apart by a column `problem`; so are the rows made of them."""
    return ["problem"] if "problem" in segments.columns else []


def _members(segments: DataFrame) -> DataFrame:
    side = lambda c, left: segments.select(*_by(segments), "key", F.explode(c).alias("id"), F.lit(left).alias("is_left"))
    return side("sl", True).unionByName(side("sr", False))


def _used(segments: DataFrame) -> DataFrame:
    """id, key: the segments with a slice on their left side, or for slices on no left side those with it on the right."""
    m, by = _members(segments), _by(segments)
    has = m.where("is_left").select(*by, "id").distinct()
    return m.where("is_left").unionByName(m.where(~F.col("is_left")).join(has, [*by, "id"], "left_anti")).drop("is_left")


def conflict_rows(cliques: DataFrame, segments: DataFrame, forced: bool = False) -> DataFrame:
    """row, key, coef, relation, value: at most one segment over each clique (clique, id, maximal)'s slices; exactly one if forced and the clique is maximal."""
    rel = F.when(F.lit(forced) & F.col("maximal"), "=").otherwise("<=")
    return cliques.join(_used(segments), "id").select(*_by(segments), F.concat(F.lit("clique:"), F.col("clique")).alias("row"), "key", F.lit(1).alias("coef"), rel.alias("relation"), F.lit(1).alias("value")).distinct()


def exclusivity_rows(slices: DataFrame, cliques: DataFrame, segments: DataFrame, forced: bool = False) -> DataFrame:
    """The same for slices in no clique."""
    free = slices.select("id").join(cliques.select("id"), "id", "left_anti")
    return free.join(_used(segments), "id").select(*_by(segments), F.concat(F.lit("slice:"), F.col("id")).alias("row"), "key", F.lit(1).alias("coef"), F.lit("=" if forced else "<=").alias("relation"), F.lit(1).alias("value"))


def continuation_rows(segments: DataFrame) -> DataFrame:
    """For slices with segments on both sides: those with it on their left less those with it on their right is 0."""
    by = _by(segments)
    m = _members(segments).select(*by, "id", "key", F.when(F.col("is_left"), 1).otherwise(-1).alias("coef"))
    both = m.groupBy(*by, "id").agg(F.min("coef").alias("lo"), F.max("coef").alias("hi")).where("lo < hi").select(*by, "id")
    return m.join(both, [*by, "id"], "left_semi").select(*by, F.concat(F.lit("flow:"), F.col("id")).alias("row"), "key", "coef", F.lit("=").alias("relation"), F.lit(0).alias("value"))


def explanation_rows(segments: DataFrame) -> DataFrame:
    """The same for every slice, boundary slices included, with the right side positive."""
    m = members(segments)
    return m.select(F.concat(F.lit("explain:"), F.col("id")).alias("row"), "key", F.when(F.col("is_left"), -1).otherwise(1).alias("coef"), F.lit("=").alias("relation"), F.lit(0).alias("value"))


def explicit_rows(user: DataFrame, segments: DataFrame) -> DataFrame:
    """Rows (row, key, coef, relation, value) of a user whose segments are known; see unknown_keys for the rest."""
    return user.join(segments.select("key"), "key", "left_semi")


def consistency_rows(user: DataFrame, numbers: DataFrame) -> DataFrame:
    """Rows (row, key, coef, relation, value) with the numbers (key, number) of their variables in place of the keys; rows with an unknown key are left out whole."""
    lost = unknown_keys(user, numbers).select("row").distinct()
    return user.join(lost, "row", "left_anti").join(numbers, "key").select("row", "number", "coef", "relation", "value")


def unknown_keys(user: DataFrame, segments: DataFrame) -> DataFrame:
    return user.join(segments.select("key"), "key", "left_anti")


def enclosing(inner: DataFrame, outer: DataFrame, shared: DataFrame, least: float = 0.9, radius: float = 1000.0) -> DataFrame:
    """i_key, o_key: continuations of `outer` that hold at least `least` (over 0) of the pixels of one of `inner`.

    Both: key, isi, left, right (slice ids), sz (of both slices), cx, cy.  shared: a_id, b_id, o of slices of one section,
    each pair both ways, and each slice with itself.  The squared distance of centres is compared with the radius.
    Candidates are those that share pixels on a side, by equi-joins on ids; what both sides share is summed up.
    """
    if least <= 0:
        raise ValueError("what holds nothing of another isn't looked for")
    c = F.col
    d2 = (c("cx") - c("o_cx")) ** 2 + (c("cy") - c("o_cy")) ** 2

    def side(k: str) -> DataFrame:
        i = inner.select(c("key").alias("i_key"), "isi", c(k).alias("a_id"), "sz", "cx", "cy")
        o = outer.select(c("key").alias("o_key"), c("isi").alias("o_isi"), c(k).alias("b_id"), c("cx").alias("o_cx"), c("cy").alias("o_cy"))
        j = i.join(shared.select("a_id", "b_id", c("o").alias("held")), "a_id").join(o, "b_id")
        return j.where((c("isi") == c("o_isi")) & (d2 < radius)).select("i_key", "o_key", "sz", "held")

    held = side("left").unionByName(side("right")).groupBy("i_key", "o_key", "sz").agg(F.sum("held").alias("held"))
    return held.where(c("held").cast("double") / c("sz") >= least).select("i_key", "o_key")


def mitochondria_rows(inner: DataFrame, pairs: DataFrame) -> DataFrame:
    """x of each inner segment less the sum of those that enclose it is at most 0."""
    r = F.concat(F.lit("mito:"), F.col("key")).alias("row")
    own = inner.select(r, "key", F.lit(1).alias("coef"))
    held = pairs.select(F.concat(F.lit("mito:"), F.col("i_key")).alias("row"), F.col("o_key").alias("key"), F.lit(-1).alias("coef"))
    return own.unionByName(held).select("*", F.lit("<=").alias("relation"), F.lit(0).cast("long").alias("value"))


def synapse_rows(inner: DataFrame, pairs: DataFrame) -> DataFrame:
    """n times x of each inner segment plus the sum of the n that enclose it is at most n; none without an enclosing one."""
    n = pairs.groupBy("i_key").agg(F.count("*").alias("n"))
    row = F.concat(F.lit("syn:"), F.col("i_key")).alias("row")
    own = n.select(row, F.col("i_key").alias("key"), F.col("n").cast("int").alias("coef"), "n")
    held = pairs.join(n, "i_key").select(row, F.col("o_key").alias("key"), F.lit(1).alias("coef"), "n")
    return own.unionByName(held).select("row", "key", "coef", F.lit("<=").alias("relation"), F.col("n").alias("value"))


def window_starts(last: int, size: int, overlap: int) -> list[int]:
    """Starts of overlapping windows of intervals up to `last`."""
    if overlap >= size:
        raise ValueError("windows must overlap by less than their size")
    return list(range(0, max(1, last), size - overlap))


def in_windows(variables: DataFrame, size: int, overlap: int) -> DataFrame:
    """Adds `window` (its number): each variable (isi) once for every window that holds it."""
    return variables.withColumn("window", _windows("isi", "isi", size, overlap))


def _windows(first: str, last: str, size: int, overlap: int) -> Column:
    """A row for each window (from 0) that holds all intervals from `first` to `last`; none where there is no such window."""
    step = size - overlap
    if step <= 0:
        raise ValueError("windows must overlap by less than their size")
    lo = F.greatest(F.lit(0).cast("long"), F.floor((F.col(last) - size) / step).cast("long") + 1)
    hi = F.floor(F.col(first) / step).cast("long")
    return F.explode(F.when(lo <= hi, F.sequence(lo, hi)))


def window_rows(coefs: DataFrame, placed: DataFrame) -> DataFrame:
    """row, window: rows all of whose variables are in the window (division, by counting)."""
    n = coefs.groupBy("row").agg(F.countDistinct("key").alias("n"))
    k = coefs.select("row", "key").distinct().join(placed.select("key", "window"), "key").groupBy("row", "window").agg(F.count("*").alias("k"))
    return k.join(n, "row").where("k = n").select("row", "window")


def continuation_windows(segments: DataFrame, size: int, overlap: int, **lists: str) -> DataFrame:
    """row, window, lists: the continuation rows all of whose segments (isi) are in the window; see `window_rows` for any other rows and windows.

    A window is a stretch of intervals, so it holds a row if it holds its first and its last one: slices are grouped once and
    nothing is joined.  lists: names of columns, each the sorted values of another of the row's segments, as `pos_` and `neg_` by coefficient.
    """
    return spans_in_windows(continuation_spans(segments, **lists), size, overlap)


def spans_in_windows(spans: DataFrame, size: int, overlap: int) -> DataFrame:
    """`window` in place of first and last: each once for every window that holds all between."""
    return spans.withColumn("window", _windows("first", "last", size, overlap)).drop("first", "last")


def continuation_spans(segments: DataFrame, **lists: str) -> DataFrame:
    """row, first, last, lists: the continuation rows with their first and last interval; rows with a segment without one are left out."""
    at = lambda c, k: F.transform(c, lambda x: F.struct(x.alias("id"), F.lit(k).alias("coef")))
    m = segments.select(F.explode(F.concat(at("sl", 1), at("sr", -1))).alias("m"), "isi", *set(lists.values())).where("m.id is not null")
    m = m.select("m.id", "m.coef", "isi", *set(lists.values()))
    if lists:
        m = m.repartition("id")  # lists don't get shorter before the shuffle
    pick = lambda c, k: F.array_sort(F.collect_list(F.when(F.col("coef") == k, F.col(c))))
    g = m.groupBy("id").agg(
        F.min("coef").alias("lo"), F.max("coef").alias("hi"), F.min("isi").alias("first"), F.max("isi").alias("last"), F.max(F.col("isi").isNull()).alias("lost"),
        *(pick(c, k).alias(f"{s}_{name}") for name, c in lists.items() for s, k in (("pos", 1), ("neg", -1))),
    )
    more = [f"{s}_{name}" for name in lists for s in ("pos", "neg")]
    return g.where("lo < hi and not lost").select(F.concat(F.lit("flow:"), F.col("id")).alias("row"), "first", "last", *more)


def parameter_grid(spark, **axes: tuple[float, float, float]) -> DataFrame:
    """Every combination of the axes' values (first, last, step), the first axis slowest; `number` counts them."""
    out, rest = None, 1
    sizes = {k: int(round((hi - lo) / step)) + 1 if hi > lo else 1 for k, (lo, hi, step) in axes.items()}
    total = 1
    for n in sizes.values():
        total *= n
    out, rest = spark.range(total).withColumnRenamed("id", "number"), total
    for k, (lo, _, step) in axes.items():
        rest //= sizes[k]
        out = out.withColumn(k, F.lit(float(lo)) + (F.floor(F.col("number") / rest) % sizes[k]) * F.lit(float(step)))
    return out
