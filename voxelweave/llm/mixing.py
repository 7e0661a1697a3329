"""Mixing sources to target weights by Pareto order sampling.

``targets`` shares the words of all sources by weight, capped at `most` copies.  ``mix`` gives
every document an expected number of copies, proportional to its weight within its source and
at most `most`; the whole part is certain, the fraction is an inclusion probability pi.  With
U uniform, documents are ranked by (U / (1 - U)) / (pi / (1 - pi)) and taken in that order
until the words of the source's remainder are reached.  Documents are taken whole, so the last
one may not fit; then the order goes on, and the next document whose size is at least a half of
what is missing, and not more, is taken, `rounds` times, so that the gap at least halves each time;
where a source has no such document left, the one that leaves the least gap ends it.

Every step is an aggregate or a window over bounded buckets: the running sum in rank order is
taken over sums of rank buckets of about `bucket` documents (at most 100,000 buckets a source) first, so a source with a third of
all rows is dealt over many tasks.  U is a hash of doc_id and seed, so reruns agree.

Defined results: null texts have size 0; size 0 is never taken; a null source is a source of
its own, the last; rows with equal doc_id are taken each on its own; no rows, no result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, written


def n_words(text: Column) -> Column:
    """Number of words, without an array of them: each run of word characters becomes one letter."""
    return F.coalesce(F.length(F.regexp_replace(F.regexp_replace(text, WORD, "x"), r"[\x20\x09-\x0D]+", "")), F.lit(0)).cast("long")


def source_sums(sized: DataFrame) -> DataFrame:
    return sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))


def by_weight(sources: DataFrame, cycle: int = 3) -> DataFrame:
    """Adds `weight`: 1, 2, .. cycle and again, by code point of the source, null last.  One row a source."""
    order = W.orderBy(F.encode(F.col("source"), "UTF-8").asc_nulls_last())
    return sources.withColumn("weight", (((F.row_number().over(order) - 1) % cycle) + 1).cast("double"))


def targets(sources: DataFrame, share: float = 1.0, most: int = 3) -> DataFrame:
    """Adds `target`: weights share `share` of all words, each at most `most` times its source's words.

    Water filling in closed form: sources in the order in which they reach their cap; the level
    is that of the first source which doesn't.
    """
    cap = F.col("source_size") * F.lit(float(most))
    name = F.encode(F.col("source"), "UTF-8").asc_nulls_last()
    order = W.orderBy(cap / F.col("weight"), name)
    rest = F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
    full = F.coalesce(F.sum(cap).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    total = F.sum("source_size").over(W.partitionBy()) * F.lit(float(share))
    open_ = F.when(F.col("level") * F.col("weight") < F.col("cap"), F.col("level"))
    return (
        sources.withColumn("cap", cap)
        .withColumn("level", (total - full) / rest)
        .withColumn("level", F.min(F.when(open_.isNotNull(), F.struct(F.col("cap") / F.col("weight"), "level"))).over(W.partitionBy())["level"])
        .withColumn("target", F.coalesce(F.least(F.col("cap"), F.col("level") * F.col("weight")), F.col("cap")))
        .drop("cap", "level")
    )


def _expected(classes: DataFrame, most: int) -> DataFrame:
    """Adds `copies`, expected copies of a document of (source, w): min(most, level * w), which fills the target."""
    cap = F.col("words") * F.lit(float(most))
    order = W.partitionBy("source").orderBy(F.desc("w"))
    full = F.coalesce(F.sum(cap).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum(F.col("words") * F.col("w")).over(order.rowsBetween(0, W.unboundedFollowing))
    level = F.when(rest > 0, (F.col("target") - full) / rest)
    found = F.max(F.when(F.col("level") * F.col("w") <= most, F.struct("w", "level"))).over(W.partitionBy("source"))["level"]
    return classes.withColumn("level", level).withColumn("level", found).withColumn("copies", F.least(F.lit(float(most)), F.coalesce(F.col("level") * F.col("w"), F.lit(float(most))))).drop("level")


def uniform(seed: int, *cols: str) -> Column:
    """In (0, 1): 52 bits of an MD5 of the columns and the seed."""
    return (F.conv(F.substring(F.md5(F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols), F.lit(str(seed)))), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def length_weight(size: Column) -> Column:
    """The default weight within a source: 1 + log2 of the size, rounded down, so that whole long texts repeat more than scraps."""
    return F.floor(F.log2(size.cast("double") + 0.5)).cast("double") + 1.0


def mix(docs: DataFrame, weights, share: float = 1.0, most: int = 3, weight=length_weight, seed: int = 1, bucket: int = 5_000, rounds: int = 5) -> DataFrame:
    """doc_id, source, size, source_size, target, copies (whole) and taken (words) of every row.

    weights: adds `weight` to a table of sources (source, source_size, n).  weight: column of a
    size, or of other columns of docs, with few distinct values; None for equal chances.
    """
    sized = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"))
    sized = written(sized.withColumn("w", weight(F.col("size")) if weight else F.lit(1.0)), "sizes", sized=True)
    sources = targets(weights(source_sums(sized)), share, most)
    same = F.col("s.source").eqNullSafe(F.col("t.source"))
    classes = sized.where("size > 0").groupBy("source", "w").agg(F.sum("size").alias("words"), F.count("*").alias("rows"))
    classes = _expected(classes.alias("s").join(sources.alias("t"), same).select("s.*", "t.target", "t.source_size", "t.n"), most)
    sure = F.floor(F.col("copies") + 1e-9)
    classes = classes.withColumn("sure", sure.cast("long")).withColumn("pi", F.greatest(F.col("copies") - sure, F.lit(0.0)))
    by = W.partitionBy("source")
    mean = F.sum(F.col("pi") * F.col("rows")).over(by) / F.sum(F.when(F.col("pi") > 0, F.col("rows"))).over(by)
    classes = written(classes.withColumn("budget", F.col("target") - F.sum(F.col("sure") * F.col("words")).over(by)).withColumn("mean", mean), "mix-classes")
    # rank: odds of U over odds of pi; scaled by the mean odds it is again in (0, 1), and about even
    ranked = sized.where("size > 0").alias("s").join(classes.alias("t"), same & (F.col("s.w") == F.col("t.w"))).where("pi > 0").select("s.doc_id", "s.source", "s.size", "t.pi", "t.mean", "t.n", "t.budget")
    odds = F.col("u") / (1 - F.col("u")) / (F.col("pi") / (1 - F.col("pi"))) * (F.col("mean") / (1 - F.col("mean")))
    ranked = ranked.withColumn("u", uniform(seed, "doc_id")).withColumn("q", odds).withColumn("key", F.col("q") / (1 + F.col("q")))
    ranked = ranked.withColumn("bucket", F.floor(F.col("key") * F.least(F.ceil(F.col("n") / bucket), F.lit(100_000))).cast("long")).select("doc_id", "source", "size", "budget", "key", "bucket")
    ranked = written(ranked, "mix-ranks")
    sums = ranked.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    before = F.coalesce(F.sum("words").over(by.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumn("before", before).drop("words")
    inside = W.partitionBy("source", "bucket").orderBy("key", "doc_id", "size")
    placed = (
        ranked.withColumn("inside", F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("at", F.row_number().over(inside))
        .alias("r").join(sums.alias("b"), F.col("r.source").eqNullSafe(F.col("b.source")) & (F.col("r.bucket") == F.col("b.bucket")))
        .select("r.*", (F.col("b.before") + F.col("r.inside")).alias("upto"))
    )
    placed = written(placed.withColumn("extra", (F.col("upto") <= F.col("budget")).cast("int")), "mix-order")
    gap = written(placed.groupBy("source").agg(F.first("budget").alias("budget"), F.sum(F.when(F.col("extra") == 1, F.col("size")).otherwise(0)).alias("got")), "mix-gap")
    picks = None
    for _ in range(rounds):
        # of the rest, the first in rank that halves the gap; tables of a row a source or a pick, which Spark broadcasts if they are small
        free = placed.where("extra = 0")
        if picks is not None:
            free = free.alias("f").join(picks.alias("p"), F.col("f.source").eqNullSafe(F.col("p.source")) & (F.col("f.bucket") == F.col("p.bucket")) & (F.col("f.at") == F.col("p.at")), "left_anti")
        left = F.col("g.budget") - F.col("g.got")
        off = F.abs(left - F.col("f.size"))
        odd = (F.col("f.size") > left) | (2 * F.col("f.size") < left)
        near = (
            free.alias("f").join(gap.alias("g"), F.col("f.source").eqNullSafe(F.col("g.source")))
            .where(off < left)
            .groupBy(F.col("f.source").alias("source")).agg(F.min(F.struct(odd.alias("odd"), F.when(odd, off).alias("off"), "f.key", "f.doc_id", "f.size", "f.bucket", "f.at")).alias("m"))
            .select("source", "m.bucket", "m.at", "m.size")
        )
        near = written(near, "mix-near")
        picks = near if picks is None else picks.unionByName(near)
        gap = gap.alias("g").join(near.alias("n"), F.col("g.source").eqNullSafe(F.col("n.source")), "left").select("g.source", "g.budget", (F.col("g.got") + F.coalesce("n.size", F.lit(0))).alias("got"))
        gap = written(gap, "mix-gap")
    extra = placed.where("extra = 1").select("doc_id", "source", "size", "extra")
    if picks is not None:
        more = placed.alias("f").join(picks.alias("p"), F.col("f.source").eqNullSafe(F.col("p.source")) & (F.col("f.bucket") == F.col("p.bucket")) & (F.col("f.at") == F.col("p.at")), "left_semi")
        extra = extra.unionByName(more.select("doc_id", "source", "size", F.lit(1).alias("extra")))
    # rows with equal doc_id, source and size are told apart by a number only where there are such rows
    key = ["doc_id", "source", "size"]
    extra = extra.groupBy(*key).agg(F.sum("extra").alias("k"))
    rows = sized.withColumn("copy", F.row_number().over(W.partitionBy(*key).orderBy("w")))
    joined = rows.alias("s").join(extra.alias("e"), F.col("s.doc_id").eqNullSafe(F.col("e.doc_id")) & F.col("s.source").eqNullSafe(F.col("e.source")) & (F.col("s.size") == F.col("e.size")), "left").select("s.*", (F.coalesce("e.k", F.lit(0)) >= F.col("s.copy")).cast("long").alias("extra"))
    out = joined.alias("s").join(classes.select("source", "w", "sure").alias("t"), same & (F.col("s.w") == F.col("t.w")), "left").select("s.*", F.coalesce("t.sure", F.lit(0)).alias("sure"))
    out = out.alias("s").join(sources.select("source", "source_size", "target").alias("t"), same)
    copies = (F.col("s.sure") + F.col("s.extra")).cast("long")
    return out.select("s.doc_id", "s.source", "s.size", "t.source_size", "t.target", copies.alias("copies"), (copies * F.col("s.size")).alias("taken"))


def take(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The rows of docs as often as `mixed` says, all columns.

    Rows with equal doc_id, source and size but different texts, should there be any, share their copies evenly.
    """
    names = set(docs.columns)
    tag = "__mix"
    while any(c.startswith(tag) for c in names):
        tag += "_"
    k = mixed.groupBy("doc_id", "source", "size").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows"))
    k = k.select(F.col("doc_id").alias(f"{tag}d"), F.col("source").alias(f"{tag}s"), F.col("size").alias(f"{tag}n"), "copies", "rows").where("copies > 0")
    k = k.withColumnsRenamed({"copies": f"{tag}c", "rows": f"{tag}r"})
    rows = docs.withColumn(f"{tag}w", n_words(F.col("text")))
    got = rows.join(k, F.col("doc_id").eqNullSafe(F.col(f"{tag}d")) & F.col("source").eqNullSafe(F.col(f"{tag}s")) & (F.col(f"{tag}w") == F.col(f"{tag}n")))
    single = got.where(F.col(f"{tag}r") == 1).withColumn(f"{tag}k", F.col(f"{tag}c").cast("int"))
    order = W.partitionBy("doc_id", "source", f"{tag}w").orderBy("text")
    many = got.where(F.col(f"{tag}r") > 1).withColumn(f"{tag}o", F.row_number().over(order))
    each = F.floor(F.col(f"{tag}c") / F.col(f"{tag}r")) + (F.col(f"{tag}o") <= F.col(f"{tag}c") % F.col(f"{tag}r")).cast("long")
    many = many.withColumn(f"{tag}k", each.cast("int")).drop(f"{tag}o")
    return single.unionByName(many).where(F.col(f"{tag}k") > 0).withColumn(f"{tag}e", F.explode(F.sequence(F.lit(1), F.col(f"{tag}k")))).select(*docs.columns)
