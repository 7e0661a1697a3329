"""Dense numbers and ranks without a window over a large group: range partitions, their counts, prefix sums, local places."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .graph import settled


def _plain(order) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def numbered(df: DataFrame, order: list, name: str = "number", parts: int | None = None, groups: list[str] = ()) -> DataFrame:
    """df with `name`: the place of a row, from 0, in the order of `groups` and `order`; with groups the place in its group.

    Rows are dealt out by ranges of groups and order, so a group that holds most rows lies over many partitions.  A
    partition's rows are sorted and written with their place in it; only counts of partitions, and of the groups in each, are
    summed up; without groups those are a row a partition, and rows are not shuffled again for them.  Rows that are equal in groups and order lie in one partition, so end `order` with a key.  Null groups are a group.
    """
    spark, groups = df.sparkSession, list(groups)
    keys = [F.col(g).asc_nulls_first() for g in groups] + _plain(order)
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    at = F.monotonically_increasing_id()
    placed = settled(placed.withColumn("__part", F.shiftright(at, 33)).withColumn("__at", at.bitwiseAND(F.lit((1 << 33) - 1))))
    if not groups:
        counts = placed.groupBy("__part").agg(F.count("*").alias("n"))
        before = counts.select("__part", F.coalesce(F.sum("n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
        return placed.join(F.broadcast(before), "__part").withColumn(name, (F.col("__base") + F.col("__at")).cast("long")).drop("__part", "__at", "__base")
    counts = placed.groupBy("__part", *groups).agg(F.count("*").alias("n"), F.min("__at").alias("first"))
    earlier = F.coalesce(F.sum("n").over(W.partitionBy(*groups).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    before = counts.select(F.col("__part").alias("__p"), *(F.col(g).alias(f"__g{k}") for k, g in enumerate(groups)), (earlier - F.col("first")).alias("__base"))
    same = reduce(and_, (F.col(g).eqNullSafe(F.col(f"__g{k}")) for k, g in enumerate(groups)), F.col("__part") == F.col("__p"))
    out = placed.join(before, same).withColumn(name, (F.col("__base") + F.col("__at")).cast("long"))
    return out.drop("__part", "__at", "__base", "__p", *(f"__g{k}" for k in range(len(groups))))
