"""Connected components and forests of edge tables."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); a temporary one where it is unset and Spark runs in one process."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="voxelweave-"))
        base = sc.getCheckpointDir()
    return base.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def settled(df: DataFrame) -> DataFrame:
    """Cuts lineage with a table in the shared folder; it goes when the driver ends, or with `dropped`."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/step-{uuid.uuid4().hex}"

    def remove():
        with contextlib.suppress(Exception):  # the session may have ended before
            delete(spark, path)

    atexit.register(remove)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def dropped(df: DataFrame) -> None:
    """Deletes a table of settled() that no later step reads."""
    delete(df.sparkSession, df._settled_at)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """id, component (the least id reachable) of all nodes of edges (a, b).

    Labels move along edges, then to their labels' labels, so rounds grow with the logarithm of
    a path's length; nothing is gathered but whether a round changed anything.  The joins are merged: the tables grow with the
    input, and one that is small as a file would be many times that in the driver as a broadcast.
    """
    both = settled(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    label = settled(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    for _ in range(most_rounds):
        heard = both.join(label.withColumnRenamed("id", "b").hint("merge"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("m"))
        step = label.join(heard.hint("merge"), "id").select("id", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        jump = label.select(F.col("id").alias("label"), F.col("label").alias("up"))
        new = settled(step.join(jump.hint("merge"), "label").select("id", "old", F.least("label", "up").alias("label")))
        changed = new.where("old <> label").limit(1).count()
        dropped(label)
        label = new.drop("old")
        label._settled_at = new._settled_at
        if not changed:
            dropped(both)
            return label.withColumnRenamed("label", "component")
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def components_within(edges: DataFrame, by: str, most: int = 300_000) -> DataFrame:
    """by, id, component (the least id reachable within its group) of all nodes of edges (by, a, b; whole numbers).

    A group of at most `most` edges is joined in the task that has it; larger ones are joined over tables.
    """
    edges = settled(edges.select(by, "a", "b"))
    big = settled(edges.groupBy(by).agg(F.count("*").alias("n")).where(F.col("n") > most).select(by))
    schema = f"{by} {edges.schema[by].dataType.simpleString()}, id long, component long"

    def one(lines: pd.DataFrame) -> pd.DataFrame:
        ids, at = np.unique(lines[["a", "b"]].to_numpy(), return_inverse=True)
        a, b = at.reshape(-1, 2).T
        label = np.arange(len(ids))
        while True:
            new = label.copy()
            least = np.minimum(label[a], label[b])
            for side in (a, b, label[a], label[b]):
                np.minimum.at(new, side, least)
            new = new[new]
            if (new == label).all():
                return pd.DataFrame({by: lines[by].iloc[0], "id": ids, "component": ids[label]})
            label = new

    if not big.take(1):
        return edges.groupBy(by).applyInPandas(one, schema)
    small = edges.join(big, by, "left_anti").groupBy(by).applyInPandas(one, schema)
    name = lambda c: F.concat_ws("|", F.col(by).cast("string"), F.lpad(F.col(c).cast("string"), 20, "0"))
    got = components(edges.join(big, by, "left_semi").select(name("a").alias("a"), name("b").alias("b")))
    back = lambda c, k: F.split(c, "\\|")[k]
    return small.unionByName(got.select(back("id", 0).cast(edges.schema[by].dataType).alias(by), back("id", 1).cast("long").alias("id"), back("component", 1).cast("long").alias("component")))


def forest(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """label, a, b, o: a maximum spanning forest of each label's edges (label, a, b, o), ties by ids.

    Rounds in which every tree takes the best edge that leaves it, so trees at least pair up; edges within a tree leave the
    next round.  The order of edges is total, so what is taken has no cycles.
    """
    rank = F.struct((-F.col("o")).alias("o"), "a", "b")
    left, taken = settled(edges.select("label", "a", "b", "o").where("a <> b").withColumn("p", F.col("a")).withColumn("q", F.col("b"))), None
    for _ in range(most_rounds):
        if not left.take(1):
            return taken if taken is not None else left.select("label", "a", "b", "o")
        sides = left.select("label", F.col("p").alias("tree"), rank.alias("e")).unionByName(left.select("label", F.col("q").alias("tree"), rank.alias("e")))
        best = settled(sides.groupBy("label", "tree").agg(F.min("e").alias("e")).select("label", "e.a", "e.b", (-F.col("e.o")).alias("o")).distinct())
        taken = best if taken is None else settled(taken.unionByName(best))
        one = lambda c: F.concat_ws(":", F.col("label").cast("string"), F.col(c).cast("string"))
        tree = components(taken.select(one("a").alias("a"), one("b").alias("b")))
        at = lambda c, k: tree.select(F.col("id").alias(f"__{k}"), F.col("component").alias(k))
        named = left.select("label", "a", "b", "o", one("a").alias("__p"), one("b").alias("__q"))
        named = named.join(at("a", "p"), "__p", "left").join(at("b", "q"), "__q", "left").select("label", "a", "b", "o", F.coalesce("p", "__p").alias("p"), F.coalesce("q", "__q").alias("q"))
        left = settled(named.where("p <> q"))
    raise RuntimeError(f"the forest did not settle in {most_rounds} rounds")


def leaf_paths(nodes: DataFrame) -> DataFrame:
    """clique, node, depth: each leaf's path from its root in trees given as (node, parent; null at a root).

    Each leaf's path is one maximal clique of nodes that exclude each other.  By pointer doubling: a table of every node's
    ancestor 2**k steps up is joined with itself to that of 2**(k+1), and doubles what is known of the leaves' paths, so
    rounds grow with the logarithm of the depth and no row holds a path.  A cycle is an error.
    """
    up = settled(nodes.where(F.col("parent").isNotNull()).select("node", F.col("parent").alias("up")))
    inner = up.select(F.col("up").alias("node")).distinct()
    paths = settled(nodes.select("node").join(inner.hint("merge"), "node", "left_anti").select(F.col("node").alias("clique"), "node", F.lit(0).cast("long").alias("rise")))
    step, most = 1, up.count()
    while up.take(1):
        if step > 2 * most:
            raise ValueError("the parents have a cycle")
        more = paths.join(up.hint("merge"), "node").select("clique", F.col("up").alias("node"), (F.col("rise") + step).alias("rise"))
        grown = settled(paths.unionByName(more))
        above = up.select(F.col("node").alias("up"), F.col("up").alias("higher"))
        higher = settled(up.join(above.hint("merge"), "up").select("node", F.col("higher").alias("up")))
        for old in (paths, up):
            dropped(old)
        paths, up, step = grown, higher, 2 * step
    length = paths.groupBy("clique").agg(F.max("rise").alias("length"))
    return paths.join(length.hint("merge"), "clique").select("clique", "node", (F.col("length") - F.col("rise")).alias("depth"))


def nearest_stop(nodes: DataFrame) -> DataFrame:
    """node, stop: the first node with `stops` at or above each node of trees (node, up; null at a root, stops); null if there is none.

    Pointers that aren't at a stop move to where their target points, so rounds grow with the logarithm of the depth.
    """
    at = settled(nodes.select("node", F.when(F.col("stops"), F.col("node")).otherwise(F.col("up")).alias("stop"), (F.col("stops") | F.col("up").isNull()).alias("done")))
    while at.where(~F.col("done")).take(1):
        target = at.select(F.col("node").alias("stop"), F.col("stop").alias("next"), F.col("done").alias("there"))
        found = at.where(~F.col("done")).join(target.hint("merge"), "stop", "left").select("node", F.col("next").alias("stop"), F.coalesce("there", F.lit(True)).alias("done"))
        after = settled(at.where("done").unionByName(found))
        dropped(at)
        at = after
    return at.select("node", "stop")
