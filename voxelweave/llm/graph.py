"""Connected components of an edge table, without the driver holding any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(id, component: the least id reachable) of every node of edges (a, b).

    Each round replaces every node's label by the least of its neighbours' labels, then by its
    label's label, so that long paths halve; every step's aggregate combines before shuffling.
    """
    both = written(edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select("b", "a")).distinct(), "edges")
    own = edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct()
    near = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m"))
    label = written(own.join(near, "id", "left").select("id", F.least("id", F.coalesce("m", "id")).alias("label")), "labels")
    for _ in range(most_rounds):
        heard = both.join(label.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("m"))
        step = label.join(heard, "id", "left").select("id", F.col("label").alias("old"), F.least("label", F.coalesce("m", "label")).alias("label"))
        jump = label.select(F.col("id").alias("label"), F.col("label").alias("up"))
        new = written(step.join(jump, "label", "left").select("id", "old", F.least("label", F.coalesce("up", "label")).alias("label")), "labels")
        changed = new.where("old <> label").limit(1).count()
        drop_written(label)
        label = new.drop("old")
        if not changed:
            return label.withColumnRenamed("label", "component")
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
