"""New sections as a stream: each micro-batch's slices are added once, and their blocks are flagged done."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.grid import Grid, slice_blocks
from ..operators.store import Tables


def ingest(batch: DataFrame, path: str, g: Grid) -> None:
    """Adds a batch of slices and their block links, and the blocks' flags; a batch that comes again changes nothing.

    New rows are a folder more of each table; what is there isn't written again.
    """
    tables = Tables(batch.sparkSession, path)
    links = slice_blocks(batch, g)
    flags = links.select("bx", "by", "bz").distinct().withColumn("flag", F.lit(True))
    for name, rows, keys in (("slices", batch, ["id"]), ("links", links, ["id", "bx", "by", "bz"]), ("slices_done", flags, ["bx", "by", "bz"])):
        tables.upsert(rows, name, keys)


def start(stream: DataFrame, path: str, checkpoint: str, g: Grid):
    return stream.writeStream.foreachBatch(lambda df, _: ingest(df, path, g)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
