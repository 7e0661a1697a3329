"""Slices, values and vectors out of the driver's tables: integer rules that any SQL engine repeats."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.masks import small


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, z, and x, y: the corner of each order's mask."""
    z = ((F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate") - 1).cast("long")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), z.alias("z"), F.col("o_custkey").alias("x"), F.floor(F.col("o_totalprice") / 10000).cast("long").alias("y"))


def _lines(spark: SparkSession, sf_dir: str, deal: bool = False) -> DataFrame:
    """A row for each order: id, z, and lines, its mask's runs (y, x0, x1): a box with ragged sides, and holes in every fourth line.

    deal: the orders are dealt by id before their masks are made, as a file of few row groups is read by few tasks.
    """
    o = _orders(spark, sf_dir)
    o = o.repartition("id") if deal else o
    a, b = "x + (r * (1 + id % 3)) % 3", "x + 4 + id % 40 - IF(r > 0, (r + id) % 2, 0)"
    run = "named_struct('y', y + r, 'x0', {}, 'x1', {})".format
    hole = f"r % 4 = 2 AND ({b}) - ({a}) >= 8"
    lines = f"flatten(transform(sequence(0L, 3 + id % 30), r -> IF({hole}, array({run(a, f'{a} + 3')}, {run(f'{a} + 5', b)}), array({run(a, b)}))))"
    return o.select("id", "z", F.expr(lines).alias("lines"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, z, sz, y, x0, x1: the masks' runs; sz is the slice's number of pixels."""
    return slices(spark, sf_dir, ("lines",)).select("id", "z", "sz", F.inline("lines"))


def slices(spark: SparkSession, sf_dir: str, more: tuple[str, ...] = (), deal: bool = False) -> DataFrame:
    """id, z, box, sz, sx, sy of orders' masks, within the row; density stays the same at every scale."""
    total = lambda e: F.expr(f"aggregate(lines, 0L, (s, t) -> s + {e})")
    box = [F.expr(f"array_{f}(transform(lines, t -> t.{c})) + {k}L").alias(n) for n, f, c, k in (("x0", "min", "x0", 0), ("y0", "min", "y", 0), ("x1", "max", "x1", 0), ("y1", "max", "y", 1))]
    sums = [total("t.x1 - t.x0").alias("sz"), total("(t.x0 + t.x1 - 1) * (t.x1 - t.x0) div 2").alias("sx"), total("t.y * (t.x1 - t.x0)").alias("sy")]
    return _lines(spark, sf_dir, deal).select("id", "z", *box, *sums, *more)


PACKED = "id long, z long, x0 long, y0 long, x1 long, y1 long, sz long, sx long, sy long, lines binary"


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, z, box, sz, sx, sy, lines: the same slices with their masks packed (see `masks.small`), made for a batch of orders at once."""

    def run(batches):
        for t in batches:
            known = [t.column(c).is_valid().to_numpy(zero_copy_only=False) for c in ("id", "x", "y")]
            i, x, y = (pc.fill_null(t.column(c), 0).to_numpy() for c in ("id", "x", "y"))
            h = 4 + i % 30
            of = np.repeat(np.arange(len(i)), h)
            r, k = np.arange(len(of)) - np.repeat(np.cumsum(h) - h, h), i[of]
            a, b = (r * (1 + k % 3)) % 3, 4 + k % 40 - np.where(r > 0, (r + k) % 2, 0)
            hole = (r % 4 == 2) & (b - a >= 8)
            n = 1 + hole
            right = np.cumsum(n)[hole] - 1  # the second run of a line with a hole
            of, r, a, b = (np.repeat(c, n) for c in (of, r, a, b))
            a[right] += 5
            b[right - 1] = a[right - 1] + 3
            first = np.searchsorted(of, np.arange(len(i)))
            x0, x1 = np.minimum.reduceat(a, first), np.maximum.reduceat(b, first)
            area, total = b - a, lambda v: np.add.reduceat(v, first)
            sz = total(area)
            sums = (sz, total((a + b - 1) * area // 2) + x * sz, total(r * area) + y * sz)
            no = {c: ~np.logical_and.reduce([known["ixy".index(u)] for u in c]) for c in ("ix", "iy", "ixy")}
            columns = [(x + x0, "ix"), (y, "iy"), (x + x1, "ix"), (y + h, "iy"), (sums[0], "ix"), (sums[1], "ix"), (sums[2], "ixy")]
            lines = small(np.stack((r, a - x0[of], area), 1), np.bincount(of, minlength=len(i)))
            lines = pc.if_else(pa.array(no["ixy"]), None, lines)
            yield pa.RecordBatch.from_arrays([t.column("id"), t.column("z"), *(pa.array(v, mask=no[c]) for v, c in columns), lines], names=PACKED.replace(" long", "").replace(" binary", "").split(", "))

    return _orders(spark, sf_dir).repartition("id").mapInArrow(run, PACKED)


SLICES_SQL = """base AS (SELECT o_orderkey AS id, CAST((year(o_orderdate)-1995)*12+month(o_orderdate)-1 AS BIGINT) AS z, o_custkey AS x0, CAST(floor(o_totalprice/10000) AS BIGINT) AS y0, 4+o_orderkey%40 AS w, unnest(range(0, 4+o_orderkey%30)) AS r FROM orders),
lines AS (SELECT id, z, y0+r AS y, r, x0+(r*(1+id%3))%3 AS a, x0+w-CASE WHEN r>0 THEN (r+id)%2 ELSE 0 END AS b FROM base),
runs AS (SELECT id, z, y, a AS x0, CASE WHEN r%4=2 AND b-a>=8 THEN a+3 ELSE b END AS x1 FROM lines UNION ALL SELECT id, z, y, a+5, b FROM lines WHERE r%4=2 AND b-a>=8),
slices AS (SELECT id, z, min(x0) AS x0, min(y) AS y0, max(x1) AS x1, max(y)+1 AS y1, CAST(sum(x1-x0) AS BIGINT) AS sz, CAST(sum((x0+x1-1)*(x1-x0)//2) AS BIGINT) AS sx, CAST(sum(y*(x1-x0)) AS BIGINT) AS sy FROM runs GROUP BY id, z)"""


def values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, value in [0, 1]: pixel intensities of slices."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_discount") * 10).alias("value"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("features"), "label")
