"""Blocks in a row share a file; whole masks are dealt without a table of their runs; the result is that of a file a block."""

import os

import pytest
from pyspark.sql import functions as F

from voxelweave.operators import masks
from voxelweave.sources import volumes


def test_shelves(spark, tmp_path):
    rows = [(z, y, x + (y * 7) % 5, x + 29, 10**9 + 1000 * z + x) for z in range(10) for y in range(16) for x in range(0, 400, 20)]
    rows += [(0, 0, 60, 70, 10**12), (0, 0, 61, 62, 3), (0, 1, 5, 5, 8), (25, 40, 200, 500, 4), (0, 0, 7, 9, 0)]
    painted = spark.createDataFrame(rows, "z long, y long, x0 long, x1 long, label long").repartition(3)
    read = lambda index: {tuple(r) for r in volumes.read_volume(index, (64, 16, 10)).collect()}
    one = volumes.export_volume(painted, str(tmp_path / "one"), (64, 16, 10), True).cache()
    many = volumes.export_volume(painted, str(tmp_path / "many"), (64, 16, 10), True, shelf=4).cache()
    assert read(one) == read(many.repartition(3)) and len(read(one)) > 100
    sums = lambda index: {(r.bx, r.by, r.bz, r.n_labelled, r.crc32) for r in index.collect()}
    assert sums(one) == sums(many) and len({r.path for r in many.collect()}) == 4 < len({r.path for r in one.collect()})
    path = many.where("bx = 1").first().path
    first = many.where(F.col("path") == path).orderBy("at").first()
    data = bytearray(open(path, "rb").read())
    data[first.at + first["size"] // 2] ^= 255
    with open(path, "wb") as f:
        f.write(data)
    with pytest.raises(Exception):
        volumes.read_volume(many, (64, 16, 10)).count()
    assert not [f for _, _, files in os.walk(tmp_path) for f in files if f.count(".") > 1 and not f.startswith(".")]


def test_whole_masks(spark, tmp_path):
    runs = spark.createDataFrame([(i, i % 3, y, x + y % 2, x + 90) for i, x in enumerate(range(0, 300, 25)) for y in range(5, 25)], "id long, z long, y long, x0 long, x1 long")
    packed = masks.with_masks(runs).withColumn("label", F.col("id") + 1)
    a = volumes.export_volume(runs.withColumn("label", F.col("id") + 1), str(tmp_path / "a"), (64, 16, 10), True)
    b = volumes.export_volume(packed, str(tmp_path / "b"), (64, 16, 10), True, shelf=4)
    assert {tuple(r) for r in volumes.read_volume(a, (64, 16, 10)).collect()} == {tuple(r) for r in volumes.read_volume(b, (64, 16, 10)).collect()}
