"""Chunks of a label volume that take what is drawn in them."""

import os

from voxelweave.operators import labels
from voxelweave.sources import volumes


def test_deflated_chunks(spark, tmp_path):
    rows = [(z, y, x + (y * 7) % 5, x + 29, 10**9 + 1000 * z + x) for z in range(10) for y in range(16) for x in range(0, 120, 20)]
    rows += [(0, 0, 60, 70, 10**12), (0, 0, 61, 62, 3), (0, 1, 5, 5, 8), (25, 40, 200, 500, 4)]
    painted = spark.createDataFrame(rows, "z long, y long, x0 long, x1 long, label long").repartition(3)
    want = {tuple(r) for r in labels.pixels(painted.where("x0 < x1")).select("z", "y", "x", "label").collect()}
    sums = {}
    for deflate in (False, True):
        index = volumes.export_volume(painted, str(tmp_path / str(deflate)), (64, 16, 10), deflate).cache()
        got = [(r.z, r.y, x, r.label) for r in volumes.read_volume(index, (64, 16, 10)).collect() for x in range(r.x0, r.x1)]
        assert len(got) == len(want) and set(got) == want
        found = index.collect()
        assert all(os.path.exists(r.path) for r in found) and len({(r.bx, r.by, r.bz) for r in found}) == len(found) == 8
        sums[deflate] = {(r.bx, r.by, r.bz): (r.n_labelled, r.crc32) for r in found}, sum(os.path.getsize(r.path) for r in found)
    assert sums[True][0] == sums[False][0] and sums[True][1] * 20 < sums[False][1]
