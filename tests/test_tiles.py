"""The tile source: what it plans, reads and refuses."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelweave.sources import stacks, tiles


@pytest.fixture(scope="module")
def image():
    return np.rint(np.random.default_rng(4).random((3, 50, 70)) * 255) / 255


@pytest.fixture(scope="module")
def stack(spark, image, tmp_path_factory):
    rows = [(z, y, x, float(image[z, y, x])) for z in range(3) for y in range(50) for x in range(70)]
    s = stacks.StackDescription(70, 50, 3, base=f"{tmp_path_factory.mktemp('stack')}/", extension="pgm", tile=(32, 16), source_type=5)
    assert tiles.write_stack(spark.createDataFrame(rows, "z long, y long, x long, value double"), s).count() == 3 * 3 * 4
    return s


def read(df):
    return {(r.z, r.y, r.x): r.value for r in df.collect()}


def want(image, z, y, x):
    return {(k, j, i): image[k, j, i] for k in range(*z) for j in range(*y) for i in range(*x)}


def test_whole_and_box(spark, stack, image):
    got = tiles.read_stack(spark, stack)
    assert got.rdd.getNumPartitions() == 36 and read(got) == pytest.approx(want(image, (0, 3), (0, 50), (0, 70)))
    box = tiles.read_stack(spark, stack, (30, -5, 1, 34, 17, 9))
    assert box.rdd.getNumPartitions() == 2 * 2 * 2 and read(box) == pytest.approx(want(image, (1, 3), (0, 17), (30, 34)))
    assert tiles.read_stack(spark, stack, batch=2).rdd.getNumPartitions() == 3 * 4 * 2


def test_filters_prune(spark, stack, image):
    """Comparisons with constants become the reader's box: fewer partitions, and no filter is left for z, y and x."""
    got = tiles.read_stack(spark, stack).where((F.col("z") == 2) & (F.col("x") >= 64) & (F.col("y") < 16) & (F.col("y") > 3))
    assert got.rdd.getNumPartitions() == 1
    assert read(got) == pytest.approx(want(image, (2, 3), (4, 16), (64, 70)))
    bright = tiles.read_stack(spark, stack).where((F.col("z").isin(0, 2)) & (F.col("value") > 0.9) & (F.col("x") < 5))
    assert read(bright) == pytest.approx({k: v for k, v in want(image, (0, 3), (0, 50), (0, 5)).items() if v > 0.9 and k[0] != 1})
    assert tiles.read_stack(spark, stack).where("z > 7").count() == 0


def test_missing_tiles(spark, stack, image):
    import os

    gone = stacks.StackDescription(**{**vars(stack), "depth": 5})
    assert tiles.read_stack(spark, gone).where("z >= 2").count() == 50 * 70
    with pytest.raises(Exception, match="NoImage"):
        tiles.read_stack(spark, gone, required=True).count()
    os.remove(tiles.address(stack, 0, 0, 0))
    assert tiles.read_stack(spark, stack).where("z = 0").count() == 50 * 70 - 32 * 16


def test_refused(spark, stack):
    for box, error in (((5, 5, 0, 5, 9, 1), "no pixels"), ((70, 0, 0, 90, 9, 1), "outside")):
        with pytest.raises(Exception, match=error):
            tiles.read_stack(spark, stack, box).count()
    with pytest.raises(ValueError):
        tiles.decode(b"GIF89a")


def test_formats(spark, tmp_path):
    import io

    wide = np.arange(12).reshape(3, 4) / 65535
    assert (tiles.decode(tiles.encode(wide, 65535)) == wide).all()
    out = io.BytesIO()
    np.save(out, np.array([[0, 255]], np.uint8))
    assert tiles.decode(out.getvalue()).tolist() == [[0.0, 1.0]]
    assert tiles.decode(b"P5 # made by hand\n2 1 255\n\x00\xff").tolist() == [[0.0, 1.0]]


@pytest.mark.parametrize("kind", [1, 4, 5, 6, 8])
def test_addresses(spark, kind):
    s = stacks.StackDescription(base="http://h/", extension="jpg", scale=2, tile=(512, 256), source_type=kind)
    url = stacks.tile_url(kind, s.base, s.extension, s.scale, s.tile, "z", "r", "c")
    assert spark.range(1).select(F.lit(3).alias("z"), F.lit(5).alias("r"), F.lit(7).alias("c")).select(url).first()[0] == tiles.address(s, 3, 5, 7)


def test_label_volume(spark, tmp_path):
    """Chunks hold the painted pixels, background 0; blocks without labels have no file; a changed file is noticed."""
    import pathlib

    from voxelweave.operators import labels
    from voxelweave.sources import volumes

    rows = [(0, 0, 0, 20, 5), (0, 0, 3, 9, 9), (0, 0, 12, 13, 2), (0, 1, 7, 8, 1), (3, 5, 16, 40, 4), (3, 5, 20, 22, 0), (3, 5, 22, 24, -3)]
    painted = spark.createDataFrame(rows, "z long, y long, x0 long, x1 long, label long")
    index = volumes.export_volume(painted, str(tmp_path), (8, 4, 2)).cache()
    want = {tuple(r) for r in labels.pixels(painted.where("label > 0")).select("z", "y", "x", "label").collect()}
    found = index.collect()
    assert {(r.bx, r.by, r.bz) for r in found} == {(x // 8, y // 4, z // 2) for z, y, x, _ in want} and sum(r.n_labelled for r in found) == len(want)
    one = next(r for r in found if (r.bx, r.by, r.bz) == (0, 0, 0))
    assert np.load(one.path)[0, 0].tolist() == [5, 5, 5, 9, 9, 9, 9, 9] and np.load(one.path).shape == (2, 4, 8)
    got = [(r.z, r.y, x, r.label) for r in volumes.read_volume(index, (8, 4, 2)).collect() for x in range(r.x0, r.x1)]
    assert len(got) == len(want) and set(got) == want
    chunk = np.load(one.path)
    chunk[1, 1, 1] = 77
    np.save(one.path, chunk)
    with pytest.raises(Exception, match="has changed"):
        volumes.read_volume(index, (8, 4, 2)).count()
    assert not list(pathlib.Path(tmp_path).glob("*/*.npy.*"))
