"""Near-duplicates and exact matches without taking every mask apart."""

from voxelweave.operators import labels, masks
from voxelweave.sources import adapter

SMALL = "/root/testdata/sf0.001"


def test_the_same_from_runs_and_rows(spark):
    """Several rounds of merging (a low likeness), from both forms."""
    p, r = adapter.packed(spark, SMALL).where("z < 12"), adapter.runs(spark, SMALL).where("z < 12").drop("sz")
    rows = lambda d: sorted(map(tuple, d.collect()))
    (a, gone), (b, gone_too) = masks.remove_duplicates(p, 0.3, 400), masks.remove_duplicates(r, 0.3, 400)
    assert rows(gone) == rows(gone_too) and rows(gone)
    assert rows(a.select("id", "z", "y", "x0", "x1")) == rows(b.select("id", "z", "y", "x0", "x1"))


def test_matches_make_no_row_a_pixel(spark):
    """One mask cut into other runs matches; one with the same box, size and sums, but other pixels, doesn't."""
    t = "id long, z long, y long, x0 long, x1 long"
    old = spark.createDataFrame([(1, 0, 0, 0, 9), (2, 0, 5, 0, 1), (2, 0, 5, 3, 4), (2, 0, 6, 1, 3), (2, 0, 7, 1, 3), (2, 0, 8, 0, 1), (2, 0, 8, 3, 4)], t)
    new = spark.createDataFrame([(7, 0, 0, 0, 4), (7, 0, 0, 4, 9), (8, 0, 5, 1, 3), (8, 0, 6, 0, 1), (8, 0, 6, 3, 4), (8, 0, 7, 0, 1), (8, 0, 7, 3, 4), (8, 0, 8, 1, 3)], t)
    got = labels.exact_matches(old, new)
    assert [tuple(r) for r in masks.measure(old).where("id = 2").drop("id").collect()] == [tuple(r) for r in masks.measure(new).where("id = 8").drop("id").collect()]
    assert [tuple(r) for r in got.collect()] == [(1, 7)]
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in labels.exact_matches(masks.with_masks(old), masks.with_masks(new)).collect()] == [(1, 7)]
    both = [sorted(map(tuple, labels.edits(f(old), f(new)).collect())) for f in (masks.with_masks, lambda d: d)]
    assert both[0] == both[1] == []  # 2 and 8 share no pixel
