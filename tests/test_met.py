"""Pairs of masks that meet, found in cells of the volume: pixels by brute force, at every border, and what is shuffled."""

import itertools

import numpy as np
import pytest

from voxelweave.operators import masks, segments
from voxelweave.sources import adapter

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def made(spark):
    """Slices at random, some over several cells and tiles, some with negative places and sections; one without pixels."""
    rng, rows, pixels = np.random.default_rng(5), [], {}
    for i in range(60):
        z, x, y = int(rng.integers(-5, 5)), int(rng.integers(-150, 150)), int(rng.integers(-40, 40))
        lines = []
        for r in range(int(rng.integers(1, 40))):
            a = x + int(rng.integers(0, 5))
            b = a + int(rng.integers(1, 120))
            lines += [(y + r, a, b), (y + r, b + 2, b + 4)]
        x0 = min(t[1] for t in lines)
        pixels[i] = (z, {(k, c) for k, a, b in lines for c in range(a, b)})
        flat = [v for k, a, b in lines for v in (k - y, a - x0, b - a)]
        rows.append((i, z, x0, y, max(t[2] for t in lines), lines[-1][0] + 1, len(pixels[i][1]), flat))
    rows.append((99, 0, None, None, None, None, 0, None))
    s = spark.createDataFrame(rows, "id long, z long, x0 long, y0 long, x1 long, y1 long, sz long, lines array<int>")
    return s, pixels


def test_met(made):
    s, pixels = made
    want = set()
    for (a, (z, p)), (b, (w, q)) in itertools.permutations(pixels.items(), 2):
        if (w == z + 1 or (w == z and a < b)) and p & q:
            want.add((a, b, z, w - z, len(p & q), len(p), len(q)))
    assert len(want) > 50
    for slab, cell in ((16, 1024), (2, 64), (3, 128)):
        got = [tuple(r) for r in masks.met(s, slab, cell).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_a_few_pairs_at_a_time():
    place = np.sort(np.random.default_rng(1).integers(0, 9, 40))
    left = np.arange(40) % 3 > 0
    pairs = lambda most: [(int(a), int(b)) for i, j in masks._pairs_of_tiles(place, 2, left, most) for a, b in zip(i, j)]
    want = {(a, b) for a in range(40) for b in range(40) if left[a] and ((a < b and place[a] == place[b]) or place[b] == place[a] + 2)}
    for most in (1, 7, 1 << 18):
        assert len(pairs(most)) == len(want) and set(pairs(most)) == want


def test_packed_slices_are_the_slices(spark):
    p = adapter.packed(spark, SMALL)
    names = ["id", "z", "x0", "y0", "x1", "y1", "sz", "sx", "sy"]
    assert p.select(names).exceptAll(adapter.slices(spark, SMALL).select(names)).count() == 0 and p.count() == 1500
    runs = adapter.runs(spark, SMALL).select("id", "z", "sz", "y", "x0", "x1")
    got = masks.runs_of(p, "sz")
    assert got.exceptAll(runs).count() == 0 and runs.exceptAll(got).count() == 0


def test_pairs_shuffle_masks_once(spark):
    """One exchange of the masks and no sum of pixels over a shuffle."""
    plan = masks.met(adapter.packed(spark, SMALL))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(slab") == 1 and "Aggregate" not in plan and "Join" not in plan


def test_pairs_left_out_of_the_branch_join_make_no_branch(spark):
    """The bound on what a second target adds is never under what one adds."""
    rng = np.random.default_rng(3)
    rows = [(int(rng.integers(0, 40)), 100 + i, 0, int(rng.integers(1, 60)), 60, int(rng.integers(60, 200))) for i in range(400)]
    p = spark.createDataFrame(rows, "a_id long, b_id long, z long, o long, a_sz long, b_sz long")
    none = p.select("a_id", "b_id").limit(0)
    want = set()
    for x, y in itertools.permutations(rows, 2):
        if x[0] == y[0] and x[1] > y[1]:
            o = x[3] + y[3]
            if o / max(60 + x[5] + y[5] - o, 1) >= 0.2 and min(x[5], y[5]) / max(x[5], y[5]) >= 0.5:
                want.add((x[0], x[1], y[1]))
    got = {(r.source, r.t1, r.t2) for r in segments.branches(p, none, like=0.2).collect()}
    assert want and got == want
