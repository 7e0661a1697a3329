"""What is painted, and what encloses what, without lines or places being shuffled."""

import re

import numpy as np
import pytest

from voxelweave.operators import constraints, labels
from voxelweave.plans import catalogue

SMALL = "/root/testdata/sf0.001"


def test_visible(spark):
    rng, rows, want = np.random.default_rng(2), [], {}
    for i in range(40):
        z, x, y, label = int(rng.integers(0, 2)), int(rng.integers(-60, 60)), int(rng.integers(-20, 20)), int(rng.integers(-5, 30))
        lines = [(r, int(a := rng.integers(0, 4)), int(rng.integers(1, 50)) + 0 * int(a)) for r in range(int(rng.integers(1, 25)))]
        x0 = x + min(t[1] for t in lines)
        flat = [v for r, a, n in lines for v in (r, a + x - x0, n)]
        rows.append((i, z, x0, y, x + max(a + n for _, a, n in lines), y + len(lines), flat, label))
        for r, a, n in lines:
            for c in range(x + a, x + a + n):
                want[z, y + r, c] = max(label, want.get((z, y + r, c), label))
    rows += [(90, 0, 0, 0, 5, 1, [0, 0, 5], None), (91, 0, None, None, None, None, None, 4)]
    s = spark.createDataFrame(rows, "id long, z long, x0 long, y0 long, x1 long, y1 long, lines array<int>, label long")
    for w, h in ((8192, 1024), (16, 8)):
        got = [((r.z, r.y, x), r.label) for r in labels.visible(s, w, h).collect() for x in range(r.x0, r.x1)]
        assert len(got) == len(want) and dict(got) == want


def test_label_paint_shuffles_no_lines(spark):
    """Masks by id and by cell, then sums of a label: no exchange by a line."""
    plan = catalogue.label_paint(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Exchange hashpartitioning\(.*\by#", plan)


def test_enclosing(spark):
    """Against all pairs; and no join of places."""
    rng = np.random.default_rng(7)
    c = lambda n, lo, hi: [(f"{lo}:{i}", int(rng.integers(0, 2)), int(rng.integers(0, 9)), int(rng.integers(10, 19)), int(rng.integers(lo, hi)), float(rng.integers(0, 60)), float(rng.integers(0, 60))) for i in range(n)]
    small, large = c(60, 10, 40), c(60, 80, 99)
    share = {(a, b): int(rng.integers(1, 30)) for k in (0, 10) for a in range(k, k + 9) for b in range(k, k + 9) if rng.random() < 0.4}
    t = "key string, isi int, left long, right long, sz long, cx double, cy double"
    inner, outer = (spark.createDataFrame(r, t) for r in (small, large))
    shared = spark.createDataFrame([(*k, o) for k, o in share.items()], "a_id long, b_id long, o long")
    want = set()
    for i in small:
        for o in large:
            held = share.get((i[2], o[2]), 0) + share.get((i[3], o[3]), 0)
            if i[1] == o[1] and (i[5] - o[5]) ** 2 + (i[6] - o[6]) ** 2 < 1000 and held / i[4] >= 0.9:
                want.add((i[0], o[0]))
    got = constraints.enclosing(inner, outer, shared)
    assert want and sorted(map(tuple, got.collect())) == sorted(want)
    assert "floor" not in got._jdf.queryExecution().executedPlan().toString().lower()
    with pytest.raises(ValueError):
        constraints.enclosing(inner, outer, shared, least=0)
