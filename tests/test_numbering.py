"""Numbers without a window over a group, and paths by pointer doubling."""

import pytest
from pyspark.sql import functions as F

from voxelweave.operators import graph, numbering


def test_numbered(spark):
    rows = [((7 * k) % 101, k) for k in range(1000)]
    got = numbering.numbered(spark.createDataFrame(rows, "v long, k long").repartition(5), [F.desc("v"), "k"], parts=7)
    want = sorted(rows, key=lambda r: (-r[0], r[1]))
    assert [(r.v, r.k) for r in sorted(got.collect(), key=lambda r: r.number)] == want
    assert sorted(r.number for r in got.collect()) == list(range(1000))


def test_numbered_in_groups(spark):
    """One group, null, holds most rows and lies over many partitions; the plan has no window partitioned by the group over rows."""
    rows = [(None if k % 3 else k % 5, (k * 17) % 503, k) for k in range(2000)]
    got = numbering.numbered(spark.createDataFrame(rows, "g long, v long, k long"), ["v", "k"], "place", parts=9, groups=["g"])
    want = {}
    for g in {r[0] for r in rows}:
        for n, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: r[1:])):
            want[r[2]] = n
    assert {r.k: r.place for r in got.collect()} == want
    assert numbering.numbered(spark.createDataFrame([], "g long, v long"), ["v"], groups=["g"]).count() == 0


def test_deep_paths(spark):
    """A chain of 700 nodes with a leaf at every tenth one."""
    nodes = [(k, k - 1 if k else None) for k in range(700)] + [(1000 + k, k) for k in range(0, 690, 10)]
    got = {}
    for r in graph.leaf_paths(spark.createDataFrame(nodes, "node long, parent long")).collect():
        got.setdefault(r.clique, {})[r.depth] = r.node
    assert set(got) == {699} | {1000 + k for k in range(0, 690, 10)}
    for leaf, path in got.items():
        n = leaf if leaf < 1000 else leaf - 1000
        assert [path[d] for d in range(len(path))] == list(range(n + 1)) + ([leaf] if leaf >= 1000 else [])


def test_cycle(spark):
    with pytest.raises(ValueError):
        graph.leaf_paths(spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1)], "node long, parent long"))
