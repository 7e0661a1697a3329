"""Windows, numbers and blocks of segments without joins of all segments: against the plain forms, and what is shuffled."""

import pytest
from pyspark.sql import functions as F

from voxelweave.operators import constraints, features, numbering, segments, store
from voxelweave.plans import catalogue

SMALL = "/root/testdata/sf0.001"
SEGMENT = "key string, type int, isi long, sl array<long>, sr array<long>"


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning") + plan.count("Exchange rangepartitioning"), plan


@pytest.fixture(scope="module")
def odd(spark):
    """Slices seen at intervals far apart, on one side only, without an interval, before the first window and without an id."""
    rows = [("a", 0, 6, [1], []), ("b", 0, 7, [], [1]), ("c", 1, 9, [1], [2]), ("d", 0, 10, [2], []), ("e", 0, 3, [3], []), ("f", 0, 30, [], [3]), ("g", 0, 5, [4], []), ("h", 2, 12, [5], [6, 7]), ("i", 0, 12, [6], [])]
    rows += [("j", 0, 13, [], [5]), ("k", 0, 14, [7], []), ("l", 0, None, [8], []), ("m", 0, 4, [], [8]), ("n", 0, -3, [9], []), ("o", 0, -2, [], [9]), ("p", 0, 1, [None], []), ("q", 0, 1, [], [None])]
    return spark.createDataFrame(rows, SEGMENT)


@pytest.mark.parametrize("size, overlap", [(10, 3), (4, 0), (2, 1)])
def test_rows_of_windows(odd, size, overlap):
    want = constraints.window_rows(constraints.continuation_rows(odd), constraints.in_windows(odd, size, overlap)).collect()
    got = constraints.continuation_windows(odd, size, overlap).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) > 0


def test_no_window_before_the_first(odd):
    """An interval below 0 is in no window; it was in 0 and -1."""
    got = {(r.key, r.window) for r in constraints.in_windows(odd, 10, 3).collect()}
    assert {w for _, w in got} == {0, 1, 2, 3, 4} and not {"l", "n", "o"} & {k for k, _ in got}


def test_windows_are_not_joined(spark):
    """One sum over slices (the keys of all segments were joined with their windows, and counted twice)."""
    n, plan = exchanges(catalogue.QUERIES["subproblem_constraints"](spark, SMALL))
    assert n == 1 and "Join" not in plan


def test_numbers_are_not_shuffled_again(spark, odd):
    """The place of a partition comes to its rows, whatever the limit of broadcasts."""
    had = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        n, plan = exchanges(numbering.numbered(odd, ["type", "isi", "key"]))
        assert n == 1 and "SortMergeJoin" not in plan  # the count of each partition's rows
        n, plan = exchanges(catalogue.QUERIES["subproblem_text"](spark, SMALL))
        assert "hashpartitioning(key" not in plan and "SortMergeJoin [key" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", had)


def test_numbers_in_rows(odd):
    got = {r.key: r.number for r in constraints.with_numbers(odd).collect()}
    assert got == {r.key: r.number for r in constraints.variables(odd).collect()} and sorted(got.values()) == list(range(17))


def test_terms_of_rows(odd):
    """The lists of a row are its segments' numbers by side, in order."""
    got = {r.row: (r.pos_n, r.neg_n) for r in constraints.continuation_spans(odd.withColumn("n", F.ascii("key") - 97), n="n").collect()}
    assert got["flow:1"] == ([0, 2], [1]) and got["flow:5"] == ([7], [9]) and got["flow:6"] == ([8], [7]) and "flow:4" not in got and "flow:8" not in got


def test_segments_of_blocks(spark, odd):
    s = odd.where("isi is not null").withColumn("cost", F.when(F.col("isi") % 2 == 1, 1.0))
    links = spark.createDataFrame([(1, 0, 0), (1, 0, 1), (7, 0, 0), (3, 5, 5)], "id long, bx long, by long")
    blocks = spark.createDataFrame([(0, 0), (0, 1)], "bx long, by long")
    feats = spark.createDataFrame([("a", 60), ("b", 70), ("h", 80), ("e", 90)], "key string, feature int")
    tell = lambda df: {r.key: ([(x.id, x.is_left) for x in r.slices], r.feature) for r in df.collect()}
    one, two, h = [(1, True)], [(1, True), (2, False)], [(5, True), (6, False), (7, False)]
    assert tell(store.segments_by_blocks(s, links, blocks, feats, True)) == {"a": (one, 60), "b": ([(1, False)], None), "c": (two, None), "h": (h, 80), "k": ([(7, True)], None)}
    assert tell(store.segments_by_blocks(s, links, blocks, feats, False)) == {"a": (one, 60), "b": ([(1, False)], 70), "h": (h, 80)}


def test_slices_of_segments_are_not_gathered(spark):
    """Segments are shuffled once for their slices (and features once), not grouped by key from all their members."""
    n, plan = exchanges(catalogue.QUERIES["segments_by_blocks_costs"](spark, SMALL))
    assert "collect_set" not in plan and n <= 7


def test_histograms_are_made_once(spark):
    rel = spark.createDataFrame([("c", 1, 1, 2, None), ("b", 2, 3, 2, 1), ("x", 1, None, 8, None)], "key string, type int, s long, t1 long, t2 long")
    values = spark.createDataFrame([(1, 0.05), (1, 0.15), (2, 0.15), (2, 1.0)], "id long, value double")
    df = features.histogram_differences(rel, features.histograms(values))
    plan = exchanges(df)[1]
    got = {r.key: (r.d, r.dn) for r in df.collect()}
    assert got["c"] == ([1, 0] + [0] * 7 + [1], [0.5, 0.0] + [0.0] * 7 + [0.5])
    assert got["b"] == ([1, 2] + [0] * 7 + [1], [0.25, 0.5] + [0.0] * 7 + [0.25]) and got["x"] == ([0] * 10, [0.0] * 10)
    assert plan.count("Exchange hashpartitioning(id") == 2 and plan.count("Join") == 1  # the histograms and the slices of all sides


def test_pairs_of_branches_are_shuffled_once(spark):
    """Both sides of the join of a source's pairs are one exchange (they were two of different columns), whatever the limit of broadcasts."""
    had = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs = spark.createDataFrame([(1, 10, 3, 20, 50, 25), (1, 11, 3, 22, 50, 24), (2, 10, 3, 1, 9, 25), (1, 12, 3, 24, 50, 26)], "a_id long, b_id long, z long, o long, a_sz long, b_sz long")
        b = segments.branches(pairs, spark.createDataFrame([(11, 12)], "a_id long, b_id long"))
        assert {tuple(r)[:6] for r in b.collect()} == {(11, 10, 1, 3, 42, 50), (12, 10, 1, 3, 44, 50)}
        final = b._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert "ReusedExchange" in final
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", had)
