"""Programmes by windows against all assignments' best: agreement, odd cycles over borders, windows that may not grow."""

import random

import pytest
from pyspark.sql import functions as F

from voxelweave.operators import decompose, solve


def tables(spark, variables, rows):
    v = spark.createDataFrame(variables, "key string, cost double, window long")
    return v, spark.createDataFrame([(n, k, c, rel, val) for n, coef, rel, val in rows for k, c in coef.items()], "row string, key string, coef int, relation string, value int")


def optimum(variables, rows):
    at = {k: i for i, (k, _, _) in enumerate(variables)}
    x, sure = solve.branch_and_bound([c for _, c, _ in variables], [({at[k]: c for k, c in coef.items()}, rel, val) for _, coef, rel, val in rows])
    assert sure
    return sum(c * g for (_, c, _), g in zip(variables, x))


def feasible(rows, x):
    for _, coef, rel, val in rows:
        have = sum(c * x[k] for k, c in coef.items())
        if (rel == "=" and have != val) or (rel == "<=" and have > val) or (rel == ">=" and have < val):
            return False
    return True


def odd_cycles(n=5, per=3):
    """A ring of n where neighbours exclude each other: the relaxation's best is half of each."""
    v = [(f"k{i:03d}", -4.0 - (i * 7 % 3), i // per) for i in range(n)]
    rows = [(f"r{i}", {f"k{i:03d}": 1, f"k{(i + 1) % n:03d}": 1}, "<=", 1) for i in range(n)]
    return v, rows


def test_windows_join_where_relaxation_has_a_gap(spark):
    v, rows = odd_cycles()
    solution, bounds = decompose.solve_windows(*tables(spark, v, rows), rounds=2)
    x = {r.key: r.x for r in solution.collect()}
    (b,) = bounds.collect()
    best = optimum(v, rows)
    assert feasible(rows, x) and len(x) == len(v)
    assert b.lower == pytest.approx(best) and b.upper == pytest.approx(best) and sum(c * x[k] for k, c, _ in v) == pytest.approx(best)


def test_windows_that_may_not_grow_give_bounds(spark):
    v, rows = odd_cycles()
    solution, bounds = decompose.solve_windows(*tables(spark, v, rows), rounds=2, most=4, hops=1)
    x = {r.key: r.x for r in solution.collect()}
    (b,) = bounds.collect()
    best = optimum(v, rows)
    assert feasible(rows, x) and b.lower <= best + 1e-6 and best <= b.upper + 1e-6
    assert b.upper == pytest.approx(sum(c * x[k] for k, c, _ in v))


def test_windows_of_random_programmes(spark):
    rnd = random.Random(5)
    v, rows = [], []
    for p in range(3):  # three components in one call
        n = 8
        v += [(f"p{p}k{i:02d}", float(rnd.randint(-9, 4)), i // 4) for i in range(n)]
        rows += [(f"p{p}r{i}", {f"p{p}k{j:02d}": 1 for j in sorted(rnd.sample(range(max(0, i - 3), min(n, i + 4)), 3))}, "<=", 1) for i in range(n)]
        rows += [(f"p{p}f{i}", {f"p{p}k{i:02d}": 1, f"p{p}k{i + 2:02d}": -1}, "=", 0) for i in range(0, n - 2, 5)]
    v.append(("free", -2.0, 0))
    v.append(("dear", 2.0, 0))
    solution, bounds = decompose.solve_windows(*tables(spark, v, rows), rounds=2)
    x = {r.key: r.x for r in solution.collect()}
    assert feasible(rows, x) and x["free"] == 1 and x["dear"] == 0 and len(x) == len(v)
    total = bounds.agg(F.sum("lower").alias("lower"), F.sum("upper").alias("upper")).first()
    best = optimum(v, rows)
    assert total.lower == pytest.approx(best) and total.upper == pytest.approx(best)


def test_windows_without_solution_or_rows(spark):
    v, rows = [("a", 1.0, 0), ("b", 1.0, 1)], [("r", {"a": 1, "b": 1}, ">=", 3)]
    with pytest.raises(ValueError):
        decompose.solve_windows(*tables(spark, v, rows))
    a, c = tables(spark, v, rows)
    solution, bounds = decompose.solve_windows(a, c.limit(0))
    assert {r.key: r.x for r in solution.collect()} == {"a": 0, "b": 0} and bounds.count() == 2


def test_window_codes_join_neighbours(spark):
    got = spark.sql("select * from values (0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1), (1, 1, 1), (5, 9, 3) as t(x, y, z)").select("x", "y", "z", decompose.window_code(F.col("x"), F.col("y"), F.col("z")).alias("w")).collect()
    assert [r.w for r in got[:5]] == [0, 1, 2, 4, 7]
    want = sum(((r >> b) & 1) << (3 * b + k) for k, r in enumerate((5, 9, 3)) for b in range(20))
    assert got[5].w == want
