"""Programmes over their open rows: as good as all assignments, and proven where branch and bound gives up."""

import itertools
import random

from voxelweave.operators import solve


def holds(rows, x):
    have = [(sum(c * x[v] for v, c in coef.items()), rel, value) for coef, rel, value in rows]
    return all(h <= v if rel == "<=" else h >= v if rel == ">=" else h == v for h, rel, v in have)


def test_open_rows_against_all_assignments():
    rnd = random.Random(1)
    for _ in range(300):
        n = rnd.randint(1, 9)
        cost = [rnd.randint(-20, 20) / 4 for _ in range(n)]
        rows = [({v: rnd.choice([1, 1, -1, 2, -3]) for v in rnd.sample(range(n), rnd.randint(1, min(n, 4)))}, rnd.choice(["<=", ">=", "="]), rnd.randint(-1, 3)) for _ in range(rnd.randint(0, 8))]
        best = min((sum(c * a for c, a in zip(cost, x)) for x in itertools.product((0, 1), repeat=n) if holds(rows, x)), default=None)
        for known in ([], solve.branch_and_bound(cost, rows, 5)[0]):
            got = solve.by_open_rows(cost, rows, known)
            assert (got == []) if best is None else (holds(rows, got) and sum(c * a for c, a in zip(cost, got)) == best)


def ring(n):
    """A ring of triangles of which neighbours exclude each other: many choices nearly as good."""
    rnd = random.Random(n)
    cost = [-1 - rnd.randint(0, 3) / 4 for _ in range(3 * n)]
    rows = []
    for k in range(n):
        a, b = 3 * k, 3 * ((k + 1) % n)
        rows += [({a: 1, a + 1: 1, b: 1}, "<=", 1), ({a + 1: 1, a + 2: 1, b + 2: 1}, "<=", 1), ({a + 2: 1, b: 1, b + 1: 1}, "<=", 1)]
    return cost, rows


def test_more_than_branch_and_bound_proves():
    cost, rows = ring(40)
    assert not solve.branch_and_bound(cost, rows, 200_000)[1]
    x, sure = solve.exact(cost, rows, 200_000)
    assert sure and holds(rows, x)


def test_solve_of_a_large_component(spark):
    """A component that branch and bound leaves unproven within the limit, beside small ones, in partitions of several components."""
    cost, rows = ring(40)
    v = [(0, f"v{i:03}", c) for i, c in enumerate(cost)] + [(1, f"w{i}", -1.0) for i in range(50)]
    r = [(0, f"r{k}", f"v{i:03}", c, rel, value) for k, (coef, rel, value) in enumerate(rows) for i, c in coef.items()]
    r += [(1, f"p{i // 2}", f"w{i}", 1, "<=", 1) for i in range(50)]
    got = solve.solve(spark.createDataFrame(v, "problem long, key string, cost double"), spark.createDataFrame(r, "problem long, row string, key string, coef int, relation string, value long"), 200_000)
    x = {(p, k): n for p, k, n in got.collect()}
    assert len(x) == len(v) and sum(n for (p, _), n in x.items() if p == 1) == 25
    best, _ = solve.exact(cost, rows, 200_000)
    assert sum(c * x[0, k] for _, k, c in v[: len(cost)]) == sum(c * n for c, n in zip(cost, best))
