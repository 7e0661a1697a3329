"""The programme's rows are made of what stays open; what other rows imply is left out, and the optimum is the same."""

import random

from voxelweave.operators import solve


def _tables(spark, seed: int):
    """Slices 0 .. 29 with ends, some continuations and cliques; slices 20 and on are in no continuation, and 24 and on have ends that pay."""
    rng = random.Random(seed)
    s, c = [], []
    for i in range(30):
        for side, sl, sr in (("R", [i], []), ("L", [], [i])):
            s.append((0, f"E:{i}:{side}", 0, i % 5 + (side == "R"), sl, sr, float(rng.choice([-3, 1]) if i >= 24 else 2)))
    for a in range(0, 15):
        for b in rng.sample(range(15, 20), 2):
            s.append((0, f"C:{a}:{b}", 1, 1, [a], [b], float(rng.randint(-8, -2))))
    for k in range(25):
        a, b = sorted(rng.sample(range(30), 2))
        c += [(f"{k}:{a}-{b}", a, True), (f"{k}:{a}-{b}", b, True)]
    seg = spark.createDataFrame(s, "problem long, key string, type int, isi long, sl array<long>, sr array<long>, cost double")
    return seg, spark.createDataFrame([(i,) for i in range(30)], "id long"), spark.createDataFrame(c, "clique string, id long, maximal boolean")


def test_closed_ends_are_in_no_row(spark, monkeypatch):
    seen, rows_of = [], solve.programme

    def programme(segments, *rest):
        rows = rows_of(segments, *rest)
        seen.append({r.key for r in rows.select("key").collect()})
        return rows

    monkeypatch.setattr(solve, "programme", programme)
    for seed in range(2):
        seg, slices, cliques = _tables(spark, seed)
        got = solve.solved(seg, slices, cliques).cache()
        x = {r.key: r.x for r in got.collect()}
        assert set(x) == {r.key for r in seg.collect()} and got.count() == len(x)
        closed = {r.key for r in solve.opened(seg).where("closed").collect()}
        assert {"E:20:R", "E:23:L"} <= closed and not closed & seen[-1] and not any(x[k] for k in closed)
        cost = {r.key: r.cost for r in seg.collect()}
        whole = {r.key: r.x for r in solve.solve(seg.select("problem", "key", "cost"), rows_of(seg, slices, cliques)).collect()}
        assert sum(cost[k] * x[k] for k in x) == sum(cost[k] * whole[k] for k in whole)
        assert solve.broken(got, slices, cliques).count() == 0
        lasting = {r.key for r in solve.lasting(seg).collect()}
        assert lasting <= set(x) and not any(x[k] for k in set(x) - lasting)


def test_broken_rows(spark):
    seg, slices, cliques = _tables(spark, 5)
    bad = seg.selectExpr("*", "CAST(key IN ('E:3:R', 'E:3:L', 'C:3:' || get(sr, 0)) AS INT) AS x")
    rows = solve.programme(bad, slices, cliques)
    have: dict = {}
    on = {r.key for r in bad.where("x = 1").collect()}
    for r in rows.collect():
        k = (r.row, r.relation, r.value)
        have[k] = have.get(k, 0) + r.coef * (r.key in on)
    want = {(*k, h) for k, h in have.items() if k[1] == "=" and h != k[2] or k[1] == "<=" and h > k[2]}
    got = {(r.row, r.relation, r.value, r.have) for r in solve.broken(bad, slices, cliques).collect()}
    assert got == want and got


def test_lean():
    one = lambda *v: ({k: 1 for k in v}, "<=", 1)
    rows = [one(1, 2), one(2, 1), one(1, 2, 3), one(3, 4), ({1: 1, 2: -1}, "=", 0), ({1: 1, 2: -1}, "=", 0), ({3: 2, 4: 1}, "<=", 1), ({5: 1}, "<=", 1)]
    assert solve.lean(rows) == [one(1, 2, 3), one(3, 4), ({1: 1, 2: -1}, "=", 0), ({3: 2, 4: 1}, "<=", 1), ({5: 1}, "<=", 1)]
