"""Small problems fall apart in their task, large ones over tables; both give the same, and nothing that grows is broadcast."""

from voxelweave.operators import graph, solve


def _programme(spark):
    v, c = [], []
    for p in range(6):
        for k in range(7):
            v.append((p, f"k{k}", float((k * 5 + p * 3) % 7 - 4)))
        for k in range(0, 6, 1 + p % 3):
            c += [(p, f"r{k}", f"k{k}", 1, "<=", 1), (p, f"r{k}", f"k{k + 1}", 1, "<=", 1)]
    return spark.createDataFrame(v, "problem long, key string, cost double"), spark.createDataFrame(c, "problem long, row string, key string, coef int, relation string, value long")


def test_whole_or_by_tables(spark, monkeypatch):
    v, c = _programme(spark)
    by_tables = sorted(map(tuple, solve.solve(v, c, whole=0).collect()))
    mixed = sorted(map(tuple, solve.solve(v, c, whole=8).collect()))  # problems with 12 coefficients over tables, the others whole
    monkeypatch.setattr(solve, "components", lambda edges: 1 / 0)
    assert sorted(map(tuple, solve.solve(v, c).collect())) == by_tables == mixed


def test_pieces():
    rows = [({0: 1, 3: 1}, "<=", 1), ({2: 1}, "<=", 1), ({3: -1, 4: 1}, "=", 0)]
    assert solve.pieces(5, rows) == [([0, 3, 4], [({0: 1, 1: 1}, "<=", 1), ({1: -1, 2: 1}, "=", 0)]), ([1], []), ([2], [({0: 1}, "<=", 1)])]


def test_components_within(spark):
    e = [(p, i, i + 1) for p in range(4) for i in range(-3, 40) if i % (5 + p)] + [(9, 7, 7)]
    edges = spark.createDataFrame([x for x in e if x[0] != 9 or True], "problem long, a long, b long").where("a >= 0")
    some, none = (sorted(map(tuple, graph.components_within(edges, "problem", most=m).collect())) for m in (35, 1000))
    assert some == none and (0, 1, 1) in none and (0, 5, 1) in none and (0, 6, 6) in none and (9, 7, 7) in none


def test_components_broadcast_nothing(spark, monkeypatch):
    plans, keep = [], graph.settled

    def settled(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(df)

    monkeypatch.setattr(graph, "settled", settled)
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(20)], "a string, b string")
    assert graph.components(edges).select("component").distinct().collect()[0][0] == "n0"
    assert plans and not any("Broadcast" in p for p in plans)
