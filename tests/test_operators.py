"""Operators against definitions: pixels, all assignments, one block against many, stores, sources, streams."""

import itertools
import pickle

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelweave import streaming
from voxelweave.engine import Engine, SliceParameters, SolutionParameters, get_log_level, set_log_level
from voxelweave.operators import constraints, extract, features, graph, grid, labels, learned, masks, segments, solve, spatial, store
from voxelweave.sources import stacks

RUNS = "id long, z long, y long, x0 long, x1 long"


def shapes(spark, n=120, seed=0, sections=4):
    """Ragged masks with holes: their runs, their slices, and the pixels of each."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        x, y, w, h = int(rng.integers(0, 120)), int(rng.integers(0, 60)), int(rng.integers(3, 30)), int(rng.integers(3, 25))
        z, lean = int(rng.integers(sections)), int(rng.integers(0, 3))
        for r in range(h):
            at = x + lean * r // 2
            if w > 8 and r % 3 == 1:
                rows += [(i, z, y + r, at, at + 3), (i, z, y + r, at + 6, at + w)]
            else:
                rows.append((i, z, y + r, at, at + w))
    runs = masks.unite(spark.createDataFrame(rows, RUNS))
    slices = masks.measure(runs).cache()
    runs = runs.join(slices.select("id", "sz"), "id").cache()
    pixels = {}
    for i, z, y, x0, x1 in rows:
        pixels.setdefault((i, z), set()).update((x, y) for x in range(x0, x1))
    return runs, slices, pixels


def hypotheses(slices, runs):
    t = masks.tiles(runs, "sz")
    return segments.all_segments(slices, masks.overlap_pairs(t), masks.conflict_pairs(t))


def test_overlap_is_pixels(spark):
    runs, slices, px = shapes(spark)
    assert {(r.id, r.z, r.sz, r.x0, r.y0, r.x1, r.y1) for r in slices.collect()} == {(i, z, len(p), min(x for x, _ in p), min(y for _, y in p), max(x for x, _ in p) + 1, max(y for _, y in p) + 1) for (i, z), p in px.items()}
    t = masks.tiles(runs, "sz")
    for dz, got in ((1, masks.overlap_pairs(t)), (0, masks.conflict_pairs(t))):
        want = {(a, b, len(p & q)) for (a, z), p in px.items() for (b, y), q in px.items() if y == z + dz and (dz or a < b) and p & q}
        assert {(r.a_id, r.b_id, r.o) for r in got.collect()} == want
    both = masks.intersect(masks.conflict_pairs(t), runs).collect()
    for (a, z), p in px.items():
        for (b, y), q in px.items():
            if y == z and a < b:
                assert {(x, r.y) for r in both if (r.a_id, r.b_id) == (a, b) for x in range(r.x0, r.x1)} == p & q
    boxes = slices.select("id", "z", "x0", "y0", "x1", "y1")
    hits = {(r.a_id, r.b_id) for r in spatial.box_join(boxes, boxes, 1, cell=7).select(F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id")).collect()}
    rows = boxes.collect()
    assert hits == {(a.id, b.id) for a in rows for b in rows if b.z == a.z + 1 and a.x0 < b.x1 and b.x0 < a.x1 and a.y0 < b.y1 and b.y0 < a.y1}


def test_diagonals(spark):
    """Three thin diagonals, whose boxes overlap more than their pixels do."""
    rows = [(k, 0, 10 * d + y, 10 * d + y + s, 10 * d + y + s + 1) for k, (d, s) in enumerate(((0, 0), (0, 1), (0, 0))) for y in range(20 if k < 2 else 40)]
    runs = spark.createDataFrame(rows, RUNS).join(spark.createDataFrame([(0, 20), (1, 20), (2, 40)], "id long, sz long"), "id")
    assert [(r.a_id, r.b_id, r.o) for r in masks.conflict_pairs(masks.tiles(runs, "sz")).collect()] == [(0, 2, 20)]


@pytest.mark.parametrize("block", [(1000, 1000, 100), (16, 16, 2), (7, 5, 1)])
def test_one_block_is_many(spark, block):
    """Hypotheses found block by block, each with what lies around it, are those of the whole."""
    runs, slices, _ = shapes(spark)
    g = grid.Grid(block, (180, 100, 4))
    links = {(r.id, r.bx, r.by, r.bz) for r in grid.slice_blocks(slices, g).collect()}
    for r in slices.collect():
        assert {b[1:] for b in links if b[0] == r.id} == {(bx, by, r.z // block[2]) for bx in range(r.x0 // block[0], (r.x1 - 1) // block[0] + 1) for by in range(r.y0 // block[1], (r.y1 - 1) // block[1] + 1)}
    if block[0] == 16:
        whole = {r.key for r in hypotheses(slices, runs).collect()}
        found = set()
        for z in range(2):
            near = store.slices_by_blocks(slices, grid.slice_blocks(slices, g), grid.expand(grid.all_blocks(spark, g).where(F.col("bz") == z), (1, 1, 1), g))
            found |= {r.key for r in hypotheses(near, runs.join(near.select("id"), "id", "left_semi")).collect()}
        assert found == whole


def test_distances():
    """Mean and largest nearest-pixel distance, both ways, one or two targets, moved or not."""
    rng = np.random.default_rng(1)

    def mask():
        x, y, h = int(rng.integers(0, 40)), int(rng.integers(0, 40)), int(rng.integers(2, 9))
        return np.array([(y + r, x + r, x + r + int(rng.integers(1, 7))) for r in range(h)], np.int64)

    def pixels(m, dx=0, dy=0):
        return np.array([(x + dx, y + dy) for y, a, b in m for x in range(a, b)], float)

    for k in range(20):
        s, ts, (dx, dy) = mask(), [mask() for _ in range(1 + k % 2)], map(int, rng.integers(-5, 6, 2))
        p, q = pixels(s), np.concatenate([pixels(t, dx, dy) for t in ts])
        d = np.minimum(np.sqrt(((p[:, None] - q[None]) ** 2).sum(-1)), 50.0)
        there, back = d.min(0), d.min(1)
        assert masks.distance(s, ts, dx, dy, 50.0) == pytest.approx(((there.mean() + back.mean()) / 2, max(there.max(), back.max())))


def test_duplicates_go_in_rounds(spark):
    """A chain: 0-1 and 1-2 are near-duplicates, 0-2 are not; 1 goes into 0, and 2 then meets nothing that is near."""
    side = lambda x: [(x + dx, y) for y in range(30) for dx in range(30)]
    rows = [(i, 0, y, 4 * i, 4 * i + 30) for i in range(3) for y in range(30)]
    left, gone = masks.remove_duplicates(spark.createDataFrame(rows, RUNS), 0.7, 400)
    px = {}
    for r in left.collect():
        px.setdefault(r.id, set()).update((x, r.y) for x in range(r.x0, r.x1))
    assert {tuple(r) for r in gone.collect()} == {(1, 0)}
    assert px == {0: set(side(0)) & set(side(4)), 2: set(side(8))}


def test_vector(spark):
    assert len(features.NAMES) == 59 and features.NAMES[6] == "size" and features.NAMES[-1] == "is branch"


def test_branch_and_bound():
    rng = np.random.default_rng(2)
    for _ in range(60):
        n, m = int(rng.integers(1, 9)), int(rng.integers(0, 6))
        cost = [float(c) for c in rng.integers(-5, 6, n)]
        rows = [({int(v): int(rng.choice([-1, 1])) for v in rng.choice(n, int(rng.integers(1, n + 1)), replace=False)}, str(rng.choice(["<=", ">=", "="])), int(rng.integers(0, 2))) for _ in range(m)]

        def ok(x):
            return all({"<=": s <= v, ">=": s >= v, "=": s == v}[r] for c, r, v in rows for s in [sum(k * x[i] for i, k in c.items())])

        best = min((sum(c * v for c, v in zip(cost, x)) for x in itertools.product((0, 1), repeat=n) if ok(x)), default=None)
        x, sure = solve.branch_and_bound(cost, rows)
        assert sure and (best is None and x == [] or best is not None and ok(x) and sum(c * v for c, v in zip(cost, x)) == pytest.approx(best))


def test_solve_by_components(spark):
    v = spark.createDataFrame([(0, f"k{i}", -1.0 - i % 3) for i in range(9)], "problem long, key string, cost double")
    rows = spark.createDataFrame([(0, f"r{i // 3}", f"k{i}", 1, "<=", 1) for i in range(9)], "problem long, row string, key string, coef int, relation string, value int")
    got = {r.key: r.x for r in solve.solve(v, rows).collect()}
    assert got == {f"k{i}": int(i % 3 == 2) for i in range(9)}


def test_components_and_paths(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 51)], "a long, b long")
    assert {(r.id, r.component) for r in graph.components(e).collect()} == {(i, 0) for i in range(31)} | {(50, 50), (51, 50)}


def test_windows():
    assert constraints.window_starts(20, 10, 3) == [0, 7, 14]
    with pytest.raises(ValueError):
        constraints.window_starts(20, 3, 3)


def test_unknown_user_keys(spark):
    u = spark.createDataFrame([("r", "a", 1, "=", 1), ("r", "zz", 1, "=", 1)], "row string, key string, coef int, relation string, value int")
    s = spark.createDataFrame([("a",)], "key string")
    assert [r.key for r in constraints.unknown_keys(u, s).collect()] == ["zz"]


def flooded(img, levels, least, most, height, downsample=False):
    """The tree's nodes by flood fill of each threshold: {pixels: (value, parent's pixels)}."""
    found = []
    for k in range(levels):
        left = {(y, x) for y, x in zip(*np.nonzero(img > (k + 0.5) / levels))}
        while left:
            todo, region = [left.pop()], set()
            while todo:
                y, x = todo.pop()
                region.add((y, x))
                for n in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                    if n in left:
                        left.remove(n)
                        todo.append(n)
            found.append((k, frozenset(region)))
    nodes = {}
    for k, r in found:
        if least <= len(r) <= most:
            nodes[r] = max(nodes.get(r, 0), (k + 0.5) / levels)
    parent = lambda r, among: min((s for s in among if r < s), key=len, default=None)
    if downsample:
        up = {r: parent(r, nodes) for r in nodes}
        many = {s: list(up.values()).count(s) for s in nodes}
        nodes = {r: v for r, v in nodes.items() if up[r] is None or many[up[r]] != 1}

    def rise(r):
        return max((1 + rise(s) for s in nodes if parent(s, nodes) == r), default=0)

    kept = {r: v for r, v in nodes.items() if rise(r) < height}
    return {r: (v, parent(r, kept)) for r, v in kept.items()}


def extracted(spark, img, origin=(0, 0), **options):
    rows = [(7, y + origin[0], x + origin[1], float(img[y, x])) for y in range(img.shape[0]) for x in range(img.shape[1])]
    got = extract.sections(spark.createDataFrame(rows, "z long, y long, x long, value double"), **options)
    pixels = {}
    for r in got.runs.collect():
        pixels.setdefault(r.id, set()).update((r.y - origin[0], x - origin[1]) for x in range(r.x0, r.x1))
    s = {r.id: r for r in got.slices.collect()}
    cliques = {}
    for r in got.cliques.collect():
        cliques.setdefault(r.clique, {})[r.depth] = frozenset(pixels[r.id])
    return {frozenset(pixels[i]): (r.value, frozenset(pixels[r.parent]) if r.parent is not None else None) for i, r in s.items()}, cliques, set(s)


def test_extraction(spark):
    """Tiles of any size give the trees of the uncut section, which a flood fill gives, with the same ids; also where it starts below 0."""
    rng = np.random.default_rng(11)
    coarse = np.kron(rng.random((5, 7)), np.ones((5, 5)))
    img = np.round(0.6 * coarse + 0.4 * rng.random(coarse.shape), 3)
    want = flooded(img, 5, 3, 400, 3)
    ids = None
    for side in (64, 8, 3):
        got, cliques, names = extracted(spark, img, levels=5, least=3, most=400, height=3, side=side)
        assert got == want and (ids or names) == names and len(want) > 10
        ids = names
        inner = {up for _, up in want.values()}
        assert {path[max(path)] for path in cliques.values()} == {r for r in want if r not in inner}
        for path in cliques.values():
            assert sorted(path) == list(range(len(path))) and all(want[path[k]][1] == (path[k - 1] if k else None) for k in path)
    moved, _, _ = extracted(spark, img, origin=(-13, -5), levels=5, least=3, most=400, height=3, side=8)
    assert moved == want


def test_extraction_options(spark):
    rng = np.random.default_rng(2)
    img = np.round(np.kron(rng.random((4, 4)), np.ones((4, 4))) * 0.7 + 0.3 * rng.random((16, 16)), 3)
    assert extracted(spark, img, levels=6, least=2, most=300, height=9, side=5, downsample=True)[0] == flooded(img, 6, 2, 300, 9, downsample=True)
    assert extracted(spark, 1 - img, levels=6, least=2, most=300, height=2, side=5, dark=True)[0] == flooded(1 - (1 - img), 6, 2, 300, 2)
    empty = extract.sections(spark.createDataFrame([(1, 1, 1, None), (None, 1, 1, 0.9), (1, 2, 2, 0.01)], "z long, y long, x long, value double"))
    assert empty.slices.count() == empty.runs.count() == empty.cliques.count() == 0


def test_store_versions(spark, tmp_path):
    a = spark.createDataFrame([(1, "x")], "id long, v string")
    store.save(a, str(tmp_path), "t")
    new = store.insert_ignore(store.load(spark, str(tmp_path), "t"), spark.createDataFrame([(1, "y"), (2, "z"), (2, "a")], "id long, v string"), ["id"])
    store.save(new, str(tmp_path), "t")
    assert sorted(map(tuple, store.load(spark, str(tmp_path), "t").collect())) == [(1, "x"), (2, "a")]
    assert store.same_sets(new, new, ["id", "v"]) and not store.same_sets(new, a, ["id", "v"])
    big = spark.createDataFrame([("c", -1), ("c", 5), ("d", 3)], "clique string, id long")
    assert [tuple(r) for r in store.clique_pairs(big).collect()] == [("c", 5, -1)]  # unsigned
    with pytest.raises(ValueError):
        store.backend("none")


def test_stream(spark, tmp_path):
    df = shapes(spark, 40)[1]
    g = grid.Grid((16, 16, 2), (180, 100, 4))
    src = f"{tmp_path}/in"
    df.where("id < 20").write.parquet(src)
    for _ in range(2):
        streaming.start(spark.readStream.schema(df.schema).parquet(src), f"{tmp_path}/out", f"{tmp_path}/ck", g).awaitTermination()
        df.where("id >= 10").write.mode("append").parquet(src)
    streaming.start(spark.readStream.schema(df.schema).parquet(src), f"{tmp_path}/out", f"{tmp_path}/ck", g).awaitTermination()
    assert store.load(spark, f"{tmp_path}/out", "slices").count() == 40
    assert store.same_sets(store.load(spark, f"{tmp_path}/out", "links"), grid.slice_blocks(df, g), ["id", "bx", "by", "bz"])


def test_sources(spark, tmp_path):
    for k in (2, 0, 1):
        (tmp_path / f"s{k}.raw").write_bytes(bytes([k]))
    got = {r.z: bytes(r.content) for r in stacks.directory_sections(spark, str(tmp_path), "*.raw").collect()}
    assert got == {0: b"\x00", 1: b"\x01", 2: b"\x02"}
    (tmp_path / "w.txt").write_text("0.5 1\n-2\n")
    assert stacks.read_weights(spark, str(tmp_path / "w.txt")) == [0.5, 1.0, -2.0]
    with pytest.raises(NotImplementedError):
        stacks.tile_url(3, "", "png", 0, (1, 1), "z", "row", "col")
    one = spark.createDataFrame([(7, 2, 3)], "z long, row long, col long")
    url = {k: one.select(stacks.tile_url(k, "b/", "png", 1, (64, 32), "z", "row", "col")).first()[0] for k in (1, 4, 5, 6, 8)}
    assert url == {1: "b/7/2_3_1.png", 4: "b/7/1/2_3.png", 5: "b/1/7/2/3.png", 6: "b/64_32/192_64_7/png", 8: "b/xy/1/3_2_7"}
    stacks.check_volume(stacks.StackDescription(200, 100, 9, scale=1), (100, 50, 10), (20, 20, 5))
    with pytest.raises(stacks.UsageError):
        stacks.check_volume(stacks.StackDescription(200, 100, 9), (100, 50, 10), (20, 20, 5))


def test_tiles(spark):
    """A request assembled from tiles is the crop of the image."""
    img = np.arange(64 * 48, dtype=float).reshape(48, 64)
    req = spark.createDataFrame([(5, 9, 40, 33, 0)], "x0 long, y0 long, x1 long, y1 long, z long")
    t = stacks.tiles_of(req, (16, 16)).withColumn("url", F.concat_ws("_", "row", "col"))

    def fetch(url):
        r, c = map(int, url.split("_"))
        return None if (r, c) == (1, 1) else img[r * 16 : r * 16 + 16, c * 16 : c * 16 + 16]

    got = {(r.x, r.y): r.value for r in stacks.fetch_tiles(t, fetch, False).collect()}
    want = {(x, y): img[y, x] for x in range(5, 40) for y in range(9, 33) if not (16 <= x < 32 and 16 <= y < 32)}
    assert got == want
    with pytest.raises(Exception, match="1_1"):
        stacks.fetch_tiles(t, fetch, True).collect()


def test_labels_round_trip(spark):
    rng = np.random.default_rng(3)
    rows = [(0, int(y), int(x), int(x) + 1, int(v)) for (y, x), v in np.ndenumerate(rng.integers(-(2**62), 2**62, (16, 16)))]
    df = spark.createDataFrame(rows, "z long, y long, x0 long, x1 long, label long")
    assert {(r.y, r.x, r.label) for r in labels.pixels(df).collect()} == {(r[1], r[2], r[4]) for r in rows}


def test_forest_model(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [([float(a), float(b)], int(a > 0.5)) for a, b in rng.random((200, 2))]
    df = spark.createDataFrame(rows, "features array<double>, label int")
    m = learned.train(df)
    learned.save(m, str(tmp_path / "m"))
    p = learned.probability(learned.load(str(tmp_path / "m")), df).collect()
    assert np.mean([(r.p > 0.5) == r.label for r in p]) > 0.95 and learned.importances(m)[0] > 0.7


def test_out_of_bag(spark):
    """Every vote is of a tree that hasn't seen the row; labels that features settle are told, random ones are not."""
    rng = np.random.default_rng(5)
    x = rng.random((400, 2))
    rows = [(k, [float(a), float(b)], int(a > 0.5)) for k, (a, b) in enumerate(x)]
    votes = learned.out_of_bag(spark.createDataFrame(rows, "id long, features array<double>, label int"), 6)
    got = learned.out_of_bag_error(votes).first()
    assert got.error < 0.1 and 300 < got.rows <= 400  # a row escapes a tree with probability 0.37
    noise = [(k, [float(a), float(b)], int(rng.integers(2))) for k, (a, b) in enumerate(x)]
    assert learned.out_of_bag_error(learned.out_of_bag(spark.createDataFrame(noise, "id long, features array<double>, label int"), 6)).first().error > 0.35


def an_engine(spark, path, backend="parquet", n=40):
    runs, slices, _ = shapes(spark, n)
    conf = stacks.ProjectConfiguration(backend=backend, path=str(path), block=(64, 64, 2), core=(1, 1, 1), volume=(180, 100, 4))
    values = slices.select("id", ((F.col("id") % 10) / 10.0).alias("value"))
    return Engine(spark, conf, runs, values), SliceParameters(1, 10_000)


def table(e, name, *columns):
    return sorted(tuple(r) for r in e.tables.load(name).select(*columns).collect())


def test_engine_keeps_what_is_there(spark, tmp_path):
    """Two calls on different blocks are one on both, a repeated call changes nothing, and only what was asked for is flagged."""
    one, p = an_engine(spark, tmp_path / "one")
    two, _ = an_engine(spark, tmp_path / "two")
    every = grid.all_blocks(spark, one.grid)
    lack = one.segments(every)
    assert lack.count() == every.count()
    assert one.slices(every, p).count() == 0
    for half in ("bx = 0", "bx > 0", "bx > 0"):
        assert two.slices(every.where(half), p).count() == 0
        assert half != "bx = 0" or two.tables.load("slices_done").where("bx > 0").count() == 0
    for name, columns in (("slices", ("id", "z", "sz")), ("links", ("id", "bx", "by", "bz")), ("runs", ("id", "y", "x0", "x1")), ("conflicts", ("a_id", "b_id", "o")), ("slices_done", ("bx", "by", "bz"))):
        assert table(one, name, *columns) == table(two, name, *columns)
    version = len(list((tmp_path / "two" / "slices").glob("version-*")))
    two.slices(every, p)
    assert len(list((tmp_path / "two" / "slices").glob("version-*"))) == version


def test_block_tables(spark, tmp_path):
    """Upserts look at, and requests read, the folders of their cells only; put() writes what it is given and latest() reads the newest."""
    t = store.BlockTables(spark, str(tmp_path))
    with pytest.raises(store.Missing):
        t.load("t")
    rows = lambda *r: spark.createDataFrame(list(r), "id long, cell string, v string")
    t.upsert(rows((1, "c0_0_0", "a"), (1, "c0_0_0", "b"), (2, "c0_0_1", "x")), "t", ["id"])
    t.upsert(rows((1, "c0_0_0", "z"), (3, "c1_0_0", "y")), "t", ["id"])
    assert sorted(map(tuple, t.load("t").select("id", "cell", "v").collect())) == [(1, "c0_0_0", "a"), (2, "c0_0_1", "x"), (3, "c1_0_0", "y")]
    near = t.near("t", ["c0_0_1"])
    assert "PartitionFilters: [isnotnull(cell" in near._jdf.queryExecution().executedPlan().toString() and len(near.inputFiles()) == 3
    assert near.where("cell = 'c0_0_1'").count() == 1
    t.upsert(rows(), "none", ["id"])
    assert t.load("none").count() == 0
    for k in range(3):
        t.put(spark.createDataFrame([(k, float(k)), (9, float(k))], "key long, cost double"), "costs")
    assert sorted(map(tuple, t.latest("costs", ["key"]).collect())) == [(0, 0.0), (1, 1.0), (2, 2.0), (9, 2.0)] and t.load("costs").count() == 6
    t.append(rows((4, "c0_0_1", "w")), "t")
    t.compact("t", ["c0_0_1"])
    assert t.load("t").count() == 4 and len(list((tmp_path / "t" / "cell=c0_0_1").glob("*.parquet"))) == 1


def test_engine_on_block_tables(spark, tmp_path):
    """The same tables and solution as the other backend's; a core's solution writes its own costs only."""
    price = lambda s: s.select("key", F.when(F.col("type") == 1, -3.0).otherwise(-0.25).alias("cost"))
    cores = spark.createDataFrame([(0, 0, 0), (1, 0, 0)], "cx long, cy long, cz long")
    found = []
    for backend in ("memory", "blocks"):
        e, p = an_engine(spark, tmp_path / backend, backend, 24)
        e.slices(grid.all_blocks(spark, e.grid), p)
        e.complete(lambda e=e: e.solve(cores, SolutionParameters(padding=1), price), e.segments)
        found.append([table(e, n, *c) for n, c in (("slices", ("id", "cell")), ("links", ("id", "bx", "by", "bz", "home")), ("segments", ("key", "isi", "cell")), ("segment_links", ("key", "bx", "home")))] + [sorted(map(tuple, e.solution(cores).collect()))])
    assert found[0] == found[1] and found[0][-1]
    before = e.tables.load("costs").count()
    keys = e.tables.near("segment_links", ["c0_0_0"]).join(grid.core_blocks(cores.limit(1), e.grid, 1), ["bx", "by", "bz"], "left_semi").select("key").distinct().count()
    e.solve(cores.where("cx = 0"), SolutionParameters(padding=1), price)
    assert e.tables.load("costs").count() == before + keys


def test_engine(spark, tmp_path):
    """Solutions of cores: asked for again and again until all they need is there, feasible, and the same when asked for once more."""
    e, p = an_engine(spark, tmp_path, "memory", 24)
    assert pickle.loads(pickle.dumps(e.config)) == e.config
    cores = spark.createDataFrame([(0, 0, 0), (1, 0, 0)], "cx long, cy long, cz long")
    ask = SolutionParameters(padding=1)
    price = lambda s: s.select("key", F.when(F.col("type") == 1, -3.0).otherwise(-0.25).alias("cost"))
    e.slices(grid.all_blocks(spark, e.grid), p)
    assert e.complete(lambda: e.solve(cores, ask, price), e.segments) == 2
    first = sorted(map(tuple, e.solution(cores).collect()))
    assert first
    used = [i for r in e.solution(cores).select("cx", "key").distinct().join(e.tables.load("segments").select("key", "sl", "sr"), "key").collect() for i in [(r.cx, "l", i) for i in r.sl] + [(r.cx, "r", i) for i in r.sr]]
    assert len(used) == len(set(used))
    n = e.tables.load("solutions").count()
    assert e.solve(cores, SolutionParameters(padding=1, read_costs=True), lambda s: s.select("key", F.lit(100.0).alias("cost"))).count() == 0  # all costs are stored
    assert sorted(map(tuple, e.solution(cores).collect())) == first and e.tables.load("solutions").count() == n
    lack = e.ground_truth(cores, e.tables.load("slices").withColumn("label", F.col("id") % 3))
    assert lack.count() == 0 and e.tables.load("truth_ends").count() > 0
    with pytest.raises(stacks.UsageError):
        e.solve(cores, ask)
    set_log_level("WARNING")
    assert get_log_level() == 30


def test_visible_runs_are_the_painted_pixels(spark):
    """Nested, equal, touching and tile-crossing runs; no runs, no result."""
    rows = [(0, 0, 0, 200, 5), (0, 0, 60, 70, 9), (0, 0, 60, 70, 9), (0, 0, 64, 65, 1), (0, 0, 200, 201, 2), (0, 1, 63, 64, 3), (1, 0, 10, 140, 4), (1, 0, 0, 64, 8)]
    painted = spark.createDataFrame(rows, "z long, y long, x0 long, x1 long, label long")
    want = sorted(tuple(r) for r in labels.pixels(painted).select("z", "y", "x", "label").collect())
    got = sorted((r.z, r.y, x, r.label) for r in labels.visible_runs(painted).collect() for x in range(r.x0, r.x1))
    assert got == want
    assert labels.visible_runs(painted.limit(0)).count() == 0
