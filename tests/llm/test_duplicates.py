"""op3 and op7 against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from test_sampling_and_tokens import thue_morse

from voxelweave.llm import common, graph, jaccard, queries, substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(t, n):
    w = WORD.findall((t or "").translate(LOWER))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def components(rows, n, share):
    """rows: (id, text); least id of each row's component, by comparing all pairs that share a shingle."""
    sets = [shingles(t, n) for _, t in rows]
    by = defaultdict(list)
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for j, s in enumerate(sets):
        seen = defaultdict(int)
        for g in s:
            for i in by[g]:
                seen[i] += 1
            by[g].append(j)
        for i, o in seen.items():
            if 100 * o >= share * (len(sets[i]) + len(s) - o):
                a, b = sorted((find(i), find(j)))
                up[b] = a
    least = defaultdict(lambda: 1 << 63)
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least[find(i)], d)
    return [(d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)]


def test_op3(spark, sf_dir, docs):
    got = sorted(tuple(r) for r in queries.op3_jaccard(spark, sf_dir).collect())
    assert got == sorted(components(docs, 4, 85))


def near_copies(seed, groups=12, most=9):
    rng = random.Random(seed)
    out, i = [], 0
    for _ in range(groups):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(4, 160))]
        for _ in range(rng.randrange(1, most)):
            w = base[:]
            for _ in range(rng.randrange(0, max(2, len(w) // 14))):
                w[rng.randrange(len(w))] = f"x{rng.randrange(9)}"
            out.append((i, " ".join(w)))
            i += 1
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("block", [jaccard.BLOCK, 60])
def test_join_blocks(spark, block):
    """Whole blocks, and blocks too large for one task: the same components."""
    rows = near_copies(5)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for n, share in ((2, 80), (4, 85)) if block > 1000 else ((2, 80),):
        got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(df, n, share, block).collect())
        assert got == sorted(components(rows, n, share))


def test_join_large_chains(spark):
    """Chains of sets in blocks too large for one task: links between sets that different pivots hold are found, too."""
    rows, i = [], 0
    for c in range(24):
        for k in range(4 + c % 9):  # neighbours are 18 / 22 alike, all others 16 / 24 or less
            rows.append((i, " ".join(f"c{c}v{x}" for x in range(2 * k, 2 * k + 20))))
            i += 1
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(df, 1, 80, 60).collect())
    assert got == sorted(components(rows, 1, 80)) and len({r[2] for r in got}) == 24


def test_known_components():
    """Known components count as linked, and links beyond them are found."""
    sets = [np.arange(2 * k, 2 * k + 20).astype(np.uint64) for k in range(6)]
    assert jaccard.join_sets(sets, 80, [], [7, 7, 8, 8, 9, 9]) == [0, 0, 2, 2, 4, 4]
    assert jaccard.join_sets(sets, 80, [2, 3, 4, 5], [7, 7, 8, 8, 9, 9]) == [0] * 6


def test_trie():
    rng = np.random.default_rng(2)
    for share in (60, 80, 95):
        base = rng.integers(0, 300, (6, 40))
        sets = [np.unique(np.where(rng.random(40) < 0.12, rng.integers(300, 900, 40), base[rng.integers(6)])).astype(np.uint64) for _ in range(150)]
        got = jaccard.join_sets(sets, share)
        up = list(range(len(sets)))

        def find(i):
            while up[i] != i:
                i = up[i]
            return i

        for j in range(len(sets)):
            for i in range(j):
                o = len(np.intersect1d(sets[i], sets[j]))
                if 100 * o >= share * (len(sets[i]) + len(sets[j]) - o):
                    a, b = sorted((find(i), find(j)))
                    up[b] = a
        assert got == [find(i) for i in range(len(sets))]
        some = list(range(0, 150, 7))
        part = jaccard.join_sets(sets, share, some)
        for i in some:
            for j in range(len(sets)):
                o = len(np.intersect1d(sets[i], sets[j]))
                if 100 * o >= share * (len(sets[i]) + len(sets[j]) - o):
                    assert part[i] == part[j]


def test_near_copies_walk_little():
    """A large group of near copies: walks skip what is one component already."""
    rng = np.random.default_rng(4)
    base = np.arange(200)
    sets = [np.unique(np.where(rng.random(200) < 0.03, rng.integers(1000, 9000, 200), base)).astype(np.uint64) for _ in range(1500)]
    x, universe = jaccard.ranks(sets)
    trie = jaccard.Trie(universe, len(sets), 80)
    for i in range(len(sets)):
        trie.probe(i, x[i])
        trie.store(i, x[i])
    assert len({trie.find(i) for i in range(len(sets))}) == 1 and trie.visits < 60 * len(sets)


def test_jaccard_odd(spark, odd, none):
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(odd, 4, 85).collect()}
    assert {(3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 1, 6), (7, 1, 6), (1, 23, 1), (2, 23, 1), (None, 23, 1)} <= got
    assert jaccard.join(none, 4, 85).collect() == []
    kept = jaccard.keep_one(odd).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id) == [1, 3, 4, 5, 6, 8, 9] and kept[0].__fields__ == odd.columns
    assert jaccard.keep_one(none).collect() == []


def test_crafted_words(spark):
    """Words that polynomials modulo a power of two can't tell apart don't make documents alike."""
    a, b = thue_morse(1024)
    df = spark.createDataFrame([(0, f"{a} p q r s"), (1, f"{b} p q r s")], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in jaccard.join(df, 4, 85).collect()) == [(0, 0), (1, 1)]
    got = [(r.doc_id, r.n_removed) for r in substrings.remove(df, 4, 2).collect()]
    assert sorted(got) == [(0, 0), (1, 4)]


def test_largest_id(spark):
    """The largest number isn't taken for null."""
    big, t = 2**63 - 1, " ".join(f"w{i}" for i in range(30))
    rows = [(big, t), (None, t), (None, "q r s t u v w"), (big, "a b c d e f g"), (None, "a b c d e f g"), (big, None), (None, None), (-(2**63), "lone words here and there")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(df, 4, 85).collect()), key=str)
    assert got == sorted([(big, 27, big), (None, 27, big), (None, 4, None), (big, 4, big), (None, 4, big), (big, 0, big), (None, 0, None), (-(2**63), 2, -(2**63))], key=str)
    assert sorted(str(r.doc_id) for r in substrings.remove(df).collect()) == sorted(str(i) for i, _ in rows)
    kept = [(r.doc_id, r.text) for r in jaccard.keep_one(df, 4, 85).collect()]
    assert sorted(map(str, kept)) == sorted(map(str, [rows[0], rows[2], rows[3], *rows[5:]]))


def test_hot_class_is_not_gathered(spark):
    """Texts aren't dealt by their class: copies of one text lie in many partitions."""
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(i, text) for i in range(300)] + [(1000 + i, f"{i} " * 9) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = jaccard.join(df, 4, 85).collect()
    assert {r.component_id for r in got if r.doc_id < 1000} == {0} and len(got) == 350


def test_keep_one_shared_ids(spark):
    """Rows with a null doc_id, or with one doc_id, are documents of their own: one of each component stays."""
    text = lambda c: " ".join(f"{c}{x}" for x in range(30))
    rows = [(None, text("a")), (None, text("b")), (None, text("b") + " end"), (None, text("b")), (None, "x"), (None, None), (None, None)]
    rows += [(7, text("c")), (7, text("d")), (7, text("d")), (8, text("d") + " end"), (9, text("e")), (9, text("e") + " end"), (10, text("f")), (None, text("f"))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [(r.doc_id, r.text) for r in jaccard.keep_one(df).collect()]
    b = {text("b"), text("b") + " end"} & {t for _, t in kept}
    e = {text("e"), text("e") + " end"} & {t for _, t in kept}
    assert len(b) == len(e) == 1
    want = [(None, text("a")), (None, *b), (None, "x"), (None, None), (None, None), (7, text("c")), (7, text("d")), (9, *e), (10, text("f"))]
    assert sorted(kept, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("block", [jaccard.BLOCK, 60])
def test_component_keys(spark, block):
    """Keys tell components apart that have one component_id."""
    rows = [(None, t) if i % 3 else (5, t) for i, t in near_copies(6)]
    want = dict(zip((t for _, t in rows), (c for _, _, c in components([(i, t) for i, (_, t) in enumerate(rows)], 2, 80))))
    text = {r.row: r.text for r in spark.createDataFrame(rows, "doc_id long, text string").selectExpr("xxhash64(text) & -2 as row", "text").collect()}
    both = {(want[text[r.row & -2]], r.component_key if r.component_key is not None else text[r.row & -2]) for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80, block).collect()}
    assert len(both) == len({a for a, _ in both}) == len({b for _, b in both})


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 102), (102, 101), (200, 200)]
    got = {(r.id, r.component) for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(i, 0) for i in range(41)} | {(100, 100), (101, 100), (102, 100), (200, 200)}


def removed(rows, n):
    """rows: (id, text): words, removed, hash of what stays."""
    first = {}
    words = [(d, WORD.findall(t or "")) for d, t in rows]
    for d, w in words:
        for i in range(len(w) - n + 1):
            k = tuple(w[i : i + n])
            first[k] = min(first.get(k, d), d)
    out = []
    for d, w in words:
        gone = set()
        for i in range(len(w) - n + 1):
            if first[tuple(w[i : i + n])] < d:
                gone.update(range(i, i + n))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def test_op7(spark, sf_dir, docs):
    got = sorted(tuple(r) for r in queries.op7_substrings(spark, sf_dir).collect())
    want = removed(docs, 13)
    assert got == want and sum(r[2] for r in got) > 0


@pytest.mark.parametrize("hot", [2, 5, 10**6])
def test_remove_small(spark, hot):
    rng = random.Random(8)
    lines = [" ".join(f"v{rng.randrange(30)}" for _ in range(rng.randrange(3, 22))) for _ in range(25)]
    rows = [(i * 3, " ".join(rng.choice(lines) for _ in range(rng.randrange(1, 8)))) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in substrings.remove(df, 7, 4, hot).collect())
    assert got == removed(rows, 7)


def test_automaton():
    rng = random.Random(1)
    seqs = [[rng.randrange(3) for _ in range(rng.randrange(1, 14))] for _ in range(60)]
    sa = substrings.SuffixAutomaton()
    for i, s in enumerate(seqs):
        sa.add(s, i)
    sa.finish()
    for s in [*seqs, [rng.randrange(4) for _ in range(40)]]:
        want = [min([i for i, t in enumerate(seqs) if any(t[a : a + 4] == s[p : p + 4] for a in range(len(t) - 3))], default=substrings.X.BIGGEST) for p in range(len(s) - 3)]
        assert sa.matching(s, 4) == want


def test_remove_odd(spark, odd, none):
    got = [(r.doc_id, r.n_words, r.n_removed) for r in substrings.remove(odd).collect()]
    want = [(1, 26, 0), (2, 26, 26), (2, 26, 26), (3, 0, 0), (4, 0, 0), (5, 0, 0), (6, 2, 0), (7, 2, 0), (None, 26, 25), (9, len(WORD.findall(odd.where("doc_id = 9").first().text)), 0)]
    assert sorted(map(str, got)) == sorted(map(str, [*want, (8, 30_000, 0)]))
    assert substrings.remove(none).collect() == []


def test_word_kernel(odd):
    texts = ["a B  c d\x0be\x0c", "", None, "A", " x y ", " em\n\n"]
    import pyarrow as pa

    data, off = common.text_buffers(pa.array(["skip", *texts]).slice(1))
    x = common.Words(data, off, 0, len(texts))
    raw = x.d.tobytes()
    assert [[raw[s:e].decode() for s, e, o in zip(x.start, x.end, x.of) if o == i] for i in range(len(texts))] == [WORD.findall(t or "") for t in texts]
