"""Sets that share much and are no copies: a walk goes to those that could be linked, not to all that share."""

import numpy as np

from voxelweave.llm import jaccard


def _sets(own: int):
    rng = np.random.default_rng(8)
    base, new = np.arange(200), 1000
    sets = []
    for _ in range(400):
        at = rng.choice(200, own, replace=False)
        x = base.copy()
        x[at] = np.arange(new, new + own)
        new += own
        sets.append(np.unique(x).astype(np.uint64))
    return sets


def test_far_copies_are_not_walked_to():
    sets = _sets(45)  # what two share is in the first 41 of neither
    x, universe = jaccard.ranks(sets)
    trie = jaccard.Trie(universe, len(sets), 80)
    for i in range(len(sets)):
        trie.probe(i, x[i])
        trie.store(i, x[i])
    assert trie.visits < 60 * len(sets)
    assert jaccard.join_sets(sets, 80) == [trie.find(i) for i in range(len(sets))] == list(range(len(sets)))


def test_sizes_rise_or_not():
    """Fewer ranks are named where sets come by size; with sets of all sizes the result is that of all pairs."""
    rng = np.random.default_rng(9)
    for share in (60, 85, 100):
        base = rng.integers(0, 90, 60)
        sets = [np.unique(np.where(rng.random(k) < 0.08, rng.integers(90, 400, k), base[:k])).astype(np.uint64) for k in rng.integers(1, 60, 200)]
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
        want = [find(i) for i in range(len(sets))]
        assert jaccard.join_sets(sets, share) == want == jaccard.join_sets(sets, share, list(range(len(sets))))
