"""N-gram Jaccard join with a prefix tree, and its connected components.

1. A document can only have a partner if few of its shingles are its own alone: with n shingles
   and likeness s, a partner lacks at most n - ceil(s n) of them.  Shingles in a fixed half of
   the hash space are counted over the corpus (`exchange`), and documents with more lonely
   shingles than that leave, without loss.
2. Documents with equal sets become one class, and one of them stands for it.  Classes' shingles get a global order, rarest
   first; two linked classes share one of their first n - ceil(s n) + 1 shingles.  Classes
   that share one, directly or over others, form a block.
3. In a block, sets are stored in a trie in one order, rarest first.  A set walks the paths of
   those stored that have one of its first n - ceil(s n) + 1 shingles among theirs, each node once,
   and sums what it shares with the nodes' runs; sets whose lengths can't bring the likeness, or
   that are in the walker's component already, are not walked to.
4. Blocks over `block` shingles are not gathered: rounds of pivots link what is near a common
   set.  Of the components known then, the largest of each block needs no more links inside; all
   sets out of it meet the whole block in pairs of pieces of bounded size, where walks skip what
   is known to be one component.

Defined results: words are separated by ASCII white space, A-Z are lower-cased; a text with
fewer words than n has its whole sequence as one shingle; a null, empty or white text has none
and is linked with nothing; rows with equal doc_id are documents of their own; a null doc_id
counts as larger than all others and comes back as null; extra columns are ignored; no rows, no
result.  Words are known by 62-bit hashes, shingles and sets by 64-bit ones, so results are exact
but for chance collisions of these, of which no construction is known.
"""

from __future__ import annotations

from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from .common import Words, mix, parts, segments, shingle_sets, text_bytes, written
from .graph import components

#: shingles that one task gathers at most, and bytes of the corpus for each shard
BLOCK, SHARD = 4_000_000, 8 << 20


def need(n: int, share: int) -> int:
    """Least overlap of a set of n with a partner: ceil(n * share / 100)."""
    return -(-n * share // 100)


def linked(o: int, n: int, m: int, share: int) -> bool:
    return (100 + share) * o >= share * (n + m)


# --- the trie ---------------------------------------------------------------------------


class Trie:
    """Sets of ranks, each ascending, with a path each from its last rank to its first; store() puts a set in, and probe() links a set with those stored before.

    Nodes are numbers: a node has a run of ranks and its parent.  Two linked sets share one of the
    rarest n - ceil(s n) + 1 ranks of each, so a probe walks only the paths of stored sets that have one of its own among theirs,
    from the leaf up to what it has walked already; a set in the prober's component isn't walked to.  `shared`: ranks from
    there on are in one set only, so nothing is looked for by them.  `rising`: no set is smaller than those before it, so a partner
    that comes later shares 2 s / (1 + s) n of a stored set, and fewer of its ranks need naming.
    """

    def __init__(self, universe: int, count: int, share: int, shared: int | None = None, rising: bool = False):
        self.share, self.shared, self.rising = share, universe if shared is None else shared, rising
        self.mask = np.zeros(universe + 1, bool)
        self.kids: list[dict[int, int]] = [{}]  # node 0 is the root, and has no run
        self.parent, self.start, self.length = np.zeros(16, np.int64), np.zeros(16, np.int64), np.zeros(16, np.int64)
        self.flat, self.used = np.zeros(1024, np.int32), 0
        self.leaf, self.sizes = np.zeros(count, np.int64), np.zeros(count, np.int64)
        self.seen, self.held = np.full(16, -1, np.int64), np.zeros(16, np.int64)  # the last probe that walked a node, and how much of its run was the prober's
        self.met = np.full(count, -1, np.int64)  # the last probe that walked to a set
        self.label, self.least, self.groups = np.arange(count), list(range(count)), {}
        self.by_rank: dict[int, array] = {}
        self.clean: dict[int, int] = {}  # of a rank: so many of its first sets are one component
        self.visits = self.probes = 0

    def find(self, i: int) -> int:
        return self.least[self.label[i]]

    def union(self, i: int, j: int) -> bool:
        a, b = int(self.label[i]), int(self.label[j])
        if a == b:
            return False
        x, y = self.groups.pop(a, None) or [a], self.groups.pop(b, None) or [b]
        if len(x) < len(y):
            a, b, x, y = b, a, y, x
        x.extend(y)  # the smaller one is named anew
        self.label[y] = a
        self.groups[a] = x
        self.least[a] = min(self.least[a], self.least[b])
        return True

    def _first(self, x: np.ndarray, least: int) -> list[int]:
        """The rarest ranks of a set of which one is a partner's too if they share at least `least`, rarest first; without those of one set."""
        tail = x[least - 1 :]
        return tail[: np.searchsorted(tail, self.shared)][::-1].tolist()

    def _overlap(self, sets: np.ndarray) -> np.ndarray:
        """What the prober (in the mask) shares with stored sets."""
        cur = self.leaf[sets]
        paths = [cur]
        while cur.any():
            cur = self.parent[cur]
            paths.append(cur)
        paths = np.concatenate(paths)
        new = np.unique(paths[self.seen[paths] != self.probes])
        if len(new):
            self.seen[new] = self.probes
            self.visits += len(new)
            n = self.length[new]
            to = np.cumsum(n)
            total = np.zeros(to[-1] + 1, np.int64)
            np.cumsum(self.mask[self.flat[np.repeat(self.start[new] - to + n, n) + np.arange(to[-1])]], out=total[1:])
            self.held[new] = total[to] - total[to - n]
        return self.held[paths].reshape(-1, len(sets)).sum(0)

    def probe(self, i: int, x: np.ndarray):
        """Numbers of stored sets that are linked with set i; sets of i's own component may be left out."""
        n, share, out = len(x), self.share, []
        self.mask[x] = True
        self.probes += 1
        lists, total = [], 0
        first = [r for r in self._first(x, need(n, share)) if r in self.by_rank]
        for k, r in enumerate(first):
            held = self.by_rank[r]
            if self.clean.get(r) != len(held) or self.label[held[0]] != self.label[i]:
                lists.append(np.frombuffer(held, np.int32).copy())
                total += len(held)
            if not total or total < 2048 and k < len(first) - 1:
                continue
            c = np.concatenate(lists)
            other = self.label[c] != self.label[i]
            if len(lists) == 1 and not other.any():
                self.clean[r] = len(held)
            lists, total, batch = [], 0, 1
            m = self.sizes[c]
            c = np.unique(c[other & (self.met[c] != self.probes) & (100 * m >= share * n) & (share * m <= 100 * n)])
            while len(c):
                now, c = c[:batch], c[batch:]
                self.met[now] = self.probes
                hit = now[(100 + share) * self._overlap(now) >= share * (n + self.sizes[now])]
                for j in hit.tolist():
                    if self.union(i, j):
                        out.append(j)
                if len(hit):
                    c = c[self.label[c] != self.label[i]]
                batch = min(8 * batch, 512)
        self.mask[x] = False
        return out

    def _node(self, run: np.ndarray, parent: int) -> int:
        v = len(self.kids)
        if v == len(self.parent):
            self.parent, self.start, self.length, self.held = (np.concatenate([c, np.zeros_like(c)]) for c in (self.parent, self.start, self.length, self.held))
            self.seen = np.concatenate([self.seen, np.full_like(self.seen, -1)])
        if self.used + len(run) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(run)), np.int32)])
        self.flat[self.used : self.used + len(run)] = run
        self.parent[v], self.start[v], self.length[v] = parent, self.used, len(run)
        self.used += len(run)
        self.kids.append({})
        return v

    def _place(self, x: np.ndarray) -> int:
        """The node where a set, rarest rank first, ends; made if there is none."""
        v, at, n = 0, 0, len(x)
        while at < n:
            w = self.kids[v].get(int(x[at]))
            if w is None:
                w = self._node(x[at:], v)
                self.kids[v][int(x[at])] = w
                return w
            s, k = self.start[w], min(int(self.length[w]), n - at)
            off = np.flatnonzero(self.flat[s : s + k] != x[at : at + k])
            k = int(off[0]) if len(off) else k
            if k < self.length[w]:  # split the run: its upper part is a new node; the lower one keeps its number, so nothing below moves
                top = self._node(x[:0], v)
                self.start[top], self.length[top] = s, k
                self.start[w], self.length[w], self.parent[w] = s + k, self.length[w] - k, top
                self.kids[v][int(x[at])] = top
                self.kids[top][int(self.flat[s + k])] = w
                w = top
            v, at = w, at + k
        return v

    def store(self, i: int, x: np.ndarray) -> None:
        self.sizes[i] = len(x)
        self.leaf[i] = self._place(x[::-1])
        for r in self._first(x, -(-2 * self.share * len(x) // (100 + self.share)) if self.rising else need(len(x), self.share)):
            held = self.by_rank.setdefault(r, array("i"))
            held.append(i)
            if self.clean.get(r, 0) == len(held) - 1 and self.label[held[0]] == self.label[i]:
                self.clean[r] = len(held)


def ranks(sets: list[np.ndarray]) -> tuple[list[np.ndarray], int]:
    """Sets as ascending ranks in one order of all their shingles: most common first, then by hash; the trie has them from the last."""
    x, universe, _ = _ranks(sets)
    return x, universe


def _ranks(sets: list[np.ndarray]) -> tuple[list[np.ndarray], int, int]:
    """And the first rank that only one set has."""
    flat = np.concatenate(sets)
    u, inv, count = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.empty(len(u), np.int32)
    rank[np.lexsort((u, -count))] = np.arange(len(u), dtype=np.int32)
    return [np.sort(r) for r in np.split(rank[inv], np.cumsum([len(s) for s in sets])[:-1])], len(u), int(np.count_nonzero(count > 1))


def join_sets(sets: list[np.ndarray], share: int, probes: list[int] | None = None, known=()) -> list[int]:
    """Component (least number) of each set; with `probes`, only links of these with all are looked for; sets of one `known` label are one component before."""
    if len(sets) == 1:
        return [0]
    x, universe, shared = _ranks(sets)
    trie = Trie(universe, len(sets), share, shared, probes is None)
    first_of: dict[int, int] = {}
    for i, label in enumerate(known):
        trie.union(first_of.setdefault(label, i), i)
    if probes is None:
        order = sorted(range(len(sets)), key=lambda i: len(x[i]))
    else:
        order = list(probes)
        first = set(probes)
        for i in range(len(sets)):
            if i not in first:
                trie.store(i, x[i])
    for i in order:
        trie.probe(i, x[i])
        trie.store(i, x[i])
    return [trie.find(i) for i in range(len(sets))]


# --- the operator -----------------------------------------------------------------------


def _sets(batch: pa.RecordBatch, first: int, last: int, data, off, n: int):
    """Distinct shingles (text, hash) of texts first..last, in segments."""
    of, g = [], []
    for a, b in segments(off[first : last + 1]):
        t, h = shingle_sets(Words(data, off, first + a, first + b, lower=True), n)
        of.append(t + a)
        g.append(h)
    return (np.concatenate(of), np.concatenate(g)) if of else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def set_hash(of: np.ndarray, g: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Size and hash of the set of each text, of sorted (text, shingle) pairs."""
    cut = np.searchsorted(of, np.arange(texts + 1))
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(g.copy()))])
    size = np.diff(cut)
    return size, mix((total[cut[1:]] - total[cut[:-1]]) + size.astype(np.uint64))


def survivors(docs: DataFrame, n: int, share: int, shards: int) -> DataFrame:
    """dk, row, n_shingles, class (hash of the set; without shingles, of the row), stays of every row of keyed(docs): step 1."""

    def send(batch):
        dk, row = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        for i, j, data, off in X.chunks(batch):
            of, g = _sets(batch, i, j, data, off, n)
            size, name = set_hash(of, g, j - i)
            name = np.where(size > 0, name, mix(dk[i:j].astype(np.uint64) + mix(row[i:j].astype(np.uint64)))).astype(np.int64)
            half = (g & np.uint64(1)) == 0
            keys, text, count = X.distinct(g[half], of[half])
            alone = np.where(count == 1, text, 0xFFFF).astype(np.uint16)
            yield X.chunk_name(dk[i:j], row[i:j]), (dk[i:j], row[i:j], size, name), X.split(keys, shards, alone)

    def answer(blocks):
        got = X.totals([(k, np.where(t == 0xFFFF, 2, 1)) for k, t in blocks])
        return [np.bincount(t[(c == 1)], minlength=0).astype(np.uint32) for (k, t), c in zip(blocks, got)]

    def gather(meta, replies):
        dk, row, size, name = meta
        lonely = np.zeros(len(dk), np.int64)
        for r in replies.values():
            if r is not None:
                lonely[: len(r)] += r
        may = size - -(-size * share // 100)
        return pd.DataFrame({"dk": dk, "row": row, "n_shingles": size, "class": name, "stays": (size > 0) & (lonely <= may)})

    return X.scatter_gather(docs, shards, send, answer, gather, "dk long, row long, n_shingles long, class long, stays boolean")


def shingles_of(texts: DataFrame, n: int) -> DataFrame:
    """class, dk, row, size, shingles (64-bit numbers, ascending) of rows (class, dk, row, text)."""

    def run(batches):
        for b in batches:
            for i, j, data, off in X.chunks(b):
                of, g = _sets(b, i, j, data, off, n)
                cut = np.searchsorted(of, np.arange(j - i + 1))
                for a in range(0, j - i, 512):
                    e = min(a + 512, j - i)
                    blobs = [g[cut[k] : cut[k + 1]].astype("<u8").tobytes() for k in range(a, e)]
                    yield pa.RecordBatch.from_arrays([*(b.column(k).slice(i + a, e - a) for k in range(3)), pa.array(np.diff(cut)[a:e], pa.int64()), pa.array(blobs, pa.binary())], names=["class", "dk", "row", "size", "shingles"])

    return texts.select("class", "dk", "row", "text").mapInArrow(run, "class long, dk long, row long, size long, shingles binary")


def prefixes(reps: DataFrame, share: int, shards: int) -> DataFrame:
    """class, shingle: the shared ones among each class's first n - ceil(s n) + 1, rarest first."""

    def send(batch):
        name = batch.column(0).to_numpy(zero_copy_only=False)
        blobs = batch.column(1).to_pylist()
        i = 0
        while i < len(blobs):
            j, size = i, 0
            while j < len(blobs) and (j == i or size + len(blobs[j]) <= X.BYTES) and j - i < X.TEXTS:
                size += len(blobs[j])
                j += 1
            g = [np.frombuffer(b, "<u8") for b in blobs[i:j]]
            of = np.repeat(np.arange(j - i), [len(x) for x in g])
            flat = np.concatenate(g)
            keys, _, count = X.distinct(flat, of)
            yield X.chunk_name(name[i:j], name[i:j]), (name[i:j], of.astype(np.uint16), flat), X.split(keys, shards, count.astype(np.uint32))
            i = j

    def answer(blocks):
        return [c.astype(np.uint32) for c in X.totals(blocks)]

    def gather(meta, replies):
        name, of, flat = meta
        keys = np.unique(flat)
        count = np.zeros(len(keys), np.int64)
        for s, (_, at) in X.split(keys, shards, np.arange(len(keys))).items():  # the order in which they were sent
            count[at] = replies[s]
        c = count[np.searchsorted(keys, flat)]
        order = np.lexsort((flat, c, of))
        of, flat, c = of[order], flat[order], c[order]
        size = np.bincount(of, minlength=len(name))
        first = np.cumsum(size) - size
        place = np.arange(len(of)) - first[of]
        keep = (place < (size - -(-size * share // 100) + 1)[of]) & (c > 1)
        return pd.DataFrame({"class": name[of[keep]], "shingle": flat[keep].astype(np.int64)})

    return X.scatter_gather(reps.select("class", "shingles"), shards, send, answer, gather, "class long, shingle long")


def _unpack(blobs) -> list[np.ndarray]:
    return [np.frombuffer(b, "<u8") for b in blobs]


def join_blocks(reps: DataFrame, share: int, groups: int) -> DataFrame:
    """class, component (its least dk, null is the largest) and key (a class of it) in each block (columns class, dk, nul, block, shingles), one task a group of blocks."""

    def run(pdf):
        out = []
        for _, g in pdf.groupby("block", sort=True):
            g = g.sort_values(["dk", "nul", "class"])  # so a component's first set has its least dk
            root = join_sets(_unpack(g["shingles"]), share)
            out.append(pd.DataFrame({"class": g["class"].to_numpy(), "component": g["dk"].to_numpy()[root], "nul": g["nul"].to_numpy()[root], "key": g["class"].to_numpy()[root]}))
        return pd.concat(out)

    dealt = reps.withColumn("part", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int")).repartitionById(groups, F.col("part"))
    return dealt.groupBy("part").applyInPandas(run, "class long, component long, nul long, key long")


def join_large(reps: DataFrame, share: int, block: int, rounds: int = 3) -> DataFrame:
    """a, b: links that span the components of blocks too large for one task.  See step 4."""
    sizes = reps.groupBy("block").agg(F.ceil(F.sum("size") / F.lit(block // 4)).cast("int").alias("pieces"))
    reps = written(reps.join(sizes, "block").withColumn("piece", F.pmod(F.xxhash64("class", F.lit(7)), F.col("pieces")).cast("int")), "large")
    links, free = None, reps.select("block", "class")

    def near(pdf):
        x = _unpack(pdf["pivot"])
        y = _unpack(pdf["shingles"])
        hit = [linked(len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b), share) for a, b in zip(x, y)]
        return pdf.loc[hit, ["class", "pivot_class"]].rename(columns={"class": "a", "pivot_class": "b"})

    def run(batches):
        for b in batches:
            yield near(b)

    for r in range(rounds):
        pick = free.groupBy("block").agg(F.min(F.struct(F.xxhash64("class", F.lit(r)).alias("h"), "class")).alias("m")).select("block", F.col("m.class").alias("class"))
        pivot = reps.join(pick, ["block", "class"], "left_semi").select("block", F.col("class").alias("pivot_class"), F.col("shingles").alias("pivot"), F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))
        got = written(reps.join(pivot, ["block", "piece"]).select("class", "shingles", "pivot_class", "pivot").mapInPandas(run, "a long, b long"), "pivots")
        links = got if links is None else links.unionByName(got)
        free = written(free.join(links.select(F.col("a").alias("class")), "class", "left_anti"), "free")
    # all but the largest known component meets every piece of its block; it is cut into pieces itself
    known = components(links).select(F.col("id").alias("class"), F.col("component").alias("known"))
    known = written(reps.select("block", "class", "size").join(known, "class", "left").withColumn("known", F.coalesce("known", "class")), "known")
    top = known.groupBy("block", "known").agg(F.sum("size").alias("total")).groupBy("block").agg(F.max(F.struct("total", "known")).alias("m")).select("block", F.col("m.known").alias("top"))
    reps = reps.join(known.select("block", "class", "known"), ["block", "class"])
    rest = reps.join(top, "block").where("known <> top").drop("top")
    cut = rest.groupBy("block").agg(F.ceil(F.sum("size") / F.lit(block // 4)).cast("int").alias("cuts"))
    build = reps.join(cut, "block").select("block", "piece", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("cut"), "class", "known", "shingles", F.lit(False).alias("probe"))
    probe = rest.join(cut, "block").withColumn("cut", F.pmod(F.xxhash64("class", F.lit(9)), F.col("cuts")).cast("int")).select("block", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), "cut", "class", "known", "shingles", F.lit(True).alias("probe"))

    def pair(pdf):
        pdf = pdf.sort_values(["probe", "class"], ignore_index=True)
        ask = pdf["probe"].to_numpy(bool)
        same = pdf["class"].isin(pdf.loc[ask, "class"]).to_numpy() & ~ask
        pdf, ask = pdf[~same].reset_index(drop=True), ask[~same]
        names = pdf["class"].to_numpy()
        root = join_sets(_unpack(pdf["shingles"]), share, np.flatnonzero(ask).tolist(), pdf["known"].tolist())
        return pd.DataFrame({"a": names, "b": names[root]})

    return links.unionByName(build.unionByName(probe).groupBy("block", "piece", "cut").applyInPandas(pair, "a long, b long"))


def join(docs: DataFrame, n: int = 5, share: int = 80, block: int = BLOCK) -> DataFrame:
    """doc_id, row (hash of the text), n_shingles, component_id and component_key of every row; share in per cent.

    component_id is the least doc_id, so components that share it (null, or a repeated doc_id) have it in
    common; component_key tells them apart.  It is null in rows that step 1 found to be alone.
    """
    spark = docs.sparkSession
    shards = max(parts(spark), text_bytes(docs) // SHARD)
    texts = X.keyed(docs)
    found = written(survivors(texts, n, share, shards), "shared", sized=True)
    # one row of each class goes on, so copies cost no more than a line
    first = found.where("stays").groupBy("class").agg(F.min(F.struct("dk", F.col("row").bitwiseAND(F.lit(1)).alias("nul"), "row")).alias("m")).select("class", "m.dk", "m.row")
    first = written(first, "first").repartition(shards, "dk", "row")  # else the join would deal texts by class alone, all copies to one task
    reps = shingles_of(texts.join(first.hint("merge"), ["dk", "row"]), n).dropDuplicates(["class"]).withColumn("nul", F.col("row").bitwiseAND(F.lit(1))).drop("row")
    reps = written(reps, "classes")
    prefix = written(prefixes(reps, share, shards), "prefixes", sized=True)
    least = prefix.groupBy("shingle").agg(F.min("class").alias("b"), F.count("*").alias("k")).where("k > 1")
    meet = prefix.join(least, "shingle").select(F.col("class").alias("a"), "b").distinct()
    blocks = components(meet).select(F.col("id").alias("class"), F.col("component").alias("block"))
    reps = reps.join(blocks, "class")
    weight = written(reps.groupBy("block").agg(F.sum("size").alias("total")), "weights")
    total, most = weight.agg(F.sum("total"), F.max("total")).first()
    placed = written(reps.join(weight, "block"), "blocks")
    groups = max(1, (total or 0) // (block // 4), parts(spark))
    found_in = join_blocks(placed.where(F.col("total") <= block).select("class", "dk", "nul", "block", "shingles"), share, min(groups, X.MOST_PARTITIONS))
    if (most or 0) > block:
        large = placed.where(F.col("total") > block)
        roots = components(join_large(large.select("class", "block", "size", "shingles"), share, block)).withColumnRenamed("id", "class").join(large.select("class", "dk", "nul"), "class")
        least_of = roots.groupBy("component").agg(F.min(F.struct("dk", "nul")).alias("m")).select(F.col("component").alias("key"), F.col("m.dk").alias("component"), "m.nul")
        found_in = found_in.unionByName(roots.select("class", F.col("component").alias("key")).join(least_of, "key"))
    # the least doc_id of a component is that of its classes; a class without links has its own
    own = first.select("class", "dk", F.col("row").bitwiseAND(F.lit(1)).alias("nul"))
    of = own.join(written(found_in, "links", sized=True).withColumnRenamed("nul", "cnul"), "class", "left")
    of = of.select("class", F.coalesce("key", "class").alias("key"), F.when(F.coalesce("cnul", "nul") == 0, F.coalesce("component", "dk")).alias("component"))
    of = written(of, "components").withColumn("in", F.lit(True))
    out = found.join(of, "class", "left")
    return out.select(X.doc_id_of().alias("doc_id"), "row", "n_shingles", F.when(F.col("in"), F.col("component")).otherwise(X.doc_id_of()).alias("component_id"), F.col("key").alias("component_key"))


def keep_one(docs: DataFrame, n: int = 5, share: int = 80) -> DataFrame:
    """The rows of docs with one of each component: the least doc_id, and of equal ones the least text hash."""
    got = join(docs, n, share).withColumn("dk", F.coalesce("doc_id", F.lit(X.BIGGEST)))
    keep = got.where("component_key is not null").groupBy("component_key").agg(F.min(F.struct("dk", F.col("row").bitwiseAND(F.lit(1)).alias("nul"), "row")).alias("m")).select("m.dk", "m.row")
    names = set(docs.columns)
    dk, row = "__dk", "__row"
    while dk in names or row in names:
        dk, row = dk + "_", row + "_"
    rows = docs.withColumn(dk, F.coalesce("doc_id", F.lit(X.BIGGEST))).withColumn(row, X.row_of())
    named = lambda d: d.select(F.col("dk").alias(dk), F.col("row").alias(row))
    full = rows.join(named(keep.repartition(parts(docs.sparkSession), "dk", "row")), [dk, row], "left_semi").dropDuplicates([dk, row])
    alone = rows.join(named(got.where("component_key is null")).distinct(), [dk, row], "left_semi")
    return full.unionByName(alone).select(*docs.columns)
