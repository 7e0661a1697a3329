"""Substring dedup with suffix automata of reference shards, exact.

A word goes if it lies in a run of `n` words that also starts in a document with a smaller
doc_id.  The reference is the corpus itself, so it is cut into shards such that equal runs meet:

1. Each run of n words is known by its minimizer, the least hash of the k-word grams in it,
   which depends on its words alone.  Minimizers that only one document has are found by
   `exchange` and dropped; what remains of a document are the pieces around shared ones.
2. Pieces go to the shard of their minimizer: each stretch of runs with the same minimizer is
   one piece of at most 2 n - k words.  A shard keeps distinct pieces with the least doc_id of
   each.  Where a minimizer is in very many documents, its runs go to shards by their own hash.
3. A shard builds a suffix automaton of its pieces, in which each state knows the least doc_id
   of all places its words end at, and streams every piece through it: the matching statistics
   give for each run the least document that has it.  The answer goes back to the pieces'
   documents, where runs of smaller documents are joined to maximal spans.

There is a shard of minimizers for each `SHARD` bytes of the corpus, and one of automata for each
`FINER`; shards grow in number, not in size, and a chunk sends at most as many blocks as it has pieces.

Defined results: words are separated by ASCII white space and compared unchanged; null and
empty texts have no words; rows with equal doc_id are not smaller than each other; a null
doc_id counts as 2**63 - 1; repeated rows are judged each on its own; extra columns are
ignored; no rows, no result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from .common import Words, covered, mix, parts, segments, text_bytes

SHARD = 8 << 20
#: bytes of the corpus for each shard of automata, whose states take some 400 bytes
FINER = 1 << 20
#: documents with a minimizer from which on its runs are dealt by their own hash
HOT = 2000


class SuffixAutomaton:
    """Of sequences of hashable symbols; each state knows the least number of the sequences it occurs in."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.len, self.least = [-1], [0], [X.BIGGEST]

    def add(self, words, number: int) -> None:
        nxt, link, length, least = self.next, self.link, self.len, self.least
        last = 0
        for w in words:
            q = nxt[last].get(w)
            if q is not None:  # the state may be there from an earlier sequence
                if length[q] == length[last] + 1:
                    last = q
                else:
                    last = self._clone(last, w, q)
            else:
                cur = len(length)
                nxt.append({})
                length.append(length[last] + 1)
                link.append(0)
                least.append(X.BIGGEST)
                p = last
                while p >= 0 and w not in nxt[p]:
                    nxt[p][w] = cur
                    p = link[p]
                if p >= 0:
                    q = nxt[p][w]
                    link[cur] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
                last = cur
            if number < least[last]:
                least[last] = number

    def _clone(self, p: int, w, q: int) -> int:
        c = len(self.len)
        self.next.append(dict(self.next[q]))
        self.len.append(self.len[p] + 1)
        self.link.append(self.link[q])
        self.least.append(X.BIGGEST)
        self.link[q] = c
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        return c

    def finish(self) -> None:
        """Hands each state's least number to its suffixes."""
        least, link = self.least, self.link
        for v in sorted(range(1, len(link)), key=self.len.__getitem__, reverse=True):
            u = link[v]
            if least[v] < least[u]:
                least[u] = least[v]

    def matching(self, words, n: int) -> list[int]:
        """For each run of n words, the least number of a sequence that has it (BIGGEST: none)."""
        nxt, link, length, least = self.next, self.link, self.len, self.least
        v = m = 0
        out = []
        for i, w in enumerate(words):
            while v and w not in nxt[v]:
                v = link[v]
                m = length[v]
            u = nxt[v].get(w)
            if u is None:
                m = 0
            else:
                v, m = u, m + 1
            if m >= n:
                while length[link[v]] >= n:
                    v = link[v]
                    m = length[v]
                out.append(least[v])
            elif i >= n - 1:
                out.append(X.BIGGEST)
        return out


def minimizers(x: Words, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first word and minimizer of every run of n words."""
    g, at = x.grams(k)
    full = np.zeros(max(0, len(x.hash) - k + 1), np.uint64)
    full[at] = g
    m = len(x.hash) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    start = np.flatnonzero(x.of[:m] == x.of[n - 1 :])
    low = full[:m].copy()
    for j in range(1, n - k + 1):
        np.minimum(low, full[j : m + j], out=low)
    return start, low[start]


def shared_keys(docs: DataFrame, n: int, k: int, shards: int, hot: int) -> DataFrame:
    """dk, row, keys (minimizers that other documents have too, 64-bit), hot (which of them very many have): step 1."""

    def send(batch):
        dk, row = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
        for i, j, data, off in X.chunks(batch):
            of, key = [], []
            for a, b in segments(off[i : j + 1]):
                x = Words(data, off, i + a, i + b)
                start, low = minimizers(x, n, k)
                new = np.ones(len(low), bool)
                t = x.of[start]
                new[1:] = (low[1:] != low[:-1]) | (t[1:] != t[:-1])
                of.append(t[new] + a)
                key.append(low[new])
            of, key = (np.concatenate(of), np.concatenate(key)) if of else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
            order = np.lexsort((of, key))
            of, key = of[order], key[order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (of[1:] != of[:-1])
            of, key = of[new], key[new]
            keys, text, count = X.distinct(key, of)
            many = np.repeat(count > 1, count)
            meta = (dk[i:j], row[i:j], of[many].astype(np.uint16), key[many])
            yield X.chunk_name(dk[i:j], row[i:j]), meta, X.split(keys, shards, np.where(count == 1, text, 0xFFFF).astype(np.uint16), count.astype(np.uint16))

    def answer(blocks):
        got = X.totals([(b[0], b[2]) for b in blocks])
        out = []
        for (keys, text, _), c in zip(blocks, got):
            one = (c > 1) & (text != 0xFFFF)
            out.append((keys[one], text[one], c[one] >= hot, keys[(text == 0xFFFF) & (c >= hot)]))
        return out

    def gather(meta, replies):
        dk, row, of, key = meta
        got = [r for r in replies.values() if r is not None]
        very = np.concatenate([r[3] for r in got] + [np.zeros(0, np.uint64)])
        of = np.concatenate([of] + [r[1] for r in got])
        flag = np.concatenate([np.isin(key, very)] + [r[2] for r in got])
        key = np.concatenate([key] + [r[0] for r in got])
        order = np.argsort(of, kind="stable")
        of, key, flag = of[order], key[order], flag[order].astype(np.uint8)
        at = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, int)
        end = [*at[1:], len(of)] if len(of) else []
        return pd.DataFrame({"dk": dk[of[at]], "row": row[of[at]], "keys": [key[a:e].tobytes() for a, e in zip(at, end)], "hot": [flag[a:e].tobytes() for a, e in zip(at, end)]})

    return X.scatter_gather(docs, shards, send, answer, gather, "dk long, row long, keys binary, hot binary")


def smaller_runs(texts: DataFrame, n: int, k: int, shards: int) -> DataFrame:
    """dk, row, spans (pairs of 32-bit first and last word + 1, ascending) of keyed texts with `keys`, `hot`: steps 2 and 3."""

    def send(batch):
        dk, row = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
        keys, hots = (batch.column(c).to_pylist() for c in (3, 4))
        for i, j, data, off in X.chunks(batch):
            pieces: dict[int, dict[bytes, int]] = {}
            texts, least, first = [], [], []  # of distinct pieces: in order of their numbers
            number: dict[bytes, int] = {}
            shard_of: list[int] = []
            where_doc, where_at, where_piece = [], [], []
            for a, b in segments(off[i : j + 1]):
                x = Words(data, off, i + a, i + b)
                start, low = minimizers(x, n, k)
                t = x.of[start]
                cut = np.searchsorted(t, np.arange(b - a + 1))
                raw = x.d.tobytes()
                g, g_at = x.grams(n)
                for d in range(b - a):
                    lo, hi = int(cut[d]), int(cut[d + 1])
                    if lo == hi:
                        continue
                    mine = np.frombuffer(keys[i + a + d], np.uint64)
                    order = np.argsort(mine)
                    mine, hot = mine[order], np.frombuffer(hots[i + a + d], np.uint8)[order]
                    m = low[lo:hi]
                    p = np.minimum(np.searchsorted(mine, m), len(mine) - 1)
                    has = mine[p] == m
                    if not has.any():
                        continue
                    single = hot[p] > 0
                    at = np.flatnonzero(has)
                    new = np.ones(len(at), bool)
                    new[1:] = (np.diff(at) > 1) | (m[at[1:]] != m[at[:-1]]) | single[at[1:]]
                    begin = at[new]
                    stop = np.concatenate([at[np.flatnonzero(new)[1:] - 1], at[-1:]])
                    s = start[lo:hi]
                    wfirst = s[begin]
                    wend = s[stop] + n
                    route = np.where(single[begin], g[lo:hi][begin], m[begin])
                    base = int(x.first[d])
                    owner = int(dk[i + a + d])
                    for f, e, r, ws, we in zip(wfirst.tolist(), wend.tolist(), ((mix(route.copy()) >> np.uint64(20)) % np.uint64(shards)).tolist(), x.start[wfirst].tolist(), x.end[wend - 1].tolist()):
                        piece = b" ".join(raw[ws:we].split())
                        q = number.get(piece)
                        if q is None:
                            q = number[piece] = len(texts)
                            texts.append(piece)
                            least.append(owner)
                            shard_of.append(r)
                        elif owner < least[q]:
                            least[q] = owner
                        where_doc.append(a + d)
                        where_at.append(f - base)
                        where_piece.append(q)
            blocks: dict[int, tuple[list, list, list]] = {}
            for q, r in enumerate(shard_of):
                block = blocks.setdefault(r, ([], [], []))
                block[0].append(q)
                block[1].append(texts[q])
                block[2].append(least[q])
            blocks = {r: (np.array(q, np.int32), b"\n".join(t), np.array(m, np.int64)) for r, (q, t, m) in blocks.items()}
            meta = (dk[i:j], row[i:j], np.array(where_doc, np.uint16), np.array(where_at, np.uint32), np.array(where_piece, np.int32), len(texts))
            yield X.chunk_name(dk[i:j], row[i:j]), meta, blocks

    def answer(blocks):
        least: dict[bytes, int] = {}
        split = [b[1].split(b"\n") for b in blocks]
        for texts, (_, _, owner) in zip(split, blocks):
            for t, o in zip(texts, owner.tolist()):
                if o < least.get(t, X.BIGGEST + 1):
                    least[t] = o
        sa = SuffixAutomaton()
        symbol: dict[bytes, int] = {}
        coded = {t: [symbol.setdefault(w, len(symbol)) for w in t.split(b" ")] for t in least}
        for t, o in least.items():
            sa.add(coded[t], o)
        sa.finish()
        found = {t: sa.matching(w, n) for t, w in coded.items()}
        out = []
        for texts, (q, _, _) in zip(split, blocks):
            runs = [found[t] for t in texts]
            out.append((q, np.array([len(r) for r in runs], np.int32), np.array([v for r in runs for v in r], np.int64)))
        return out

    def gather(meta, replies):
        dk, row, doc, at, piece, count = meta
        got = [r for r in replies.values() if r is not None]
        if not len(doc) or not got:
            return pd.DataFrame({"dk": [], "row": [], "spans": []})
        q = np.concatenate([r[0] for r in got])
        runs = np.concatenate([r[1] for r in got])
        value = np.concatenate([r[2] for r in got])
        first, length = np.zeros(count, np.int64), np.zeros(count, np.int64)
        first[q], length[q] = np.cumsum(runs) - runs, runs
        k = length[piece]
        ends = np.cumsum(k)
        inside = np.arange(ends[-1]) - np.repeat(ends - k, k)
        smaller = value[np.repeat(first[piece], k) + inside] < np.repeat(dk[doc], k)
        d, w = np.repeat(doc, k)[smaller].astype(np.int64), (np.repeat(at, k).astype(np.int64) + inside)[smaller]
        order = np.lexsort((w, d))
        d, w = d[order], w[order]
        if not len(d):
            return pd.DataFrame({"dk": [], "row": [], "spans": []})
        new = np.concatenate([[True], (d[1:] != d[:-1]) | (w[1:] > w[:-1] + n)])
        begin = np.flatnonzero(new)
        stop = np.concatenate([begin[1:] - 1, [len(d) - 1]])
        spans = np.stack([w[begin], w[stop] + n], 1).astype("<u4")
        docs, cut = np.unique(d[begin], return_index=True)
        return pd.DataFrame({"dk": dk[docs], "row": row[docs], "spans": [spans[a:e].tobytes() for a, e in zip(cut, [*cut[1:], len(spans)])]})

    return X.scatter_gather(texts.select("dk", "row", "text", "keys", "hot"), shards, send, answer, gather, "dk long, row long, spans binary")


def spans(docs: DataFrame, n: int = 13, k: int = 8, hot: int = HOT) -> DataFrame:
    """dk, row, text and spans (null: none) of every row of docs."""
    texts = X.keyed(docs)
    size = text_bytes(docs)
    shards = max(parts(docs.sparkSession), size // SHARD)
    keys = shared_keys(texts, n, k, shards, hot).dropDuplicates(["dk", "row"])
    got = smaller_runs(texts.join(keys, ["dk", "row"]), n, k, max(parts(docs.sparkSession), size // FINER)).dropDuplicates(["dk", "row"])
    return texts.join(got, ["dk", "row"], "left")


def remove(docs: DataFrame, n: int = 13, k: int = 8, hot: int = HOT) -> DataFrame:
    """doc_id, row, n_words, n_removed and kept (the words that stay, joined by one blank) of every row."""

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                words, gone, kept = [], [], []
                for t, s in zip(part.column(2).to_pylist(), part.column(3).to_pylist()):
                    w = t.encode().split()
                    words.append(len(w))
                    if s is None:
                        gone.append(0)
                        kept.append(b" ".join(w).decode())
                        continue
                    out, at = [], 0
                    for f, e in np.frombuffer(s, "<u4").reshape(-1, 2).tolist():
                        out += w[at:f]
                        at = e
                    out += w[at:]
                    gone.append(len(w) - len(out))
                    kept.append(b" ".join(out).decode())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(words, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=["dk", "row", "n_words", "n_removed", "kept"])

    got = spans(docs, n, k, hot).select("dk", "row", "text", "spans").mapInArrow(run, "dk long, row long, n_words long, n_removed long, kept string")
    return got.select(X.doc_id_of().alias("doc_id"), "row", "n_words", "n_removed", "kept")
