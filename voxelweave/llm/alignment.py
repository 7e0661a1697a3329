"""How the tokens of two vocabularies lie over each other, by a sweep over their ends.

Each text is encoded by A (byte-level BPE, of a blank and the text) and by B (pieces, which puts the
blank there itself).  A row of *end events* is a run of tokens of one side: document, byte offset of
the run, side, ids; where each token ends follows from its id, for a vocabulary says how long each is.
Both sides' events are one table, dealt out by document and sorted by offset; a machine streams
through it.  Its state is what lies after the last place where ends of both sides met: of the events
that it has, it emits all groups up to the last common end, and their links.

Groups are what lies between common ends.  Links are pairs of an A and a B token that share a byte.
In how many documents an id pair is linked is counted over the corpus and goes back to the documents
as in llm.postings, so that no text meets a table of all pairs.

Defined results: null and empty texts, and texts whose tokens' bytes don't spell a blank and the text
(a character that B normalises away), have no tokens: counts 0, groups ''; strings of special tokens are
plain text; repeated rows, rows with a null doc_id and rows that share one are documents of their own;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, parts, small_batches, text_bytes, written
from .exchange import TEXTS, chunks
from .postings import encode, head, salts, summed
from .tokens import Encoder, encoder

#: tokens of a run, tokens that the sweep takes at once, links of a chunk, bytes of text a partition of the sweep
RUN, WINDOW, LINKS, PART = 1 << 14, 1 << 18, 1 << 20, 16 << 20
BLANK = "▁"
#: distinct pieces and their bytes that each side's encoder keeps
KEPT = 500_000, 16 << 20


class PieceEncoder(Encoder):
    """Ids of a sentencepiece BPE for buffers of texts that begin with the blank it would put there.

    No piece has a blank after another character, so nothing merges over such a place; there texts are cut, unless
    only blanks follow.  Vocabularies with such a piece, or that don't keep texts as they are, encode whole texts.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.tok = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.tok.vocab_size()
        names = [self.tok.id_to_piece(k) for k in range(self.size)]
        kept = ["a  b", " a", "a ", "é ﬁ½", "\t\n x"]
        self.plain = not any(BLANK in n.lstrip(BLANK) for n in names) and all(b"".join(self._bytes(k) for k in self.tok.encode(t)) == f" {t}".encode() for t in kept)
        self.whole: list[bytes] = []
        self._clear(1 << 16)

    def _bytes(self, k: int) -> bytes:
        if self.tok.is_byte(k):
            return bytes([int(self.tok.id_to_piece(k)[3:-1], 16)])
        return self.tok.id_to_piece(k).replace(BLANK, " ").encode()

    def _cuts(self, d: np.ndarray, o: np.ndarray, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        full = np.diff(o) > 0
        first = o[:-1][full]
        if not self.plain:
            return first, full
        blank = d == 32
        cut = np.zeros(len(d), bool)
        cut[1:] = blank[1:] & ~blank[:-1]
        # a run of blanks at a text's end stays with what is before it
        other = np.flatnonzero(~blank)
        last = np.searchsorted(other, o[1:][full]) - 1
        tail = np.where((last >= 0) & (other[last] >= first), other[last], first - 1) + 1 if len(other) else first
        tail = tail[tail < o[1:][full]]
        cut[tail] = False
        cut[first] = True
        return np.flatnonzero(cut), np.zeros(len(full), bool)

    def _append(self, words: list[bytes]) -> np.ndarray:
        first = self.many
        for k in range(0, len(words), 20_000):
            ids = self.tok.encode([w[1:].decode() for w in words[k : k + 20_000]], num_threads=1)
            ids = [i or [self.tok.piece_to_id(BLANK)] for i in ids]  # the library gives nothing for a blank alone
            n = np.fromiter(map(len, ids), np.int32, len(ids))
            total = int(n.sum())
            while self.used + total > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            while self.many + len(ids) > len(self.start):
                self.start, self.count, self.text_start, self.text_len = (np.concatenate([v, np.zeros_like(v)]) for v in (self.start, self.count, self.text_start, self.text_len))
            self.flat[self.used : self.used + total] = np.concatenate([np.asarray(i, np.uint32) for i in ids]) if total else 0
            new = slice(self.many, self.many + len(ids))
            self.start[new], self.count[new] = self.used + np.cumsum(n) - n, n
            self.used += total
            self.many += len(ids)
        return np.arange(first, self.many)


class Spelling:
    """The bytes of each id of a vocabulary."""

    def __init__(self, names: list[bytes]):
        self.length = np.fromiter(map(len, names), np.int64, len(names))
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(names), np.uint8)

    def spells(self, ids: np.ndarray, cut: np.ndarray, d: np.ndarray, o: np.ndarray) -> np.ndarray:
        """Which texts (bytes d, from o) the ids (text k's from cut[k]) spell."""
        n = self.length[ids]
        sums = np.concatenate([[0], np.cumsum(n)])[cut]
        ok = np.diff(sums) == np.diff(o)
        if not ok.all():
            keep = np.repeat(ok, np.diff(cut))
            ids, n = ids[keep], n[keep]
            d = d[np.repeat(ok, np.diff(o))]
        if len(ids):
            at = np.repeat(self.start[ids] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            wrong = np.concatenate([[0], np.cumsum(self.flat[at] != d)])
            ends = np.cumsum(np.diff(o)[ok])
            ok[ok] = wrong[ends] == wrong[np.concatenate([[0], ends[:-1]])]
        return ok


def _byte_names(tok) -> list[bytes]:
    """Bytes of a byte-level vocabulary's entries: printable Latin-1 stands for itself, the other bytes for characters from 256 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in own)}
    return [bytes(back[c] for c in name) if all(c in back for c in name) else name.encode() for name in (tok.id_to_token(k) or "" for k in range(tok.get_vocab_size()))]


_loaded: dict[tuple[str, str], tuple] = {}


def sides(a: str, b: str) -> tuple[tuple[Encoder, Spelling], tuple[PieceEncoder, Spelling]]:
    """Both encoders and spellings, one of each for a worker process."""
    if (a, b) not in _loaded:
        left, right = encoder(a, ordinary=True), PieceEncoder(b)
        _loaded[a, b] = (left, Spelling(_byte_names(left.tok))), (right, Spelling([right._bytes(k) for k in range(right.size)]))
    return _loaded[a, b]


def _spaced(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes with a blank before each that isn't empty."""
    n = np.diff(off)
    o = np.concatenate([[0], np.cumsum(n + (n > 0))])
    out = np.full(int(o[-1]), 32, np.uint8)
    out[np.arange(len(data)) + np.repeat(np.cumsum(n > 0), n)] = data
    return out, o


EVENTS = "doc long, at long, side byte, ids binary, doc_id long"


def end_events(docs: DataFrame, a: str, b: str) -> DataFrame:
    """Runs of both sides' tokens; a document's first A run carries its doc_id, and is there even if it has no tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        doc = TaskContext.get().partitionId() << 33
        encoders = [enc for enc, _ in sides(a, b)]
        for enc in encoders:
            enc.MOST, enc.BYTES = KEPT
        for batch in batches:
            ids_of = batch["doc_id"]
            for i, j, data, off in chunks(batch):
                d, o = _spaced(data[off[i] : off[j]], off[i : j + 1] - off[i])
                got, ok = [], np.diff(o) > 0
                for enc, spelling in sides(a, b):
                    side = []
                    for p, q, ids, cut in enc.buffers(d, o):
                        ok[p:q] &= spelling.spells(ids, cut, d[o[p] : o[q]], o[p : q + 1] - o[p])
                        side += [ids[x:y] for x, y in zip(cut.tolist(), cut[1:].tolist())]
                    got.append((side, spelling.length, np.uint16 if enc.size <= 1 << 16 else np.uint32))
                rows = []
                for k in range(j - i):
                    for s, (side, length, kind) in enumerate(got):
                        ids = side[k] if ok[k] else side[k][:0]
                        at = 0
                        for x in range(0, max(len(ids), 1 - s), RUN):
                            part = ids[x : x + RUN]
                            rows.append((doc + k, at, s, part.astype(kind).tobytes(), ids_of[i + k].as_py() if x == 0 and s == 0 else None))
                            at += int(length[part].sum()) if len(ids) > RUN else 0
                doc += j - i
                columns = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int8(), pa.binary(), pa.int64()))], names=["doc", "at", "side", "ids", "doc_id"])
        for enc in encoders:  # the next task in this worker may be one of the sweep
            enc._clear(1 << 16)

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, EVENTS)


def aligned(a: np.ndarray, b: np.ndarray, end_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of two rows of tokens over the same bytes, given their ends: each token's group (A, B), and the links' places (A, B)."""
    at = np.searchsorted(end_b, end_a)
    hit = end_b[at] == end_a
    group_a = np.cumsum(hit) - hit
    hit_b = np.zeros(len(b), bool)
    hit_b[at[hit]] = True
    group_b = np.cumsum(hit_b) - hit_b
    first = np.concatenate([[0], (at + hit)[:-1]])
    n = at - first + 1
    link_a = np.repeat(np.arange(len(a)), n)
    link_b = np.arange(len(link_a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
    return group_a, group_b, link_a, link_b


class _Document:
    def __init__(self, doc: int, doc_id):
        self.doc, self.doc_id = doc, doc_id
        self.wait: tuple[list, list] = ([], [])
        self.n = np.zeros(4, np.int64)  # A tokens, B tokens, groups, links
        self.hash, self.tail = None, b""


class Sweep:
    """Takes rows of events in order, gives batches of MARKED."""

    def __init__(self, lengths: tuple[np.ndarray, np.ndarray], kinds: tuple, place: int):
        self.lengths, self.kinds, self.place = lengths, kinds, place
        self.text = [f"{k}{s}".encode() for k in range(max(map(len, lengths))) for s in ",|;"]
        self.bits = [max(1, (len(x) - 1).bit_length()) for x in lengths]
        self.open: _Document | None = None
        self.ready: list[_Document] = []  # complete documents, not yet swept
        self.held = 0
        self._new_chunk()

    def _new_chunk(self) -> None:
        self.done: list[_Document] = []
        self.links: list[tuple[np.ndarray, np.ndarray]] = []  # distinct (pair, document) and how often
        self.n_links, self.merged = 0, 0

    def add(self, doc: int, side: int, ids: bytes, doc_id) -> Iterator[pa.RecordBatch]:
        if self.open is None or self.open.doc != doc:
            yield from self._close()
            self.open = _Document(doc, doc_id)
        if side == 0 and doc_id is not None:
            self.open.doc_id = doc_id
        if ids:
            got = np.frombuffer(ids, self.kinds[side])
            self.open.wait[side].append(got)
            self.held += len(got)
        if self.held > WINDOW:
            if self.ready:
                yield from self._sweep(self.ready)
            else:
                self._part(self.open)

    def _close(self) -> Iterator[pa.RecordBatch]:
        if self.open is not None:
            self.ready.append(self.open)
            if len(self.ready) + len(self.done) >= TEXTS or self.held > WINDOW:
                yield from self._sweep(self.ready)

    def end(self) -> Iterator[pa.RecordBatch]:
        yield from self._close()
        self.open = None
        yield from self._sweep(self.ready)
        yield from self._flush(bool(self.done))

    def _part(self, doc: _Document) -> None:
        """Sweeps an unfinished document up to its last common end."""
        a, b = (np.concatenate(w) if w else np.zeros(0, k) for w, k in zip(doc.wait, self.kinds))
        ends = [np.cumsum(n[x]) for n, x in zip(self.lengths, (a, b))]
        common = np.intersect1d(*ends, assume_unique=True)
        if len(common):
            x, y = (int(np.searchsorted(e, common[-1])) + 1 for e in ends)
            self._run([doc], [(a[:x], b[:y])])
            a, b = a[x:], b[y:]
        doc.wait = ([a], [b])
        self.held = len(a) + len(b)
        if self.held > WINDOW // 2:  # a long group: looked at again when it has grown
            self.held = 0

    def _sweep(self, docs: list[_Document]) -> Iterator[pa.RecordBatch]:
        """Sweeps finished documents."""
        tokens = [tuple(np.concatenate(w) if w else np.zeros(0, k) for w, k in zip(d.wait, self.kinds)) for d in docs]
        self._run(docs, tokens)
        for d in docs:
            d.wait = ([], [])
        self.done += docs
        self.ready = []
        self.held = sum(len(x) for w in (self.open.wait if self.open else ()) for x in w) if self.open not in docs else 0
        yield from self._flush(self.n_links > LINKS or len(self.done) >= TEXTS)

    def _run(self, docs: list[_Document], tokens: list[tuple[np.ndarray, np.ndarray]]) -> None:
        a, b = (np.concatenate([t[s] for t in tokens]).astype(np.int64) if tokens else np.zeros(0, np.int64) for s in (0, 1))
        if not len(a):
            return
        n = np.array([[len(x), len(y)] for x, y in tokens])
        end_a, end_b = (np.cumsum(length[x]) for length, x in zip(self.lengths, (a, b)))
        group_a, group_b, link_a, link_b = aligned(a, b, end_a, end_b)
        cut = np.concatenate([[[0, 0]], np.cumsum(n, axis=0)])
        # in the order of groups, A before B: a token comes after the other side's tokens of the groups before it, a B token also after its own group's A tokens
        groups = int(group_a[-1]) + 1
        text = np.empty(len(a) + len(b), np.int64)
        last_a, last_b = (np.append(g[1:] != g[:-1], True) for g in (group_a, group_b))
        text[np.arange(len(a)) + np.searchsorted(group_b, group_a)] = 3 * a + last_a
        text[np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")] = 3 * b + 2 * last_b
        text, words = text.tolist(), self.text
        of_link = np.repeat(np.arange(len(docs)), n[:, 0])[link_a]
        links = np.bincount(of_link, minlength=len(docs))
        before = np.append(group_a, groups)[cut[:, 0]]
        base = len(self.done)
        for k, d in enumerate(docs):
            if n[k, 0]:
                d.n += (n[k, 0], n[k, 1], before[k + 1] - before[k], links[k])
                part = d.tail + b"".join(map(words.__getitem__, text[cut[k].sum() : cut[k + 1].sum()]))
                d.hash = d.hash or hashlib.sha256()
                d.hash.update(part[:-1])
                d.tail = b";"
        keys = np.sort((a[link_a] << self.bits[1] | b[link_b]) * TEXTS + base + of_link)
        at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        self.links.append((keys[at], np.diff(np.append(at, len(keys)))))
        self.n_links += len(at)
        if self.n_links > 2 * max(LINKS, self.merged):  # parts of one long document
            self._merge()

    def _merge(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.links) > 1:
            keys, count = (np.concatenate([x[k] for x in self.links]) for k in (0, 1))
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            self.links = [(keys[at], np.add.reduceat(count[order], at))]
        self.n_links = self.merged = len(self.links[0][0]) if self.links else 0
        return self.links[0] if self.links else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def _flush(self, now: bool) -> Iterator[pa.RecordBatch]:
        """Gives the chunk out."""
        if not now:
            return
        keys, count = self._merge()
        pair, doc = keys // TEXTS, keys % TEXTS
        first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])) if len(pair) else np.zeros(0, np.int64)
        found, n_docs = encode(doc, count, first)
        pair, n = pair[first], len(first)
        names = ["chunk", "a", "b", "n_docs", "posting", "head"]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, self.place)), pa.array((pair >> self.bits[1]).astype(np.int32)), pa.array((pair & ((1 << self.bits[1]) - 1)).astype(np.int32)), pa.array(n_docs.astype(np.int32)), found, pa.nulls(n, pa.binary())], names=names)
        about = {"doc_id": pa.array([d.doc_id for d in self.done], pa.int64())}
        about |= {c: pa.array([int(d.n[k]) for d in self.done], pa.int64()) for k, c in enumerate(("n_a", "n_b", "n_groups", "n_links"))}
        about["groups_sha256"] = pa.array([d.hash.hexdigest() if d.hash else "" for d in self.done], pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([self.place]), pa.array([-1], pa.int32()), pa.array([int(mix(np.array([self.place], np.uint64))[0] >> np.uint64(33))], pa.int32()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary()), pa.array([head(about)], pa.binary())], names=names)
        self.place += 1
        self._new_chunk()


MARKED = "chunk long, a int, b int, n_docs int, posting binary, head binary"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pair_docs long, best long"


def swept(events: DataFrame, a: str, b: str, partitions: int) -> DataFrame:
    """Postings of linked id pairs, and heads with what else is known of the documents."""
    both = sides(a, b)
    kinds = tuple(np.uint16 if enc.size <= 1 << 16 else np.uint32 for enc, _ in both)
    lengths = tuple(spelling.length.astype(np.int32) for _, spelling in both)  # two numbers an entry of the vocabularies

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        machine = Sweep(lengths, kinds, TaskContext.get().partitionId() << 32)
        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in ("doc", "side", "ids", "doc_id"))):
                yield from machine.add(*row)
        yield from machine.end()

    return events.repartition(partitions, "doc").sortWithinPartitions("doc", "at", "side").mapInArrow(run, MARKED)


def align(docs: DataFrame, a: str, b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and over a document's links: pair_docs, the sum of the documents that hold their
    pair linked, and best, how many have no rival of their A id in more documents."""
    size = text_bytes(docs)
    found = written(swept(end_events(docs, a, b), a, b, max(parts(docs.sparkSession), size // PART)), "links")
    n = salts(docs)
    found = found.withColumn("salt", F.pmod(F.xxhash64("chunk"), F.lit(n)).cast("int"))
    part = found.where("a >= 0").groupBy("a", "b", "salt").agg(F.sum("n_docs").alias("n"))
    pairs = part.groupBy("a", "b").agg(F.sum("n").alias("pair_docs"))
    pairs = pairs.join(pairs.groupBy("a").agg(F.max("pair_docs").alias("most")), "a")
    weights = pairs.select("a", "b", "pair_docs", (F.col("pair_docs") == F.col("most")).cast("long").alias("best"))
    weights = part.select("a", "b", "salt").join(weights, ["a", "b"]) if n > 1 else weights.withColumn("salt", F.lit(0))
    return summed(found.join(weights, ["a", "b", "salt"], "left"), ["pair_docs", "best"], RESULT)
