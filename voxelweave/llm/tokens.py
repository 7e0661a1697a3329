"""Token ids by a public byte-level BPE, and files of equal-length sequences.

``Encoder`` gives exactly the ids that the tokenizers library gives for the whole text, but
encodes each distinct piece of a worker once: a byte-level BPE works on pre-tokens, and at
some places every text has a pre-token's start (`cuts`), so what lies between two of them has
the same ids wherever it stands.

``write_tokens`` writes a stream of ids as Arrow IPC files: record batches of
``fixed_size_list<uint16|uint32>[length]`` with a mask of the same shape, so that row k of a
memory-mapped file is a view into it, without copying.  Documents are in ascending doc_id
order (null last) over all files, each followed by an end id; a sequence may hold the end of
one document and the start of the next; the last of a file is padded (mask 0).  Each file has
an index file with the documents' first ids and lengths.  A task writes under a name of its
own attempt and moves the file in place at its end, and the manifest, itself a written table,
names only files that are complete; so a lost executor costs a rewrite, nothing else.

Defined results: null and empty texts are one end id; rows with equal doc_id are in the order of
a hash of their texts; an empty table gives an empty manifest; extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from itertools import chain
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import byte_hash, parts, scratch, segments, small_batches, text_buffers, text_bytes, written

_loaded: dict[tuple[str, bool], "Encoder"] = {}


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: bytes after a blank or line end at which a text isn't cut: white space, or the first byte of characters that may be
_NO_CUT = np.zeros(256, bool)
_NO_CUT[[*range(33), 0xC2, 0xE1, 0xE2, 0xE3]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".,!?;:"]] = True


def cuts(d: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where texts (bytes d, text k from off[k]) may be cut without changing a byte-level BPE's ids; the first byte of each text is one.

    A blank or line end before a character that isn't white space starts a pre-token; so does
    what follows such a line end, and so does a stop after an ASCII or Latin-1 letter.
    """
    n = len(d)
    cut = np.zeros(n + 3, bool)
    bound = np.zeros(n + 1, bool)
    bound[off] = True
    ok = np.zeros(n, bool)
    ok[:-1] = ~_NO_CUT[d[1:]] & ~bound[1:n]
    line = (d == 10) & ok
    cut[:n] = ((d == 32) & ok) | line
    cut[1 : n + 1] |= line
    latin = np.zeros(n, bool)
    latin[1:] = (d[:-1] == 0xC3) & (d[1:] != 0x97) & (d[1:] != 0xB7)
    cut[1:n] |= (_STOP[d[1:]] & (_LETTER[d[:-1]] | latin[:-1])) if n else False
    cut[off] = True
    return np.flatnonzero(cut[:n])


class Encoder:
    """Ids of the tokenizers library; pieces between cuts are encoded once and kept, found by a hash and compared byte by byte.

    ordinary: whether the strings of special tokens in a text are ordinary text.  If not, as the library has it, a text
    that holds one is encoded as a whole.  So is every text where the vocabulary isn't a plain byte-level one.
    """

    #: pieces kept and their bytes; longer pieces than LONG aren't
    MOST, BYTES, LONG = 2_000_000, 64 << 20, 256

    def __init__(self, path: str, ordinary: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = ordinary
        self.size = self.tok.get_vocab_size()
        known = json.loads(self.tok.to_str())
        pre = known["pre_tokenizer"] or {}
        self.plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not known["normalizer"]
        added = known["added_tokens"]
        self.whole = [t["content"].encode() for t in added if not (ordinary and t["special"])]
        self._clear(1 << 16)

    def _clear(self, slots: int) -> None:
        self.keys = np.zeros(slots, np.uint64)
        self.slot = np.zeros(slots, np.int32)
        self.many = 0
        self.flat = np.zeros(1 << 17, np.uint32)
        self.start = np.zeros(1 << 16, np.int32)
        self.count = np.zeros(1 << 16, np.int32)
        self.used = 0
        self.text = np.zeros(1 << 17, np.uint8)  # the pieces' bytes
        self.text_start = np.zeros(1 << 16, np.int32)
        self.text_len = np.zeros(1 << 16, np.int32)
        self.text_used = 0

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Number of each key, -1 if new."""
        out = np.full(len(h), -1, np.int64)
        mask = np.uint64(len(self.keys) - 1)
        at, left = (h & mask).astype(np.int64), np.arange(len(h))
        while len(left):
            k = self.keys[at]
            hit = k == h[left]
            out[left[hit]] = self.slot[at[hit]]
            go = ~hit & (k != 0)
            left, at = left[go], (at[go] + 1) & int(mask)
        return out

    def _place(self, h: np.ndarray, number: np.ndarray) -> None:
        mask = len(self.keys) - 1
        at, left = (h & np.uint64(mask)).astype(np.int64), np.arange(len(h))
        while len(left):
            free = self.keys[at] == 0
            slots, first = np.unique(at[free], return_index=True)
            who = left[free][first]
            self.keys[slots] = h[who]
            self.slot[slots] = number[who]
            go = np.ones(len(left), bool)
            go[np.flatnonzero(free)[first]] = False
            left, at = left[go], (at[go] + 1) & mask

    def _append(self, words: list[bytes]) -> np.ndarray:
        """Encodes pieces and gives their numbers."""
        first = self.many
        for k in range(0, len(words), 20_000):
            ids = [e.ids for e in self.tok.encode_batch_fast([w.decode() for w in words[k : k + 20_000]], add_special_tokens=False)]
            n = np.fromiter(map(len, ids), np.int32, len(ids))
            total = int(n.sum())
            while self.used + total > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            while self.many + len(ids) > len(self.start):
                self.start, self.count, self.text_start, self.text_len = (np.concatenate([v, np.zeros_like(v)]) for v in (self.start, self.count, self.text_start, self.text_len))
            self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(ids), np.uint32, total)
            new = slice(self.many, self.many + len(ids))
            self.start[new], self.count[new] = self.used + np.cumsum(n) - n, n
            self.used += total
            self.many += len(ids)
        return np.arange(first, self.many)

    def _learn(self, h: np.ndarray, words: list[bytes]) -> None:
        if 2 * (self.many + len(h)) > len(self.keys):
            old, number = self.keys[self.keys != 0], self.slot[self.keys != 0]
            size = len(self.keys)
            while 2 * (self.many + len(h)) > size:
                size *= 2
            self.keys, self.slot = np.zeros(size, np.uint64), np.zeros(size, np.int32)
            self._place(old, number)
        new = self._append(words)
        n = np.fromiter(map(len, words), np.int32, len(words))
        total = int(n.sum())
        while self.text_used + total > len(self.text):
            self.text = np.concatenate([self.text, np.zeros_like(self.text)])
        self.text[self.text_used : self.text_used + total] = np.frombuffer(b"".join(words), np.uint8)
        self.text_start[new], self.text_len[new] = self.text_used + np.cumsum(n) - n, n
        self.text_used += total
        self._place(h, new)

    def _same(self, d: np.ndarray, s: np.ndarray, n: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Which of the pieces (n bytes from s; together all of d) are, byte by byte, the kept pieces k (-1: none)."""
        ok = (k >= 0) & (self.text_len[k] == n)
        at = np.repeat(np.where(ok, self.text_start[k] - s, 0), n) + np.arange(len(d))
        off = self.text[np.minimum(at, len(self.text) - 1)] != d
        return ok & (np.add.reduceat(off, s, dtype=np.int64) == 0)

    def _cuts(self, d: np.ndarray, o: np.ndarray, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Where pieces start, and which texts (from o) are one piece that isn't kept."""
        full = np.diff(o) > 0
        alone = np.zeros(len(full), bool) if self.plain else full.copy()
        for t in self.whole:
            at = raw.find(t)
            while at >= 0:  # on to the next text that may hold it
                i = int(np.searchsorted(o, at, "right")) - 1
                alone[i] = alone[i] or at + len(t) <= o[i + 1]
                at = raw.find(t, at + 1)
        first = o[:-1][full]
        s = cuts(d, first) if self.plain else first
        if alone.any():
            of = np.searchsorted(o, s, "right") - 1
            s = s[~alone[of] | (s == o[of])]
        return s, alone

    def buffers(self, data: np.ndarray, off: np.ndarray):
        """For ranges of texts (Arrow buffers): first, last, ids of all of them, and where each text's ids start (one more)."""
        for i, j in segments(off):
            if self.many > self.MOST or self.text_used > self.BYTES:
                self._clear(len(self.keys))
            lo, hi = int(off[i]), int(off[j])
            d, o = data[lo:hi], off[i : j + 1] - lo
            if not len(d):
                yield i, j, np.zeros(0, np.uint32), np.zeros(j - i + 1, np.int64)
                continue
            raw = d.tobytes()
            s, alone = self._cuts(d, o, raw)
            n = np.diff(np.append(s, len(d)))
            kept = (n <= self.LONG) & ~alone[np.searchsorted(o, s, "right") - 1]
            h = byte_hash(d, s, s + n)
            k = np.where(kept, self._find(h), -1)
            if (new := np.flatnonzero((k < 0) & kept)).size:
                u, first = np.unique(h[new], return_index=True)
                self._learn(u, [raw[a : a + b] for a, b in zip(s[new[first]].tolist(), n[new[first]].tolist())])
                k[new] = self._find(h[new])
            many, used = self.many, self.used
            if (odd := np.flatnonzero(~self._same(d, s, n, k))).size:  # long ones, whole texts, and other pieces of the same hash
                k[odd] = self._append([raw[a : a + b] for a, b in zip(s[odd].tolist(), n[odd].tolist())])
            c = self.count[k].astype(np.int64)
            ends = np.cumsum(c)
            ids = self.flat[np.repeat(self.start[k] - (ends - c), c) + np.arange(ends[-1])]
            self.many, self.used = many, used
            yield i, j, ids, np.concatenate([[0], ends])[np.searchsorted(s, o)]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """uint32 ids of each text."""
        data, off = text_buffers(pa.array([t or "" for t in texts], pa.string()))
        return [ids[a:b] for _, _, ids, cut in self.buffers(data, off) for a, b in zip(cut, cut[1:])]

    def column(self, texts: pa.Array):
        """uint32 ids of each text of an Arrow column, in order."""
        data, off = text_buffers(texts)
        for _, _, ids, cut in self.buffers(data, off):
            for a, b in zip(cut.tolist(), cut[1:].tolist()):
                yield ids[a:b]


def encoder(path: str, ordinary: bool = False) -> Encoder:
    """One for each worker process and vocabulary."""
    if (path, ordinary) not in _loaded:
        _loaded[path, ordinary] = Encoder(path, ordinary)
    return _loaded[path, ordinary]


def fixed_lists(values: np.ndarray, length: int, kind: pa.DataType) -> pa.FixedSizeListArray:
    return pa.FixedSizeListArray.from_arrays(pa.array(values, kind), length)


def _fs(uri: str):
    """A file system and a path for a URI that executors share (file, hdfs, s3, gs, abfs)."""
    from pyarrow import fs

    if not urlparse(uri).scheme:
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), urlparse(uri).path
    return fs.FileSystem.from_uri(uri)


class _Shard:
    """Writes one file of sequences and its index."""

    def __init__(self, uri: str, length: int, kind: pa.DataType, rows: int):
        self.fs, self.path = _fs(uri)
        self.tmp, self.length, self.kind, self.rows = f"{self.path}.{uuid.uuid4().hex}", length, kind, rows
        self.schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.sink = self.fs.open_output_stream(self.tmp)
        self.file = pa.ipc.new_file(self.sink, self.schema)
        self.index_schema = pa.schema([(k, pa.int64()) for k in ("doc_id", "start", "n_tokens")])
        self.index_sink = self.fs.open_output_stream(f"{self.tmp}.index")
        self.index = pa.ipc.new_file(self.index_sink, self.index_schema)
        self.wait: list[np.ndarray] = []
        self.n = self.total = self.n_docs = 0
        self.docs: list[tuple[int | None, int, int]] = []  # not yet in the index file

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.docs.append((doc_id, self.total, len(ids)))
        self.n_docs += 1
        if len(self.docs) == 10_000:
            self._list()
        self.wait.append(ids)
        self.n += len(ids)
        self.total += len(ids)
        if self.n >= self.rows * self.length:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.wait) if self.wait else np.zeros(0, np.uint32)
        real = len(ids) if last else len(ids) - len(ids) % self.length
        rest, ids = ids[real:], ids[:real]
        rows = -(-real // self.length)
        if rows:
            full = np.zeros(rows * self.length, self.kind.to_pandas_dtype())
            full[:real] = ids
            mask = np.arange(rows * self.length) < real
            for k in range(0, rows, self.rows):
                a, b = k * self.length, min(rows, k + self.rows) * self.length
                self.file.write_batch(pa.record_batch([fixed_lists(full[a:b], self.length, self.kind), fixed_lists(mask[a:b], self.length, pa.bool_())], schema=self.schema))
        self.wait, self.n = ([rest] if len(rest) else []), len(rest)

    def _list(self) -> None:
        self.index.write_batch(pa.record_batch([pa.array([d[k] for d in self.docs], pa.int64()) for k in range(3)], schema=self.index_schema))
        self.docs = []

    def close(self) -> tuple[int, int]:
        self._flush(True)
        self._list()
        for f in (self.file, self.sink, self.index, self.index_sink):
            f.close()
        self.fs.move(f"{self.tmp}.index", f"{self.path}.index")
        self.fs.move(self.tmp, self.path)
        return self.n_docs, self.total


#: bytes of text for each file
SHARD = 64 << 20


def write_tokens(docs: DataFrame, vocabulary: str, end_id: int, out: str | None = None, length: int = 2048, rows: int = 128, shards: int | None = None) -> DataFrame:
    """Writes the files and returns their manifest: shard, path, n_docs, n_tokens, base (ids in the shards before)."""
    spark = docs.sparkSession
    out = out or scratch(spark, "tokens")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(hadoop)
    shards = shards or max(parts(spark), text_bytes(docs) // SHARD)

    def run(batches):
        from pyspark import TaskContext

        enc, shard = encoder(vocabulary), TaskContext.get().partitionId()
        kind = pa.uint16() if max(enc.size, end_id + 1) <= 1 << 16 else pa.uint32()
        file, end = None, np.array([end_id], np.uint32)
        for b in batches:
            if file is None and b.num_rows:
                file = _Shard(f"{out}/shard-{shard:06d}.arrow", length, kind, rows)
            for i, x in zip(b.column(0).to_pylist(), enc.column(b.column(1))):
                file.add(i, np.concatenate([x, end]))
        if file:
            n, total = file.close()
            yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [f"{out}/shard-{shard:06d}.arrow"], "n_docs": [n], "n_tokens": [total]})

    small_batches(spark)
    # rows with equal doc_id, a null one included, are dealt by their texts, and equal rows by their place, so no file grows with one key
    rows_ = docs.select("doc_id", "text").withColumn("hash", F.xxhash64("text")).withColumn("place", F.monotonically_increasing_id())
    order = [F.col("doc_id").asc_nulls_last(), "hash", F.col("text"), "place"]
    placed = rows_.repartitionByRange(shards, order[0], "hash", "place").sortWithinPartitions(*order)
    found = placed.select("doc_id", "text").mapInArrow(run, "shard long, path string, n_docs long, n_tokens long")
    found = written(found.repartition(1 + shards // 256), "token-manifest")  # few rows: few files
    base = F.coalesce(F.sum("n_tokens").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return written(found.withColumn("base", base), "token-manifest")


def open_shard(uri: str) -> tuple[pa.Table, pa.Table]:
    """Sequences and index of a file; a local file is mapped, not read."""
    system, path = _fs(uri)
    from pyarrow import fs

    def load(p):
        return pa.ipc.open_file(pa.memory_map(p) if isinstance(system, fs.LocalFileSystem) else system.open_input_file(p)).read_all()

    return load(path), load(f"{path}.index")


def sequence(table: pa.Table, k: int) -> tuple[np.ndarray, pa.Array]:
    """Ids and mask of sequence k: a view of the file."""
    batch = table.slice(k, 1)
    ids, mask = batch.column("ids").chunk(0), batch.column("mask").chunk(0)
    return ids.flatten().to_numpy(), mask.flatten()


def read_tokens(spark: SparkSession, manifest: DataFrame, emit, schema: str) -> DataFrame:
    """Rows of `emit(doc_id, start, ids)` for every document, read from the files; start counts all ids before it."""

    def run(batches):
        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                table, index = open_shard(path)
                # the lists' values are one buffer a batch; a document's ids are copied only where they cross batches
                chunks = [c.flatten().to_numpy(zero_copy_only=True) for c in table.column("ids").chunks]
                ends = np.cumsum([len(c) for c in chunks])
                rows, doc = [], 0
                for i, s, n in zip(index["doc_id"].to_pylist(), index["start"].to_pylist(), index["n_tokens"].to_pylist()):
                    k, got, need = int(np.searchsorted(ends, s, "right")), [], n
                    at = s - (int(ends[k - 1]) if k else 0)
                    while need:
                        got.append(chunks[k][at : at + need])
                        need -= len(got[-1])
                        k, at = k + 1, 0
                    rows.append(emit(i, base + s, got[0] if len(got) == 1 else np.concatenate(got)))
                    doc += 1
                    if len(rows) >= 10_000:
                        yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(spark.createDataFrame([], schema).schema)
    n = max(1, manifest.count())
    return manifest.select("path", "base").repartition(n, "path").mapInArrow(run, schema)


def digest(doc_id, start: int, ids: np.ndarray) -> dict:
    return {"doc_id": doc_id, "start": start, "n_tokens": len(ids), "ids_crc32": zlib.crc32(ids.astype("<u4").tobytes())}
