"""Scatter and gather: keys of many texts meet by hash, and the answer goes back to the texts.

A task turns a chunk of texts into one block of keys for each shard; a shard sees the blocks of
all chunks and answers each; a chunk's answers are put together.  Rows of the exchange are
blocks, not keys, so the JVM moves a few thousand rows and NumPy does the rest.  A chunk sends
each distinct key once, so a key that a third of all texts hold costs one entry a chunk, and
no group grows with one key.  Chunks are named by what they hold; the input must be a table
(or a deterministic plan over one), so that a task that runs again makes the same chunks.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix, small_batches, text_buffers

BIGGEST = (1 << 63) - 1
#: texts and bytes of a chunk
TEXTS, BYTES = 4096, 4 << 20


#: partitions that an exchange may have; with more shards, several share one
MOST_PARTITIONS = 50_000


def row_of() -> Column:
    """Hash of the text; its lowest bit says whether doc_id is null."""
    return F.xxhash64("text").bitwiseAND(F.lit(-2)).bitwiseOR(F.col("doc_id").isNull().cast("long"))


def keyed(docs: DataFrame) -> DataFrame:
    """dk (doc_id, null as the largest number), row (row_of), text: what tells rows apart.  Neither key is nullable."""
    return docs.select(F.coalesce("doc_id", F.lit(BIGGEST)).alias("dk"), row_of().alias("row"), F.coalesce("text", F.lit("")).alias("text"))


def doc_id_of(dk: str = "dk", row: str = "row") -> Column:
    return F.when(F.col(row).bitwiseAND(F.lit(1)) == 0, F.col(dk))


def chunks(batch: pa.RecordBatch, column: str = "text"):
    """(first, last, data, offsets) of the chunks of a batch."""
    data, off = text_buffers(batch.column(batch.schema.get_field_index(column)))
    i, n = 0, len(off) - 1
    while i < n:
        j = min(i + TEXTS, n, max(i + 1, int(np.searchsorted(off, off[i] + BYTES, "right")) - 1))
        yield i, j, data, off
        i = j


def pack(value) -> bytes:
    return zstandard.compress(pickle.dumps(value, 5), 1)


def unpack(blob: bytes):
    return pickle.loads(zstandard.decompress(blob))


def scatter_gather(df: DataFrame, shards: int, send: Callable, answer: Callable, gather: Callable, schema: str) -> DataFrame:
    """
    send(batch) yields for each chunk (name, meta, blocks): blocks maps shards to picklable values;
    answer(list of blocks) gives as many answers; gather(meta, {shard: answer}) gives a pandas frame of `schema`.
    """

    def out(batches):
        from pyspark import TaskContext

        task, place = TaskContext.get().partitionId(), 0
        for b in batches:
            for name, meta, blocks in send(b):
                place += 1  # equal chunks of repeated rows are told apart by their place
                name = int(mix(np.array([(name + (task << 32) + place) & ((1 << 64) - 1)], np.uint64)).astype(np.int64)[0])
                if not blocks:
                    blocks = {name % shards: None}
                with_meta = list(blocks)[name % len(blocks)]  # any shard, not always the same one
                rows = [(name, s, pack(v), pack(meta) if s == with_meta else None) for s, v in blocks.items()]
                for k in range(0, len(rows), 256):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 256]), (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["chunk", "shard", "block", "meta"])

    def shard(pdf):
        blocks = [unpack(b) for b in pdf["block"]]
        some = [b for b in blocks if b is not None]
        got = iter(answer(some) if some else [])
        replies = [None if b is None else next(got) for b in blocks]
        return pd.DataFrame({"chunk": pdf["chunk"], "shard": pdf["shard"], "block": [pack(r) for r in replies], "meta": pdf["meta"]})

    def back(pdf):
        meta = next(unpack(m) for m in pdf["meta"] if m is not None)
        return gather(meta, {int(s): unpack(b) for s, b in zip(pdf["shard"], pdf["block"])})

    small_batches(df.sparkSession)
    wire = "chunk long, shard long, block binary, meta binary"
    # both exchanges have as many partitions as there are shards, that is in proportion to the bytes; a shard has one for itself
    n = max(1, min(shards, MOST_PARTITIONS))
    sent = df.mapInArrow(out, wire).withColumn("part", (F.col("shard") % n).cast("int")).repartitionById(n, F.col("part"))
    return sent.groupBy("part", "shard").applyInPandas(shard, wire).repartition(n, "chunk").groupBy("chunk").applyInPandas(back, schema)


def chunk_name(dk: np.ndarray, row: np.ndarray) -> int:
    """Of the rows a chunk holds."""
    with np.errstate(over="ignore"):
        h = mix(dk.astype(np.uint64) + mix(row.astype(np.uint64)))
        return int(mix(np.array([np.bitwise_xor.reduce(h * (2 * np.arange(len(h), dtype=np.uint64) + np.uint64(1)))]))[0].astype(np.int64))


def split(keys: np.ndarray, shards: int, *more: np.ndarray) -> dict[int, tuple[np.ndarray, ...]]:
    """Keys and what goes with them, by shard."""
    s = (keys >> np.uint64(32)) % np.uint64(shards)
    order = np.argsort(s, kind="stable")
    s = s[order]
    cut = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, int)
    return {int(s[a]): tuple(x[order[a:b]] for x in (keys, *more)) for a, b in zip(cut, [*cut[1:], len(s)])}


def distinct(keys: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of (key, text) pairs without repeats, the first text of each, and in how many texts it is."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, int)
    return k[at], of[order[at]], np.diff(np.concatenate([at, [len(k)]]))


def totals(blocks: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """For blocks of (keys, counts): the count of each key over all blocks, in the blocks' order."""
    keys = np.concatenate([b[0] for b in blocks])
    n = np.concatenate([b[1] for b in blocks]).astype(np.int64)
    u, inv = np.unique(keys, return_inverse=True)
    total = np.bincount(inv, n, minlength=len(u)).astype(np.int64)[inv]
    return np.split(total, np.cumsum([len(b[0]) for b in blocks])[:-1])
