"""Weights of keys that many documents share, summed up by document.

A key (a pre-token, a pair of token ids) gets its weight once for the whole corpus.  The documents
that hold it come as *postings*: a row a chunk of texts and key, with the chunk's documents and how
often each holds the key.  Postings are joined with the weights, summed within a task, and gathered
by chunk.  A key that all texts hold is a row a chunk, and its rows are dealt over salts of SALTED
chunks, so no task gets more of one key; a chunk's sums are bounded by its documents.

What a document has besides its sums goes along as the *head* of its chunk, a posting without a
key, so nothing has to name a document twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_bytes
from .exchange import BYTES

#: chunks whose rows of one key may meet in a task; documents that a chunk may have
SALTED, DOCS = 4096, 1 << 16
SUMS = "chunk long, docs binary, sums binary, head binary"


def salts(docs: DataFrame) -> int:
    return 1 + text_bytes(docs) // (BYTES * SALTED)


def binary_array(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Stretches of bytes that end at `ends`."""
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def encode(docs: np.ndarray, counts: np.ndarray, first: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Postings of keys whose entries start at `first`, and how many documents each has; an entry is 16 bits of document and 8 of count, larger counts are several."""
    n_docs = np.diff(np.append(first, len(docs)))
    times = (counts + 254) // 255
    if (times > 1).any():
        last = np.cumsum(times) - 1
        entry = np.repeat(np.arange(len(docs)), times)
        small = np.full(len(entry), 255, np.int64)
        small[last] = counts - 255 * (times - 1)
        first = np.concatenate([[0], np.cumsum(times)])[first]
        docs, counts = docs[entry], small
    n = np.diff(np.append(first, len(docs)))
    place = np.arange(len(docs)) - np.repeat(first, n)
    at = 3 * np.repeat(first, n) + 2 * place
    data = np.empty(3 * len(docs), np.uint8)
    data[at], data[at + 1] = docs & 255, docs >> 8
    data[3 * np.repeat(first, n) + 2 * np.repeat(n, n) + place] = counts
    return binary_array(data, 3 * np.cumsum(n)), n_docs


def decode(postings: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, document and count of each entry; null postings have none."""
    if postings.null_count:
        postings = postings.fill_null(b"")
    offsets = np.frombuffer(postings.buffers()[1], np.int32)[postings.offset : postings.offset + len(postings) + 1].astype(np.int64)
    n = np.diff(offsets) // 3
    row = np.repeat(np.arange(len(n)), n)
    if not len(row):
        return row, row, row
    data = np.frombuffer(postings.buffers()[2], np.uint8)
    start = offsets[:-1]
    place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    at = np.repeat(start, n) + 2 * place
    docs = data[at].astype(np.int64) | data[at + 1].astype(np.int64) << 8
    return row, docs, data[np.repeat(start + 2 * n, n) + place].astype(np.int64)


def head(columns: dict[str, pa.Array]) -> bytes:
    batch = pa.RecordBatch.from_pydict(columns)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def summed(weighted: DataFrame, weights: list[str], schema: str) -> DataFrame:
    """Rows of `schema`: the columns of the heads, then for each of `weights` the sum over a document's keys of count times weight.

    weighted: chunk, posting, head and the weights (long); those of a head are null.
    """
    k = len(weights)

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            chunk, which = np.unique(b["chunk"].to_numpy(), return_inverse=True)
            row, doc, count = decode(b["posting"])
            w = [b[c].fill_null(0).to_numpy().astype(np.int64) for c in weights]
            held, at = np.unique(which[row] * DOCS + doc, return_inverse=True)
            sums = np.zeros((len(held), k), np.int64)
            for c in range(k):
                np.add.at(sums[:, c], at, count * w[c][row])
            cut = np.searchsorted(held, np.arange(1, len(chunk) + 1) * DOCS)
            docs = binary_array((held % DOCS).astype("<u2").view(np.uint8), 2 * cut)
            heads = [h for h in zip(b["chunk"].to_pylist(), b["head"].to_pylist()) if h[1] is not None]
            yield pa.RecordBatch.from_arrays([pa.array(chunk, pa.int64()), docs, binary_array(sums.reshape(-1).view(np.uint8), 8 * k * cut), pa.nulls(len(chunk), pa.binary())], names=["chunk", "docs", "sums", "head"])
            if heads:
                ids, blobs = zip(*heads)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.nulls(len(ids), pa.binary()), pa.nulls(len(ids), pa.binary()), pa.array(blobs, pa.binary())], names=["chunk", "docs", "sums", "head"])

    def whole(group: pa.Table) -> pa.Table:
        docs = pa.ipc.open_stream(next(h for h in group["head"].to_pylist() if h is not None)).read_all()
        sums = np.zeros((len(docs), k), np.int64)
        for at, part in zip(group["docs"].to_pylist(), group["sums"].to_pylist()):
            if at:  # a document once in a part
                sums[np.frombuffer(at, "<u2")] += np.frombuffer(part, np.int64).reshape(-1, k)
        for c, name in enumerate(weights):
            docs = docs.append_column(name, pa.array(sums[:, c]))
        return docs

    ordered = weighted.select("chunk", "posting", "head", *weights).sortWithinPartitions("chunk")
    return ordered.mapInArrow(within, SUMS).groupBy("chunk").applyInArrow(whole, schema)
