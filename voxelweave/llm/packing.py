"""Best-fit packing of token pieces into sequences, with several capacities.

A piece is a vector (tokens, documents, attention cost = tokens squared).  Pieces are placed
longest first; among the sequences whose residual capacities all hold it, the one with the
smallest weighted norm of what would be left wins (``norm``), or the one with the largest
weighted dot product of piece and residual (``dot``).

Pieces are dealt by a hash of what they are and of their place into groups of about `group`
pieces, so equal rows spread, too; each is packed by one task on lengths alone and leaves one
or two sequences part full, whatever the input's size.

Defined results: a null text is empty and, like an empty one, one piece of the end id; rows
with equal doc_id are packed each on its own; a piece longer than the capacity is an error; an
empty table gives no rows; columns named in `carry` go along, others are dropped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .tokens import encoder


def pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int = 2048) -> DataFrame:
    """doc_id, piece, start, length and ids (little-endian unsigned 32-bit) of every document's ids with the end id.

    Only documents over the capacity are cut; the first piece takes what does not fill one.
    """

    def run(batches):
        enc, end = encoder(vocabulary), np.array([end_id], "<u4")
        for b in batches:
            doc, piece, start, length, blob, size = [], [], [], [], [], 0
            for i, x in zip(b.column(0).to_pylist(), enc.column(b.column(1))):
                x = np.concatenate([x, end])
                at = [0, *range((len(x) - 1) % capacity + 1, len(x), capacity), len(x)]
                for k, (s, e) in enumerate(zip(at, at[1:])):
                    doc.append(i)
                    piece.append(k)
                    start.append(s)
                    length.append(e - s)
                    blob.append(x[s:e].tobytes())
                size += len(x)
                if size > 1 << 20:
                    yield batch(doc, piece, start, length, blob)
                    doc, piece, start, length, blob, size = [], [], [], [], [], 0
            yield batch(doc, piece, start, length, blob)

    def batch(doc, piece, start, length, blob):
        return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(blob, pa.binary())], names=["doc_id", "piece", "start", "length", "ids"])

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")


def about(docs: DataFrame, capacity: int = 2048) -> int:
    """About how many pieces docs have: one each, and one more for each capacity of four-byte tokens."""
    n, size = docs.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    return n + (size or 0) // (4 * capacity)


def best_fit(length: np.ndarray, capacity: int, most_docs: int, most_cost: int, score: str = "norm", weights=(1.0, 0.01, 0.01)) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and place of each piece; pieces are taken in the given order."""
    n = len(length)
    cap = np.array([capacity, most_docs, most_cost], float)
    scale = np.array(weights, float)
    if n and (length.max() > capacity or length.max() ** 2 > most_cost):
        raise ValueError("a piece is larger than a sequence may be")
    least = np.minimum.accumulate(length[::-1])[::-1] if n else length  # the shortest piece still to come
    bin_of, at = np.zeros(n, np.int64), np.zeros(n, np.int64)
    size = 1024
    tokens, docs, cost, name = (np.zeros(size, np.int64) for _ in range(4))  # residuals of the open sequences
    fill: list[int] = []
    opened = 0
    for i in range(n):
        x = int(length[i])
        c = x * x
        k = -1
        if x < capacity and opened:
            t, d, q = tokens[:opened], docs[:opened], cost[:opened]
            ok = np.flatnonzero((t >= x) & (d >= 1) & (q >= c))
            if len(ok):
                a, b, e = t[ok], d[ok], q[ok]
                if score == "dot":
                    s = -(scale[0] * (x / cap[0]) * (a / cap[0]) + scale[1] * (1 / cap[1]) * (b / cap[1]) + scale[2] * (c / cap[2]) * (e / cap[2]))
                else:
                    s = scale[0] * ((a - x) / cap[0]) ** 2 + scale[1] * ((b - 1) / cap[1]) ** 2 + scale[2] * ((e - c) / cap[2]) ** 2
                k = int(ok[np.argmin(s)])
        if k < 0:
            fill.append(0)
            if x == capacity:
                bin_of[i] = len(fill) - 1
                fill[-1] = x
                continue
            if opened == size:
                size *= 2
                tokens, docs, cost, name = (np.concatenate([v, np.zeros_like(v)]) for v in (tokens, docs, cost, name))
            k = opened
            tokens[k], docs[k], cost[k], name[k] = capacity, most_docs, most_cost, len(fill) - 1
            opened += 1
        b = int(name[k])
        bin_of[i], at[i] = b, fill[b]
        fill[b] += x
        tokens[k] -= x
        docs[k] -= 1
        cost[k] -= c
        if i + 1 < n and (tokens[k] < least[i + 1] or docs[k] < 1 or cost[k] < int(least[i + 1]) ** 2):  # closed: no later piece fits
            opened -= 1
            for v in (tokens, docs, cost, name):
                v[k] = v[opened]
    return bin_of, at


def pack(items: DataFrame, n_items: int, carry: tuple[str, ...], capacity: int = 2048, most_docs: int | None = None, most_cost: int | None = None, score: str = "norm", group: int = 16_000) -> DataFrame:
    """The columns `carry`, length, sequence_id and offset of every item; n_items: about how many there are.

    By default a sequence may have as many documents as it has tokens and any attention cost that these allow, so that neither costs a sequence.
    """
    most_docs, most_cost = most_docs or capacity, most_cost or capacity * capacity
    groups = max(1, round(n_items / group))
    fields = items.select(*carry, "length").schema
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["sequence_id long", "offset long"])

    def run(key, pdf):
        pdf = pdf.sort_values(["length", *carry], ascending=[False] + [True] * len(carry), kind="stable", ignore_index=True)
        bins, at = best_fit(pdf["length"].to_numpy(np.int64), capacity, most_docs, most_cost, score)
        return pdf.drop(columns="__group").assign(sequence_id=(int(key[0]) << 32) + bins, offset=at)

    hashed = F.pmod(F.xxhash64(*carry, F.monotonically_increasing_id()), F.lit(groups))
    return items.select(*carry, "length", hashed.alias("__group")).groupBy("__group").applyInPandas(run, schema)
