"""Hard negatives by a two-dimensional block matrix product.

Scores are integer inner products of anchors with all rows.  Anchors and rows are cut into blocks,
and their vectors into chunks of dimensions.  A cell is a square of blocks for one chunk: it gets
the chunk's part of its anchor and row blocks and multiplies them to partial int64 tiles (anchors x
rows).  Partial tiles of a pair of blocks meet by a shuffle and are added.  A whole tile gives each
anchor its best rows of the tile, a window's few, and only these are ranked over all tiles.  Tiles
are of fixed size, so memory doesn't grow with the table, and no group grows with a label, a
score or a vector that many rows share.

Two products are made.  The first takes tiles whose blocks share a label (rows are in blocks by
label) and finds positives: an anchor's first `positives` other rows of its label.  The second finds
negatives: for each positive score p the first `negatives` rows of other labels whose score s has
low * p <= 100 * s <= high * p.  Scores fall, ties go to the smaller id, a null id comes last.

Every anchor meets every row, in blocks: the stated queries (an anchor a hundred rows) against all.

Defined results: rows with a null label, a null vector, or a null or non-finite component take no
part; repeated rows, and rows that share an id, are rows of their own; missing dimensions of
shorter vectors count as 0; components beyond 64 bits saturate and sums wrap modulo 2**64; an
anchor without positives, or a positive without negatives, gives no rows; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.numbering import numbered
from .common import drop_written, written

#: dimensions of a chunk, rows of a row block, anchors of an anchor block, blocks a side of a cell
CHUNK, ROWS, ANCHORS, SIDE = 32, 4096, 256, 4
LEAST = np.iinfo(np.int64).min
#: a block's chunk: lo and hi are its labels' range, values its part of the vectors, row by row
BLOCK = "block long, chunk int, n int, lo long, hi long, ids binary, labels binary, rows binary, wanted binary, values binary"


def usable(vectors: DataFrame, label: Column, vector: str = "embedding") -> DataFrame:
    """id, label, q (array of long, floor(256 x)) of the rows that take part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector))
    rows = rows.where(F.col("label").isNotNull() & F.col(vector).isNotNull()).where(finite)
    return rows.select("id", "label", F.transform(vector, lambda x: F.floor(x.cast("double") * 256).cast("long")).alias("q"))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Lists of numbers as rows, shorter ones filled up with 0."""
    column = column.combine_chunks()
    n, values = column.value_lengths().to_numpy(), column.flatten().to_numpy()
    out = np.zeros((len(n), int(n.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < n[:, None]] = values
    return out


def _int64(column) -> np.ndarray:
    return column.combine_chunks().fill_null(np.iinfo(np.int64).max).to_numpy().astype(np.int64)


def _blocked(group: pa.Table) -> pa.Table:
    """The chunks of a block's rows, in the order of id.  wanted: for each row how many scores it has, and these."""
    nulls = group["id"].is_null().combine_chunks().to_numpy(zero_copy_only=False)
    group = group.take(pa.array(np.lexsort((_int64(group["number"]), _int64(group["id"]), nulls))))
    q, labels = _matrix(group["q"]), _int64(group["label"])
    wanted = np.zeros((len(labels), 1), np.int64)
    if "wanted" in group.column_names:
        wanted = np.hstack([group["wanted"].combine_chunks().value_lengths().to_numpy()[:, None], _matrix(group["wanted"])])
    meta = [x.astype(np.int64).tobytes() for x in (_int64(group["id"]), labels, _int64(group["number"]), wanted)]
    rows = []
    for c in range(max(1, -(-q.shape[1] // CHUNK))):
        part = np.ascontiguousarray(q[:, c * CHUNK : (c + 1) * CHUNK])
        rows.append((group["block"][0].as_py(), c, len(labels), int(labels.min()), int(labels.max()), *(meta if c == 0 else [None] * 4), part.tobytes()))
    return _table(rows, BLOCK)


_TYPES = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(n, _TYPES[t]) for n, t in (c.split() for c in ddl.split(", "))])


def _table(rows: list[tuple], ddl: str) -> pa.Table:
    schema = _schema(ddl)
    return pa.Table.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def blocks(rows: DataFrame, place: str, size: int) -> DataFrame:
    """Chunks of blocks of `size` rows (id, label, number, q, maybe wanted), numbered densely by `place`."""
    return written(rows.withColumn("block", F.floor(F.col(place) / size)).groupBy("block").applyInArrow(_blocked, BLOCK), "blocks")


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T as int64: by floating point where that is exact."""
    most = [float(np.abs(x.astype(np.float64)).max(initial=0)) for x in (a, b)]
    if most[0] * most[1] * max(1, a.shape[1]) < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    with np.errstate(over="ignore"):
        return a @ b.T


PART = "a long, b long, chunk int, tile binary, a_ids binary, a_labels binary, a_rows binary, wanted binary, b_ids binary, b_labels binary, b_rows binary"


def tiles(anchors: DataFrame, rows: DataFrame, found, schema: str, same_label: bool) -> DataFrame:
    """Rows of found(scores, side a, side b) of every tile; a side is (ids, labels, rows, wanted).

    same_label: only tiles whose blocks' label ranges meet; else all but those of one label.
    """
    top_a, top_b = (df.agg(F.max("block")).first()[0] for df in (anchors, rows))
    if top_a is None or top_b is None:
        return anchors.sparkSession.createDataFrame([], schema)
    down, across = top_a // SIDE + 1, top_b // SIDE + 1
    cell = lambda df, own, other, n: df.withColumn(own, F.floor(F.col("block") / SIDE)).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>")))
    left = cell(anchors, "down", "across", across).withColumn("is_anchor", F.lit(True))
    right = cell(rows, "across", "down", down).withColumn("is_anchor", F.lit(False))

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side = {True: [], False: []}
        for r in (r for b in batches for r in b.to_pylist()):
            side[r["is_anchor"]].append((r, np.frombuffer(r["values"], np.int64).reshape(r["n"], -1)))
        for a, x in side[True]:
            for b, y in side[False]:
                meet = a["lo"] <= b["hi"] and b["lo"] <= a["hi"]
                if not meet if same_label else a["lo"] == a["hi"] == b["lo"] == b["hi"]:
                    continue
                d = min(x.shape[1], y.shape[1])
                tile = _product(x[:, :d], y[:, :d])
                meta = [r[k] for r, names in ((a, ("ids", "labels", "rows", "wanted")), (b, ("ids", "labels", "rows"))) for k in names]
                yield from _table([(a["block"], b["block"], a["chunk"], tile.tobytes(), *meta)], PART).to_batches()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, first = None, None
        for b in batches:
            for k in range(b.num_rows):
                part = np.frombuffer(b["tile"][k].as_buffer(), np.int64)
                with np.errstate(over="ignore"):
                    tile = part.copy() if tile is None else np.add(tile, part, out=tile)
                if b["chunk"][k].as_py() == 0:
                    first = b.slice(k, 1).drop_columns(["tile"]).to_pylist()[0]
        ids = [np.frombuffer(first[k], np.int64) for k in ("a_ids", "a_labels", "a_rows", "b_ids", "b_labels", "b_rows")]
        n = len(ids[0])
        yield from found(tile.reshape(n, -1), (*ids[:3], np.frombuffer(first["wanted"], np.int64).reshape(n, -1)), tuple(ids[3:])).to_batches()

    partial = left.unionByName(right).groupBy("down", "across", "chunk").applyInArrow(multiply, PART)
    return partial.groupBy("a", "b").applyInArrow(add, schema)


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest that aren't LEAST, falling, ties by place (rows are in the order of ids)."""
    if len(scores) > k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        at = np.arange(len(scores))
    at = at[scores[at] > LEAST]
    return at[np.argsort(-scores[at], kind="stable")][:k]


POSITIVE = "anchor long, anchor_id long, id long, score long"
NEGATIVE = "anchor long, place long, id long, score long"


def positives_of(k: int):
    """The tile's k best other rows of each anchor's label."""

    def found(scores, a, b):
        out = []
        for i, (own_id, label, row, s) in enumerate(zip(a[0].tolist(), a[1], a[2], scores)):
            for j in _best(np.where((b[1] == label) & (b[2] != row), s, LEAST), k).tolist():
                out.append((int(a[2][i]), own_id, int(b[0][j]), int(s[j])))
        return _table(out, POSITIVE)

    return found


def negatives_of(k: int, low: int, high: int):
    """The tile's k best rows of other labels in the window of each positive of each anchor."""

    def found(scores, a, b):
        out = []
        for label, row, wanted, s in zip(a[1], a[2].tolist(), a[3].tolist(), scores):
            other = b[1] != label
            for place, p in enumerate(wanted[1 : 1 + wanted[0]], 1):
                least, most = -(-low * p // 100), high * p // 100
                if least <= most:
                    for j in _best(np.where(other & (s >= least) & (s <= most), s, LEAST), k).tolist():
                        out.append((row, place, int(b[0][j]), int(s[j])))
        return _table(out, NEGATIVE)

    return found


def _first(found: DataFrame, by: list[str], k: int, name: str) -> DataFrame:
    """The first k of each group over all tiles, with their place from 1."""
    order = W.partitionBy(*by).orderBy(F.desc("score"), "id")
    return found.withColumn(name, F.row_number().over(order)).where(F.col(name) <= k)


def mine(vectors: DataFrame, label: Column, anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; anchor is a condition over id, label and q."""
    placed = numbered(usable(vectors, label).withColumn("tie", F.monotonically_increasing_id()), ["label", "id", "tie"], "number").drop("tie")
    rows = blocks(placed, "number", ROWS)
    anchors = written(numbered(placed.where(anchor), ["label", "number"], "place"), "anchors")
    first = blocks(anchors, "place", ANCHORS)
    found = tiles(first, rows, positives_of(positives), POSITIVE, same_label=True)
    best = written(_first(found, ["anchor"], positives, "place"), "positives")
    drop_written(first)
    scores = F.sort_array(F.collect_list(F.struct("place", "score")))["score"]
    wanted = best.groupBy(F.col("anchor").alias("number")).agg(scores.alias("wanted"))
    second = blocks(anchors.join(wanted, "number"), "place", ANCHORS)
    found = tiles(second, rows, negatives_of(negatives, low, high), NEGATIVE, same_label=False)
    ranked = _first(found, ["anchor", "place"], negatives, "rank")
    of = best.select("anchor", "place", "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    named = ranked.select("anchor", "place", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(of, ["anchor", "place"])
    unnamed = lambda c: F.when(F.col(c) != np.iinfo(np.int64).max, F.col(c)).alias(c)
    return named.select("anchor_id", unnamed("positive_id"), F.col("rank").cast("int").alias("rank"), unnamed("negative_id"), "positive_score", "negative_score")
