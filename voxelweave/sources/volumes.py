"""Label volumes as dense chunks: one file a block that has a label (or a file for some blocks in a row), background 0, and an index table of the chunks.

A task fills one block's array from its runs, so memory is a block's; the file is written under a name of the
attempt's own and moved in place, so a lost executor costs its blocks again and nothing else.  Blocks without a
label have no file and read as background.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import masks
from .tiles import _place

RUN = np.dtype([("label", "<i8"), ("at", "<i4"), ("n", "<i4")])
INDEX = "bx long, by long, bz long, path string, n_labelled long, crc32 long, at long, size long"


def export_volume(painted: DataFrame, folder: str, block: tuple[int, int, int], deflate: bool = False, shelf: int = 1) -> DataFrame:
    """Writes runs with labels (z, y, x0, x1, label; the largest wins, 0 and below are background), or whole masks with labels (z, x0, y0, lines, label), as NPY chunks of int64 in the order z, y, x; gives their index.

    Chunks are whole blocks, also at the volume's sides.  deflate: files are NPZ with a chunk's labels and each place's number
    among them, deflated, so that they take what is drawn in them and not the block's size.  folder: one that all executors reach.
    shelf: so many blocks in x share a file if it is more than 1 (with deflate), one after the other: labels, then each place's number
    among them, deflated; the index says where each lies (`at`, `size`; null where a file has one chunk).
    """
    w, h, d = block
    if shelf > 1 and not deflate:
        raise ValueError("only deflated chunks share files")
    whole = "lines" in painted.columns
    cut = painted.where("label > 0").select("z", *(("x0", "y0", "lines") if whole else ("y", "x0", "x1")), "label")

    def deal(batches: Iterator) -> Iterator:
        """bx, by, bz, runs: a batch's runs cut at the blocks' sides, those of a block as one row of packed (label, place, length)."""
        for b in batches:
            if whole:
                r, of = masks._flat(b.column("lines"))
                z, left, top, label = (b.column(c).to_numpy(zero_copy_only=False)[of] for c in ("z", "x0", "y0", "label"))
                y, x0 = r[:, 0] + top, r[:, 1] + left
                x1 = x0 + r[:, 2]
            else:
                z, y, x0, x1, label = (b.column(c).to_numpy(zero_copy_only=False) for c in ("z", "y", "x0", "x1", "label"))
            n = np.maximum((x1 - 1) // w - x0 // w + 1, 0) * (x1 > x0)
            k = np.repeat(np.arange(len(z)), n)
            bx = (x0 // w)[k] + np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n)
            lo, hi = np.maximum(x0[k], bx * w), np.minimum(x1[k], (bx + 1) * w)
            by, bz = (y // h)[k], (z // d)[k]
            runs = np.empty(len(k), RUN)
            runs["label"], runs["at"], runs["n"] = label[k], ((z[k] - bz * d) * h + y[k] - by * h) * w + lo - bx * w, hi - lo
            order = np.lexsort((bx, by, bz))
            bx, by, bz, runs = bx[order], by[order], bz[order], runs[order]
            first = np.flatnonzero(np.r_[True, (bx[1:] != bx[:-1]) | (by[1:] != by[:-1]) | (bz[1:] != bz[:-1])]) if len(k) else np.zeros(0, np.int64)
            parts = [r.tobytes() for r in np.split(runs, first[1:])] if len(k) else []
            yield pa.RecordBatch.from_arrays([pa.array(bx[first], pa.int64()), pa.array(by[first], pa.int64()), pa.array(bz[first], pa.int64()), pa.array(parts, pa.binary())], names=["bx", "by", "bz", "runs"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        import uuid
        import zlib

        bx, by, bz = (int(pdf[c].iloc[0]) for c in ("bx", "by", "bz"))
        r = np.frombuffer(b"".join(pdf["runs"]), RUN)
        r = r[np.argsort(r["label"], kind="stable")]  # the largest is drawn last
        n = r["n"].astype(np.int64)
        chunk = np.zeros(d * h * w, np.int64)
        chunk[np.repeat(r["at"] - (np.cumsum(n) - n), n) + np.arange(n.sum())] = np.repeat(r["label"], n)
        chunk = chunk.reshape(d, h, w)
        out = io.BytesIO()
        if deflate:
            names, at = np.unique(chunk, return_inverse=True)
            np.savez_compressed(out, labels=names, at=at.reshape(d, h, w).astype(np.uint16 if len(names) <= 1 << 16 else np.int64))
        else:
            np.save(out, chunk)
        system, path = _place(f"{folder.rstrip('/')}/{bz}/{by}_{bx}.{'npz' if deflate else 'npy'}")
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        tmp = f"{path}.{uuid.uuid4().hex}"
        with system.open_output_stream(tmp) as f:
            f.write(out.getbuffer())
        system.move(tmp, path)
        return pd.DataFrame([(bx, by, bz, path, int((chunk != 0).sum()), zlib.crc32(chunk.astype("<i8").tobytes()), None, None)], columns=columns)

    def run_shelf(pdf: pd.DataFrame) -> pd.DataFrame:
        import uuid
        import zlib

        by, bz, first = (int(pdf[c].iloc[0]) for c in ("by", "bz", "shelf"))
        parts: dict[int, list[bytes]] = {}
        for bx, blob in zip(pdf["bx"].tolist(), pdf["runs"]):
            parts.setdefault(bx, []).append(blob)
        system, path = _place(f"{folder.rstrip('/')}/{bz}/{by}_{first}.shelf")
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        tmp, at, found = f"{path}.{uuid.uuid4().hex}", 0, []
        with system.open_output_stream(tmp) as f:
            for bx in sorted(parts):
                r = np.frombuffer(b"".join(parts[bx]), RUN)
                r = r[np.argsort(r["label"], kind="stable")]  # the largest is drawn last
                names, number = np.unique(r["label"], return_inverse=True)
                names = np.concatenate([np.zeros(1, "<i8"), names])
                n = r["n"].astype(np.int64)
                drawn = np.zeros(d * h * w, "<u4")
                drawn[np.repeat(r["at"] - (np.cumsum(n) - n), n) + np.arange(n.sum())] = np.repeat(number + 1, n)
                body = zlib.compress(np.int64(len(names)).tobytes() + names.astype("<i8").tobytes() + (drawn.astype("<u2") if len(names) <= 1 << 16 else drawn).tobytes(), 1)
                f.write(body)
                found.append((bx, by, bz, path, int(np.count_nonzero(drawn)), zlib.crc32(names[drawn].astype("<i8").tobytes()), at, len(body)))
                at += len(body)
        system.move(tmp, path)
        return pd.DataFrame(found, columns=columns)

    columns = [c.split()[0] for c in INDEX.split(", ")]
    dealt = cut.mapInArrow(deal, "bx long, by long, bz long, runs binary")
    if shelf > 1:
        return dealt.withColumn("shelf", F.floor(F.col("bx") / shelf)).groupBy("shelf", "by", "bz").applyInPandas(run_shelf, INDEX)
    return dealt.groupBy("bx", "by", "bz").applyInPandas(run, INDEX)


def read_volume(index: DataFrame, block: tuple[int, int, int]) -> DataFrame:
    """z, y, x0, x1, label: the labelled runs of the chunks of an index, cut at the blocks' sides; a chunk that isn't what the index says is an error."""
    w, h, d = block

    def shelved(body: bytes) -> np.ndarray:
        import zlib

        raw = zlib.decompress(body)
        n = int(np.frombuffer(raw, "<i8", 1)[0])
        names, wide = np.frombuffer(raw, "<i8", n, 8), "<u2" if n <= 1 << 16 else "<u4"
        return names[np.frombuffer(raw, wide, d * h * w, 8 + 8 * n)].reshape(d, h, w)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zlib

        last, data = None, b""  # chunks of a file come one after the other as a rule
        for b in batches:
            out = []
            for r in b.itertuples():
                if r.path != last:
                    system, path = _place(r.path)
                    with system.open_input_file(path) as f:
                        last, data = r.path, f.read()
                if pd.isna(r.bytes):
                    stored = np.load(io.BytesIO(data), allow_pickle=False)
                    chunk = stored if isinstance(stored, np.ndarray) else stored["labels"][stored["at"]]
                else:
                    chunk = shelved(data[int(r.at) : int(r.at) + int(r.bytes)])
                if zlib.crc32(chunk.astype("<i8").tobytes()) != r.crc32:
                    raise ValueError(f"{r.path} has changed")
                flat = np.pad(chunk, ((0, 0), (0, 0), (1, 1)))
                z, y, x = np.nonzero(flat[:, :, 1:] != flat[:, :, :-1])  # where a stretch of one label starts, or the background after it
                label = chunk[z, y, np.minimum(x, w - 1)] * (x < w)
                same = (z[1:] == z[:-1]) & (y[1:] == y[:-1])
                end = np.append(np.where(same, x[1:], w), w) if len(x) else x
                keep = label != 0
                out.append([c[keep] for c in (z + r.bz * d, y + r.by * h, x + r.bx * w, end + r.bx * w, label)])
                if len(out) == 256:
                    yield frame(out)
                    out = []
            if out:
                yield frame(out)

    frame = lambda out: pd.DataFrame(dict(zip(("z", "y", "x0", "x1", "label"), map(np.concatenate, zip(*out)))))
    return index.select("bx", "by", "bz", "path", "crc32", F.col("at"), F.col("size").alias("bytes")).mapInPandas(run, "z long, y long, x0 long, x1 long, label long")
