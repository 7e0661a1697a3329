"""What the operators of this package share: shared folders, written tables, text kernels.

Words are maximal runs of bytes outside ``\\x20`` and ``\\x09``-``\\x0D``; no other byte of
UTF-8 text has those values, so the kernels work on the Arrow buffers without decoding.
Peak memory of a kernel is about 40 bytes for each byte of ``SEGMENT`` or of the longest
single text, whichever is larger.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SEGMENT = 1 << 20


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir; a temporary one where it is unset and Spark runs in one process."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="voxelweave-"))
        base = sc.getCheckpointDir()
    return base.rstrip("/")


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path below the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"

    def remove(jvm=spark.sparkContext._jvm, conf=spark.sparkContext._jsc.hadoopConfiguration()):
        try:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
        except Exception:  # the session has ended before
            pass

    atexit.register(remove)
    return path


def written(df: DataFrame, tag: str, sized: bool = False) -> DataFrame:
    """Cuts lineage: writes df as a Parquet table in the shared folder and reads it back.

    sized: small rows of many tasks are rebalanced first, so that there are as many files as the bytes need.
    """
    path = scratch(df.sparkSession, tag)
    (df.hint("rebalance") if sized else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Deletes a table of written() that no later step reads."""
    spark = df.sparkSession
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f)
        p.getFileSystem(conf).delete(p, True)


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Batches of texts for Python of few rows: a batch and its copies are what a worker holds."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


# --- text kernels -----------------------------------------------------------------------

_rng = np.random.default_rng(20240229)
_STEPS = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_IS_WORD = np.ones(256, bool)
_IS_WORD[[32, 9, 10, 11, 12, 13]] = False

#: words are hashed by two polynomials modulo this prime; powers of two as modulus have known collisions (Thue-Morse words)
PRIME = (1 << 31) - 1
_BASES = tuple(int(b) for b in _rng.integers(1 << 20, PRIME - 1, 2))
_VALUES = [_rng.integers(1, PRIME - 1, 256, dtype=np.uint64) for _ in _BASES]
_LOWERED = [v.copy() for v in _VALUES]
for _v in _LOWERED:
    _v[65:91] = _v[97:123]
_powers: dict[tuple[int, int], np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser: a bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _fold(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME up to one more PRIME, for x under 2**63."""
    return (x & np.uint64(PRIME)) + (x >> np.uint64(31))


def _mod(x: np.ndarray) -> np.ndarray:
    x = _fold(_fold(x))
    return np.where(x >= PRIME, x - np.uint64(PRIME), x)


def _power(k: int, sign: int, n: int) -> np.ndarray:
    """Powers 0 .. n - 1 of base k, or of its inverse."""
    if len(_powers.get((k, sign), ())) < n:
        base, m = pow(_BASES[k], sign, PRIME), 1 << max(12, (n - 1).bit_length())
        out = np.ones(m, np.uint64)
        have = 1
        while have < m:
            out[have : 2 * have] = _mod(out[:have] * np.uint64(pow(base, have, PRIME)))
            have *= 2
        _powers[k, sign] = out
    return _powers[k, sign]


class Spans:
    """Hashes of stretches of bytes, all from sums over prefixes."""

    def __init__(self, d: np.ndarray, lower: bool = False):
        n = len(d)
        self.sums, self.down = [], []
        for k, values in enumerate(_LOWERED if lower else _VALUES):
            s = np.zeros(n + 1, np.uint64)
            np.cumsum(_fold(values[d] * _power(k, 1, n + 1)[:n]), out=s[1:])
            self.sums.append(s)
            self.down.append(_power(k, -1, n + 1))

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of bytes start..end: 62 bits of two polynomials and the length, mixed."""
        a, b = (_mod(_mod(s[end] - s[start]) * p[start]) for s, p in zip(self.sums, self.down))
        return mix((a << np.uint64(31) | b) * np.uint64(0x9E3779B97F4A7C15) + (end - start).astype(np.uint64))


_TABLE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_QUICK = np.uint64(0x9E3779B97F4A7C15)
_QUICK_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_quick: list[np.ndarray] = []


def byte_hash(d: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A quick hash of each piece start..end of bytes, never 0: crafted pieces can collide, so who finds a piece by it compares its bytes."""
    if not _quick or len(_quick[0]) < len(d) + 1:
        m = 1 << max(12, len(d).bit_length())
        _quick[:] = [np.full(m, b, np.uint64) for b in (_QUICK, _QUICK_INV)]
        for a in _quick:
            a[0] = 1
            np.multiply.accumulate(a, out=a)
    up, down = _quick
    h = np.zeros(len(d) + 1, np.uint64)
    np.cumsum(_TABLE[d] * up[: len(d)], out=h[1:])
    return mix((h[end] - h[start]) * down[start] + (end - start).astype(np.uint64)) | np.uint64(1)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than texts) of a string column; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    _, offs, data = column.buffers()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    off = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), off


def segments(off: np.ndarray, most: int = SEGMENT):
    """Ranges of whole texts of about `most` bytes; a longer text is alone."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Words:
    """Words of texts i..j of the buffers: hash, number of the text (from 0), first and last byte."""

    def __init__(self, data: np.ndarray, off: np.ndarray, i: int, j: int, lower: bool = False):
        lo, hi = int(off[i]), int(off[j])
        d = data[lo:hi]
        self.d, self.off, n = d, off[i : j + 1] - lo, hi - lo
        w = _IS_WORD[d]
        first = np.ones(n + 1, bool)
        first[1:n] = ~w[:-1] if n else first[1:n]
        first[self.off] = True
        self.start = np.flatnonzero(w & first[:n])
        last = np.ones(n + 1, bool)
        last[1:n] = ~w[1:] if n else last[1:n]
        last[self.off] = True
        self.end = np.flatnonzero(w & last[1:]) + 1
        self.spans, self.is_word = Spans(d, lower), w
        self.hash = self.spans.hash(self.start, self.end)
        self.of = np.searchsorted(self.off, self.start, "right") - 1
        #: index of each text's first word, one more than texts
        self.first = np.searchsorted(self.start, self.off)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each run of n words of one text, and the index of its first word."""
        m = len(self.hash) - n + 1
        if m <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.of[:m] == self.of[n - 1 :])
        g = np.zeros(m, np.uint64)
        for k in range(n):
            g += self.hash[k : m + k] * _STEPS[k]
        return mix(g[at]), at

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of bytes start..end."""
        return self.spans.hash(start, end)


def shingle_sets(x: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-word shingles of each text as (text, hash), sorted by both; texts with fewer words have the whole sequence as one, without words none."""
    g, at = x.grams(n)
    of = x.of[at]
    count = np.diff(x.first)
    few = np.flatnonzero((count > 0) & (count < n))
    if len(few):
        h = np.zeros(len(few), np.uint64)
        for k in range(n - 1):
            has = count[few] > k
            h[has] += x.hash[x.first[few[has]] + k] * _STEPS[k]
        g = np.concatenate([g, mix(h ^ np.uint64(0x5BD1E995))])
        of = np.concatenate([of, few])
    order = np.lexsort((g, of))
    g, of = g[order], of[order]
    keep = np.ones(len(g), bool)
    keep[1:] = (g[1:] != g[:-1]) | (of[1:] != of[:-1])
    return of[keep], g[keep]


def covered(at: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which of `total` words lie in a run of n words that starts at one of `at`."""
    d = np.zeros(total + 1, np.int32)
    np.add.at(d, at, 1) if len(at) < 64 else None
    if len(at) >= 64:
        d += np.bincount(at, minlength=total + 1).astype(np.int32)
    end = np.minimum(at + n, total)
    d -= np.bincount(end, minlength=total + 1).astype(np.int32)
    return np.cumsum(d[:-1]) > 0


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys are there twice or more."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    same = k[1:] == k[:-1]
    flag = np.zeros(len(keys), bool)
    flag[order[1:][same]] = True
    flag[order[:-1][same]] = True
    return flag
