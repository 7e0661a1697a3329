"""Token counts without token ids: each distinct pre-token is counted once for the corpus.

A text is cut into pre-tokens as the tokenizers library cuts it.  Each chunk of texts says which of
its texts hold which pre-token how often.  These frequencies are dealt out and sorted by pre-token, so
a pre-token's rows stand together: it is counted once and its count joins its rows, where the counts of
a separate table would have to be shuffled to the same place.  Then they are summed by document
(llm.postings).  No ids are kept: a pre-token gives the length of its encoding alone.  A pre-token with
more than postings.SALTED chunks is dealt over several tasks and counted once in each.

A chunk's texts are first cut at places where every text has a pre-token's start (tokens.cuts), and
only distinct pieces go through the library's own pre-tokenizer.  Strings of special tokens are one
token where the library has them so: a text with one is cut there, and its parts are texts of their own.
Where a vocabulary isn't a plain byte-level one, or a special string takes blanks along, whole texts
are what is counted once each.  Several keys are kept apart by their first byte, none of which is UTF-8.

Defined results: null and empty texts have 0 bytes and 0 tokens; repeated rows, rows with a null
doc_id and rows that share one are counted each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_hash, parts, segments, small_batches, text_bytes
from .exchange import TEXTS, chunks
from .postings import DOCS, encode, head, salts, summed
from .tokens import cuts

#: first byte of the keys of special tokens, of whole texts and of heads
SPECIAL, WHOLE, HEAD = b"\xfe", b"\xfd", b"\xff"
#: bytes of text and distinct pre-tokens of a chunk, bytes of text a partition of pre-tokens
CHUNK, KEYS, PART = 12 << 20, 1 << 19, 16 << 20
#: rows of a batch that goes out
ROWS = 1 << 15
_loaded: dict[str, "Pretokens"] = {}


class Pretokens:
    """Pre-tokens of texts, and how many tokens a key has."""

    #: distinct pieces that a worker keeps
    MOST = 100_000

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        known = json.loads(self.tok.to_str())
        pre, added = known["pre_tokenizer"] or {}, known["added_tokens"]
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not known["normalizer"]
        self.plain = plain and not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added)
        self.special = [t["content"] for t in added]
        self.at_special = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if added else None
        self.known: dict[bytes, tuple[bytes, ...]] = {}

    def of(self, piece: bytes) -> tuple[bytes, ...]:
        """Pre-tokens of a piece without special strings."""
        body = piece[1:] if piece[:1] == b" " else piece
        if body.isalpha() or body.isdigit():  # ASCII letters or digits after at most one blank: one pre-token
            return (piece,)
        got = self.known.get(piece)
        if got is None:
            text = piece.decode()
            got = tuple(text[a:b].encode() for _, (a, b) in self.tok.pre_tokenizer.pre_tokenize_str(text))
            if len(self.known) >= self.MOST:
                self.known.clear()
            if len(piece) <= 256:
                self.known[piece] = got
        return got

    def of_text(self, text: bytes) -> tuple[bytes, ...]:
        """Keys of a text that has special strings, or that is counted as a whole."""
        if not self.plain:
            return (WHOLE + text,) if text else ()
        out: list[bytes] = []
        for k, part in enumerate(self.at_special.split(text.decode())):
            out += (SPECIAL + part.encode(),) if k % 2 else self.of(part.encode()) if part else ()
        return tuple(out)

    def odd(self, raw: bytes, o: np.ndarray) -> np.ndarray:
        """Which of the texts from o are not cut into pieces."""
        out = np.full(len(o) - 1, not self.plain)
        for s in self.special:
            at = raw.find(t := s.encode())
            while at >= 0:
                i = int(np.searchsorted(o, at, "right")) - 1
                out[i] = out[i] or at + len(t) <= o[i + 1]
                at = raw.find(t, at + 1)
        return out

    def frequencies(self, d: np.ndarray, o: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """Keys of texts (bytes d, text k from o[k]); key, text and count of each pair, in the order of both."""
        raw = d.tobytes()
        alone = self.odd(raw, o)
        full = np.flatnonzero((np.diff(o) > 0) & ~alone)
        number: dict[bytes, int] = {}
        pre, of = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if len(full):
            s = cuts(d, o[:-1][np.diff(o) > 0])
            text = np.searchsorted(o, s, "right") - 1
            e = np.append(s[1:], len(d))
            s, e, text = (x[~alone[text]] for x in (s, e, text))
            h = byte_hash(d, s, e)
            _, first, which = np.unique(h, return_index=True, return_inverse=True)
            n = e - s
            same = n == n[first[which]]  # of one hash, but other bytes: compared, and numbered apart
            shift = np.where(same, s[first[which]] - s, 0)
            begin = np.cumsum(n) - n
            inside = np.arange(int(n.sum())) - np.repeat(begin - s, n)
            same &= np.add.reduceat(d[inside] != d[inside + np.repeat(shift, n)], begin, dtype=np.int64) == 0
            pieces = [raw[a:b] for a, b in zip(s[first].tolist(), e[first].tolist())]
            for k in np.flatnonzero(~same).tolist():
                which[k] = len(pieces)
                pieces.append(raw[s[k] : e[k]])
            keys = [[number.setdefault(t, len(number)) for t in self.of(p)] for p in pieces]
            many = np.fromiter(map(len, keys), np.int64, len(keys))
            flat = np.fromiter((x for k in keys for x in k), np.int64, int(many.sum()))
            c, start = many[which], (np.cumsum(many) - many)[which]
            pre.append(flat[np.repeat(start - (np.cumsum(c) - c), c) + np.arange(int(c.sum()))])
            of.append(np.repeat(text, c))
        for k in np.flatnonzero(alone).tolist():
            got = [number.setdefault(t, len(number)) for t in self.of_text(raw[o[k] : o[k + 1]])]
            pre.append(np.array(got, np.int64))
            of.append(np.full(len(got), k))
        pairs, count = np.unique(np.concatenate(pre) * TEXTS + np.concatenate(of), return_counts=True)
        return list(number), pairs // TEXTS, pairs % TEXTS, count

    def count(self, keys: list[bytes]) -> list[int]:
        """Tokens of each key."""
        texts = ["" if k[:1] in (SPECIAL, HEAD) else (k[1:] if k[:1] == WHOLE else k).decode() for k in keys]
        got = self.tok.encode_batch_fast(texts, add_special_tokens=False)
        return [1 if k[:1] == SPECIAL else len(e.ids) for k, e in zip(keys, got)]


def pretokens(path: str) -> Pretokens:
    """One for each worker process and vocabulary."""
    if path not in _loaded:
        _loaded[path] = Pretokens(path)
    return _loaded[path]


class _Chunk:
    """Frequencies of some thousand texts, put together of smaller parts."""

    def __init__(self):
        self.number: dict[bytes, int] = {}
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.ids, self.sizes, self.docs, self.bytes = [], [], 0, 0

    def add(self, keys: list[bytes], key: np.ndarray, doc: np.ndarray, count: np.ndarray, doc_id: pa.Array, sizes: np.ndarray) -> None:
        own = np.fromiter((self.number.setdefault(k, len(self.number)) for k in keys), np.int32, len(keys))
        self.parts.append((own[key], (self.docs + doc).astype(np.uint16), count.astype(np.int32)))
        self.ids.append(doc_id)
        self.sizes.append(sizes)
        self.docs += len(doc_id)
        self.bytes += int(sizes.sum())

    def full(self) -> bool:
        return self.docs > DOCS - TEXTS or self.bytes >= CHUNK or len(self.number) >= KEYS

    def rows(self, place: int) -> Iterator[pa.RecordBatch]:
        if not self.docs:
            return
        names = ["chunk", "key", "posting", "head"]
        key, doc, count = (np.concatenate([p[k] for p in self.parts]) for k in range(3))
        order = np.argsort(key, kind="stable")
        key, doc, count = key[order], doc[order].astype(np.int64), count[order].astype(np.int64)
        keys = pa.array(list(self.number), pa.binary())
        for a in range(0, len(keys), ROWS):
            part = keys[a : a + ROWS]
            lo, hi = np.searchsorted(key, [a, a + len(part)])
            first = np.searchsorted(key[lo:hi], np.arange(a, a + len(part)))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), place)), part, encode(doc[lo:hi], count[lo:hi], first)[0], pa.nulls(len(part), pa.binary())], names=names)
        about = head({"doc_id": pa.concat_arrays(self.ids), "n_bytes": pa.array(np.concatenate(self.sizes))})
        yield pa.RecordBatch.from_arrays([pa.array([place]), pa.array([HEAD + place.to_bytes(8, "big")], pa.binary()), pa.nulls(1, pa.binary()), pa.array([about], pa.binary())], names=names)


MARKED = "chunk long, key binary, posting binary, head binary"


def frequencies(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Postings of pre-tokens, and heads with doc_id and n_bytes, whose keys are spread."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        place, chunk = TaskContext.get().partitionId() << 32, _Chunk()
        for b in batches:
            for i, j, data, off in chunks(b):
                for p, q in segments(off[i : j + 1]):
                    o = off[i + p : i + q + 1]
                    found = pretokens(vocabulary).frequencies(data[o[0] : o[-1]], o - o[0])
                    chunk.add(*found, b["doc_id"].slice(i + p, q - p), np.diff(o))
                if chunk.full():
                    yield from chunk.rows(place)
                    place, chunk = place + 1, _Chunk()
        yield from chunk.rows(place)

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, MARKED)


def weighted(found: DataFrame, vocabulary: str) -> DataFrame:
    """Frequencies, of which a key's rows stand together in a partition, with n_tokens; each key is counted once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            keys = b["key"].to_pylist()
            new = [k for k, before in zip(keys, [last, *keys]) if k != before]
            n = dict(zip(new, pretokens(vocabulary).count(new)))
            if keys[0] == last:
                n[last] = known
            yield pa.RecordBatch.from_arrays([b["chunk"], b["posting"], b["head"], pa.array([n[k] for k in keys], pa.int64())], names=["chunk", "posting", "head", "n_tokens"])
            last, known = keys[-1], n[keys[-1]]

    return found.select("chunk", "key", "posting", "head").mapInArrow(run, "chunk long, posting binary, head binary, n_tokens long")


def count_tokens(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens of every document."""
    salt = F.pmod(F.xxhash64("chunk"), F.lit(salts(docs)))
    found = frequencies(docs, vocabulary).repartition(max(parts(docs.sparkSession), text_bytes(docs) // PART), "key", salt)
    return summed(weighted(found.sortWithinPartitions("key"), vocabulary), ["n_tokens"], "doc_id long, n_bytes long, n_tokens long")
