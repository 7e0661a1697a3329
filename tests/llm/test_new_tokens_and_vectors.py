"""op11 to op13 against brute force, and their odd rows."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelweave.llm import alignment, counts, negatives, postings, queries, tokens

A, B = tokens.vocabulary_path(), tokens.vocabulary_path("piece_bpe_32k.model")
ODD_TEXTS = [
    "", None, " ", "  ", "a", "a ", "a  b  ", "\n", "\n\n a\t\tb \n", "it's we'll 'S ''re", "x<|endoftext|>y", "<|endoftext|>", "a <|endoftext|> b<|endoftext|>", "<|endoftext|", "▁a", "ünï çödé 日本語   nbsp em  two",
    "<s> a </s> <0x41> <unk>", "é ﬁ ½ ", "a\0b", "🙂🙂 z" * 3, "　x  ", "word " * 3000, "z" * 5000, "1234567 8", " lead", "tail \n ",
]


# --- op11 ---


def brute_negatives(rows, label_of, anchors=lambda i: i is not None and i % 100 == 0, k=5, m=10, low=30, high=90):
    """rows: (vec_id, embedding, label)."""
    use = []
    for i, v, lab in rows:
        lab = label_of(i, lab)
        if lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            use.append((i, lab, [int(np.floor(256 * float(np.float32(x)))) for x in v]))
    out = []
    key = lambda t: (-t[0], t[1] is None, t[1] or 0)
    for n, (i, lab, q) in enumerate(use):
        if not anchors(i):
            continue
        score = [(sum(x * y for x, y in zip(q, r)), j, other, at) for at, (j, other, r) in enumerate(use)]
        for p in sorted((t for t in score if t[2] == lab and t[3] != n), key=key)[:k]:
            window = sorted((t for t in score if t[2] != lab and low * p[0] <= 100 * t[0] <= high * p[0]), key=key)[:m]
            out += [(i, p[1], r, t[1], p[0], t[0]) for r, t in enumerate(window, 1)]
    return sorted(out, key=str)


def moved(i, lab):
    return None if lab is None else (lab + 1) % 10 if i is not None and i % 7 == 0 else lab


def mined(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("score", F.lit("clash")).withColumn("block", F.lit(None).cast("string"))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return sorted(map(tuple, negatives.mine(df, label, F.col("id") % 100 == 0).collect()), key=str)


def test_op11_odd(spark):
    """Nulls, non-finite components, shorter and empty vectors, repeated rows and ids, ties, one vector that a third of the rows have."""
    rng = np.random.default_rng(5)
    rows = [(k, [float(x) for x in rng.normal(0, 0.3, 40)], int(rng.integers(0, 3))) for k in range(0, 420)]
    rows += [(1000 + k, [0.5] * 40, k % 4) for k in range(150)]
    rows += [rows[100], rows[100], (100, [0.25] * 40, 1), (200, [1.0], 2), (300, [], 0), (300, [], 1)]
    rows += [(None, [0.5] * 40, 1), (500, None, 1), (600, [0.1] * 40, None), (700, [float("nan")] * 40, 1), (800, [None] + [0.1] * 39, 1), (900, [float("inf")] * 40, 0), (2000, [float(-x) for x in range(40)], 5)]
    got = mined(spark, rows)
    assert got == brute_negatives(rows, moved) and len(got) > 400


def test_op11_empty_and_alone(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(100, [1.0], 1)]) == []
    assert mined(spark, [(100, [1.0], 1), (101, [0.5], 2)]) == []  # no positive


def test_op11_wide_values(spark):
    """Products beyond what floating point holds exactly, up to 63 bits."""
    rows = [(k, [float(2**18 + k), float(-(2**17) + 3 * k)], k % 2) for k in range(0, 400, 25)] + [(k, [2.0**21, float(k)], k % 2) for k in range(1, 60)]
    assert mined(spark, rows) == brute_negatives(rows, moved)


def test_op11_blocks(monkeypatch):
    """Tiles of parts of the dimensions add up, and the best of a tile are in the order of score and id."""
    rng = np.random.default_rng(3)
    x, y = rng.integers(-300, 300, (7, 70)), rng.integers(-300, 300, (50, 70))
    assert (sum(negatives._product(x[:, c : c + 32], y[:, c : c + 32]) for c in (0, 32, 64)) == x @ y.T).all()
    s = rng.integers(0, 4, 300)
    assert negatives._best(s, 20).tolist() == sorted(range(300), key=lambda k: (-s[k], k))[:20]


# --- op12 ---


def library_counts(texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(A)
    return [(len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for t in texts]


def test_op12_odd(spark):
    rows = [(k if k % 4 else None, t, "clash") for k, t in enumerate(ODD_TEXTS * 2)]
    got = counts.count_tokens(spark.createDataFrame(rows, "doc_id long, text string, key string").repartition(3), A).collect()
    want = [(r[0], *c) for r, c in zip(rows, library_counts([r[1] for r in rows]))]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert counts.count_tokens(spark.createDataFrame([], "doc_id long, text string"), A).count() == 0


def test_op12(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: c for r, c in zip(rows, library_counts([r.text for r in rows]))}
    got = queries.op12_counts(spark, sf_dir).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in got} == want and len(got) == len(rows)
    assert all(r.over_limit == (r.n_tokens > 1024) for r in got)


@pytest.mark.parametrize("salted", [1, 7])
def test_op12_salts(spark, monkeypatch, salted):
    """A key's chunks dealt over salts give the same sums; each distinct pre-token is a row of what is counted."""
    monkeypatch.setattr(counts, "salts", lambda docs: salted)
    rows = [(k, f"same words again {k % 9}") for k in range(60)]
    got = counts.count_tokens(spark.createDataFrame(rows, "doc_id long, text string").repartition(11), A).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == [(r[0], *c) for r, c in zip(rows, library_counts([r[1] for r in rows]))]


def test_postings_round_trip():
    rng = np.random.default_rng(1)
    docs, n, first = np.concatenate([np.sort(rng.choice(4096, 40, False)) for _ in range(6)]), rng.integers(1, 900, 240), np.arange(0, 240, 40)
    found, many = postings.encode(docs, n, first)
    row, doc, count = postings.decode(found)
    total = Counter()
    for r, d, c in zip(row.tolist(), doc.tolist(), count.tolist()):
        total[r, d] += c
    assert total == {(k // 40, int(docs[k])): int(n[k]) for k in range(240)} and many.tolist() == [40] * 6


# --- op13 ---


def _names():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(x): x for x in own} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in own)}
    an = [bytes(back[c] for c in a.id_to_token(k)) if k < 50256 else b"" for k in range(a.get_vocab_size())]
    bn = [bytes([int(b.id_to_piece(k)[3:-1], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode() for k in range(b.vocab_size())]
    return a, b, an, bn


def brute_alignment(texts):
    """Of each text: n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; one step an event."""
    a, b, an, bn = _names()
    per, held = [], Counter()
    for t in texts:
        x, y, want = (a.encode(f" {t}", add_special_tokens=False).ids, b.encode(t), f" {t}".encode()) if t else ([], [], b"")
        if not t or any(b"".join(n[k] for k in ids) != want for n, ids in ((an, x), (bn, y))):
            per.append(None)
            continue
        ends = lambda ids, n: np.cumsum([len(n[k]) for k in ids]).tolist()
        ex, ey, i, j, groups, links, open_a, open_b = ends(x, an), ends(y, bn), 0, 0, [], [], [x[0]], [y[0]]
        while True:
            links.append((x[i], y[j]))
            step = (ex[i] <= ey[j], ey[j] <= ex[i])
            if all(step):
                groups.append(",".join(map(str, open_a)) + "|" + ",".join(map(str, open_b)))
                open_a, open_b = [], []
                if i + 1 == len(x):
                    break
            i, j = i + step[0], j + step[1]
            open_a += [x[i]] if step[0] else []
            open_b += [y[j]] if step[1] else []
        per.append((len(x), len(y), groups, links))
        held.update(set(links))
    most = defaultdict(int)
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    return [(0, 0, 0, 0, 0, 0, "") if p is None else (p[0], p[1], len(p[2]), len(p[3]), sum(held[q] == most[q[0]] for q in p[3]), sum(held[q] for q in p[3]), hashlib.sha256(";".join(p[2]).encode()).hexdigest()) for p in per]


def result(df):
    return sorted(((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.best, r.pair_docs, r.groups_sha256) for r in df.collect()), key=str)


def test_op13_odd(spark):
    rows = [(k if k % 4 else None, t, "clash") for k, t in enumerate([*ODD_TEXTS, *ODD_TEXTS])]
    got = alignment.align(spark.createDataFrame(rows, "doc_id long, text string, side string").repartition(3), A, B)
    assert result(got) == sorted(((r[0], *w) for r, w in zip(rows, brute_alignment([r[1] for r in rows]))), key=str)
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string"), A, B).count() == 0


def test_op13(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: w for r, w in zip(rows, brute_alignment([r.text for r in rows]))}
    got = queries.op13_alignment(spark, sf_dir).collect()
    assert {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got} == want and len(got) == len(rows)


def test_op13_salts(spark, monkeypatch):
    monkeypatch.setattr(alignment, "salts", lambda docs: 5)
    rows = [(k, f"Some words, and others: {k % 7}.") for k in range(40)]
    got = alignment.align(spark.createDataFrame(rows, "doc_id long, text string").repartition(9), A, B)
    assert result(got) == sorted(((r[0], *w) for r, w in zip(rows, brute_alignment([r[1] for r in rows]))), key=str)


@pytest.mark.parametrize("window", [5, 300, 1 << 19])
def test_op13_parts_of_documents(monkeypatch, window):
    """The machine gives the same with a document in many parts, and holds little more than its window."""
    import pyarrow as pa

    monkeypatch.setattr(alignment, "WINDOW", window)
    monkeypatch.setattr(alignment, "LINKS", 50)
    monkeypatch.setattr(alignment, "RUN", 7)
    texts = ["Hello wörld, it's 1234 🙂 " * 40, "z" * 3, "", "a b c " * 9]
    a, b, an, bn = _names()
    lengths = tuple(np.array([len(n) for n in names]) for names in (an, bn))
    machine, heads, keys = alignment.Sweep(lengths, (np.uint16, np.uint16), 0), [], Counter()
    rows, most = [], 0
    for doc, t in enumerate(texts):
        events = [(0, 0, np.zeros(0, np.uint16))]
        for side, (ids, n) in enumerate(((a.encode(f" {t}", add_special_tokens=False).ids, an), (b.encode(t), bn))) if t else ():
            at = 0
            for k in range(0, len(ids), 7):
                events.append((at, side, np.array(ids[k : k + 7], np.uint16)))
                at += sum(len(n[x]) for x in ids[k : k + 7])
        rows += [(doc, side, ids.tobytes(), doc) for _, side, ids in sorted(events, key=lambda e: e[:2])]
    batches = []
    for r in rows:
        batches += machine.add(*r)
        most = max(most, sum(len(x) for w in machine.open.wait for x in w))
    batches += machine.end()
    for x in batches:
        for r in x.to_pylist():
            if r["head"]:
                heads += pa.ipc.open_stream(r["head"]).read_all().to_pylist()
            else:
                row, d, c = postings.decode(pa.array([r["posting"]]))
                keys.update({(r["a"], r["b"]): int(c.sum())})
    want = brute_alignment(texts)
    assert [(h["n_a"], h["n_b"], h["n_groups"], h["n_links"], h["groups_sha256"]) for h in heads] == [(*w[:4], w[6]) for w in want]
    assert sum(keys.values()) == sum(w[3] for w in want)
    assert window > 300 or most < window + 100
