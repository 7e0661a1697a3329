"""The pipeline against a brute-force version of its stages."""

import re
from collections import Counter, defaultdict

import corpus_pipeline
from test_duplicates import components
from test_sampling_and_tokens import library

from voxelweave.llm import mixing, secrets, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_pipeline(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    steps = [{r.doc_id: r for r in docs.collect()}]
    rows = []
    df = docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, df, sf_dir).write.parquet(f"{tmp_path}/{name}")
        df = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "pack":
            assert df.columns == docs.columns
        rows.append(df.collect())
    # toxicity: what goes is what the model's scores say, and nearly what the labels say
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scores = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert {r.doc_id for r in rows[0]} == {i for i, s in scores.items() if s < 0.7}
    kept = {r.doc_id for r in rows[0]}
    clean = [i for i, t in toxic.items() if not t]
    assert sum(i in kept for i in clean) >= 0.98 * len(clean)
    # near duplicates: the least of each component
    want = {c for _, n, c in components([(r.doc_id, r.text) for r in rows[0]], 5, 80)}
    assert sorted(r.doc_id for r in rows[1]) == sorted(want)
    # secrets: no planted token is left, other texts are as they were
    before = {r.doc_id: r for r in rows[1]}
    assert {r.doc_id for r in rows[2]} == set(before)
    forest = secrets.train(spark)
    bad = {r.doc_id for r in secrets.scan(spark.read.parquet(f"{tmp_path}/near_duplicates"), forest).collect() if r.is_secret}
    for r in rows[2]:
        assert not re.search(r'token = "[0-9a-f]{40}"', r.text) and r.n_chars == len(r.text)
        assert (r.text != before[r.doc_id].text) == (r.doc_id in bad)
    # mix: whole copies, as mix() says
    copies = {r.doc_id: r.copies for r in mixing.mix(spark.read.parquet(f"{tmp_path}/secrets"), mixing.by_weight).collect()}
    assert Counter(r.doc_id for r in rows[3]) == Counter({i: c for i, c in copies.items() if c})
    # pack: every copy's tokens, gapless sequences
    length = {r.doc_id: len(x) + 1 for r, x in zip(rows[2], library([r.text for r in rows[2]]))}
    got, seq = Counter(), defaultdict(list)
    for r in rows[4]:
        got[r.doc_id] += r.length
        seq[r.sequence_id].append((r.offset, r.length))
    assert got == Counter({i: length[i] * c for i, c in copies.items() if c})
    for s in seq.values():
        s.sort()
        assert s[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(s, s[1:])) and s[-1][0] + s[-1][1] <= 2048


def test_stages_odd(spark, odd, none, sf_dir, tmp_path):
    """Nulls, repeated rows, clashing names and empty tables go through every stage."""
    for k, first in enumerate((odd, none)):
        df = first
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, df, sf_dir).write.parquet(f"{tmp_path}/{k}{name}")
            df = spark.read.parquet(f"{tmp_path}/{k}{name}")
            if name in ("toxicity", "secrets"):
                assert df.count() == (spark.read.parquet(f"{tmp_path}/{k}near_duplicates") if name == "secrets" else first).count()
        assert (df.count() > 0) == (k == 0)
