"""op6 and op9: statistics against brute force, models on held-out rows."""

import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from voxelweave.llm import quality, queries, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def stats(t):
    t = t or ""
    w = WORD.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    win = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(win)
    flag = set()
    for i, x in enumerate(win):
        if n[x] > 1:
            flag.update(range(i, i + 5))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(flag)


def test_statistics(spark, docs, odd, none, sf_dir):
    text = dict(docs)
    for r in quality.statistics(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect():
        assert tuple(r[1:]) == stats(text[r.doc_id]), r
    want = sorted((str(r.doc_id), *stats(r.text)) for r in odd.collect())
    assert sorted((str(r.doc_id), *r[1:]) for r in quality.statistics(odd).collect()) == want
    assert quality.statistics(none).collect() == []


def test_rules_find_what_was_planted():
    rng = np.random.default_rng(3)
    x = {"a": rng.random(3000), "b": rng.random(3000)}
    bad = ((x["a"] > 0.8) & (x["b"] <= 0.5)) | (x["b"] > 0.97)
    rules = quality.learn(x, bad)
    found = np.zeros(3000, bool)
    for r in rules:
        found |= quality._holds(r, x, 3000)
    assert (found == bad).mean() > 0.97 and len(rules) <= 6
    assert quality.learn(x, np.zeros(3000, bool)) == []


def test_op6(spark, sf_dir):
    got = queries.op6_quality(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").collect()
    good = [r for r in got if r.quality == 1]
    bad = [r for r in got if r.quality == 0]
    assert sum(r.kept for r in good) / len(good) > 0.97
    assert sum(not r.kept for r in bad) / len(bad) > 0.6
    assert all(not r.kept for r in got if r.base_failed)


def test_op9(spark):
    """On the larger tables: most held-out toxic documents are caught, clean ones left alone; scores are the noisy-or."""
    import math

    big = "/root/testdata/sf0.1"
    got = queries.op9_toxicity(spark, big)
    rows = got.join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in rows)
    toxic, clean = [r for r in rows if r.toxic], [r for r in rows if not r.toxic]
    assert sum(r.predicted for r in toxic) >= 0.9 * len(toxic)
    assert sum(r.predicted for r in clean) <= 0.01 * len(clean)
    docs = spark.read.parquet(f"{big}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{big}/labels.parquet"), train=lambda i: queries.remainder(i) != 1)
    score = {r.doc_id: (r.score, r.held_out) for r in got.collect()}
    for r in docs.where("doc_id < 1500").collect():  # brute force, word by word
        miss = 0.0
        text = r.text or ""
        stops = [0, *(m.end() for m in re.finditer(r"[.!?\n]+\s*", text))]
        z = dict.fromkeys(range(len(stops)), 0.0)
        found: dict[int, set] = {}
        for w in re.finditer(r"[^\W_]+", text.lower()):
            s = max(k for k, at in enumerate(stops) if at <= w.start())
            found.setdefault(s, set()).update(" " + w.group()[:k] for k in toxicity.STEMS if " " + w.group()[:k] in model.weights and len(w.group()) >= k)
        n = 1 + sum(text.count(c) for c in ".!?\n")
        for s in found:
            z[s] = sum(model.weights[k] for k in found[s])
        some = [s for s in found if found[s]]
        miss = sum(math.log1p(math.exp(model.bias + z[s])) for s in some) + max(0, n - len(some)) * math.log1p(math.exp(model.bias))
        assert abs(score[r.doc_id][0] - (1 - math.exp(-miss))) < 1e-9, r.doc_id
        assert score[r.doc_id][1] == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def test_mil_and_places(spark):
    rng = np.random.default_rng(5)
    clean = ["the sky is calm", "we went home early", "rain fell on the roof", "numbers add up"]
    rows = []
    for i in range(400):
        s = [str(x) for x in rng.choice(clean, 6)]
        if i % 2:
            s[int(rng.integers(6))] = "you are vile rubbish" if i % 4 == 1 else "such nasties again"
        rows.append((i, ". ".join(s), i % 2))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(df.drop("toxic"), df.select("doc_id", "toxic"))
    got = toxicity.score(df.drop("toxic"), model).collect()
    text = {r[0]: r[1] for r in rows}
    for r in got:
        assert (r.score >= 0.7) == (r.doc_id % 2 == 1)
        bad = [text[r.doc_id][o.start : o.end] for o in r.offending]
        assert len(bad) == r.doc_id % 2 and all("vile" in b or "nasties" in b for b in bad)


def test_op9_small(spark, sf_dir):
    got = queries.op9_toxicity(spark, sf_dir)
    rows = got.join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").where("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got.collect())
    hit = sum(r.predicted == r.toxic for r in rows)
    assert hit / len(rows) > 0.93
    assert all(0 <= r.score <= 1 for r in got.collect())


def test_places_of_letters_that_grow(spark):
    """Letters whose small form is longer don't move the places."""
    model = toxicity.Model(-5.0, {" vile": 9.0})
    text = "\u0130\u0130\u0130 first. so vile here. last"
    r = toxicity.score(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    assert [text[o.start : o.end].strip() for o in r.offending] == ["so vile here."]


def test_op9_null_id(spark, tmp_path):
    """A null doc_id is scored, and isn't held out."""
    rows = [(None, "you vile"), (1, "calm"), (2, "you vile"), (3, "calm"), (4, None)] + [(10 + i, "so vile a day" if i % 2 else "a calm day") for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(10 + i, i % 2) for i in range(40)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r for r in queries.op9_toxicity(spark, str(tmp_path)).collect()}
    assert got[None].held_out is False and got[None].predicted == 1 and got[4].predicted == 0 and len(got) == len(rows)


def test_odd(spark, odd, none):
    model = toxicity.Model(-5.0, {" one": 9.0})
    got = {r.doc_id: r for r in toxicity.score(odd, model).collect()}
    assert got[3].score == got[4].score and abs(got[3].score - 1 / (1 + np.exp(5))) < 1e-9
    assert got[6].score > 0.9 and got[7].score > 0.9
    assert toxicity.score(none, model).collect() == []
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.train(odd, labels).weights == {} and quality.train(odd, labels) == []
    assert toxicity.score(odd, toxicity.train(odd, labels)).agg(F.max("score")).first()[0] < 1e-9
