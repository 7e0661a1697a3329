"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  A sentence's probability is logistic in the word stems it
holds; the document's is the noisy-or of its sentences, so one bad sentence is enough.  Only
documents carry labels; the weights are fitted through the noisy-or, and the same weights then
say which sentences are to blame.

Stems are the first 4, 5, 6 and 8 characters of lower-cased words (`STEMS`).  Which stems can
matter is counted over the training sample on the executors: those in three toxic texts at least
(`seen`) that are surely commoner in toxic texts, at most `stems` of them, the best first.  The
driver fits their weights, starting from and drawn to what each stem says beyond its shorter
ones (so a word's weights add up to its own log odds), with both classes counting the same.

Defined results: null and empty texts have no sentence with a stem and get the score of one
empty sentence; rows with equal doc_id are scored each on its own; extra columns are ignored;
without a usable label (an empty table) every score is 0.  Places of sentences are code points
of the text as it is.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

STEMS = (4, 5, 6, 8)
SENTENCE = re.compile(r"[.!?\n]+\s*")
EDGE = re.compile(r"[^\w]+|_+")


@dataclass
class Model:
    """Log-odds of a sentence: bias + weights of the stems in it (keys start with a blank)."""

    bias: float = -40.0
    weights: dict[str, float] = field(default_factory=dict)


def _lower(text: str) -> str:
    """Lower-cased, each letter at its place: one whose small form has another length stays."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _plain(text: str) -> str:
    return " " + EDGE.sub(" ", _lower(text))


def _stems(text: str) -> set[str]:
    return {" " + w[:k] for w in set(_plain(text).split()) for k in STEMS if len(w) >= k}


def training_rows(docs: DataFrame, labels: DataFrame, most: int, train) -> DataFrame:
    """Text and label of at most `most` documents of each class, by a fixed hash of doc_id."""
    lab = labels.where(F.col("toxic").isin(0, 1) & train(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = (F.xxhash64("doc_id"), "doc_id")
    some = [lab.where(F.col("toxic") == k).orderBy(*order).limit(most) for k in (0, 1)]
    return docs.select("doc_id", "text").join(F.broadcast(some[0].unionByName(some[1])), "doc_id")


def train(docs: DataFrame, labels: DataFrame, most: int = 3000, stems: int = 4000, seen: int = 3, train=lambda i: F.lit(True)) -> Model:
    """Fits on at most `most` labelled documents of each class and the `stems` best stems that `seen` toxic texts have.

    `train` says which doc_id may be learned from.
    """
    rows = training_rows(docs, labels, most, train)

    def count(batches):
        pos, neg = Counter(), Counter()
        n = [0, 0]
        for b in batches:
            for t, y in zip(b["text"], b["toxic"]):
                n[int(y)] += 1
                (pos if y else neg).update(_stems(t or ""))
        keys = ["", *{*pos, *neg}]
        yield pd.DataFrame({"stem": keys, "p": [n[1], *(pos[k] for k in keys[1:])], "q": [n[0], *(neg[k] for k in keys[1:])]})

    stats = rows.select("text", "toxic").mapInPandas(count, "stem string, p long, q long").groupBy("stem").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    total = stats.where("stem = ''").collect()
    if not total or not total[0].p:
        return Model()
    n1, n0 = total[0].p, total[0].q
    ratio = ((F.col("p") + 0.5) / (n1 + 1)) / ((F.col("q") + 0.5) / (n0 + 1))
    # surely (1.64 standard errors) twice as common in toxic texts
    sure = F.log(ratio) - 1.64 * F.sqrt(1.0 / F.greatest(F.col("p"), F.lit(1)) + 1.0 / (F.col("q") + 0.5)) >= F.log(F.lit(2.0))
    best = stats.where((F.col("stem") != "") & (F.col("p") >= seen) & sure).withColumn("r", ratio).orderBy(F.desc("r"), "stem").limit(stems).collect()
    names = [r.stem for r in best]
    if not names:
        return Model()

    def bags(batches):
        hit = Finder(dict.fromkeys(names, 0.0))
        for b in batches:
            out = []
            for i, (t, y) in enumerate(zip(b["text"], b["toxic"])):
                n, found = hit.sentences(t or "")
                out.append((int(y), n, [f"{s}:{k}" for s, ks in found.items() for k in ks]))
            yield pd.DataFrame(out, columns=["y", "n", "found"])

    bag = rows.select("text", "toxic").mapInPandas(bags, "y int, n long, found array<string>").collect()
    odds = {r.stem: float(np.log(r.r)) for r in best}
    beyond = [odds[k] - next((odds[k[:j]] for j in range(len(k) - 1, 0, -1) if k[:j] in odds), 0.0) for k in names]
    return fit([r.y for r in bag], [r.n for r in bag], [r.found for r in bag], names, beyond)


def fit(y: list[int], n: list[int], found: list[list[str]], names: list[str], prior: list[float], bias: float = -6.0, rounds: int = 600, ridge: float = 0.3) -> Model:
    """Gradient descent (Adam) on the noisy-or's log loss, both classes of equal weight; found: 'sentence:stem number'.

    ridge draws the weights to `prior`, and the bias to `bias`, as strongly as that part of a document.
    """
    y = np.array(y, float)
    bag, cell, col = [], [], []
    for i, f in enumerate(found):
        seen: dict[str, int] = {}
        for x in f:
            s, k = x.split(":")
            if s not in seen:
                seen[s] = len(bag)
                bag.append(i)
            cell.append(seen[s])
            col.append(int(k))
    bag, cell, col = np.array(bag, int), np.array(cell, int), np.array(col, int)
    plain = np.array(n, float) - np.bincount(bag, minlength=len(y))  # sentences without a stem
    weight = np.where(y > 0, max(1.0, (y == 0).sum() / max(1.0, y.sum())), 1.0)
    weight /= weight.sum()
    start = np.append(np.array(prior, float), bias)
    w, m, v = start.copy(), 0.0, 0.0
    for t in range(1, rounds + 1):
        z = w[-1] + np.bincount(cell, w[col], minlength=len(bag))
        safe = np.bincount(bag, np.logaddexp(0, z), minlength=len(y)) + plain * np.logaddexp(0, w[-1])  # -log P(clean)
        p = -np.expm1(-safe)
        g = np.where(y > 0, -(1 - p) / np.maximum(p, 1e-9), 1.0) * weight  # d loss / d safe
        gs = g[bag] / (1 + np.exp(-z))
        grad = ridge * (w - start) / len(y)
        grad[:-1] += np.bincount(col, gs[cell], minlength=len(names))
        grad[-1] += gs.sum() + (g * plain).sum() / (1 + np.exp(-w[-1]))
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        w -= 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return Model(float(w[-1]), {k: float(x) for k, x in zip(names, w) if abs(x) > 1e-3})


class Finder:
    """Finds the stems of a model in a text in one pass (Aho-Corasick)."""

    def __init__(self, weights: dict[str, float]):
        import ahocorasick

        self.auto = ahocorasick.Automaton()
        for i, k in enumerate(weights):
            self.auto.add_word(k, (i, len(k)))
        self.any = bool(weights)
        if self.any:
            self.auto.make_automaton()

    def sentences(self, text: str) -> tuple[int, dict[int, set[int]]]:
        """The number of sentences, and the stems (by number) of each sentence that has any."""
        low = _lower(text)
        flat = " " + EDGE_ONE.sub(" ", low)
        hits = list(self.auto.iter(flat)) if self.any else []
        if not hits:
            return 1 + sum(low.count(c) for c in ".!?\n"), {}
        cuts = [m.end() for m in SENTENCE.finditer(low)]
        found: dict[int, set[int]] = {}
        for end, (i, n) in hits:
            found.setdefault(bisect.bisect_right(cuts, end - n + 1), set()).add(i)
        return 1 + sum(low.count(c) for c in ".!?\n"), found


EDGE_ONE = re.compile(r"[\W_]")  # one blank for each character, so that places stay


def score(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """doc_id, score, and the sentences at or above `least`: array of (start, end, score), places in code points of the text as it is."""
    bias, weights = model.bias, model.weights
    small_batches(docs.sparkSession)

    def run(batches):
        hit, w = Finder(weights), np.array(list(weights.values()))
        base = np.logaddexp(0, bias)
        for b in batches:
            scores, spans = [], []
            for t in b["text"]:
                t = t or ""
                n, found = hit.sentences(t)
                safe, bad = max(0, n - len(found)) * base, []
                for s, ks in found.items():
                    z = bias + w[list(ks)].sum()
                    safe += np.logaddexp(0, z)
                    bad.append((s, 1 / (1 + np.exp(-z))))
                if bad := [(s, p) for s, p in sorted(bad) if p >= least]:
                    cuts = [0, *(m.end() for m in SENTENCE.finditer(_lower(t))), len(t)]
                    bad = [{"start": cuts[s], "end": cuts[s + 1], "score": float(p)} for s, p in bad]
                scores.append(float(-np.expm1(-safe)))
                spans.append(bad)
            yield pd.DataFrame({"doc_id": b["doc_id"], "score": scores, "offending": spans})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, score double, offending array<struct<start:long,end:long,score:double>>")


def keep_clean(docs: DataFrame, model: Model, most: float) -> DataFrame:
    """The rows of docs that score under `most`, with all their columns: no join, the score is taken in the scan."""
    bias, weights, names = model.bias, model.weights, docs.columns
    small_batches(docs.sparkSession)
    schema = docs.schema

    def run(batches):
        import pyarrow as pa

        hit, w = Finder(weights), np.array(list(weights.values()))
        base, at = np.logaddexp(0, bias), names.index("text")
        for b in batches:
            keep = []
            for i in range(0, b.num_rows, 256):
                for t in b.column(at).slice(i, 256).to_pylist():
                    n, found = hit.sentences(t or "")
                    safe = max(0, n - len(found)) * base + sum(np.logaddexp(0, bias + w[list(k)].sum()) for k in found.values())
                    keep.append(bool(-np.expm1(-safe) < most))
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, schema)
