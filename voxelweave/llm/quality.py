"""Quality rules: text statistics and a learned decision list.

``statistics`` measures every whole text in one pass, without a shuffle.  ``learn`` grows and
prunes conjunctions of thresholds by sequential covering on labelled statistics (each rule is
grown on two thirds of what is not yet covered, by FOIL's gain, and pruned on the rest);
``verdict`` turns the ordered list into one Spark CASE expression.

Defined results: null texts count as empty (all statistics 0); repeated rows are measured each
on its own; extra columns stay; without labels the list is empty and keeps every document.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, covered, repeated, segments, small_batches, text_buffers

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def _measure(data, off, i, j, window: int) -> list[np.ndarray]:
    x = Words(data, off, i, j)
    n = j - i
    per_text = lambda flag: np.diff(np.concatenate([[0], np.cumsum(flag)])[x.off])  # noqa: E731  counts of bytes
    words = np.diff(x.first)
    chars = per_text(x.is_word & ((x.d & 0xC0) != 0x80))
    symbols = per_text(_SYMBOL[x.d])
    # lines: cut at each \n and at the texts' bounds; those with a word
    cut = np.unique(np.concatenate([np.flatnonzero(x.d == 10) + 1, x.off]))
    start, end = cut[:-1], cut[1:]
    if len(start):
        end = end - (x.d[end - 1] == 10)
        inside = np.concatenate([[0], np.cumsum(x.is_word)])
        has = inside[end] > inside[start]
        start, end = start[has], end[has]
    of = np.searchsorted(x.off, start, "right") - 1
    salt = np.uint64(0xD1342543DE82EF95)
    keys = x.span_hash(start, end) ^ (of.astype(np.uint64) * salt)
    order = np.argsort(keys, kind="stable")
    again = keys[order][1:] == keys[order][:-1]
    dup = np.bincount(of[order[1:][again]], minlength=n) if len(keys) else np.zeros(n, int)
    g, at = x.grams(window)
    twice = at[repeated(g ^ (x.of[at].astype(np.uint64) * salt))] if len(g) else at
    repeat = np.diff(np.concatenate([[0], np.cumsum(covered(twice, window, len(x.hash)))])[x.first])
    return [words, chars, symbols, dup, repeat]


def statistics(docs: DataFrame, window: int = 5, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` and the long columns STATS of every text."""
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema] + [f"{s} long" for s in STATS])

    def run(batches):
        for b in batches:
            data, off = text_buffers(b.column(len(keep)))
            found = [_measure(data, off, i, j, window) for i, j in segments(off)]
            stats = [np.concatenate([f[k] for f in found]).astype(np.int64) if found else np.zeros(0, np.int64) for k in range(len(STATS))]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(keep))), *map(pa.array, stats)], names=[*keep, *STATS])

    small_batches(docs.sparkSession)
    return docs.select(*keep, F.col("text").alias("__text")).mapInArrow(run, schema)


# --- features of the rules: ratios, so that a rule means the same for short and long texts ---


def features(n: str = "n_words") -> dict[str, Column]:
    words = F.greatest(F.col(n), F.lit(1)).cast("double")
    return {
        "words": F.col(n).cast("double"),
        "mean_chars": F.col("word_chars") / words,
        "symbols": F.col("n_symbols") / words,
        "dup_lines": F.col("n_dup_lines").cast("double"),
        "repeats": F.col("n_repeat_words") / words,
    }


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    threshold: float

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Test, ...]


def _holds(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    flag = np.ones(n, bool)
    for t in rule:
        flag &= (x[t.feature] > t.threshold) == t.above
    return flag


def learn(x: dict[str, np.ndarray], bad: np.ndarray, most_rules: int = 12, most_tests: int = 3, cuts: int = 64, precision: float = 0.9, least: int = 5, seed: int = 7) -> list[Rule]:
    """Rules for `bad`, best first: sequential covering until no rule of this precision covers `least` rows."""
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    third = np.random.default_rng(seed).random(len(bad)) < 1 / 3
    while len(rules) < most_rules and (bad & left).sum() >= least:
        grow, rule = left & ~third, ()
        flag = grow.copy()
        while len(rule) < most_tests and (bad & flag).any() and (flag & ~bad).any():
            p0, n0, best = (bad & flag).sum(), (flag & ~bad).sum(), (0.0, None)
            for name, v in x.items():
                for c in np.unique(np.quantile(v[flag], np.linspace(0, 1, cuts))):
                    above = v > c
                    for side in (True, False):
                        h = flag & (above == side)
                        p, n = (bad & h).sum(), (h & ~bad).sum()
                        if p >= least:
                            gain = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))
                            if gain > best[0] + 1e-9:
                                best = (gain, Test(name, side, float(c)))
            if best[1] is None:
                break
            rule = (*rule, best[1])
            flag &= _holds((best[1],), x, len(bad))

        def worth(r: Rule) -> float:
            h = _holds(r, x, len(bad)) & left & third
            return ((bad & h).sum() - (h & ~bad).sum()) / max(1, h.sum())

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        h = _holds(rule, x, len(bad)) & left
        if not rule or h.sum() < least or (bad & h).sum() < precision * h.sum():
            break
        rules.append(rule)
        left &= ~h
    return rules


def verdict(rules: list[Rule], feats: dict[str, Column] | None = None) -> Column:
    """True to keep: the first rule that holds drops, else the document stays."""
    feats = feats or features()
    out = None
    for rule in rules:
        cond = F.lit(True)
        for t in rule:
            cond = cond & ((feats[t.feature] > t.threshold) if t.above else (feats[t.feature] <= t.threshold))
        out = F.when(cond, False) if out is None else out.when(cond, False)
    return F.lit(True) if out is None else out.otherwise(True)


def labelled(docs: DataFrame, labels: DataFrame, most: int = 20000) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Statistics of at most `most` labelled documents (by a fixed hash of doc_id), and which are bad."""
    some = labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")
    names = list(features())
    got = statistics(rows, keep=("doc_id", "quality")).select("quality", *(c.alias(k) for k, c in features().items())).toPandas()
    return {k: got[k].to_numpy(float) for k in names}, got["quality"].to_numpy(int) == 0


def train(docs: DataFrame, labels: DataFrame, most: int = 20000) -> list[Rule]:
    x, bad = labelled(docs, labels, most)
    return learn(x, bad) if len(bad) else []
