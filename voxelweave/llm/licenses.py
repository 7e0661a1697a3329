"""License scanning with MinHash over overlapping windows, with DataFrame functions only.

Templates are short notices: `TEMPLATES`, a list of one's own, or a table (license, text) of at
most `MOST` rows.  A document's windows of about a template's length (8, 12, 16, 24, 32, 48 ..
words), a quarter of it apart, are hashed to `BANDS` bands of `ROWS` MinHashes over two-word
shingles; a template and a window that agree in a band are checked: the template's shingles must
be in the words around the window to `least` (exact containment).
A region that holds 0.8 of the shingles of a template of five words or more lies in some window
whose Jaccard likeness to the template is at least 0.44 (`likeness_bound`; the worst case is
a notice as long as its window, an eighth off), so it is missed with a probability of at most
(1 - 0.44**ROWS)**BANDS = 9e-9 for 32 bands of one.

Only windows that hold one of a template's anchor words are hashed.  Anchors cover more than
1 - least of the shingles of every template (`anchors` sees to it), so a text without any of
them can't reach `least`: the filter loses nothing.

Defined results: null, empty and short texts have no match unless the words they have match;
repeated rows are scanned each on its own; extra columns are ignored; no rows, no result.
"""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BANDS, ROWS, LEAST = 32, 1, 0.8
#: templates that a scan may have: they are joined to all windows' bands, and their anchor words are one pattern
MOST = 10_000

#: fixed values: notices as their licenses publish them
TEMPLATES: list[tuple[str, str]] = [
    ("MIT line", "Released under the MIT License."),
    ("Apache-2.0 line", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0 line", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0 line", "Licensed under CC BY-NC 4.0."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
]


def words_of(text: str) -> list[str]:
    """Words of a template: lower case, split at everything but letters, digits and dots inside numbers."""
    return [w for w in re.split(r"[^a-z0-9.]+|\.(?![0-9])", text.lower()) if w]


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^a-z0-9.]+|\.(?![0-9])"), lambda w: w != "")


def anchors(templates=TEMPLATES, least: float = LEAST) -> dict[str, set[str]]:
    """For each template, its rarest-looking (longest) words that touch more than 1 - least of its shingles."""
    out = {}
    for name, text in templates:
        w = words_of(text)
        pairs = {(a, b) for a, b in zip(w, w[1:])}
        chosen: set[str] = set()
        for word in sorted(set(w), key=lambda x: (-len(x), x)):
            chosen.add(word)
            if sum(a in chosen or b in chosen for a, b in pairs) > (1 - least) * len(pairs) + 1e-9:
                break
        out[name] = chosen
    return out


def _size(n: int) -> int:
    """Window length for a template of n words: the next of 8, 12, 16, 24, 32, 48 .."""
    s = 8
    while s < n:
        if 3 * s // 2 >= n:
            return 3 * s // 2
        s *= 2
    return s


def likeness_bound(n: int, least: float = LEAST) -> float:
    """Least Jaccard likeness of a template of n words and the best window over a region that holds `least` of it."""
    w = _size(n)
    lost = max(0, math.ceil((w / 4 - (w - n)) / 2))  # words that lie outside, windows being a quarter apart
    shared = max(0, math.ceil(least * (n - 1) - 1e-9) - lost)
    return shared / max(1, n - 1 + w - 1 - shared)


def shingles(w: Column) -> Column:
    """Distinct hashes of two-word shingles of an array of words."""
    pairs = F.zip_with(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.xxhash64(a, b))
    return F.array_distinct(F.when(F.size(w) > 1, pairs).otherwise(F.expr("array()").cast("array<long>")))


def bands(s: Column) -> Column:
    """array<long>: one key a band, from the least of ROWS hashes each of the shingles."""
    least = lambda k: F.array_min(F.transform(s, lambda h: F.xxhash64(h, F.lit(k))))
    return F.array(*(F.xxhash64(F.lit(b), *(least(b * ROWS + r) for r in range(ROWS))) for b in range(BANDS)))


def _table(docs: DataFrame, templates) -> tuple[list[tuple[str, str]], DataFrame]:
    """The templates as a list and as a table (license, size, w)."""
    if isinstance(templates, DataFrame):
        rows = [(r.license, r.text) for r in templates.select("license", "text").where("text is not null").limit(MOST + 1).collect()]
    else:
        rows = list(templates)
    if len(rows) > MOST:
        raise ValueError(f"more than {MOST} templates")
    rows = [(n, x) for n, x in rows if len(words_of(x)) > 1]
    listed = json.dumps([{"license": n, "size": _size(len(words_of(x))), "w": words_of(x)} for n, x in rows])
    t = docs.sparkSession.range(1).select(F.inline(F.from_json(F.lit(listed), "array<struct<license:string,size:int,w:array<string>>>")))
    return rows, t


def scan(docs: DataFrame, templates=TEMPLATES, least: float = LEAST) -> DataFrame:
    """doc_id, license, containment, start, n_words (of the best region) and places of each template found in each row.

    places counts the regions that don't overlap in which the template was verified.
    """
    listed, t = _table(docs, templates)
    chosen = anchors(listed, least)
    every = sorted(set().union(*chosen.values()))
    rx = r"(?i)(?<![a-z0-9])(?:" + "|".join(map(re.escape, every)) + r")(?![a-z0-9])"
    sizes = sorted({_size(len(words_of(x))) for _, x in listed})
    t = t.select("license", "size", shingles(F.col("w")).alias("want"))
    keys = t.select("license", "size", "want", F.posexplode(bands(F.col("want"))).alias("band", "key"))
    base = docs.select("doc_id", "text").where(F.col("text").rlike(rx) if every else F.lit(False))
    base = base.select("doc_id", F.xxhash64("text").alias("row"), F.monotonically_increasing_id().alias("copy"), words(F.col("text")).alias("w"))
    at = F.filter(F.sequence(F.lit(1), F.size("w")), lambda i: F.element_at(F.col("w"), i).isin(every))
    base = base.where(F.size("w") > 0).withColumn("at", at).where(F.size("at") > 0)

    def starts(size: int) -> Column:
        step = size // 4
        from_ = F.transform(F.col("at"), lambda i: F.transform(F.sequence(F.greatest(F.lit(0), F.ceil((i - size) / F.lit(step))).cast("int"), F.floor((i - 1) / F.lit(step)).cast("int")), lambda k: F.struct(F.lit(size).alias("size"), (k * step + 1).cast("int").alias("start"))))
        return F.array_distinct(F.flatten(from_))

    none = F.expr("cast(array() as array<struct<size:int,start:int>>)")
    windows = base.withColumn("x", F.explode(F.concat(none, *map(starts, sizes)))).select("doc_id", "row", "copy", "w", F.col("x.size").alias("size"), F.col("x.start").alias("start"))
    windows = windows.withColumn("s", shingles(F.slice("w", F.col("start"), F.col("size")))).where(F.size("s") > 0)
    lo = F.greatest(F.lit(1), F.col("start") - F.col("size"))
    around = F.slice(F.col("w"), lo, F.col("start") + 2 * F.col("size") - lo)
    windows = windows.withColumn("b", bands(F.col("s"))).withColumn("region", shingles(around)).withColumn("lo", lo).withColumn("len", F.size(around)).drop("w", "s")
    # the keys are at most MOST templates' bands, so they are broadcast
    hits = windows.select("doc_id", "row", "copy", "size", "region", "lo", "len", F.posexplode("b").alias("band", "key")).join(F.broadcast(keys), ["size", "band", "key"])
    share = F.size(F.array_intersect("want", "region")) / F.size("want")
    found = hits.dropDuplicates(["doc_id", "row", "copy", "license", "lo", "size"]).withColumn("containment", share).where(F.col("containment") >= least)
    best = found.groupBy("doc_id", "row", "copy", "license").agg(F.max(F.struct("containment", (-F.col("lo")).alias("lo"), "len")).alias("m"), F.collect_set(F.struct("lo", "len")).alias("all"))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    end = lambda x: x["lo"] + x["len"]
    places = F.aggregate(F.array_sort("all"), start, lambda a, x: F.struct((a["n"] + F.when(x["lo"] >= a["end"], 1).otherwise(0)).alias("n"), F.greatest(a["end"], end(x)).alias("end")))
    return best.select("doc_id", "license", "m.containment", (-F.col("m.lo") - 1).cast("long").alias("start"), F.col("m.len").cast("long").alias("n_words"), places["n"].cast("long").alias("places"))
