"""Homomorphic multiset fingerprints of documents, with DataFrame functions only.

A document is a multiset of paragraphs: what lies between line ends and stops, trimmed, in pieces
of at most ``LONGEST`` characters.  Each paragraph is hashed to a wide vector: ``WIDE`` lanes of
62 bits, and a one in one of ``SKETCH`` counters, of which four share a lane.  A document's
fingerprint is the sum of its paragraphs' vectors, lane by lane, modulo 2**62.  So it does not
depend on order, and a paragraph is inserted or deleted by adding or subtracting its vector
(`add`, `subtract`).  Equality of all lanes is equality of multisets.  The counters' inner
product, less what chance meetings add to it, estimates how many paragraphs two documents share:
`likeness`, 0 to 1, within about 1 / sqrt(SKETCH).

Defined results: null texts are empty; an empty text has the zero fingerprint, whose likeness
to itself is 1 and to any other 0; repeated rows have equal fingerprints and follow each other;
rows with equal doc_id are in the order of a hash of their texts; a null doc_id sorts last; a
counter over 32,767 (more equal paragraphs than that) spoils the likeness, not the equality;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

LANES, BITS, WIDE, LONGEST = 64, 15, 4, 80
SKETCH = 4 * LANES
MASK = (1 << 62) - 1
PARAGRAPH = rf"[^\n.!?]{{1,{LONGEST}}}+[.!?]*+|[.!?]++"


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PARAGRAPH), F.lit(0)), lambda p: F.trim(p)), lambda p: p != "")


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds `out`, array<long> of LANES + WIDE lanes."""
    h = f"__{out}"
    df = df.withColumn(h, paragraphs(F.col(text)))
    df = df.withColumn(h, F.transform(h, lambda p: F.struct(F.xxhash64(p).alias("a"), *(F.xxhash64(p, F.lit(k)).bitwiseAND(MASK).alias(f"w{k}") for k in range(WIDE)))))
    one = f"shiftleft(1L, CAST({BITS} * (shiftright(x.a, 6) & 3L) AS INT))"
    counters = f"transform(sequence(0L, {LANES - 1}L), i -> aggregate(filter({h}, x -> (x.a & {LANES - 1}L) = i), 0L, (s, x) -> (s + {one}) & {MASK}L))"
    wide = ", ".join(f"aggregate({h}, 0L, (s, x) -> (s + x.w{k}) & {MASK}L)" for k in range(WIDE))
    return df.withColumn(out, F.expr(f"concat({counters}, array({wide}))")).drop(h)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: (x + y).bitwiseAND(MASK))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: (x - y).bitwiseAND(MASK))


def text_of(fp: Column) -> Column:
    """Hex, 16 digits a lane."""
    return F.concat_ws("", F.transform(fp, lambda x: F.lpad(F.hex(x), 16, "0")))


def _counters(fp: Column) -> Column:
    lane = lambda x, j: F.shiftright(x, BITS * j).bitwiseAND((1 << BITS) - 1 if j < 3 else (1 << (62 - 3 * BITS)) - 1).cast("double")
    return F.flatten(F.transform(F.slice(fp, 1, LANES), lambda x: F.array(*(lane(x, j) for j in range(4)))))


def likeness(a: Column, b: Column) -> Column:
    """Share of paragraphs in common, by the counters; exactly 1 for equal fingerprints."""
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda p, x: p + x)
    x, y = _counters(a), _counters(b)
    shared = lambda u, v: total(F.zip_with(u, v, lambda p, q: p * q)) - total(u) * total(v) / SKETCH
    most = F.greatest(shared(x, x), shared(y, y))
    return F.when(a == b, 1.0).when(most <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), shared(x, y) / most)))


def _cuts(rows: DataFrame, key: Column, k: int) -> Counter:
    """The least key and about k - 1 quantiles of it, with how often each came out."""
    lo, q = rows.agg(F.min(key), F.percentile_approx(key, [i / k for i in range(1, k)] or [0.5], 10_000)).first()
    return Counter() if lo is None else Counter([lo, *(q if k > 1 else [])])


def _bucket(key: Column, cuts: Counter, last: int, share: int) -> tuple[Column, Column, dict[int, int]]:
    """Number of the stretch between cuts that a key is in, its place in that stretch in [0, 1), and the hot keys: those that make up stretches alone."""
    at = sorted(cuts)
    edges = F.array(*(F.lit(int(c)).cast("long") for c in [*at, last]))
    q = F.greatest(F.lit(1), F.size(F.filter(F.slice(edges, 1, len(at)), lambda c: c <= key)))
    low, high = F.element_at(edges, q).cast("double"), F.element_at(edges, q + 1).cast("double")
    inside = F.least(F.lit(1.0 - 2.0**-40), F.greatest(F.lit(0.0), (key.cast("double") - low) / F.greatest(high - low, F.lit(1.0))))
    return q.cast("long"), inside, {c: m * share for c, m in cuts.items() if m > 1}


def buckets(docs: DataFrame, rows: int = 5_000, most: int = 256) -> Column:
    """Bucket number of a row (doc_id, hash, place), rising in this order, of about `rows` rows.

    Quantiles of doc_id, each split evenly; a doc_id that holds a quantile alone, and null, is split by quantiles
    of the hash of its texts, and a text that holds one of these alone by its rows' places.
    """
    n, nulls, hi, top = docs.agg(F.count("*"), F.count_if(F.col("doc_id").isNull()), F.max("doc_id"), F.max("hash")).first()
    k = min(most, max(1, -(-n // rows)))
    sub = max(1, -(-n // (k * rows)))
    known = docs.where("doc_id is not null")
    q, inside, hot = _bucket(F.col("doc_id"), _cuts(known, F.col("doc_id"), k) or Counter([0]), hi if hi is not None else 1, 1)
    number = F.struct(q.alias("a"), F.floor(inside * sub).cast("long").alias("b"), F.lit(0).cast("long").alias("c"))
    if nulls > rows:
        hot[None] = max(2, nulls * k // n)
    for i, m in sorted(hot.items(), key=str):
        is_ = F.col("doc_id").isNull() if i is None else F.col("doc_id") == F.lit(i)
        p, within, same = _bucket(F.col("hash"), _cuts(docs.where(is_), F.col("hash"), min(most, m * sub)), top, sub)
        spread = F.lit(0).cast("long")
        for text, t in same.items():
            spread = F.when(F.col("hash") == F.lit(text), F.pmod(F.col("place"), F.lit(t * sub))).otherwise(spread)
        first = F.lit(most + 2).cast("long") if i is None else q
        # a hot doc_id begins its stretch, so its buckets come before the others of the stretch
        number = F.when(is_, F.struct(first.alias("a"), (p - (1 << 20)).alias("b"), spread.alias("c"))).otherwise(number)
    if None not in hot:
        number = F.when(F.col("doc_id").isNull(), F.struct(F.lit(most + 2).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("c"))).otherwise(number)
    return number


def with_next(docs: DataFrame, cols: list[str], rows: int = 5_000, derive=lambda df: df) -> DataFrame:
    """Adds `next`, a struct of `cols` of the next row in ascending (doc_id, hash of the text), the first after the last.

    derive: makes what `cols` names of rows of docs; only once a row, and for the heads below.  Rows are ordered within buckets;
    the last of a bucket takes the first of the next bucket, which comes from a table of one row a bucket.  Joins are on the
    bucket, by which rows are dealt anyway, so nothing is broadcast but what Spark finds small.
    """
    keyed = docs.withColumn("hash", F.xxhash64("text")).withColumn("place", F.monotonically_increasing_id())
    placed = keyed.withColumn("bucket", buckets(keyed.select("doc_id", "hash", "place"), rows))
    rank = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "hash")
    first = written(placed.groupBy("bucket").agg(F.min(rank).alias("first")), "firsts")
    order = W.orderBy("bucket")  # one row a bucket
    follow = first.select("bucket", F.coalesce(F.lead("bucket").over(order), F.min("bucket").over(W.partitionBy())).alias("to"))
    same = (F.col("p.bucket") == F.col("f.bucket")) & (F.col("p.hash") == F.col("f.first.hash")) & F.col("p.doc_id").eqNullSafe(F.col("f.first.doc_id"))
    heads = placed.alias("p").join(first.alias("f"), same, "left_semi").groupBy("bucket").agg(*(F.first(c).alias(c) for c in docs.columns))  # rows of one rank are equal
    heads = derive(heads).select("bucket", F.struct(*cols).alias("head"))
    heads = written(follow.join(heads.withColumnRenamed("bucket", "to"), "to").select("bucket", "head"), "heads")
    w = W.partitionBy("bucket").orderBy(F.col("doc_id").asc_nulls_last(), "hash", "text", "place")
    inner = derive(placed).withColumn("lead", F.lead(F.struct(*cols)).over(w))
    return inner.join(heads, "bucket").withColumn("next", F.coalesce("lead", "head")).drop("lead", "head", "bucket", "hash", "place")


def edited_text(text: Column, n: Column, other: Column) -> Column:
    """The last half (rounded down) of the text's code points replaced by the first as many of `other`."""
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n.cast("int") - half), F.substring(other, F.lit(1), half))


def compare(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness; see the module."""
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    got = with_next(base, ["text", "fp"], derive=lambda df: with_fingerprint(df, "text", "fp"))
    got = got.withColumn("n_chars", F.length("text").cast("long")).withColumn("edited", edited_text(F.col("text"), F.col("n_chars"), F.col("next.text"))).withColumn("next", F.col("next.fp")).drop("text")
    got = with_fingerprint(got, "edited", "fp_edited")
    return got.select("doc_id", "n_chars", "edited", "fp", "fp_edited", likeness(F.col("fp"), F.col("fp_edited")).alias("near_edited"), likeness(F.col("fp"), F.col("next")).alias("near_next"))
