"""Secret scanning with a random forest, with DataFrame functions only.

Candidates (`CANDIDATE`) are assignments to secret-like names, long runs of key characters
with a digit, and private keys: whole values and runs of any length, and a key from its BEGIN
to its END line (without an END, the BEGIN line and the lines of base64 below it).  A private
key is scored by its BEGIN line.  A forest over the candidate's length, character
classes and transitions, dictionary coverage, the document's path and the neighbouring words
removes false positives.  It is fitted on labelled findings (`findings`, made by rule for
known key formats and their usual look-alikes, or a table of one's own with the same columns)
on the driver, and applied as one Spark expression within each row: no shuffle, no Python.

Defined results: null and empty texts have no candidates and stay as they are, and so does every
character outside of secrets; repeated rows are scanned each on its own; extra columns stay; an
empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NAMES = "password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth[_-]?key"
HEADER = "-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"
#: between lines, also where a string literal holds them
BREAK = r"(?:\s|\\[nr])++"
#: possessive, so that a text of any length is read in one pass and without recursion
BLOCK = (
    rf"{HEADER}(?:(?:[^-]++|-(?!----))*+-{{5,}}+END [A-Z ]{{0,30}}PRIVATE KEY-----"
    rf"|(?:{BREAK}[A-Za-z-]{{1,30}}: [^\r\n\\]*+)*+(?:{BREAK}[A-Za-z0-9+/]{{24,}}+={{0,2}})++(?:{BREAK}[A-Za-z0-9+/]{{1,23}}+={{0,2}}(?=\s*+\z))?+)?+"
)
CANDIDATE = (
    rf"(?i:(?:{NAMES})[\"']?\s{{0,2}}[:=]\s{{0,2}}[\"']?)(?:{BLOCK}|[^\s\"',;]{{6,}}+)"
    r"|(?<![A-Za-z0-9_/+-])(?=[A-Za-z_/+-]*+[0-9])[A-Za-z0-9_/+-]{16,}+={0,2}"
    rf"|{BLOCK}"
)
ASSIGNED = rf"^(?i:(?:{NAMES})[\"']?\s{{0,2}}[:=]\s{{0,2}}[\"']?)"
#: fixed values: words that keys rarely hold and identifiers often do
DICTIONARY = "about access account action admin align block build button cache change check class client color commit common config content count create data date default document download element error event example field file filter form format function group handler header html image index input item label language layout level library license link list local login main manager media menu message method model module name node number object option order output page param parent path placeholder plugin policy post product profile project public query report request response result route sample schema script search server service session setting source start state status storage string style system table target task template test text theme time title token type update upload user value version view widget window worker your"
AROUND = 48

FEATURES = ("length", "transitions", "distinct", "digits", "uppers", "lowers", "hexish", "coverage", "assigned", "header", "known_prefix", "separators", "test_path", "code_path", "secret_near", "digest_near", "sample_near", "longest_run")


def features(cand: Column, left: Column, right: Column, path: Column) -> Column:
    """array<double> in the order of FEATURES."""
    v = F.regexp_replace(F.regexp_replace(cand, ASSIGNED, ""), rf"(?s)^({HEADER}).*+", "$1")
    n = F.greatest(F.length(v), F.lit(1)).cast("double")
    drop = lambda p: (n - F.length(F.regexp_replace(v, p, ""))) / n
    kinds = v
    for p, c in (("[a-z]+", "a"), ("[A-Z]+", "A"), ("[0-9]+", "0"), ("[^aA0]+", "-")):
        kinds = F.regexp_replace(kinds, p, c)
    words = "|".join(sorted(DICTIONARY.split(), key=lambda w: (-len(w), w)))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    before, around = F.lower(left), F.lower(F.concat(left, F.lit(" "), right))
    return F.array(
        F.length(v).cast("double"),
        F.length(kinds).cast("double") / n,
        F.size(F.array_distinct(F.split(v, ""))).cast("double"),
        drop("[0-9]"), drop("[A-Z]"), drop("[a-z]"), drop("[0-9a-f]"),
        1.0 - F.length(F.regexp_replace(F.lower(v), words, "")) / n,
        flag(cand.rlike(ASSIGNED)),
        flag(v.startswith("-----BEGIN")),
        flag(v.rlike(r"^(?:AKIA|ASIA|gh[pousr]_|xox[abpr]-|sk_live_|sk-|AIza|glpat-|eyJ)")),
        drop("[_/+.-]"),
        flag(F.lower(path).rlike(r"test|spec|fixture|example|sample|mock|docs?/")),
        flag(F.lower(path).rlike(r"\.(?:py|js|ts|java|go|rb|env|ya?ml|json|ini|cfg|conf|properties|tf)$")),
        flag(before.rlike(r"(?:pass|secret|token|key|auth|credential|bearer|login)\W{0,4}\w{0,12}\W{0,4}$")),
        flag(before.rlike(r"(?:sha1|sha256|sha|md5|commit|hash|checksum|digest|uuid|guid|revision|rev|etag|integrity|id|href|src|url|https?)\W{0,4}$")),
        flag(around.rlike(r"example|sample|placeholder|dummy|fake|changeme|redacted|your[_ -]")),
        F.length(F.regexp_extract(v, r"(?<![A-Za-z0-9])[A-Za-z0-9]++$", 0)).cast("double"),
    )


# --- the forest -------------------------------------------------------------------------


@dataclass
class Tree:
    feature: int = -1
    threshold: float = 0.0
    left: "Tree | None" = None
    right: "Tree | None" = None
    share: float = 0.0  # of positives, in a leaf


def _grow(x: np.ndarray, y: np.ndarray, depth: int, least: int, rng, tries: int) -> Tree:
    share = float(y.mean())
    if depth == 0 or len(y) < 2 * least or share in (0.0, 1.0):
        return Tree(share=share)
    best = (share * (1 - share) * len(y) - 1e-9, None, 0.0)
    for k in rng.permutation(x.shape[1])[:tries]:
        order = np.argsort(x[:, k], kind="stable")
        v, c = x[order, k], np.cumsum(y[order])
        at = np.flatnonzero(v[1:] > v[:-1]) + 1
        at = at[(at >= least) & (at <= len(y) - least)]
        if len(at):
            p, q = c[at - 1] / at, (c[-1] - c[at - 1]) / (len(y) - at)
            cost = at * p * (1 - p) + (len(y) - at) * q * (1 - q)
            i = int(np.argmin(cost))
            if cost[i] < best[0]:
                best = (float(cost[i]), int(k), float((v[at[i] - 1] + v[at[i]]) / 2))
    if best[1] is None:
        return Tree(share=share)
    go = x[:, best[1]] <= best[2]
    return Tree(best[1], best[2], _grow(x[go], y[go], depth - 1, least, rng, tries), _grow(x[~go], y[~go], depth - 1, least, rng, tries), share)


def fit(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 7, least: int = 3, seed: int = 11) -> list[Tree]:
    """Bootstrap samples, random features at each split."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(trees):
        i = rng.integers(0, len(y), len(y))
        out.append(_grow(x[i], y[i].astype(float), depth, least, rng, max(1, round(x.shape[1] ** 0.5) + 2)))
    return out


def predict(forest: list[Tree], row: np.ndarray) -> float:
    """The same in plain Python, for tests."""
    total = 0.0
    for t in forest:
        while t.feature >= 0:
            t = t.left if row[t.feature] <= t.threshold else t.right
        total += t.share
    return total / len(forest)


def expression(forest: list[Tree], feats: Column) -> Column:
    """Mean share of positives over the trees: nested conditions on the feature array."""

    def of(t: Tree) -> Column:
        return F.lit(t.share) if t.feature < 0 else F.when(feats[t.feature] <= t.threshold, of(t.left)).otherwise(of(t.right))

    total = of(forest[0])
    for t in forest[1:]:
        total = total + of(t)
    return total / float(len(forest))


# --- labelled findings ------------------------------------------------------------------


def findings(spark: SparkSession, n: int = 6000) -> DataFrame:
    """cand, left, right, path, label: a fixed mixture of key formats (1) and look-alikes (0), made from hashes of a row number."""
    a, b = F.sha2(F.concat(F.lit("a"), F.col("id").cast("string")), 256), F.sha2(F.concat(F.lit("b"), F.col("id").cast("string")), 256)
    upper = F.translate(F.upper(a), "ABCDEF01", "QWZKXMJT")
    b64 = F.translate(F.base64(F.unhex(a)), "=", "")
    words = F.split(F.lit(DICTIONARY), " ")
    word = lambda k: F.element_at(words, (F.pmod(F.xxhash64("id", F.lit(k)), F.size(words)) + 1).cast("int"))
    cut = lambda c, lo, hi: F.substring(c, F.lit(1), (F.lit(lo) + F.pmod(F.xxhash64("id", F.lit(99)), F.lit(hi - lo + 1))).cast("int"))
    uuid = F.concat_ws("-", F.substring(a, 1, 8), F.substring(a, 9, 4), F.substring(a, 13, 4), F.substring(a, 17, 4), F.substring(a, 21, 12))
    L = F.lit
    kinds = [
        (F.concat(L('token = "'), F.substring(a, 1, 40)), L("the "), L('" and'), 1),
        (F.concat(L("password="), cut(a, 8, 24)), L("with "), L(" then"), 1),
        (F.concat(L("password: "), cut(b64, 10, 28)), L("login "), L("\n"), 1),
        (F.concat(L("AKIA"), F.substring(upper, 1, 16)), L("of the "), L(" or"), 1),
        (F.concat(L("ghp_"), F.substring(b64, 1, 36)), L("use "), L("\n"), 1),
        (F.concat(L("api_key='"), cut(b64, 20, 40)), L(""), L("'"), 1),
        (F.concat(L("sk_live_"), F.substring(b64, 1, 24)), L("key "), L(" "), 1),
        (F.substring(b64, 1, 40), L("aws secret access key "), L("\n"), 1),
        (F.concat(L("eyJ"), b64), L("authorization bearer "), L("\n"), 1),
        (L("-----BEGIN RSA PRIVATE KEY-----"), L("\n"), L("\n"), 1),
        (cut(a, 32, 40), L("secret "), L(" "), 1),
        (F.substring(a, 1, 40), L("commit "), L("\n"), 0),
        (a, L("sha256: "), L("\n"), 0),
        (F.substring(a, 1, 32), L("md5 checksum "), L(" "), 0),
        (uuid, L("uuid "), L(" "), 0),
        (uuid, L("request id: "), L(" "), 0),
        (F.concat_ws("_", word(1), word(2), word(3), F.substring(F.regexp_replace(a, "[a-f]", ""), 1, 2)), L("the "), L(" "), 0),
        (F.concat_ws("-", word(1), word(2), word(3), L("2024")), L("in "), L(" "), 0),
        (F.concat_ws("/", word(1), word(2), word(3), F.concat(word(4), L("1"))), L("https://"), L(" "), 0),
        (F.concat(L("password="), word(1), L("123")), L("example "), L(" "), 0),
        (F.concat(L("token="), L("your_"), word(1), L("_here")), L("set "), L(" "), 0),
        (F.concat(L("api_key=xxxxxxxxxxxx"), F.pmod(F.col("id"), L(10)).cast("string")), L("sample "), L(" "), 0),
        (F.substring(F.regexp_replace(F.concat(a, b), "[a-f]", ""), 1, 18), L("number "), L(" "), 0),
        (F.concat(L("token: "), word(1), L("_"), word(2)), L("a "), L(" "), 0),
        (F.concat(L("2024-01-"), F.substring(F.regexp_replace(a, "[a-f]", ""), 1, 2), L("-12-30-45-6789")), L("on "), L(" "), 0),
        (F.substring(F.concat(a, b), L(1), F.element_at(F.array(*map(L, (32, 40, 56, 64, 96, 128))), (F.pmod(F.xxhash64("id", L(7)), L(6)) + 1).cast("int"))), F.concat(word(1), L(" ")), L(" "), 0),
        (F.substring(F.concat(a, b), L(1), F.element_at(F.array(*map(L, (32, 40, 56, 64, 96, 128))), (F.pmod(F.xxhash64("id", L(8)), L(6)) + 1).cast("int"))), L("digest="), L("\n"), 0),
        (F.concat(L("AKIA"), L("EXAMPLEEXAMPLE"), F.pmod(F.col("id"), L(90)).cast("string")), L("for example "), L(" "), 0),
    ]
    kind = F.pmod(F.col("id"), F.lit(len(kinds)))
    pick = lambda j: F.coalesce(*(F.when(kind == i, k[j] if j < 3 else F.lit(k[3])) for i, k in enumerate(kinds)))
    paths = F.array(*map(F.lit, ["src0", "src7", "web", "app/config.py", "deploy/settings.yaml", "tests/test_login.py", "docs/usage.md", ""]))
    path = F.element_at(paths, (F.pmod(F.xxhash64("id", F.lit(5)), F.size(paths)) + 1).cast("int"))
    return spark.range(n).select(pick(0).alias("cand"), pick(1).alias("left"), pick(2).alias("right"), path.alias("path"), pick(3).alias("label"))


def train(spark: SparkSession, labelled: DataFrame | None = None, most: int = 20_000) -> list[Tree]:
    """Fits on at most `most` labelled findings."""
    rows = (labelled if labelled is not None else findings(spark)).orderBy(F.xxhash64("cand", "left")).limit(most)
    got = rows.select(features(F.col("cand"), F.col("left"), F.col("right"), F.col("path")).alias("x"), "label").collect()
    return fit(np.array([r.x for r in got]), np.array([r.label for r in got]))


# --- scan -------------------------------------------------------------------------------


def _with_scored(docs: DataFrame, forest: list[Tree], path: str, free: str) -> DataFrame:
    """Adds `free`: null where a text has no candidate, else (pieces, found); found: (at, start, cand, score), at counts pieces from 0."""
    p, s, g = f"{free}_p", f"{free}_s", f"{free}_g"
    has = F.col("text").rlike(CANDIDATE)
    df = docs.withColumn(g, F.when(has, F.split("text", CANDIDATE, -1))).withColumn(s, F.when(has, F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0))))
    # what lies between candidates, and they: gap, candidate, gap, .. gap
    df = df.withColumn(p, F.expr(f"concat(flatten(zip_with(slice({g}, 1, size({s})), {s}, (a, b) -> array(a, b))), slice({g}, -1, 1))")).drop(g)
    where = F.coalesce(F.col(path).cast("string"), F.lit("")) if path in docs.columns else F.lit("")
    ends = F.expr(f"aggregate({p}, array(0), (a, x) -> concat(a, array(element_at(a, -1) + length(x))))")
    df = df.withColumn(s, ends)

    def one(i: Column) -> Column:
        at = lambda k: F.element_at(F.col(p), k)
        return F.struct((i - 1).alias("at"), F.element_at(F.col(s), i).alias("start"), at(i).alias("cand"), features(at(i), F.right(at(i - 1), F.lit(AROUND)), F.left(at(i + 1), F.lit(AROUND)), where).alias("x"))

    found = F.when(F.size(p) > 2, F.transform(F.sequence(F.lit(2), F.size(p) - 1, F.lit(2)), one))
    df = df.withColumn(s, found)
    return df.withColumn(s, F.transform(s, lambda c: F.struct(c["at"].alias("at"), c["start"].alias("start"), c["cand"].alias("cand"), expression(forest, c["x"]).alias("score"))))


def scan(docs: DataFrame, forest: list[Tree], path: str = "source", least: float = 0.5) -> DataFrame:
    """A row for each candidate: doc_id, start, end (code points), kind, secret (the text), score, is_secret."""
    got = _with_scored(docs.select("doc_id", "text", *([path] if path in docs.columns else [])), forest, path, "__f")
    # rows without a candidate go after the explode: a condition on the array is pushed below its parts, which are then made again in each use
    got = got.select("doc_id", F.explode_outer("__f_s").alias("c")).where(F.col("c").isNotNull())
    value = F.regexp_replace(F.col("c.cand"), ASSIGNED, "")
    kind = F.when(F.col("c.cand").startswith("-----BEGIN"), "private_key").when(F.col("c.cand").rlike(ASSIGNED), F.lower(F.regexp_extract("c.cand", rf"^(?i:({NAMES}))", 1))).otherwise("bare")
    end = (F.col("c.start") + F.length("c.cand")).cast("long")
    return got.select("doc_id", (end - F.length(value)).alias("start"), end.alias("end"), kind.alias("kind"), value.alias("secret"), F.col("c.score").alias("score"), (F.col("c.score") >= least).alias("is_secret"))


def redact(docs: DataFrame, forest: list[Tree], path: str = "source", least: float = 0.5, by: str = "[SECRET]") -> DataFrame:
    """The same rows and columns with every secret replaced, and n_chars, where there is one, counted again."""
    free = "__f"
    while any(c.startswith(free) for c in docs.columns):
        free += "_"
    df = _with_scored(docs, forest, path, free)
    bad = F.transform(F.filter(F.col(f"{free}_s"), lambda c: c["score"] >= least), lambda c: c["at"])
    df = df.withColumn(f"{free}_s", bad)
    new = F.array_join(F.transform(F.col(f"{free}_p"), lambda x, i: F.when(F.array_contains(F.col(f"{free}_s"), i), F.concat(F.regexp_extract(x, ASSIGNED, 0), F.lit(by))).otherwise(x)), "")
    hit = F.coalesce(F.size(f"{free}_s") > 0, F.lit(False))
    out = df.withColumn("text", F.when(hit, new).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(hit, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
