"""The queries of this package's operators, and SQL for those it can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, counts, fingerprints, jaccard, licenses, mixing, negatives, packing, quality, secrets, substrings, tokens, toxicity
from .common import documents

FOLD = 3  # of labels: documents with crc32(doc_id as text) mod 3 = 1 are held out


def remainder(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLD


def sized(rows: DataFrame) -> DataFrame:
    """Small result rows of many tasks, rebalanced so that files have the advisory size."""
    return rows.hint("rebalance")


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pareto order sampling mix of all documents: see llm.mixing."""
    got = mixing.mix(documents(spark, sf_dir), mixing.by_weight)
    return got.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector best-fit packing of all documents: see llm.packing."""
    docs = documents(spark, sf_dir)
    got = packing.pieces(docs, tokens.vocabulary_path(), 0).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.pack(got, packing.about(docs), ("doc_id", "piece", "start", "ids_crc32"))


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 4-word shingle sets are 85 % alike: see llm.jaccard."""
    return jaccard.join(documents(spark, sf_dir), 4, 85).select("doc_id", "n_shingles", "component_id")


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License templates in all documents: see llm.licenses."""
    return licenses.scan(documents(spark, sf_dir))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets and rejected look-alikes in all documents: see llm.secrets.  The secret is given as its SHA-256."""
    got = secrets.scan(documents(spark, sf_dir), secrets.train(spark))
    return got.withColumn("secret_sha256", F.sha2("secret", 256)).drop("secret")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned decision list over text statistics: see llm.quality."""
    docs = documents(spark, sf_dir)
    rules = quality.train(docs, documents(spark, sf_dir, "labels"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return quality.statistics(docs).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & quality.verdict(rules))


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words in runs of 13 that a smaller document has, removed: see llm.substrings."""
    got = substrings.remove(documents(spark, sf_dir))
    return sized(got.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Homomorphic fingerprints of all documents and their edited texts: see llm.fingerprints."""
    f = fingerprints
    got = f.compare(documents(spark, sf_dir))
    return got.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), f.text_of(F.col("fp")).alias("fingerprint"), f.text_of(F.col("fp_edited")).alias("edited_fingerprint"), "near_edited", "near_next")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noisy-or of sentence scores, learned from document labels outside the held-out fold: see llm.toxicity.  A null doc_id is in no fold."""
    docs = documents(spark, sf_dir)
    model = toxicity.train(docs, documents(spark, sf_dir, "labels"), train=lambda i: remainder(i) != 1)
    got = toxicity.score(docs, model)
    return got.select("doc_id", F.coalesce(remainder(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), F.size("offending").alias("n_offending"))


def op10_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids in Arrow files of equal-length sequences, written and read back: see llm.tokens."""
    manifest = tokens.write_tokens(documents(spark, sf_dir), tokens.vocabulary_path(), 2)
    return sized(tokens.read_tokens(spark, manifest, tokens.digest, "doc_id long, start long, n_tokens long, ids_crc32 long"))


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of the vectors of every hundredth id, in windows below their positives: see llm.negatives.  Every seventh id's label is moved on."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(documents(spark, sf_dir, "embeddings"), label, F.col("id") % 100 == 0)


def op12_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents, from counts of distinct pre-tokens: see llm.counts."""
    got = counts.count_tokens(documents(spark, sf_dir), tokens.vocabulary_path())
    return sized(got.withColumn("over_limit", F.col("n_tokens") > 1024))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of all documents' tokens by two vocabularies: see llm.alignment."""
    got = alignment.align(documents(spark, sf_dir), tokens.vocabulary_path(), tokens.vocabulary_path("piece_bpe_32k.model"))
    return sized(got.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.col("best").alias("n_best"), F.col("pair_docs").alias("count_sum"), "groups_sha256"))


QUERIES = {f.__name__: f for f in (op1_mix, op2_pack, op3_jaccard, op4_licenses, op5_secrets, op6_quality, op7_substrings, op8_fingerprints, op9_toxicity, op10_tokens, op11_negatives, op12_counts, op13_alignment)}
WORDS_SQL = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

#: every link of op3 between two texts, by a join on equal shingles, and what is reachable over links
OP3_SQL = rf"""WITH RECURSIVE w AS (SELECT doc_id, {WORDS_SQL.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i+3], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws)-3, 1)+1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * o >= 85 * (p.n + q.n - o)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(a, b) AS (SELECT a, a FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c.component, w.doc_id) AS component_id FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN (SELECT a, min(b) AS component FROM r GROUP BY 1) c ON c.a = w.doc_id"""

OP7_SQL = rf"""WITH w AS (SELECT doc_id, {WORDS_SQL.format("coalesce(text, '')")} AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i+12], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws)-11)) AS i FROM w)),
gone AS (SELECT DISTINCT doc_id, i+k AS i FROM g JOIN (SELECT g, min(doc_id) AS least FROM g GROUP BY 1) USING (g), range(0, 13) q(k) WHERE least < doc_id),
k AS (SELECT p.doc_id, string_agg(p.word, ' ' ORDER BY p.i) AS kept, count(*) AS n FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws)+1)) AS i FROM w) p ANTI JOIN gone ON gone.doc_id = p.doc_id AND gone.i = p.i GROUP BY 1)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k ON k.doc_id = w.doc_id"""

OP11_SQL = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label+1) % 10 ELSE label END AS label, [CAST(floor(CAST(x AS DOUBLE)*256) AS BIGINT) FOR x IN embedding] AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS al, b.vec_id AS id, b.label AS bl, CAST(list_sum([x * b.q[i] FOR x, i IN a.q]) AS BIGINT) AS score FROM v a, v b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, al, id AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS k FROM s WHERE al = bl) t WHERE k <= 5),
n AS (SELECT p.*, s.id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) AS k FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.bl <> p.al WHERE 30*positive_score <= 100*s.score AND 100*s.score <= 90*positive_score)
SELECT anchor_id, positive_id, CAST(k AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE k <= 10"""

#: models, the tokenizers library, Pareto order over several rounds and xxHash are not in SQL; those queries are tested against brute force
ORACLE_SQL: dict[str, str] = {"op3_jaccard": OP3_SQL, "op7_substrings": OP7_SQL, "op11_negatives": OP11_SQL}
