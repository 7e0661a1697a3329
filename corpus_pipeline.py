"""A training corpus from documents: five stages, each an operator of voxelweave.llm.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame,
which run() writes as Parquet and reads again as the next one's docs.

1. toxicity: documents whose noisy-or score is 0.7 or more go.
2. near_duplicates: of each component of the 5-word Jaccard join at 80 %, the document with the
   least doc_id stays; documents without words stay.
3. secrets: what the forest calls a secret is replaced by [SECRET], and n_chars counted again.
4. mix: every source's documents are repeated, kept or left out, whole, as Pareto order
   sampling says; a row taken k times is there k times.
5. pack: all are packed into sequences of 2048 tokens; a row a piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelweave.llm import jaccard, mixing, packing, secrets, tokens, toxicity
from voxelweave.llm.common import documents, scratch


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, documents(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model, 0.7)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs, 5, 80)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs, secrets.train(spark))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.take(docs, mixing.mix(docs, mixing.by_weight))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    got = packing.pieces(docs, tokens.vocabulary_path(), 0).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.pack(got, packing.about(docs), ("doc_id", "piece", "start", "ids_crc32"))


STAGES = [("toxicity", toxic), ("near_duplicates", near_duplicates), ("secrets", redact), ("mix", mix), ("pack", pack)]

#: models, hashes and tokenizers are not in SQL; tests/llm/test_pipeline.py has a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
