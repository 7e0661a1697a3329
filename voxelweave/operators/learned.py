"""Random-forest costs with Spark's own learner."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def train(samples: DataFrame, trees: int = 10, depth: int = 5, seed: int = 1) -> RandomForestClassificationModel:
    """Of samples (features array, label 0 or 1)."""
    s = samples.select(array_to_vector(F.col("features").cast("array<double>")).alias("features"), F.col("label").cast("double").alias("label"))
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed).fit(s)


def out_of_bag(samples: DataFrame, trees: int = 10, depth: int = 5, seed: int = 1) -> DataFrame:
    """samples (id, features, label) with votes (trees that didn't see the row) and p (their mean probability of label 1; null without votes).

    Each tree is fitted on a bootstrap sample of its own: a row is in it as often as a Poisson variable drawn from a hash of its
    id and the tree says, so it is the same however rows lie.
    """
    from pyspark.ml.classification import DecisionTreeClassifier

    s = samples.select("id", "label", array_to_vector(F.col("features").cast("array<double>")).alias("features"), F.col("label").cast("double").alias("y"))
    subset = max(1, round(len(samples.first().features) ** 0.5)) if samples.take(1) else 1
    votes = None
    for t in range(trees):
        u = (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(t)), F.lit(1 << 30)).cast("double") + 0.5) / float(1 << 30)
        times = sum((F.when(u > c, 1).otherwise(0) for c in (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563)), F.lit(0))  # fixed values: sums of 1/(e k!)
        placed = s.withColumn("times", times)
        bag = placed.where("times > 0").withColumn("w", F.col("times").cast("double"))
        m = RandomForestClassifier(labelCol="y", weightCol="w", numTrees=1, maxDepth=depth, seed=seed + t, featureSubsetStrategy=str(subset), bootstrap=False) if subset > 1 else DecisionTreeClassifier(labelCol="y", weightCol="w", maxDepth=depth, seed=seed + t)
        out = m.fit(bag).transform(placed.where("times = 0")).select("id", vector_to_array("probability")[1].alias("p"))
        votes = out if votes is None else votes.unionByName(out)
    mean = votes.groupBy("id").agg(F.count("*").alias("votes"), F.avg("p").alias("p"))
    return samples.join(mean, "id", "left").withColumn("votes", F.coalesce("votes", F.lit(0).cast("long")))


def out_of_bag_error(votes: DataFrame) -> DataFrame:
    """rows, error: the share of rows with votes whose majority is wrong."""
    wrong = (F.col("p") >= 0.5).cast("int") != F.col("label")
    return votes.where("votes > 0").agg(F.count("*").alias("rows"), F.avg(wrong.cast("double")).alias("error"))


def probability(model: RandomForestClassificationModel, rows: DataFrame) -> DataFrame:
    """Rows with p, the probability of label 1."""
    r = rows.withColumn("__v", array_to_vector(F.col("features").cast("array<double>")))
    got = model.setFeaturesCol("__v").transform(r)
    return got.withColumn("p", vector_to_array("probability")[1]).drop("__v", "rawPrediction", "probability", "prediction")


def save(model: RandomForestClassificationModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> RandomForestClassificationModel:
    return RandomForestClassificationModel.load(path)


def importances(model: RandomForestClassificationModel) -> list[float]:
    return list(model.featureImportances.toArray())
