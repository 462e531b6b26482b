"""Prediction of disjointness from pair features: a Spark ML pipeline trained on classified pairs."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import Imputer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NUMERIC = [
    "semantic_similarity", "depth_1", "depth_2", "av_depth", "impact_a", "impact_b", "impact_ab", "parent_depth", "semantic_distance", "relation_reliability", "intra_relation_reliability",
]


def _finite(df: DataFrame) -> DataFrame:
    clean = {c: F.when(F.isnan(c) | F.col(c).isin(float("inf"), float("-inf")), None).otherwise(F.col(c)) for c in NUMERIC}
    return df.withColumns(clean)


def train(features: DataFrame) -> PipelineModel:
    """Fit on rows whose class is disjoint or conjoint; missing numbers are imputed, unseen relations have a class of their own."""
    rows = _finite(features.where(F.col("class").isin("disjoint", "conjoint"))).withColumn("label", (F.col("class") == "disjoint").cast("double"))
    usable = [c for c in NUMERIC if rows.where(F.col(c).isNotNull()).limit(1).count()]
    stages = [
        StringIndexer(inputCol="relation", outputCol="relation_i", handleInvalid="keep"), Imputer(inputCols=usable, outputCols=[f"{c}_f" for c in usable]),
        VectorAssembler(inputCols=["relation_i", *[f"{c}_f" for c in usable]], outputCol="x", handleInvalid="keep"), LogisticRegression(featuresCol="x", labelCol="label", regParam=0.01),
    ]
    return Pipeline(stages=stages).fit(rows)


def classify(model: PipelineModel, features: DataFrame, threshold: float = 0.5, pairs: DataFrame | None = None) -> DataFrame:
    """(disamb1, disamb2, probability, score, state) of each pair.

    probability: the greatest over a pair's rows. score: 1 less the greatest class index of its rows, the index being 0
    for disjoint and 1 for conjoint, so 1 only where all rows say disjoint; -1 without rows, for pairs (disamb1, disamb2)
    if given. state: TRUE where the probability reaches the threshold, else NIL.
    """
    scored = model.transform(_finite(features)).select("disamb1", "disamb2", vector_to_array("probability")[1].alias("p"), (1 - F.col("prediction")).alias("index"))
    out = scored.groupBy("disamb1", "disamb2").agg(F.max("p").alias("probability"), (1 - F.max("index")).alias("score"))
    if pairs is not None:
        out = pairs.select("disamb1", "disamb2").distinct().join(out, ["disamb1", "disamb2"], "left").fillna(-1.0, ["score"])
    return out.withColumn("state", F.when(F.col("probability") >= threshold, "TRUE").otherwise("NIL"))


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
