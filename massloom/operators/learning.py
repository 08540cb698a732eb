"""Learned rankings: a logistic calibration of one score, and boosted trees over features with folds by group."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from massloom.session import durable


def calibrated(df: DataFrame, score: str, label: str) -> DataFrame:
    """Adds ``probability``: the logistic of a + b score, fitted to all rows (clipped to scores of at most 15 either side).

    Without rows of both labels there is nothing to fit; every probability is then the share of right rows.
    """
    rows = durable(df.withColumn("lr_x", F.greatest(F.lit(-15.0), F.least(F.lit(15.0), F.col(score)))))
    share = rows.agg(F.avg(label)).first()[0]
    if share is None or share in (0.0, 1.0):
        return rows.drop("lr_x").withColumn("probability", F.lit(share).cast("double"))
    inputs = VectorAssembler(inputCols=["lr_x"], outputCol="lr_f").transform(rows)
    model = LogisticRegression(featuresCol="lr_f", labelCol=label, regParam=0.0, maxIter=50).fit(inputs)
    a, b = model.intercept, float(model.coefficients[0])
    return rows.withColumn("probability", 1 / (1 + F.exp(-(a + b * F.col("lr_x"))))).drop("lr_x")


def group_folds(df: DataFrame, group: str, folds: int) -> DataFrame:
    """Adds ``fold``, the same for all rows of a group."""
    return df.withColumn("fold", F.pmod(F.xxhash64(group), F.lit(folds)).cast("int"))


def meta_ranked(df: DataFrame, features: list[str], label: str, folds: int, trees: int = 10, depth: int = 4) -> DataFrame:
    """Adds ``probability``: for each fold, of boosted trees fitted to the other folds.

    A fold whose training rows have one label only gets the share of right rows among them.
    """
    rows = durable(VectorAssembler(inputCols=features, outputCol="gb_f", handleInvalid="keep").transform(df))
    out = []
    for k in range(folds):
        rest, own = rows.where(F.col("fold") != k), rows.where(F.col("fold") == k)
        share = rest.agg(F.avg(label)).first()[0]
        if share is None or share in (0.0, 1.0):
            out.append(own.withColumn("probability", F.lit(share or 0.0).cast("double")).drop("gb_f"))
            continue
        model = GBTClassifier(featuresCol="gb_f", labelCol=label, maxIter=trees, maxDepth=depth, seed=1).fit(rest)
        scored = model.transform(own).withColumn("probability", vector_to_array("probability")[1])
        out.append(scored.drop("gb_f", "rawPrediction", "prediction"))
    return reduce(DataFrame.unionByName, out)
