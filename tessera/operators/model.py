"""Pair models: gradient-boosted trees and forests, cross-fitted by query folds, blended and calibrated.

Spark ML trains on all executors; rows of one query never lie on both sides of a split.
"""

from __future__ import annotations

import json
from itertools import product

from pyspark.ml import PipelineModel, Pipeline
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.splits import bucket

#: Kinds of models and their parameters; `rounds` bounds boosting, which stops early on the held-out tenth of queries.
KINDS = {
    "gbt": lambda rounds: GBTClassifier(featuresCol="x_", labelCol="y_", maxIter=rounds, maxDepth=5, stepSize=0.1, subsamplingRate=0.8, seed=0, validationIndicatorCol="valid_", validationTol=1e-4),
    "rf": lambda rounds: RandomForestClassifier(featuresCol="x_", labelCol="y_", numTrees=min(rounds, 150), maxDepth=8, minInstancesPerNode=20, seed=0),
}


def with_label(rows: DataFrame, label: str = "y") -> DataFrame:
    """rows with y_ (0 or 1) and valid_: the tenth of queries, by hash, that stops the boosting."""
    return rows.withColumns({"y_": F.col(label).cast("double"), "valid_": bucket(F.concat(F.lit("valid|"), "q_id"), 10) == 0})


def fit(rows: DataFrame, features: list[str], kind: str = "gbt", rounds: int = 40) -> PipelineModel:
    assembler = VectorAssembler(inputCols=features, outputCol="x_", handleInvalid="keep")
    return Pipeline(stages=[assembler, KINDS[kind](rounds)]).fit(with_label(rows))


def predict(model: PipelineModel, rows: DataFrame, name: str = "p") -> DataFrame:
    out = model.transform(rows.drop("x_", "rawPrediction", "probability", "prediction"))
    return out.withColumn(name, vector_to_array("probability")[1]).select(*rows.columns, name)


def importance(model: PipelineModel, features: list[str]) -> list[tuple[str, float]]:
    """Features by their share of the gain, largest first."""
    values = model.stages[-1].featureImportances.toArray()
    return sorted(zip(features, map(float, values)), key=lambda x: (-x[1], x[0]))


def fit_folds(rows: DataFrame, features: list[str], kind: str = "gbt", rounds: int = 40, held_out: Column | None = None) -> list[PipelineModel]:
    """A model for each of two query folds, of rows that aren't held out."""
    known = rows if held_out is None else rows.where(~held_out)
    return [fit(known.where(bucket(F.col("q_id"), 2) == f), features, kind, rounds) for f in (0, 1)]


def score_folds(models: list[PipelineModel], rows: DataFrame, held_out: Column | None = None) -> DataFrame:
    """rows with p: each fold is scored by the model of the other; held-out rows, which neither has seen, by the mean."""
    out = rows.withColumns({"fold_": bucket(F.col("q_id"), 2), "held_": F.lit(False) if held_out is None else held_out})
    for f, one in enumerate(models):
        out = predict(one, out, f"p{f}_")
    p = F.when(F.col("held_"), (F.col("p0_") + F.col("p1_")) / 2).when(F.col("fold_") == 0, F.col("p1_")).otherwise(F.col("p0_"))
    return out.withColumn("p", p).drop("fold_", "held_", "p0_", "p1_")


def cross_fit(rows: DataFrame, features: list[str], kind: str = "gbt", rounds: int = 40, held_out: Column | None = None) -> DataFrame:
    return score_folds(fit_folds(rows, features, kind, rounds, held_out), rows, held_out)


def blend(parts: list[str], weights: list[float]) -> Column:
    total = sum(weights)
    return sum((F.col(c) * (w / total) for c, w in zip(parts, weights)), F.lit(0.0))


def blend_weights(rows: DataFrame, parts: list[str], label: str = "y", step: float = 0.1) -> list[float]:
    """The weights of a simplex grid with the least log loss, all in one pass; ties go to the first tried."""
    n = round(1 / step)
    grid = [[i / n for i in w] for w in product(range(n + 1), repeat=len(parts)) if sum(w) == n]

    def loss(weights: list[float]) -> Column:
        p = F.least(F.greatest(blend(parts, weights), F.lit(1e-6)), F.lit(1 - 1e-6))
        return F.round(-F.avg(F.when(F.col(label), F.log(p)).otherwise(F.log(1 - p))), 9)

    found = rows.agg(*[loss(w).alias(f"l{i}") for i, w in enumerate(grid)]).first()
    return min(zip(found, range(len(grid)), grid))[2]


def calibrate(best: DataFrame, label: str = "y") -> list[tuple[float, float]]:
    """Knots (p, calibrated p) of an isotonic regression on best pairs."""
    model = IsotonicRegression(featuresCol="p", labelCol="y_").fit(best.withColumn("y_", F.col(label).cast("double")))
    return list(zip(map(float, model.boundaries.toArray()), map(float, model.predictions.toArray())))


def interpolated(p: Column, knots: list[tuple[float, float]]) -> Column:
    """Piecewise linear between knots, constant beyond them; the interval is found by a binary search in one array."""
    if not knots:
        return p
    n = len(knots)
    xs, ys = (F.array(*[F.lit(float(k[i])) for k in knots]) for i in (0, 1))
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(n.bit_length()))])
    # Knots below p, counted by steps of falling powers of two.
    below = F.aggregate(steps, F.lit(0), lambda at, by: F.when((at + by <= n) & (F.get(xs, at + by - 1) < p), at + by).otherwise(at))

    def at(k: Column) -> Column:
        x0, y0, x1, y1 = (F.get(a, i) for i in (k - 1, k) for a in (xs, ys))
        return F.when(k == 0, F.get(ys, F.lit(0))).when(k == n, F.get(ys, F.lit(n - 1))).otherwise(y0 + (p - x0) * ((y1 - y0) / (x1 - x0)))

    return F.get(F.transform(F.array(below), at), F.lit(0))


def save(models: dict[str, PipelineModel], meta: dict, path: str, spark) -> None:
    """Models by name and one JSON line of their meta data."""
    for name, model in models.items():
        model.write().overwrite().save(f"{path}/{name}")
    spark.createDataFrame([(json.dumps(meta, sort_keys=True),)], "value string").write.mode("overwrite").text(f"{path}/meta")


def load(path: str, names: list[str], spark) -> tuple[dict[str, PipelineModel], dict]:
    return {n: PipelineModel.load(f"{path}/{n}") for n in names}, json.loads(spark.read.text(f"{path}/meta").first()[0])


