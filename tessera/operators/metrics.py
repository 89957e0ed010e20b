"""Macro F0.5 and its breakdowns, over entities of the truth, those without matches included."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def entity_scores(entities: DataFrame, truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """entities (country, s_id) with n_true, n_pred, hit, precision, recall and f05.

    An entity without matches scores 1 if nothing is predicted for it, else 0.
    """
    t, p = truth.select("s_id", "q_id").distinct(), predicted.select("s_id", "q_id").distinct()
    both = t.withColumn("t_", F.lit(1)).join(p.withColumn("p_", F.lit(1)), ["s_id", "q_id"], "full_outer")
    counts = both.groupBy("s_id").agg(F.count("t_").alias("n_true"), F.count("p_").alias("n_pred"), F.count(F.col("t_") + F.col("p_")).alias("hit"))
    e = entities.select("country", "s_id").distinct().join(counts, "s_id", "left").na.fill(0, ["n_true", "n_pred", "hit"])
    counted = [F.col(c) for c in ("n_true", "n_pred", "hit")]
    return e.withColumns({"precision": _share(*counted, "n_pred"), "recall": _share(*counted, "n_true"), "f05": f_half(*counted)})


def _share(n_true: Column, n_pred: Column, hit: Column, of: str) -> Column:
    nothing = F.when(n_pred == 0, 1.0).otherwise(0.0)
    whole = n_pred if of == "n_pred" else n_true
    return F.when(n_true == 0, nothing).when(whole == 0, 0.0).otherwise(hit / F.greatest(whole, F.lit(1)))


def f_half(n_true: Column, n_pred: Column, hit: Column) -> Column:
    """F0.5 of an entity by its numbers of matches, predictions and right ones."""
    pr, rc = _share(n_true, n_pred, hit, "n_pred"), _share(n_true, n_pred, hit, "n_true")
    nothing = F.when(n_pred == 0, 1.0).otherwise(0.0)
    return F.when(n_true == 0, nothing).when(hit == 0, 0.0).otherwise(1.25 * pr * rc / (0.25 * pr + rc))


def group_of(n: Column) -> Column:
    return F.when(n == 0, "matches=0").when(n == 1, "matches=1").when(n <= 3, "matches=2-3").otherwise("matches=4+")


def report(scores: DataFrame) -> DataFrame:
    """f05, precision, recall, share of matchless entities with a prediction, and n: over all, by number of matches, by country."""
    rows = scores.withColumn("grp", group_of(F.col("n_true")))
    false_hit = F.avg(F.when(F.col("n_true") == 0, (F.col("n_pred") > 0).cast("int")))
    sets = rows.groupingSets([[], ["grp"], ["country"]], "grp", "country")
    return sets.agg(*[F.round(F.avg(c), 6).alias(c) for c in ("f05", "precision", "recall")], F.round(F.coalesce(false_hit, F.lit(0.0)), 6).alias("singleton_fp"), F.count("*").alias("n"))


def log_loss(rows: DataFrame, y: str, p: str) -> Column:
    c = F.least(F.greatest(F.col(p), F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.round(-F.avg(F.when(F.col(y), F.log(c)).otherwise(F.log(1 - c))), 6)
