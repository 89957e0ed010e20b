"""Context of scored pairs: ranks, runners-up, how contested an entity is, and records that already chose it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Q, S = ("country", "q_id"), ("country", "s_id")


def best_owner(pairs: DataFrame) -> DataFrame:
    """The best pair of every query by p, equal ones by id."""
    w = Window.partitionBy(*Q).orderBy(F.desc("p"), "s_id")
    return pairs.withColumn("rn_", F.row_number().over(w)).where(F.col("rn_") <= 1).drop("rn_")


def context_features(pairs: DataFrame) -> DataFrame:
    """The ten stage-2 context features of pairs (country, q_id, s_id, p)."""
    q, s = Window.partitionBy(*Q), Window.partitionBy(*S)
    ranked = pairs.withColumns({"p1_rank": F.row_number().over(q.orderBy(F.desc("p"), "s_id")) - 1, "s_rank": F.row_number().over(s.orderBy(F.desc("p"), "q_id")) - 1})
    at = lambda c, k, w: F.max(F.when(F.col(c) == k, F.col("p"))).over(w)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    other_q = F.when(F.col("p1_rank") == 0, zero(at("p1_rank", 1, q))).otherwise(at("p1_rank", 0, q))
    other_s = F.when(F.col("s_rank") == 0, zero(at("s_rank", 1, s))).otherwise(at("s_rank", 0, s))
    r6 = lambda c: F.round(c, 6)
    return ranked.select(
        "country", "q_id", "s_id", F.col("p").alias("p1"), "p1_rank", other_q.alias("p1_max_other"), r6(F.col("p") - other_q).alias("p1_gap"), r6(F.sum("p").over(q)).alias("q_psum"),
        F.sum((F.col("p") > 0.1).cast("int")).over(q).alias("q_n01"), r6(F.sum("p").over(s) - F.col("p")).alias("s_psum_other"), other_s.alias("s_pmax_other"), "s_rank", F.count("*").over(s).alias("s_n"),
    )


def members(best: DataFrame, tau: float, cap: int) -> DataFrame:
    """(country, s_id, mem_id, mem_p): of the queries whose best owner is s with p >= tau, the cap + 1 best."""
    w = Window.partitionBy(*S).orderBy(F.desc("p"), "q_id")
    return best.where(F.col("p") >= tau).withColumn("rn_", F.row_number().over(w)).where(F.col("rn_") <= cap + 1).select("country", "s_id", F.col("q_id").alias("mem_id"), F.col("p").alias("mem_p"))


def sibling_pairs(pairs: DataFrame, best: DataFrame, tau: float = 0.5, cap: int = 10) -> DataFrame:
    """(country, q_id, s_id, mem_id, mem_p): other records that chose s; at most cap + 1 each, so nothing grows beyond pairs * cap."""
    return pairs.select("country", "q_id", "s_id").join(members(best, tau, cap), ["country", "s_id"]).where("q_id <> mem_id")


def sibling_features(siblings: DataFrame, similar: DataFrame, prefix: str = "sib") -> DataFrame:
    """Summaries of a pair's siblings; similar has the features of (q_id, mem_id): n_wjacc, a_wjacc, num_jacc, num_near, unit_shared."""
    rows = siblings.join(similar, ["country", "q_id", "mem_id"])
    s3 = F.col("mem_id").startswith("S3-").cast("int")
    best = F.max(0.5 * F.col("n_wjacc") + 0.3 * F.col("a_wjacc") + 0.2 * F.col("num_jacc"))
    maxima = {"n_wjacc": "n_wjacc", "a_wjacc": "a_wjacc", "num_jacc": "num_jacc", "num_near": "num_near", "unit": "unit_shared"}
    return rows.groupBy("country", "q_id", "s_id").agg(
        F.count("*").alias(f"{prefix}_n"), F.sum(1 - s3).alias(f"{prefix}_n_s2"), F.sum(s3).alias(f"{prefix}_n_s3"), F.max("mem_p").alias(f"{prefix}_max_p"),
        F.round(F.round(F.sum("mem_p"), 6) / F.count("*"), 9).alias(f"{prefix}_mean_p"), *[F.max(c).alias(f"{prefix}_{k}") for k, c in maxima.items()], F.round(best, 9).alias(f"{prefix}_best"),
    )
