"""Deterministic splits by hash buckets of ids: the same on every engine, run and cluster size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucket(key: Column, mod: int, how: str = "crc32") -> Column:
    """CRC-32 of the id's UTF-8 modulo mod; how='md5' takes the first 32 bits of MD5, which SQL engines share."""
    if how == "crc32":
        return F.crc32(key) % mod
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % mod


def role(s_id: Column, report_pct: int = 4, tune_pct: int = 4, how: str = "crc32") -> Column:
    """2 report, 1 tune, 0 train."""
    b = bucket(s_id, 100, how)
    return F.when(b < report_pct, 2).when(b < report_pct + tune_pct, 1).otherwise(0)


def v1_split(s_id: Column, how: str = "crc32") -> Column:
    """70 % fit, 15 % threshold, 15 % report."""
    b = bucket(s_id, 100, how)
    return F.when(b < 70, "fit").when(b < 85, "threshold").otherwise("report")


def dev_filter(s1: DataFrame, queries: DataFrame, owners: DataFrame, share: float, how: str = "crc32") -> tuple[DataFrame, DataFrame]:
    """A slice of the index and of the queries: those owned by what is kept, and the same slice of the unowned. Records
    owned by entities that are dropped vanish."""
    cut = int(share * 1000)
    kept = s1.where(bucket(F.col("entity_id"), 1000, how) < cut)
    owned = queries.join(owners.select(F.col("q_id").alias("entity_id"), "s_id"), "entity_id", "left")
    ids = kept.select(F.col("entity_id").alias("s_id"), F.lit(True).alias("in_"))
    rows = owned.join(ids, "s_id", "left").where(F.col("in_") | (F.col("s_id").isNull() & (bucket(F.col("entity_id"), 1000, how) < cut)))
    return kept, rows.select(*queries.columns)


def orphan_filter(s1: DataFrame, share: float, how: str = "crc32") -> DataFrame:
    """s1 without a salted slice; its records stay and have no owner then."""
    return s1.where(bucket(F.concat(F.lit("orphan|"), "entity_id"), 1000, how) >= int(share * 1000))


def blanked(q_id: Column, how: str = "crc32") -> Column:
    """The fifth of the training records for which the supervised word table is hidden."""
    return bucket(F.concat(F.lit("blank|"), q_id), 100, how) < 20


def fold(q_id: Column, how: str = "crc32") -> Column:
    return bucket(q_id, 2, how)


def relevant(top: DataFrame, owners: DataFrame, report_pct: int = 4, tune_pct: int = 4, how: str = "crc32") -> DataFrame:
    """Records (country, q_id) of top pairs that tuning or the report need: their owner or one of their top candidates is a report
    or tune entity."""
    held = lambda x: role(x, report_pct, tune_pct, how) > 0
    owned = owners.where(held(F.col("s_id"))).select("q_id").distinct().withColumn("own_", F.lit(True))
    near = top.groupBy("country", "q_id").agg(F.max(held(F.col("s_id"))).alias("near_"))
    return near.join(owned, "q_id", "left").where(F.col("near_") | F.col("own_")).select("country", "q_id")


def sampled(df: DataFrame, key: str, n: int, seed: str = "0") -> DataFrame:
    """n rows by the order of a salted hash; the same rows on every run. Spark keeps n rows a task for it."""
    return df.orderBy(F.md5(F.concat(F.lit(seed + "|"), F.col(key))), key).limit(n)


def negatives(pairs: DataFrame, per_positive: int) -> DataFrame:
    """All true pairs and, for each, per_positive false ones of the same entity by a hash's order; 0 keeps all. An entity without a
    true pair keeps per_positive."""
    if not per_positive:
        return pairs
    w = Window.partitionBy("s1_id", "y").orderBy(F.md5(F.concat_ws("|", "s1_id", "candidate_id")), "candidate_id")
    positives = F.greatest(F.sum(F.col("y").cast("int")).over(Window.partitionBy("s1_id")), F.lit(1))
    ranked = pairs.withColumns({"rn_": F.row_number().over(w), "p_": positives})
    return ranked.where(F.col("y") | (F.col("rn_") <= F.col("p_") * per_positive)).drop("rn_", "p_")
