"""Reports: exploration of source tables, errors of a matcher, leaderboard algebra."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def null_counts(df: DataFrame) -> DataFrame:
    """(column, n, nulls, share) of every column, in one pass."""
    row = df.agg(F.count("*").alias("n"), *[F.count_if(F.col(c).isNull() | (F.col(c).cast("string") == "")).alias(f"c_{c}") for c in df.columns])
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"c_{c}").alias("nulls")) for c in df.columns])
    return row.select(F.explode(entries).alias("x"), "n").select("x.column", "n", "x.nulls", F.round(F.col("x.nulls") / F.col("n"), 6).alias("share"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def length_stats(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Mean, median, least and largest length of text columns by a key."""
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.length(c).alias("l")) for c in columns])
    rows = df.select(F.col(key).alias("key"), F.explode(entries).alias("x")).select("key", "x.column", "x.l")
    return rows.groupBy("key", "column").agg(F.round(F.avg("l"), 6).alias("mean"), F.median("l").alias("middle"), F.min("l").alias("least"), F.max("l").alias("largest"))


def match_counts(entities: DataFrame, truth: DataFrame) -> DataFrame:
    """How many entities have 0, 1, 2, ... matches, by the matches' sources."""
    per = truth.groupBy("s_id").agg(F.count_if(F.col("q_id").startswith("S2-")).alias("s2"), F.count_if(F.col("q_id").startswith("S3-")).alias("s3"))
    rows = entities.select("s_id").join(per, "s_id", "left").na.fill(0)
    return rows.groupBy("s2", "s3").agg(F.count("*").alias("n"))


def error_kind(owner: Column, retrieved: Column, best: Column, p: Column, threshold: float = 0.5) -> Column:
    """What went wrong with a record: its owner isn't a candidate, or is outranked, or right with a low p; or it has no owner and is kept."""
    return (
        F.when(owner.isNull(), F.when(p >= threshold, "unowned kept").otherwise("unowned left"))
        .when(~retrieved, "not retrieved").when(best != owner, "outranked").when(p < threshold, "low p").otherwise("right")
    )


def leaderboard(shares: DataFrame, full: float, blank: float) -> DataFrame:
    """A country's F0.5 from two scores: with its rows, and with them emptied. A country's emptied rows still score its
    share of entities without matches: F = singletons + (full - blank) / share."""
    return shares.withColumn("f05", F.round(F.col("singletons") + (F.lit(full) - F.lit(blank)) / F.col("share"), 6))


def emptied(lines: DataFrame, s1: DataFrame, blank: list[str]) -> DataFrame:
    """Result lines (s_id, ids), with an empty list for entities of the blank countries; s1: (s_id, country). Other lines, also those of
    unknown entities, stay as they are."""
    rows = lines.join(s1.select("s_id", F.col("country").alias("of_")).distinct(), "s_id", "left")
    return rows.withColumn("ids", F.when(F.col("of_").isin(blank), F.lit("")).otherwise(F.col("ids"))).drop("of_")


def probe_counts(lines: DataFrame, s1: DataFrame, blank: list[str]) -> DataFrame:
    """(country, blanked, entities, share, rows): how many entities each country has, and how many lines with matches a probe keeps or
    empties; lines are those before."""
    own = s1.select("s_id", "country").distinct()
    sizes = own.groupBy("country").agg(F.count("*").alias("entities"))
    total = sizes.agg(F.sum("entities").alias("all_"))
    full = lines.where("ids <> ''").join(own, "s_id").groupBy("country").agg(F.count("*").alias("rows"))
    out = sizes.join(full, "country", "left").join(F.broadcast(total))
    return out.select("country", F.col("country").isin(blank).alias("blanked"), "entities", F.round(F.col("entities") / F.col("all_"), 6).alias("share"), F.coalesce("rows", F.lit(0)).alias("rows"))
