"""Sharding by jump consistent hashing: the key and the number of shards decide, without a ring table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Jumps that almost every key ends within; the rest take the full fold.
USUAL_JUMPS = 200
#: Rows that one slot bucket should hold.
BUCKET_ROWS = 20_000


def jump_hash(key: Column, shards: int) -> Column:
    """The shard 0..shards-1 of a key by jump consistent hashing (Lamping and Veach, 2014).

    A key sits in bucket b until its next jump j >= shards. The uniform numbers are xxhash64 of the key and
    of the bucket it jumps from, so they depend on nothing else, and one more shard only moves keys into
    itself. A jump goes ahead by one at least: `shards` steps always end it.
    """
    if shards < 1:
        raise ValueError("shards must be positive")

    def fold(steps: int) -> Column:
        at = F.struct(F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"))

        def step(s: Column, _: Column) -> Column:
            r = F.shiftrightunsigned(F.xxhash64(key, s["j"]), 33) + 1
            ahead = F.floor((s["j"] + 1) * (F.lit(float(2**31)) / r)).cast("long")
            return F.when(s["j"] >= shards, s).otherwise(F.struct(s["j"].alias("b"), ahead.alias("j")))

        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), at, step)

    some = fold(min(shards, USUAL_JUMPS))
    if shards <= USUAL_JUMPS:
        return some["b"].cast("int")
    return F.when(some["j"] >= shards, some["b"]).otherwise(fold(shards)["b"]).cast("int")


def shard_documents(docs: DataFrame, shards: int = 8, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document; law `key`.

    size is the text's UTF-8 bytes plus 1, text_crc32 the unsigned CRC of those bytes; a null text has none
    (size 1, CRC 0). Slots count from 0 without a gap in each shard: rows are ranked in buckets of their hash
    and a prefix sum over the buckets' counts is added, so no shard is sorted in one task. Null ids
    share a shard; rows with one id go to one shard but over many buckets. Equal rows get slots in any order.
    """
    rows = docs.select(
        "doc_id",
        (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
    ).withColumns({
        "shard": jump_hash(F.col("doc_id"), shards),
        "grown_shard": jump_hash(F.col("doc_id"), shards + 1),
    })
    buckets = max(1, docs.count() // (shards * bucket_rows) + 1)
    rows = rows.withColumn("bucket_", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("shard").orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("shard", "bucket_").agg(F.count("*").alias("n_")).select("shard", "bucket_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("start_"))
    local = Window.partitionBy("shard", "bucket_").orderBy("doc_id", "text_crc32", "size")
    return (
        rows.withColumn("nth_", F.row_number().over(local))
        .join(starts, ["shard", "bucket_"])
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start_") + F.col("nth_") - 1).cast("long").alias("slot"), "grown_shard")
    )


def write_shards(docs: DataFrame, path: str, shards: int = 8) -> None:
    """Whole documents as Parquet, a folder for each shard."""
    docs.withColumn("shard", jump_hash(F.col("doc_id"), shards)).write.partitionBy("shard").parquet(path)
