import zlib
from collections import Counter

import pytest
from cases import documents, empty, rows
from pyspark.sql import functions as F

from tessera.llm import sharding


@pytest.mark.parametrize("bucket_rows", [1, 20_000])
def test_contract(spark, bucket_rows):
    out = sharding.shard_documents(documents(spark), 8, bucket_rows).collect()
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in out if r.doc_id is not None) == sorted((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in rows() if d is not None)
    slots = Counter()
    for r in out:
        slots[r.shard] += 1
    for shard, n in slots.items():
        assert sorted(r.slot for r in out if r.shard == shard) == list(range(n))
    assert all(r.law == "key" and r.grown_shard in (r.shard, 8) for r in out)
    assert len({(r.doc_id, r.shard) for r in out}) == len({r.doc_id for r in out})
    assert sharding.shard_documents(empty(spark), 8).collect() == []


def test_growing_moves_the_necessary_fraction(spark):
    ids = spark.range(20_000).select(F.col("id").alias("k"))
    for n in (1, 7, 250):
        c = ids.select(sharding.jump_hash(F.col("k"), n).alias("a"), sharding.jump_hash(F.col("k"), n + 1).alias("b")).collect()
        moved = [r for r in c if r.a != r.b]
        assert all(r.b == n for r in moved) and abs(len(moved) / 20_000 - 1 / (n + 1)) < 0.02
        counts = Counter(r.a for r in c)
        assert len(counts) == n and (n == 250 or max(counts.values()) < 1.15 * 20_000 / n)
    with pytest.raises(ValueError):
        sharding.jump_hash(F.col("k"), 0)


def test_written_shards(spark, tmp_path):
    sharding.write_shards(documents(spark).drop("shard"), str(tmp_path / "s"), 4)
    assert spark.read.parquet(str(tmp_path / "s")).count() == len(rows())
