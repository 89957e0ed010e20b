import re

import numpy as np
import pytest
from cases import documents, empty, rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import mixing


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        rest = [s for s in sizes if s not in full]
        level = (total - sum(2 * sizes[s] for s in full)) / sum(weight[s] for s in rest) if rest else 0
        over = {s for s in rest if level * weight[s] >= 2 * sizes[s]}
        if not over:
            return {s: 2 * sizes[s] if s in full else level * weight[s] for s in sizes}
        full |= over


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


@given(st.lists(st.tuples(st.integers(1, 50), st.floats(0, 1), st.floats(0, 0.999)), max_size=60))
@settings(max_examples=150, deadline=None)
def test_pivot_keeps_the_sum(units):
    size, x, u = (np.array([t[i] for t in units], float) for i in range(3))
    out = mixing.pivot(size, x, u)
    assert ((out > 0) & (out < 1)).sum() <= 1
    assert abs((out * size).sum() - (x * size).sum()) < 1e-3


def test_pivot_is_fair():
    rng = np.random.default_rng(2)
    size, x = np.array([3.0, 5, 2, 9, 4]), np.array([0.3, 0.6, 0.5, 0.2, 0.9])
    mean = np.mean([mixing.pivot(size, x, rng.random(5)) for _ in range(8000)], axis=0)
    assert np.abs(mean - x).max() < 0.03


@pytest.mark.parametrize("bucket_rows", [2, 2000])
def test_contract(spark, bucket_rows):
    docs = documents(spark)
    out = mixing.mix_copies(docs, bucket_rows=bucket_rows).collect()
    again = mixing.mix_copies(docs.repartition(5), bucket_rows=bucket_rows).collect()
    key = lambda r: (str(r.doc_id), str(r.source), r.fp_, r["size"], r.copies)
    assert sorted(map(key, out)) == sorted(map(key, again)) and len(out) == len(rows())
    sizes = {}
    for _, t, _, s, *_ in rows():
        sizes[s] = sizes.get(s, 0) + words(t)
    targets = brute_targets(sizes)
    for r in out:
        assert r.source_size == sizes[r.source] and abs(r.target - targets[r.source]) < 1e-6 and 0 <= r.copies <= 2
    for s in sizes:
        taken = sum(r.copies * r["size"] for r in out if r.source == s)
        assert abs(taken - targets[s]) <= max(r["size"] for r in out if r.source == s)
    assert mixing.mix_digest(empty(spark)).collect() == []


def test_targets_are_met(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = mixing.mix_digest(docs).join(docs.select("doc_id", "source"), "doc_id")
    for r in out.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect():
        assert abs(r.taken - r.target) < 0.02 * r.target


def test_documents_are_repeated(spark):
    docs = documents(spark)
    out = mixing.mix_documents(docs)
    assert out.columns == docs.columns
    copies = sum(r.copies for r in mixing.mix_copies(docs).collect())
    assert out.count() == copies
