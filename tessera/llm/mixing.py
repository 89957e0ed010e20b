"""Mixing sources to target weights by pivotal dependent rounding.

A source's documents should be taken f = target / size times: floor(f) copies, and one more with the fraction as its
probability. Two documents with fractional copies meet; words move from one to the other, at random
in either direction and without changing their sum or anyone's expectation, until one fraction is 0 or 1. Each bucket of
a source leaves one fraction at most, and these residuals meet in a tree of fixed fan-in until each source has
one. It is rounded, and documents of one bucket settle the words it was rounded by.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import n_words, row_columns, whole_row, written

WEIGHTS = (5, 2, 1)
SHARE, LIMIT = 1.5, 2.0
#: Documents of a source for each bucket, and residuals that meet at once above.
BUCKET_ROWS, FAN = 2_000, 64
EPS = 1e-9


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """source, source_size, target from (source, source_size), a row for each source.

    The i-th source by code point (null last) weighs weights[i % len]. Sources share `share` of all words by weight; a
    target stops at limit * source_size and what is over goes to the others by weight. That is one level l with
    target = min(limit * size, l * weight), found by taking the sources in the order of limit * size / weight.
    """
    # One task, but over a row for each source, not for each document.
    nth = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source"))) - 1
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), nth % len(weights))
    w = sizes.withColumn("w_", weight).withColumn("top_", F.col("source_size") * limit)
    full = Window.orderBy(F.col("top_") / F.col("w_"), F.col("source").isNull(), F.col("source"))
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.partitionBy()
    w = w.withColumn("level_", (F.sum("source_size").over(rest) * share - F.coalesce(F.sum("top_").over(before), F.lit(0.0))) / F.sum("w_").over(full.rowsBetween(0, Window.unboundedFollowing)))
    # The level holds from the first source that it doesn't fill up; those before it stop at their limit.
    filled = F.col("level_") * F.col("w_") >= F.col("top_")
    w = w.withColumns({"full_": filled, "nth_": F.row_number().over(full)})
    level = F.min(F.when(~F.col("full_"), F.struct("nth_", "level_"))).over(rest)["level_"]
    return w.select("source", "source_size", F.when(F.col("full_"), F.col("top_")).otherwise(level * F.col("w_")).alias("target"))


def pivot(sizes: np.ndarray, x: np.ndarray, u: np.ndarray) -> np.ndarray:
    """x with one fraction at most: each next unit meets the one that is still fractional; u are uniform numbers."""
    x = x.copy()
    held = -1
    for i in range(len(x)):
        if not EPS < x[i] < 1 - EPS:
            x[i] = round(x[i])
            continue
        if held < 0:
            held = i
            continue
        a = min((1 - x[held]) * sizes[held], x[i] * sizes[i])  # words that can move to the held unit
        b = min(x[held] * sizes[held], (1 - x[i]) * sizes[i])  # and away from it
        moved = a if u[i] * (a + b) < b else -b
        x[held] += moved / sizes[held]
        x[i] -= moved / sizes[i]
        for k in (held, i):
            if x[k] <= EPS or x[k] >= 1 - EPS:
                x[k] = round(x[k])
        held = next((k for k in (held, i) if 0 < x[k] < 1), -1)
    return x


def settle(sizes: np.ndarray, x: np.ndarray, over: float) -> np.ndarray:
    """x of 0 and 1 with about `over` words less: the largest documents that fit change, one after another, and at
    last a taken and an untaken document change places, those whose difference comes nearest to what is left."""
    x = x.copy()
    for i in np.argsort(-sizes, kind="stable"):
        if sizes[i] > 0 and over >= sizes[i] and x[i] == 1:
            x[i], over = 0, over - sizes[i]
        elif sizes[i] > 0 and -over >= sizes[i] and x[i] == 0:
            x[i], over = 1, over + sizes[i]
    ones, zeros = (np.flatnonzero((x == v) & (sizes > 0)) for v in (1, 0))
    if len(ones) and len(zeros):
        zeros = zeros[np.argsort(sizes[zeros], kind="stable")]
        at = np.searchsorted(sizes[zeros], sizes[ones] - over)
        near = np.stack([np.clip(at - 1, 0, len(zeros) - 1), np.clip(at, 0, len(zeros) - 1)])
        left = np.abs(over - (sizes[ones] - sizes[zeros[near]]))
        k, i = np.unravel_index(left.argmin(), left.shape)
        if left[k, i] < abs(over):
            x[ones[i]], x[zeros[near[k, i]]] = 0, 1
    return x


def _uniform(level: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(f"level {level}"), "doc_id", "fp_", "source"), F.lit(1 << 40)) / float(1 << 40)


def _met(units: DataFrame, level: int) -> DataFrame:
    """units after those of each source and bucket have met."""

    def run(pdf):
        pdf = pdf.sort_values(["u_", "doc_id", "size"], kind="stable", ignore_index=True)
        return pdf.assign(x_=pivot(pdf["size"].to_numpy(float), pdf["x_"].to_numpy(), pdf["u_"].to_numpy())).drop(columns="u_")

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in units.schema)
    return units.withColumn("u_", _uniform(level)).groupBy("source", "bucket_").applyInPandas(run, schema)


def mix_copies(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, limit: float = LIMIT, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, source, fp_ (hash of the text), size, source_size, target and copies of every document.

    Words are counted in whole texts (null: none). Coins are hashes of id, text and source, and buckets too, so reruns
    agree. A source's words come to its target but for less than its smallest
    documents, as far as one bucket can settle. Null sources are one source, the last; a source without
    words has target 0 and its documents 0 copies; an empty document is taken floor(f) times or once more by its own coin.
    """
    sized = written(docs.select("doc_id", "source", F.xxhash64("text").alias("fp_"), n_words(F.col("text")).alias("size")), "sizes")
    sums = written(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.floor(F.count("*") / bucket_rows + 1).cast("int").alias("buckets_")), "sources")
    sources = source_targets(sums.drop("buckets_"), weights, share, limit).withColumnRenamed("source", "source_key_")
    sources = written(sources.join(sums.select("source", "buckets_"), F.col("source").eqNullSafe(F.col("source_key_"))).drop("source"), "targets")
    buckets = sums.agg(F.max("buckets_")).first()[0] or 1
    f = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    frac = f - F.floor(f)
    frac = F.when(F.col("size") > 0, frac).otherwise((_uniform(-1) < frac).cast("double"))
    # Equal rows are numbered, so that a row that a table repeats very often fills buckets, not one.
    same = Window.partitionBy("doc_id", "source", "fp_").orderBy("size")
    sized = sized.withColumn("part_", F.floor(F.row_number().over(same) / bucket_rows))
    units = sized.join(sources, F.col("source").eqNullSafe(F.col("source_key_"))).select(
        "doc_id", "source", "fp_", "size", "source_size", "target", F.floor(f).cast("int").alias("whole_"), frac.alias("x_"),
        F.pmod(F.xxhash64(F.lit("bucket"), "doc_id", "fp_", "source", "part_"), F.col("buckets_")).cast("int").alias("bucket_"),
    )
    is_open = (F.col("x_") > 0) & (F.col("x_") < 1)
    first = written(_met(units, 0), "mixed")
    below, decided, level = first.where(is_open), [], 1
    while buckets > 1:
        buckets = -(-buckets // FAN)
        met = written(_met(below.withColumn("bucket_", F.floor(F.col("bucket_") / FAN).cast("int")), level), "mixed")
        decided.append(met.where(~is_open))
        below, level = met.where(is_open), level + 1
    # A row for each source at most is left: it is rounded, and its source's first bucket makes up for it.
    last = written(below.withColumns({"y_": (_uniform(level) < F.col("x_")).cast("double")}), "last")
    decided.append(last.withColumn("x_", F.col("y_")).drop("y_"))
    over = last.select("source", ((F.col("y_") - F.col("x_")) * F.col("size")).alias("over_"))
    home = first.where(~is_open).groupBy("source").agg(F.min("bucket_").alias("home_"))
    task = home.join(over, home["source"].eqNullSafe(over["source"])).select(home["source"].alias("source_key_"), "home_", "over_")
    closed = first.where(~is_open).join(task, F.col("source").eqNullSafe(F.col("source_key_")) & (F.col("bucket_") == F.col("home_")), "left").drop("source_key_", "home_")

    def run(pdf):
        pdf = pdf.sort_values(["doc_id", "fp_", "size"], kind="stable", ignore_index=True)
        return pdf.assign(x_=settle(pdf["size"].to_numpy(float), pdf["x_"].to_numpy(), float(pdf["over_"].iloc[0]))).drop(columns="over_") if len(pdf) else pdf.drop(columns="over_")

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in first.schema)
    settled = closed.where(F.col("over_").isNotNull()).groupBy("source").applyInPandas(run, schema)
    out = closed.where(F.col("over_").isNull()).drop("over_").unionByName(settled)
    for part in decided:
        out = out.unionByName(part)
    return out.select("doc_id", "source", "fp_", "size", "source_size", "target", (F.col("whole_") + F.round("x_").cast("int")).alias("copies"))


def mix_digest(docs: DataFrame) -> DataFrame:
    out = mix_copies(docs)
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """docs, each as often as the mix takes it. Rows equal in id, source and text share their copies evenly."""
    key = ["doc_id", "source", "fp_"]
    copies = mix_copies(docs, weights, share, limit).groupBy(*key).agg(F.sum("copies").alias("copies_"), F.count("*").alias("rows_"))
    copies = copies.select(*[F.col(c).alias(f"{c}k") for c in key], "copies_", "rows_")
    on = [F.col(c).eqNullSafe(F.col(f"{c}k")) for c in key]
    rows = docs.select(whole_row(docs), "doc_id", "source", F.xxhash64("text").alias("fp_")).join(copies, on)
    # Rows that differ in other columns only are told apart by these, so that a task that runs again deals copies alike.
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(F.xxhash64("row_"), F.to_json("row_"))) - 1
    share_ = F.floor((F.col("nth_") + 1) * F.col("copies_") / F.col("rows_")) - F.floor(F.col("nth_") * F.col("copies_") / F.col("rows_"))
    many = rows.where("rows_ > 1").withColumn("nth_", nth).withColumn("copies_", share_.cast("long")).drop("nth_")
    taken = rows.where("rows_ = 1").unionByName(many).where("copies_ > 0")
    return taken.withColumn("copy_", F.explode(F.sequence(F.lit(1), F.col("copies_").cast("int")))).select(*row_columns(docs))
