"""Candidate retrieval: an inverted index of rare weighted keys and a top-k set-similarity join.

Everything is keyed by country, so labels never mix and new ones need no code. A key's frequency is capped on the index side
before the join, so no key can match more than its cap. Pairs are never shuffled: a task gets the postings of a block of the index
and a part of the queries, sums the weights of each query's keys and lets go of all but its k best.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import keys as K
from tessera.functions import tables as T
from tessera.sources.stage import staged

#: Scores are compared to six places, so that the order of a sum can't decide.
PLACES = 6
KEY = ["country", "kind", "key"]
#: Pairs that one task makes of a key at most; a key that makes more is dealt over parts by the queries' hash.
PART_PAIRS = 4_000_000
#: Index records of a block; parts of the queries at least; pairs that one cell (block and part) makes, about; pairs made at once in one.
BLOCK, PARTS, CELL_PAIRS, STEP_PAIRS = 200_000, 12, 500_000_000, 1_000_000


def _long(records: DataFrame, keys: dict[str, Column]) -> DataFrame:
    return records.select("country", F.col("entity_id").alias("id"), F.explode(K.long_form(keys)).alias("k")).select("country", "id", "k.kind", "k.key")


def v3_record_keys(records: DataFrame) -> DataFrame:
    """(country, id, kind, key) of normalized records, and the exact name as kind `exact`."""
    return _long(K.with_v3_lists(records), K.v3_keys())


def v1_record_keys(records: DataFrame) -> DataFrame:
    return _long(K.with_v1_lists(records), K.v1_keys())


def exact_groups(index_keys: DataFrame) -> DataFrame:
    """Number of index records for each exact name."""
    return index_keys.where(F.col("kind") == "exact").groupBy("country", F.col("key").alias("exact")).agg(F.count("*").alias("n"))


def resolved(keys: DataFrame, groups: DataFrame, small: int = T.EXACT_SMALL, large: int = T.EXACT_LARGE) -> DataFrame:
    """keys with kind `exact` resolved: small groups match outright, larger ones only together with the number
    signature or a long number, groups over `large` not at all."""
    own = keys.where(F.col("kind") == "exact").select("country", "id", F.col("key").alias("exact"))
    own = own.join(groups.where(F.col("n") <= large), ["country", "exact"])
    alone = own.where(F.col("n") <= small).select("country", "id", F.lit("exact").alias("kind"), F.concat(F.lit("ex|"), "exact").alias("key"))
    numbers = keys.where(F.col("kind").isin("sig", "num"))
    tag = F.when(F.col("kind") == "sig", "exs|").otherwise("exn|")
    both = own.where(F.col("n") > small).join(numbers, ["country", "id"]).select("country", "id", F.lit("exact").alias("kind"), F.concat(tag, "exact", F.lit("|"), "key").alias("key"))
    return keys.where(F.col("kind") != "exact").unionByName(alone).unionByName(both)


def cap_of(specs: dict[str, tuple], kind: Column, n: Column, scale: float = 1.0) -> Column:
    """The largest number of index records a key of a kind may have, for an index of n records."""
    open_cap = F.least(F.lit(25000), F.greatest(F.lit(80), F.floor(n / 400)))
    out = open_cap
    for name, (cap, _) in specs.items():
        if cap:
            out = F.when(kind == name, F.lit(max(20, int(cap * scale)))).otherwise(out)
    return out.cast("long")


def key_weights(index_keys: DataFrame, specs: dict[str, tuple], scale: float = 1.0) -> DataFrame:
    """(country, kind, key, df, w): keys within their cap and their weight, kind weight * ln((n + 1) / df); exact
    keys weigh EXACT_WEIGHT. n is the country's number of index records that have a key."""
    sizes = index_keys.groupBy("country").agg(F.countDistinct("id").alias("n_"))
    df = index_keys.groupBy("country", "kind", "key").agg(F.count("*").alias("df"))
    factor = F.create_map(*[F.lit(x) for kind, (_, w) in specs.items() for x in (kind, float(w))])
    idf = F.try_element_at(factor, F.col("kind")) * F.log((F.col("n_") + 1) / F.col("df"))
    cap = F.when(F.col("kind") == "exact", F.lit(2**62)).otherwise(cap_of(specs, F.col("kind"), F.col("n_"), scale))
    return df.join(sizes, "country").where(F.col("df") <= cap).select("country", "kind", "key", "df", F.when(F.col("kind") == "exact", F.lit(T.EXACT_WEIGHT)).otherwise(idf).alias("w"))


def key_parts(query_keys: DataFrame, weights: DataFrame, most: int = PART_PAIRS) -> DataFrame:
    """(country, kind, key, parts) of keys that make over `most` pairs. There are few: at most one for `most` pairs in all."""
    n = query_keys.groupBy(*KEY).agg(F.count("*").alias("n_"))
    parts = F.ceil(F.col("df") * F.col("n_") / most).cast("int")
    return weights.join(n, KEY).select(*KEY, parts.alias("parts")).where("parts > 1")


def scored_pairs(query_keys: DataFrame, index_keys: DataFrame, weights: DataFrame, most: int = PART_PAIRS) -> DataFrame:
    """(country, q_id, s_id, score): the weighted number of keys that two records share.

    The plain definition that best_pairs() is compared with. The postings of a key that very many queries have are copied to each of
    its parts, so no task makes all of its pairs.
    """
    parts = staged(key_parts(query_keys, weights, most), "key-parts")
    of = F.coalesce("parts", F.lit(1))
    postings = index_keys.join(weights, KEY).join(parts, KEY, "left")
    postings = postings.select(*KEY, F.explode(F.sequence(F.lit(0), of - 1)).alias("part"), F.col("id").alias("s_id"), "w")
    queries = query_keys.join(parts, KEY, "left").select(*KEY, F.pmod(F.xxhash64("id"), of).cast("int").alias("part"), F.col("id").alias("q_id"))
    pairs = queries.join(postings, [*KEY, "part"])
    return pairs.groupBy("country", "q_id", "s_id").agg(F.round(F.sum("w"), PLACES).alias("score"))


def top_k(pairs: DataFrame, k: int, min_score: float | None = None) -> DataFrame:
    """The k best candidates of every query by score, then id, with rank from 0; those under min_score go after the cut."""
    w = Window.partitionBy("country", "q_id").orderBy(F.desc("score"), "s_id")
    out = pairs.withColumn("rn_", F.row_number().over(w)).where(F.col("rn_") <= k)
    out = out if min_score is None else out.where(F.col("score") >= min_score)
    return out.select("country", "q_id", "s_id", (F.col("rn_") - 1).alias("rank"), "score")


def numbered(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(country, id, nth), the ids of records in order of country and id, from 0 without gaps; and records with nth as entity_id."""
    spark = records.sparkSession
    found = records.select("country", F.col("entity_id").alias("id")).distinct().orderBy("country", "id")
    found = staged(found.select("country", "id", F.monotonically_increasing_id().alias("at_")), "index-order")
    part = F.shiftright("at_", 33)
    offsets, n = [], 0
    for r in found.groupBy(part.alias("part_")).agg(F.count("*").alias("n")).orderBy("part_").collect():
        offsets.append((r.part_, n - (r.part_ << 33)))
        n += r.n
    moved = spark.createDataFrame(offsets, "part_ long, offset_ long")
    ids = found.withColumn("part_", part).join(F.broadcast(moved), "part_").select("country", "id", (F.col("at_") + F.col("offset_")).cast("int").alias("nth"))
    own = ids.select("country", F.col("id").alias("entity_id"), "nth")
    return ids, records.join(own, ["country", "entity_id"]).drop("entity_id").withColumnRenamed("nth", "entity_id")


def postings(index_keys: DataFrame, weights: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """weights with a number key_ of each key, and (block, key_, w, ids): the numbers of the index records that have a key, by block."""
    known = staged(weights.withColumn("key_", F.monotonically_increasing_id()), "weights")
    rows = index_keys.join(known.select(*KEY, "key_", "w"), KEY).withColumn("block", F.expr(f"id div {block}").cast("int"))
    return known, staged(rows.groupBy(*KEY, "key_", "w", "block").agg(F.collect_list("id").alias("ids")).select("block", "key_", "w", "ids"), "postings")


def best_pairs(query_keys: DataFrame, known: DataFrame, lists: DataFrame, ids: DataFrame, k: int, min_score: float | None = None, block: int = BLOCK, cell_pairs: int = CELL_PAIRS) -> DataFrame:
    """top_k() of scored_pairs(), of postings() and the index's numbered() ids.

    Queries are dealt to parts by hash and go to the blocks that hold records of their country; postings go to every part.
    """
    keys = query_keys.join(known.select(*KEY, "key_", "df"), KEY).groupBy("country", F.col("id").alias("q_id"))
    queries = staged(keys.agg(F.collect_list("key_").alias("keys"), F.sum("df").alias("pairs")), "query-lists")
    blocks = ids.groupBy("country").agg(F.min("nth").alias("low_"), F.max("nth").alias("high_"))
    last = blocks.agg(F.max("high_")).first()[0]
    n_blocks = 1 + (last or 0) // block
    n_parts = max(PARTS, -(-(queries.agg(F.sum("pairs")).first()[0] or 0) // (cell_pairs * n_blocks)))
    of = F.explode(F.sequence(F.expr(f"low_ div {block}").cast("int"), F.expr(f"high_ div {block}").cast("int"))).alias("block")
    used = queries.select(F.explode("keys").alias("key_")).distinct()
    left = lists.join(used, "key_", "left_semi").select("block", F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1))).alias("part"), F.lit(0).alias("side"), "key_", "w", "ids", *[F.lit(None).cast(t).alias(c) for c, t in (("country", "string"), ("q_id", "string"), ("keys", "array<long>"))])
    right = queries.join(F.broadcast(blocks), "country").select(
        of, F.pmod(F.xxhash64("q_id"), F.lit(n_parts)).cast("int").alias("part"), F.lit(1).alias("side"),
        *[F.lit(None).cast(t).alias(c) for c, t in (("key_", "long"), ("w", "double"), ("ids", "array<int>"))], "country", F.col("q_id").cast("string").alias("q_id"), "keys",
    )
    cells = left.unionByName(right).repartitionById(n_blocks * n_parts, (F.col("block") * n_parts + F.col("part")).cast("int")).sortWithinPartitions("side")
    found = cells.drop("block", "part").mapInArrow(best_of_cell(k), "country string, q_id string, nth array<int>, score array<double>")
    rows = found.select("country", "q_id", F.posexplode(F.arrays_zip("nth", "score")).alias("rank", "x")).select("country", "q_id", F.col("x.nth").alias("s_id"), "rank", F.col("x.score").alias("score"))
    rows = rows if n_blocks == 1 else top_k(rows, k)
    rows = rows if min_score is None else rows.where(F.col("score") >= min_score)
    rows = rows.withColumnRenamed("s_id", "nth").join(ids.select("nth", F.col("id").alias("s_id")), "nth")
    return rows.select("country", "q_id", "s_id", "rank", "score")


def best_of_cell(k: int) -> Callable:
    """The rows of a cell, postings first, to the k best records of each query; scores are rounded to PLACES, equal ones go by number."""

    def run(batches: Iterator) -> Iterator:
        keys, weights, sizes, values, index = [], [], [], [], None
        for b in batches:
            side = b.column("side").to_numpy()
            at = int(np.searchsorted(side, 1))
            if at:
                p = b.slice(0, at)
                lists = p.column("ids")
                keys.append(p.column("key_").to_numpy(zero_copy_only=False))
                weights.append(p.column("w").to_numpy(zero_copy_only=False))
                sizes.append(lists.value_lengths().to_numpy(zero_copy_only=False))
                values.append(lists.flatten().to_numpy())
            if at < len(side) and keys:
                if index is None:
                    index = _Block(*map(np.concatenate, (keys, weights, sizes, values)))
                    weights, sizes, values = [], [], []
                yield from index.best(b.slice(at), k)

    return run


class _Block:
    """The postings of a block of the index, in memory."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, sizes: np.ndarray, values: np.ndarray):
        order, starts = np.argsort(keys), np.cumsum(sizes, dtype=np.int64) - sizes
        self.keys, self.weights, self.sizes, self.starts = keys[order], weights[order], sizes[order].astype(np.int64), starts[order]
        self.low = int(values.min())
        self.values = values - self.low
        n = int(self.values.max()) + 1
        self.sums, self.seen = np.zeros(n), np.zeros(n, np.int64)

    def best(self, queries: pa.RecordBatch, k: int) -> Iterator[pa.RecordBatch]:
        lists = queries.column("keys")
        lengths, flat = lists.value_lengths().to_numpy(zero_copy_only=False), lists.flatten().to_numpy()
        at = np.minimum(np.searchsorted(self.keys, flat), len(self.keys) - 1)
        hit = self.keys[at] == flat
        owner = np.repeat(np.arange(len(lengths)), lengths)[hit]
        at = at[hit]
        ends = np.cumsum(np.bincount(owner, minlength=len(lengths)))
        pairs = np.concatenate([[0], np.cumsum(self.sizes[at])])
        ids, scores, counts, first = [], [], np.zeros(len(lengths), np.int64), 0
        while first < len(lengths):  # as many queries as make STEP_PAIRS, one at least
            low = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(pairs[ends], pairs[low] + STEP_PAIRS, "right")))
            mine = at[low : ends[last - 1]]
            n = self.sizes[mine]
            base = pairs[low : ends[last - 1]] - pairs[low]
            found = self.values[np.arange(int(n.sum())) + np.repeat(self.starts[mine] - base, n)]
            weights = np.repeat(self.weights[mine], n)
            for q in range(first, last):
                a, b = (int(pairs[ends[q - 1]]) if q else 0) - int(pairs[low]), int(pairs[ends[q]]) - int(pairs[low])
                if a < b:
                    u, s = self.one(found[a:b], weights[a:b], k)
                    counts[q] = len(u)
                    ids.append(u)
                    scores.append(s)
            first = last
        full = np.flatnonzero(counts)
        if len(full):
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts[full])]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x).astype(t))) for x, t in ((ids, np.int32), (scores, np.float64))]
            yield pa.RecordBatch.from_arrays([*(queries.column(c).take(pa.array(full)) for c in ("country", "q_id")), *lists], ["country", "q_id", "nth", "score"])

    def one(self, found: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best of one query's postings, which hold a record as often as it shares keys."""
        np.add.at(self.sums, found, weights)
        order = np.arange(len(found))
        self.seen[found] = order
        u = found[self.seen[found] == order]
        s = self.sums[u] * 10**PLACES
        self.sums[u] = 0
        whole = np.floor(s)
        s = (whole + (s - whole >= 0.5)) / 10**PLACES
        if len(u) > k:
            kept = s >= np.partition(s, len(s) - k)[len(s) - k]
            u, s = u[kept], s[kept]
        best = np.lexsort((u, -s))[:k]
        return u[best] + self.low, s[best]


def retrieve(index: DataFrame, queries: DataFrame, k: int = 20, scale: float = 1.0) -> DataFrame:
    """v3: candidates in the index (normalized Source-1 records) for every other normalized record."""
    ids, index = numbered(index)
    ik, qk = staged(v3_record_keys(index), "index-keys"), staged(v3_record_keys(queries), "query-keys")
    groups = exact_groups(ik)
    ik, qk = resolved(ik, groups), resolved(qk, groups)
    return best_pairs(qk, *postings(ik, key_weights(ik, T.V3_KEYS, scale)), ids, k)


def block(s1: DataFrame, candidates: DataFrame, k: int = 200, min_score: float = 1.0) -> DataFrame:
    """v1: candidates for every Source-1 record; frequencies are counted among the candidates."""
    ids, candidates = numbered(candidates)
    ck, sk = staged(v1_record_keys(candidates), "candidate-keys"), staged(v1_record_keys(s1), "s1-keys")
    groups = exact_groups(ck)
    ck, sk = resolved(ck, groups), resolved(sk, groups)
    pairs = best_pairs(sk, *postings(ck, key_weights(ck, T.V1_KEYS)), ids, k, min_score)
    return pairs.select("country", F.col("q_id").alias("s1_id"), F.col("s_id").alias("candidate_id"), "rank", "score")
