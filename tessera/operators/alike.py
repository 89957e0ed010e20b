"""Pairs of sets that may be alike (Jaccard of 0.8 or more): an exact prefix filter, with lengths and positions, over hashes of the members.

Members have one order, rare ones first. The first that two alike sets share is among the first n - ceil(0.8 n) + 1 of each, and
no more follow it than either set has left. What order is taken doesn't matter for that; frequencies in a sample only keep pairs few.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.stage import staged

#: Sets in the sample; members that it ranks at most; pairs looked at in one step; counts of a mark.
SAMPLE, RANKED, STEP, BUCKETS = 20_000, 200_000, 4_000_000, 256
NONE = np.iinfo(np.int64).max


def frequent(sets: DataFrame, most: int = SAMPLE) -> np.ndarray:
    """Hashes of members that occur often in a sample of the sets (id, hs), the most frequent first."""
    n = sets.count()
    some = sets.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < -(-(most << 20) // max(n, 1)))
    counts = some.select(F.explode("hs").alias("h")).groupBy("h").agg(F.count("*").alias("n")).where("n >= 4")
    return counts.orderBy(F.desc("n"), "h").limit(RANKED).select("h").toArrow().column("h").to_numpy()


def prefixes(common: np.ndarray) -> Callable:
    """(id, hs) to (h, set_, n, pos, id): the members that two alike sets must share one of; set_ is a hash of the whole set."""
    order = np.argsort(common)
    known, rank = common[order], len(common) - order

    def run(batches: Iterator) -> Iterator:
        for b in batches:
            lists = b.column("hs")
            n, flat = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten().to_numpy()
            if not len(flat):
                continue
            owner = np.repeat(np.arange(len(n)), n)
            ranks = np.zeros(len(flat), np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
                ranks = np.where(known[at] == flat, rank[at], 0)
            starts = np.cumsum(n) - n
            sets = np.zeros(len(n), np.int64)
            sets[n > 0] = np.add.reduceat(flat, starts[n > 0])  # wraps around
            flat = flat[np.lexsort((flat, ranks, owner))]
            pos = np.arange(len(flat)) - starts[owner]
            kept = pos < (n - (4 * n + 4) // 5 + 1)[owner]
            mine = owner[kept]
            columns = (flat[kept], sets[mine], n[mine].astype(np.int32), (pos[kept] + 1).astype(np.int32), b.column("id").to_numpy(zero_copy_only=False)[mine])
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], ["h", "set_", "n", "pos", "id"])

    return run


def pairs_of_members(batches: Iterator) -> Iterator:
    """Rows of prefixes(), those of an h together, to (q, s): ids not divisible by 3 with ids divisible by 3, the least of equal sets;
    sets with both kinds of ids need no pairs."""
    held: list[tuple] = []
    for b in batches:
        rows = tuple(c.to_numpy(zero_copy_only=False) for c in b.columns)
        if not len(rows[0]):
            continue
        last = int(np.argmax(rows[0] == rows[0][-1]))  # where the last h begins; the rest of its rows may follow
        if last or held and held[-1][0][-1] != rows[0][0]:
            yield from _paired(*map(np.concatenate, zip(*held, tuple(c[:last] for c in rows))))
            held = []
        held.append(tuple(c[last:] for c in rows))
    if held:
        yield from _paired(*map(np.concatenate, zip(*held)))


def _paired(h: np.ndarray, sets: np.ndarray, n: np.ndarray, pos: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
    order = np.lexsort((pos, n, sets, h))
    h, sets, n, pos, ids = (x[order] for x in (h, sets, n, pos, ids))
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (sets[1:] != sets[:-1]) | (n[1:] != n[:-1]) | (pos[1:] != pos[:-1])
    at = np.flatnonzero(new)
    q, s = (np.minimum.reduceat(np.where(x, ids, NONE), at) for x in (ids % 3 != 0, ids % 3 == 0))
    h, n, pos = h[at], n[at].astype(np.int64), pos[at].astype(np.int64)
    left, right = np.flatnonzero(s == NONE), np.flatnonzero(s != NONE)
    low, high = (np.searchsorted(h[right], h[left], side) for side in ("left", "right"))
    ends = np.concatenate([[0], np.cumsum(high - low)])
    first = 0
    while first < len(left):  # as many rows as make STEP pairs, one at least
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + STEP, "right")) - 1)
        count = (high - low)[first:last]
        a = np.repeat(left[first:last], count)
        b = right[np.arange(int(count.sum())) + np.repeat(low[first:last] - (ends[first:last] - ends[first]), count)]
        ok = (5 * n[b] >= 4 * n[a]) & (5 * n[a] >= 4 * n[b]) & (9 * (1 + np.minimum(n[a] - pos[a], n[b] - pos[b])) >= 4 * (n[a] + n[b]))
        found = np.unique(np.stack([q[a[ok]], s[b[ok]]]), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], ["q", "s"])
        first = last


def candidates(rows: DataFrame, members: Column) -> DataFrame:
    """(q, s), each once, of rows with a column id (no nulls) and an array of distinct members."""
    sets = rows.select("id", F.transform(members, lambda x: F.xxhash64(x)).alias("hs"))
    firsts = sets.mapInArrow(prefixes(frequent(sets)), "h long, set_ long, n int, pos int, id long")
    return firsts.repartition("h").sortWithinPartitions("h").mapInArrow(pairs_of_members, "q long, s long").distinct()


def grouped(pairs: DataFrame, members: DataFrame, compare: Callable, schema: str) -> DataFrame:
    """compare() of pairs (q, s) with the rows of members (id, x) that they need.

    Pairs are dealt by the least s of their q, which near copies have in common, so a set goes to few tasks.
    """
    dealt = pairs.join(pairs.groupBy("q").agg(F.min("s").alias("group_")), "q").select("group_", "q", "s")
    needed = dealt.select(F.col("group_").alias("of_"), F.explode(F.array("q", "s")).alias("id")).distinct()
    needed = needed.join(members.join(F.broadcast(pairs.select(F.explode(F.array("q", "s")).alias("id")).distinct()), "id"), "id")
    return dealt.groupBy("group_").cogroup(needed.groupBy("of_")).applyInPandas(compare, schema)


def alike(rows: DataFrame, members: Column) -> DataFrame:
    """(q, s, c, u) of rows with a column id (long, no nulls) and an array of distinct members: pairs of ids not divisible by 3 with
    ids divisible by 3 that are alike, and how many members both have, and either. Of equal sets the least id stands for all."""
    found = staged(candidates(rows, members), "pairs")
    marks = rows.select("id", F.transform(members, lambda x: F.xxhash64(x)).alias("hs")).mapInArrow(marked, "id long, x binary")
    left = staged(grouped(found, marks, possible, "q long, s long"), "possible-pairs")
    return grouped(left, rows.select("id", members.alias("x")), compared, "q long, s long, c long, u long")


def marked(batches: Iterator) -> Iterator:
    """(id, hs) to (id, x): the number of members, and how many fall in each of BUCKETS, up to 255. The differences of two such counts,
    summed, are at most the members that only one set has, whatever is over 255."""
    for b in batches:
        lists = b.column("hs")
        n = lists.value_lengths().to_numpy(zero_copy_only=False)
        at = np.repeat(np.arange(len(n)), n) * BUCKETS + lists.flatten().to_numpy() % BUCKETS
        counts = np.minimum(np.bincount(at, minlength=len(n) * BUCKETS), 255).astype(np.uint8).reshape(-1, BUCKETS)
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([np.int64(k).tobytes() + c.tobytes() for k, c in zip(n, counts)], pa.binary())], ["id", "x"])


def possible(pairs: pd.DataFrame, needed: pd.DataFrame) -> pd.DataFrame:
    """The pairs of one group that can be alike by their counts of marked()."""
    sizes = {i: int(np.frombuffer(x[:8], np.int64)[0]) for i, x in zip(needed["id"], needed["x"])}
    of = {i: np.frombuffer(x[8:], np.uint8).astype(np.int64) for i, x in zip(needed["id"], needed["x"])}
    apart = np.array([abs(of[q] - of[s]).sum() for q, s in zip(pairs["q"], pairs["s"])])
    both = np.array([sizes[q] + sizes[s] for q, s in zip(pairs["q"], pairs["s"])])
    return pairs.loc[9 * apart <= both, ["q", "s"]]


def compared(pairs: pd.DataFrame, needed: pd.DataFrame) -> pd.DataFrame:
    """The pairs of one group that are alike, compared member by member."""
    numbers: dict[str, int] = {}
    of = {i: np.array([numbers.setdefault(w, len(numbers)) for w in ws], np.int64) for i, ws in zip(needed["id"], needed["x"])}
    seen, out = np.zeros(len(numbers), bool), []
    for q, partners in pairs.groupby("q")["s"]:
        seen[of[q]] = True
        for s in partners:
            c = int(seen[of[s]].sum())
            u = len(of[q]) + len(of[s]) - c
            if 100 * c >= 80 * u:
                out.append((q, s, c, u))
        seen[of[q]] = False
    return pd.DataFrame(out, columns=["q", "s", "c", "u"], dtype="int64")
