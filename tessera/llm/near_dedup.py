"""Near-duplicate documents by MinHash and an LSH forest; links are confirmed on full shingle sets.

1. Each text becomes the hashes of its distinct word shingles, a fingerprint of that set, and DEPTH minima for
   each of TREES orders. Documents with equal sets are one class, named by its smallest id.
2. The forest: each order is all classes sorted by their minima. Within a sorted run, classes up to NEAR places apart
   whose common prefix is LEAST levels or longer are candidates; deeper levels bring the most similar of a large
   region together. Pairs whose other minima hardly agree are left out.
3. Candidates are joined to tentative groups. Each class of a group is sent, once, to the task of its group, which finds the
   exact components there: every pair that could matter is compared on full sets.
4. A group over GROUP classes is cut into regions of the forest instead, each as deep as it takes to be small enough, which
   finds most links. An exact join on the rarest shingles of each set then compares every pair of such a group that
   could be linked and isn't connected yet; what it adds is joined again.
5. Runs longer than NEAR places are chains: the components that a chain joins are compared by the same exact join. So any pair that
   shares a prefix of LEAST levels in one order is compared, however many classes stand between.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import row_columns, trim, whole_row, written

TREES, DEPTH, LEAST = 20, 8, 4
#: Classes that are neighbours in a sorted order.
NEAR = 3
#: Minima of each order that tell whether a pair is worth comparing, and how many of all must agree (half; at a
#: similarity of 0.8 that is six standard deviations below the mean).
SKETCHED, AGREE = 3, 0.5
#: Classes of a group that one task compares, and of a region of larger groups.
GROUP, REGION = 1000, 400
#: Rows of a shingle that one task of the exact join pairs with as many others; buckets that count shingles.
HOT, BUCKETS = 2000, 1 << 18
#: Edges that one task joins in memory (a few MB).
LOCAL = 200_000
NO_ID = -(2**63)

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of `words` words (A-Z lower-cased) of a whole text.

    Fewer words are one shingle; no words give none.
    """
    import xxhash

    found = (text or "").encode().lower().split()  # bytes: A-Z only, and exactly the white space that counts
    if not found:
        return np.empty(0, np.uint64)
    h = np.array(list(map(xxhash.xxh3_64_intdigest, found)), np.uint64)
    n = min(words, len(h))
    out = np.full(len(h) - n + 1, np.uint64(n))
    for i in range(n):
        out = _mix(out * _M1 + h[i : len(h) - n + 1 + i])
    return np.unique(out)


def _factors() -> np.ndarray:
    return np.random.default_rng(20141).integers(0, 2**31, TREES * DEPTH, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def signature(found: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Minima of the shingles' hashes under TREES * DEPTH multiplications, 16 bits each."""
    x = (found >> np.uint64(32)).astype(np.uint32)
    low = np.full(len(factors), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 2048):
        np.minimum(low, (factors[:, None] * x[None, i : i + 2048]).min(axis=1), out=low)
    return ((low * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(">u2")


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """id_ (null: NO_ID), n_shingles, the set's fingerprint (a_, b_) and its minima of every document."""

    def run(batches: Iterable) -> Iterator:
        import pandas as pd

        factors = _factors()
        for pdf in batches:
            rows = []
            for t in pdf["text"]:
                s = shingles(t, words)
                a, b = (int(_mix(s ^ m).sum(dtype=np.uint64).view(np.int64)) for m in (_M1, _M3))
                rows.append((len(s), a, b, signature(s, factors).tobytes() if len(s) else b""))
            out = pd.DataFrame(rows, columns=["n_shingles", "a_", "b_", "minima_"])
            out.insert(0, "id_", pdf["id_"].to_numpy())
            yield out
        trim()

    ids = F.coalesce("doc_id", F.lit(NO_ID)).alias("id_")
    return docs.select(ids, "text").mapInPandas(run, "id_ long, n_shingles long, a_ long, b_ long, minima_ binary")


def _forest(classes: DataFrame) -> DataFrame:
    """(tree_, key_, id_), range-partitioned and sorted: all orders, dealt evenly even within one key."""
    tree = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree_")
    rows = classes.select("id_", "minima_", tree)
    rows = rows.select("tree_", F.substring("minima_", F.col("tree_") * (2 * DEPTH) + 1, F.lit(2 * DEPTH)).alias("key_"), "id_")
    return rows.repartitionByRange("tree_", "key_", "id_").sortWithinPartitions("tree_", "key_", "id_")


def _prefixes(trees: np.ndarray, keys: list[bytes]) -> np.ndarray:
    """Common levels of each sorted row with the next; -1 across orders."""
    k = np.frombuffer(b"".join(keys), ">u2").reshape(-1, DEPTH)
    same = np.cumprod(k[:-1] == k[1:], axis=1).sum(axis=1)
    return np.where(trees[:-1] == trees[1:], same, -1)


def neighbours(classes: DataFrame) -> DataFrame:
    """(a, b, sure) of classes in one run of an order, where all share a prefix of LEAST levels or more.

    a < b, not sure: all pairs up to NEAR apart. sure: next to each other in a run that is too long for all its
    pairs to be among these, or that a range of the sorted order begins or ends with, and across ranges.
    """

    def run(batches: Iterable) -> Iterator:
        import pandas as pd
        from pyspark import TaskContext

        part = 2 * TaskContext.get().partitionId()

        def edges(a: np.ndarray, b: np.ndarray, sure: bool):
            both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
            return pd.DataFrame({"a": both[0], "b": both[1], "sure": sure, "part": None, "tree_": None, "key_": None})

        def end(row, at: int):
            return pd.DataFrame({"a": [row["id_"]], "b": None, "sure": None, "part": at, "tree_": row["tree_"], "key_": [bytes(row["key_"])[: 2 * LEAST]]})

        last, opening = None, True
        for pdf in batches:
            if not len(pdf):
                continue
            if last is None:
                yield end(pdf.iloc[0], part)
            pdf = pdf if last is None else pd.concat([last, pdf], ignore_index=True)
            last = pdf.tail(NEAR + 1)
            ids, lcp = pdf["id_"].to_numpy(), _prefixes(pdf["tree_"].to_numpy(), pdf["key_"].tolist())
            least = lcp
            for d in range(1, min(NEAR + 1, len(ids))):
                least = lcp if d == 1 else np.minimum(least[:-1], lcp[d - 1 :])
                at = np.flatnonzero(least >= LEAST)
                yield edges(ids[at], ids[at + d], False)
            runs = np.concatenate([[0], np.cumsum(lcp < LEAST)])
            long = np.bincount(runs) > NEAR + 1
            long[0] |= opening
            opening &= len(long) == 1
            at = np.flatnonzero((lcp >= LEAST) & long[runs[1:]])
            yield edges(ids[at], ids[at + 1], True)
        if last is not None:
            ids, lcp = last["id_"].to_numpy(), _prefixes(last["tree_"].to_numpy(), last["key_"].tolist())
            begin = int(np.flatnonzero(np.concatenate([[True], lcp < LEAST]))[-1])
            yield edges(ids[begin:-1], ids[begin + 1 :], True)
            yield end(last.iloc[-1], part + 1)

    found = written(_forest(classes).mapInPandas(run, "a long, b long, sure boolean, part int, tree_ int, key_ binary"), "neighbours")
    w = Window.orderBy("part")  # two rows for each range
    after = [F.lead(c).over(w).alias(f"{c}n") for c in ("a", "tree_", "key_")]
    seams = found.where("part IS NOT NULL").select("*", *after).where("part % 2 = 1 AND tree_ = tree_n AND key_ = key_n").select("a", F.col("an").alias("b"), F.lit(True).alias("sure"))
    return found.where("part IS NULL").select("a", "b", "sure").unionByName(seams).where("a <> b").distinct()


def likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """pairs whose sketches (SKETCHED minima of each order, a byte each) agree in AGREE of their places or more."""
    sketch = F.concat(*[F.substring("minima_", t * 2 * DEPTH + 2 * d + 1, 1) for t in range(TREES) for d in range(SKETCHED)])
    sketches = classes.select("id_", sketch.alias("s_"))  # several rows of an id only if documents share it
    with_both = pairs.join(sketches.select(F.col("id_").alias("a"), F.col("s_").alias("x_")), "a").join(sketches.select(F.col("id_").alias("b"), F.col("s_").alias("y_")), "b")

    def run(batches: Iterable) -> Iterator:
        n = TREES * SKETCHED
        for pdf in batches:
            x, y = (np.frombuffer(b"".join(pdf[c]), np.uint8).reshape(-1, n) for c in ("x_", "y_"))
            yield pdf.loc[(x == y).sum(axis=1) >= AGREE * n, ["a", "b"]]

    return with_both.select("a", "b", "x_", "y_").mapInPandas(run, "a long, b long").distinct()


def _joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, least node of the component of each) of edges: labels fall to the least of a neighbour's, and of a label's own label."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def components(edges: DataFrame) -> DataFrame:
    """(id_, root_) of every node of an edge: the smallest node of its component, by alternating stars.

    Each step is written to the shared folder, also the least neighbours: a join of two tables can be split where one node
    has very many edges. Only a count and a checksum reach the driver. As soon as LOCAL edges or fewer are left, one task ends it.
    """

    def least(rows: DataFrame) -> DataFrame:
        return written(rows.groupBy("u").agg(F.min("v").alias("m")), "least")

    def end(batches: Iterable) -> Iterator:
        import pandas as pd

        rows = [pdf.to_numpy(np.int64) for pdf in batches if len(pdf)]
        if rows:
            u, v = np.concatenate(rows).T
            nodes, roots = _joined(u, v)
            yield pd.DataFrame({"id_": nodes, "root_": roots})

    e = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while True:
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if now["n"] <= LOCAL:
            return e.select("u", "v").coalesce(1).mapInPandas(end, "id_ long, root_ long")
        if now == before:
            break
        before = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(least(both), "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).where("u <> v")
        large = written(large.distinct(), "edges")
        small = large.join(least(large), "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.*")
        e = written(small.where("u <> v").distinct(), "edges")
    return e.groupBy(F.col("u").alias("id_")).agg(F.min("v").alias("root_")).unionByName(e.select(F.col("v").alias("id_"), F.col("v").alias("root_")).distinct())


def exact_components(ids: np.ndarray, sets: list[np.ndarray], percent: int) -> np.ndarray:
    """The smallest id of each set's component, where sets are linked if 100 * intersection >= percent * union.

    A search from one set to the next: each set reached is compared with all that are not reached yet, so a
    dense group takes a few passes. Rows with one id are one node.
    """
    sizes = np.array([len(s) for s in sets])
    places = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int64) if len(sets) else np.empty(0, np.int64)
    ends = np.cumsum(sizes)
    parts = [places[e - n : e] for e, n in zip(ends, sizes)]
    label = np.full(len(sets), -1)
    order = np.argsort(ids, kind="stable")
    left = order
    mark = np.zeros(int(places.max()) + 1 if len(places) else 1, np.int64)
    for start in order:
        if label[start] >= 0:
            continue
        label[start], queue = start, [start]
        left = left[label[left] < 0]
        flat = None
        while queue and len(left):
            at = queue.pop()
            if flat is None:
                flat, cuts = np.concatenate([parts[i] for i in left]), np.cumsum(sizes[left]) - sizes[left]
            mark[parts[at]] = 1
            both = np.add.reduceat(mark[flat], cuts)
            mark[parts[at]] = 0
            linked = (100 * both >= percent * (sizes[left] + sizes[at] - both)) | (ids[left] == ids[at])
            if linked.any():
                label[left[linked]] = start
                queue += left[linked].tolist()
                left, flat = left[~linked], None
    return ids[label]


def _by_sets(docs: DataFrame, members: DataFrame, words: int, percent: int) -> DataFrame:
    """(id_, root_): exact components within each group_ of members (id_, group_)."""

    def run(pdf):
        import pandas as pd

        ids = pdf["id_"].to_numpy()
        return pd.DataFrame({"id_": ids, "root_": exact_components(ids, [shingles(t, words) for t in pdf["text"]], percent)})

    texts = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id_"), "text").join(members, "id_")
    return texts.groupBy("group_").applyInPandas(run, "id_ long, root_ long")


def regions(classes: DataFrame, most: int) -> DataFrame:
    """(id_, group_): runs of each order, with a common prefix as long as it takes to have `most` classes or fewer."""

    def run(batches: Iterable) -> Iterator:
        import pandas as pd
        from pyspark import TaskContext

        pdf = pd.concat(list(batches) or [pd.DataFrame({"tree_": [], "key_": [], "id_": []})], ignore_index=True)  # ids and keys of one range
        if len(pdf) < 2:
            return
        lcp, out = _prefixes(pdf["tree_"].to_numpy(), pdf["key_"].tolist()), []

        def cut(begin: int, end: int, depth: int) -> None:
            if end - begin < 2:
                return
            if end - begin <= most and depth >= LEAST:
                out.append((begin, end))
            elif depth > DEPTH:
                out.extend((i, min(i + most, end)) for i in range(begin, end, max(1, most // 2)))  # equal in all levels: runs that overlap
            else:
                stops = [begin, *(begin + 1 + np.flatnonzero(lcp[begin : end - 1] < depth)).tolist(), end]
                for x, y in zip(stops, stops[1:]):
                    cut(x, y, depth + 1)

        cut(0, len(pdf), 0)
        part = TaskContext.get().partitionId() << 40
        for nth, (x, y) in enumerate(out):
            yield pd.DataFrame({"id_": pdf["id_"].to_numpy()[x:y], "group_": part + nth})

    return _forest(classes).mapInPandas(run, "id_ long, group_ long")


def _sets(docs: DataFrame, members: DataFrame, words: int) -> DataFrame:
    """members (id_, group_, root_) with their sets: sorted 64-bit hashes as bytes."""

    def run(batches: Iterable) -> Iterator:
        for pdf in batches:
            sets = [shingles(t, words).tobytes() for t in pdf["text"]]
            yield pdf[["id_", "group_", "root_"]].assign(set_=sets)
        trim()

    texts = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id_"), "text").join(members, "id_")
    return texts.select("id_", "group_", "root_", "text").mapInPandas(run, "id_ long, group_ long, root_ long, set_ binary")


def _bucket_counts(sets: DataFrame) -> np.ndarray:
    """How often shingles of each of BUCKETS buckets occur: a bounded stand-in for the frequency of each."""
    shift = np.uint64(64 - (BUCKETS - 1).bit_length())

    def run(batches: Iterable) -> Iterator:
        import pandas as pd

        counts = np.zeros(BUCKETS, np.int64)
        for pdf in batches:
            for x in pdf["set_"]:
                np.add.at(counts, (np.frombuffer(x, np.uint64) >> shift).astype(np.int64), 1)
        at = np.flatnonzero(counts)
        yield pd.DataFrame({"bucket_": at, "n_": counts[at]})

    found = sets.select("set_").mapInPandas(run, "bucket_ long, n_ long").groupBy("bucket_").agg(F.sum("n_").alias("n_")).toPandas()
    counts = np.zeros(BUCKETS, np.int64)
    counts[found["bucket_"].to_numpy()] = found["n_"].to_numpy()
    return counts


def missing_links(sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): all links between sets of one group_ whose root_ differs, by a prefix-filter join.

    Shingles have one order for all sets, rare ones first. Linked sets of n shingles or more share one of the first
    n - ceil(percent * n / 100) + 1 of each, and behind the first shared one enough are left on both sides. A shingle
    of very many sets is paired in blocks of about HOT rows. Candidates are confirmed on full sets.
    """
    counts, shift = _bucket_counts(sets), np.uint64(64 - (BUCKETS - 1).bit_length())

    def firsts(batches: Iterable) -> Iterator:
        import pandas as pd

        for pdf in batches:
            parts = []
            for i, x in enumerate(pdf["set_"]):
                s = np.frombuffer(x, np.uint64)
                n = len(s)
                first = s[np.lexsort((s, counts[(s >> shift).astype(np.int64)]))][: n + percent * n // -100 + 1]
                parts.append((np.full(len(first), i), first.view(np.int64), np.full(len(first), n), n - np.arange(len(first))))
            if parts:
                at, key, n, rest = (np.concatenate(c) for c in zip(*parts))
                row = pdf.iloc[at]
                yield pd.DataFrame({"group_": row["group_"].to_numpy(), "key_": key, "id_": row["id_"].to_numpy(), "root_": row["root_"].to_numpy(), "n_": n, "rest_": rest})

    rows = written(sets.mapInPandas(firsts, "group_ long, key_ long, id_ long, root_ long, n_ long, rest_ long"), "prefixes")
    some = rows.groupBy("group_", "key_").agg(F.count("*").alias("c_"), F.min("root_").alias("x_"), F.max("root_").alias("y_")).where("x_ <> y_")
    blocks = some.select("group_", "key_", F.ceil(F.col("c_") / HOT).alias("blocks_"))
    rows = rows.join(blocks, ["group_", "key_"]).withColumn("own_", F.pmod(F.xxhash64("id_"), "blocks_"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks_") - 1))
    keys = ["group_", "key_", "i_", "j_"]
    x = rows.select("group_", "key_", F.col("own_").alias("i_"), other.alias("j_"), F.col("id_").alias("a"), F.col("root_").alias("ra_"), F.col("n_").alias("na_"), F.col("rest_").alias("la_"))
    y = rows.select("group_", "key_", other.alias("i_"), F.col("own_").alias("j_"), F.col("id_").alias("b"), F.col("root_").alias("rb_"), F.col("n_").alias("nb_"), F.col("rest_").alias("lb_"))
    left = F.least("la_", "lb_")  # shingles that both can still share, this one included
    could = (F.col("a") < F.col("b")) & (F.col("ra_") != F.col("rb_")) & (100 * left >= percent * (F.col("na_") + F.col("nb_") - left))
    pairs = written(x.join(y, keys).where(could).select("a", "b").distinct(), "pairs")

    def confirm(batches: Iterable) -> Iterator:
        for pdf in batches:
            good = []
            for x, y in zip(pdf["x_"], pdf["y_"]):
                s, t = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(s, t, assume_unique=True))
                good.append(100 * both >= percent * (len(s) + len(t) - both))
            yield pdf.loc[np.array(good, bool), ["a", "b"]]

    side = lambda i, x: sets.select(F.col("id_").alias(i), F.col("set_").alias(x))
    with_both = pairs.join(side("a", "x_"), "a").join(side("b", "y_"), "b").select("a", "b", "x_", "y_")
    return with_both.mapInPandas(confirm, "a long, b long").distinct()


def across_runs(docs: DataFrame, sure: DataFrame, rooted: DataFrame, words: int, percent: int) -> DataFrame:
    """rooted (id_, root_: components so far) with the links between components that long runs join: all pairs there that could be
    linked are compared, near each other in an order or not."""
    of = lambda x: rooted.select(F.col("id_").alias(x), F.col("root_").alias(f"{x}_root"))
    joined = written(sure.join(of("a"), "a").join(of("b"), "b").where("a_root <> b_root").select(F.col("a_root").alias("a"), F.col("b_root").alias("b")).distinct(), "across")
    if joined.isEmpty():
        return rooted
    wide = components(joined).select(F.col("id_").alias("root_"), F.col("root_").alias("group_"))
    members = written(rooted.join(wide, "root_").select("id_", "group_", "root_"), "members")
    links = written(missing_links(written(_sets(docs, members, words), "sets"), percent), "links")
    if links.isEmpty():
        return rooted
    merged = written(components(links.join(of("a"), "a").join(of("b"), "b").select(F.col("a_root").alias("a"), F.col("b_root").alias("b"))), "merged")
    return rooted.join(merged.select(F.col("id_").alias("root_"), F.col("root_").alias("new_")), "root_", "left").select("id_", F.coalesce("new_", "root_").alias("root_"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, group: int = GROUP, region: int = REGION) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document.

    Documents are linked if 100 * intersection >= percent * union of their sets of distinct shingles of `words` words
    (fewer words: all as one). component_id is the smallest id that links reach. A text without words,
    null or empty, is linked with nothing. A null id is below all others; rows with one id are one node. kept:
    the id is the component's; rows equal in id stay together. Extra columns are ignored.
    """
    table = written(signatures(docs, words), "signatures")
    some = table.where("n_shingles > 0")
    classes = written(some.groupBy("a_", "b_").agg(F.min("id_").alias("id_"), F.first("minima_").alias("minima_")), "classes")
    near = written(neighbours(classes), "near")
    grouped = written(components(likely(near.where("NOT sure").select("a", "b"), classes)), "groups")
    sizes = grouped.groupBy("root_").agg(F.count("*").alias("n_"))
    sized = written(grouped.join(sizes, "root_").select("id_", F.col("root_").alias("group_"), "n_"), "sized")
    roots = _by_sets(docs, sized.where(F.col("n_") <= group).select("id_", "group_"), words, percent)
    if not sized.where(F.col("n_") > group).isEmpty():
        members = sized.where(F.col("n_") > group).select("id_", "group_")
        large = classes.join(members.select("id_"), "id_")
        links = _by_sets(docs, regions(large, region), words, percent)
        found = written(components(links.select(F.col("id_").alias("a"), F.col("root_").alias("b"))), "found")
        sets = written(_sets(docs, members.join(found, "id_", "left").select("id_", "group_", F.coalesce("root_", "id_").alias("root_")), words), "sets")
        both = found.select(F.col("id_").alias("a"), F.col("root_").alias("b")).unionByName(missing_links(sets, percent))
        roots = roots.unionByName(components(both))
    roots = written(roots, "roots").groupBy("id_").agg(F.min("root_").alias("root_"))
    rooted = written(classes.select("id_").distinct().join(roots, "id_", "left").select("id_", F.coalesce("root_", "id_").alias("root_")), "rooted")
    roots = across_runs(docs, near.where("sure").select("a", "b"), rooted, words, percent)
    named = classes.select("a_", "b_", "id_").join(roots, "id_", "left").select("a_", "b_", F.coalesce("root_", "id_").alias("root_"))
    component = F.when(F.col("n_shingles") > 0, F.col("root_")).otherwise(F.col("id_"))
    out = table.select("id_", "n_shingles", "a_", "b_").join(named, ["a_", "b_"], "left").select("id_", "n_shingles", component.alias("c_"))
    plain = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return out.select(plain("id_").alias("doc_id"), "n_shingles", plain("c_").alias("component_id"), (F.col("id_") == F.col("c_")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs without those that aren't kept; of rows with one kept id all stay."""
    kept = near_duplicates(docs, words, percent).where("kept").select(F.col("doc_id").alias("kept_id_")).distinct()
    return docs.select(whole_row(docs), F.col("doc_id").alias("id_")).join(kept, F.col("id_").eqNullSafe(F.col("kept_id_"))).select(*row_columns(docs))


#: For two-word shingles; documents with unique ids.
ORACLE = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, unnest(CASE WHEN len(ws) >= 2 THEN list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) ELSE ws END) AS sh FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM i JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.c = e.x),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT m.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, m.doc_id = component_id AS kept FROM m LEFT JOIN n ON m.doc_id = n.doc_id
"""
