import random

import numpy as np
import pytest
from cases import documents, empty, rows

from tessera.llm import near_dedup


def shingles(text, n):
    w = (text or "").encode().lower().split()
    k = min(n, len(w))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset()


def brute(docs, n, percent=80):
    """The smallest id that links reach, from each row; rows of one id are one node."""
    low = -(2**63)
    ids, sets = [low if d is None else d for d, *_ in docs], [shingles(r[1], n) for r in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and (100 * both >= percent * (len(sets[i]) + len(sets[j]) - both) or ids[i] == ids[j]):
                root[find(i)] = find(j)
    least = {}
    for i in range(len(docs)):
        least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return sorted((str(docs[i][0]), len(sets[i]), str(None if least[find(i)] == low else least[find(i)])) for i in range(len(docs)))


def got(out):
    found = out.collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in found)


@pytest.mark.parametrize("words", [2, 5])
def test_odd_cases(spark, words):
    assert got(near_dedup.near_duplicates(documents(spark), words)) == brute(rows(), words)
    assert near_dedup.near_duplicates(empty(spark), words).collect() == []
    kept = near_dedup.drop_near_duplicates(documents(spark), words)
    assert kept.columns == documents(spark).columns


def family(seed, n, size=80, most=14):
    rng = random.Random(seed)
    words = [f"w{rng.randrange(5000)}" for _ in range(size)]
    out = []
    for _ in range(n):
        copy = list(words)
        for _ in range(rng.randrange(most)):
            copy[rng.randrange(size)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("limits", [(1000, 400), (20, 30), (5, 100)])
def test_families_by_groups_and_by_regions(spark, limits):
    texts = [t for s, n in enumerate((2, 3, 40, 90, 1, 1, 2)) for t in family(s, n)] + family(9, 1) * 30
    random.Random(5).shuffle(texts)
    docs = list(enumerate(texts))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert got(near_dedup.near_duplicates(df, 2, group=limits[0], region=limits[1])) == brute(docs, 2)


def test_exact_components():
    sets = [np.array(x, np.uint64) for x in ([1, 2, 3, 4, 5], [1, 2, 3, 4], [9], [1, 2, 3], [9])]
    assert near_dedup.exact_components(np.array([7, 3, 5, 1, 2]), sets, 75).tolist() == [1, 1, 2, 1, 2]


def template(seed, n, pairs, size=120):
    """Variants of one text, most too different to be linked, and near copies of some of them far away in the order of ids."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(size)]

    def changed(text, places):
        copy = list(text)
        for i in rng.sample(range(0, size, 2), places):
            copy[i] = f"x{rng.randrange(10**6)}"
        return copy

    out = [changed(words, 4) for _ in range(n)]
    return [" ".join(c) for c in out + [changed(out[i], 6) for i in range(pairs)]]


@pytest.mark.parametrize("hot", [2000, 16])
def test_large_groups_lose_no_link(spark, monkeypatch, hot):
    """Near copies among variants whose minima are often those of the template, in every order."""
    monkeypatch.setattr(near_dedup, "HOT", hot)
    docs = list(enumerate(template(3, 600, 60)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert got(near_dedup.near_duplicates(df, 2, group=10, region=4)) == brute(docs, 2)


def test_the_size_of_a_group_changes_no_result(spark):
    df = spark.createDataFrame(list(enumerate(template(3, 600, 60))), "doc_id long, text string")
    whole, cut = (got(near_dedup.near_duplicates(df, 2, group=g, region=4)) for g in (1000, 10))
    assert whole == cut


@pytest.mark.parametrize("near", [0, 1])
def test_long_runs_lose_no_link(spark, monkeypatch, near):
    """Pairs further apart in every order than neighbours are taken, over several ranges of the orders."""
    monkeypatch.setattr(near_dedup, "NEAR", near)
    docs = list(enumerate(template(4, 300, 40) + [t for s, n in enumerate((2, 3, 30, 1)) for t in family(s, n)] + family(9, 1) * 5))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert got(near_dedup.near_duplicates(df, 2)) == brute(docs, 2)


@pytest.mark.parametrize("local", [0, 40, 10**6])
def test_components(spark, monkeypatch, local):
    monkeypatch.setattr(near_dedup, "LOCAL", local)
    rng = random.Random(6)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(200 + i, 201 + i) for i in range(30)] + [(-5, 7), (7, 7), (300, 300)]
    root = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in root:
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    got = near_dedup.components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.id_: r.root_ for r in got.collect()} == root and got.count() == len(root)
    assert near_dedup.components(spark.createDataFrame([], "a long, b long")).collect() == []
