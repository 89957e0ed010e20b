"""Pairs of alike sets against every pair, and the labels made of them."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import alike
from tessera.plans import fixtures


def _sets(n):
    r = random.Random(7)
    out = []
    for i in range(n):
        if out and r.random() < 0.6:
            words = [w for w in r.choice(out) if r.random() < r.choice([0.8, 0.95, 1.0])]
            words += [f"x{r.randrange(50)}" for _ in range(r.choice([0, 0, 1, 4]))]
        else:
            words = [f"w{int(r.paretovariate(0.5)) % 5000}" for _ in range(r.choice([0, 1, 3, 12, 40, 300]))]
        out.append(list(dict.fromkeys(words)))
    return out


@pytest.mark.parametrize("step", [1, 4_000_000])
def test_pairs_equal_brute_force(spark, monkeypatch, step):
    monkeypatch.setattr(alike, "STEP", step)
    sets = _sets(300)
    got = alike.alike(spark.createDataFrame(list(enumerate(sets)), "id long, ws array<string>").repartition(3), F.col("ws"))
    of = {}
    for i, ws in enumerate(sets):
        of.setdefault(frozenset(ws), []).append(i)
    want = set()
    for a in of:
        for b in of:
            c, q, s = len(a & b), [i for i in of[a] if i % 3], [i for i in of[b] if not i % 3]
            if c and q and s and not any(i % 3 == 0 for i in of[a]) and 100 * c >= 80 * len(a | b):
                want.add((min(q), min(s), c, len(a | b)))
    found = {tuple(r) for r in got.collect()}
    assert (found - want, want - found) == (set(), set()) and len(want) > 10


def test_gold_of_copies_ships_few_texts(spark):
    """Texts stay where they are, but those of possible pairs: no shuffle by word holds documents."""
    rows = [(i, " ".join(f"w{i // 60}x{j}" for j in range(30)) + (f" n{i}" if i % 2 else ""), "en") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.q_id: r.s_id for r in fixtures._gold(docs).collect()}
    want = {}
    for i in range(600):
        if i % 3:
            first = i // 60 * 60
            want[f"S{i % 3 + 1}-{i}"] = f"S1-{first}"
    assert got == want
