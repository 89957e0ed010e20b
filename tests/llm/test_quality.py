import re
from collections import Counter

import numpy as np
from cases import documents, empty, rows
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import quality


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    twice = Counter(windows)
    covered = {j for i, w in enumerate(windows) if twice[w] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)]


@given(st.lists(st.sampled_from(["a", "b", "é", "#x", "\n", " ", "a b a b a b a b", " "]), max_size=60).map(" ".join))
@settings(max_examples=150, deadline=None)
def test_statistics_equal_brute_force(text):
    assert quality.statistics(text)[0] == brute(text)


def test_forest_is_monotone_and_learns():
    rng = np.random.default_rng(1)
    x = rng.random((2000, 3))
    y = (x[:, 0] + 0.2 * rng.random(2000) < 0.6).astype(float)
    forest = quality.train(x, y, [-1, 0, 0])
    assert ((forest.scores(x) >= 0.5) == y).mean() > 0.9
    line = np.stack([np.linspace(0, 1, 50), np.full(50, 0.3), np.full(50, 0.7)], axis=1)
    assert (np.diff(forest.scores(line)) <= 1e-12).all()
    assert quality.train(x, np.ones(2000), [0, 0, 0]).scores(x[:2]).tolist() == [2000.5 / 2001] * 2
    assert quality.train(np.zeros((0, 3)), np.zeros(0), [0, 0, 0]).scores(x[:2]).tolist() == [0.5, 0.5]


def test_query(spark):
    labels = spark.createDataFrame([(1, 1), (2, 1), (13, 0), (14, 0), (14, 0), (None, 1), (999, 1), (3, None)], "doc_id long, quality int")
    docs = documents(spark)
    out = quality.quality_rules(docs, quality.fit(docs, labels)).collect()
    got = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out)
    want = [(str(d), *(b := brute(t)), b[0] < 20 or 100 * b[4] > 30 * b[0]) for d, t, *_ in rows()]
    assert got == sorted(want) and not any(r.kept and r.base_failed for r in out)
    assert quality.quality_rules(empty(spark), quality.fit(empty(spark), labels)).collect() == []
