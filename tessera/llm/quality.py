"""Quality rules: fixed rules first, then gradient-boosted trees over document statistics.

The trees are trained with logistic loss on histogram cuts of a bounded sample of labelled documents. Chosen
statistics only ever lower the score (monotonic constraints). A forest is a few numpy arrays of nodes,
and all documents of a batch walk down all trees at once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: At most so many labelled documents are learned from, those with the lowest hashes of their ids.
TRAIN_ROWS = 6000
#: Words of a window whose repeats count.
WINDOW = 8
MIN_WORDS, MAX_REPEATED = 20, 30
#: The method's verdict keeps a document from this score on; doubtful ones stay.
THRESHOLD = 0.25

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Names of the statistics that the trees see, and the sign of their constraint.
FEATURES = {
    "log_words": 0, "mean_word": 0, "symbols_per_word": -1, "dup_line_share": -1, "repeat_share": -1, "upper_share": -1,
    "marks_per_word": -1, "bars_per_word": -1, "digit_share": 0, "distinct_share": 0, "words_per_line": 0,
}

_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
_SPACES = np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8)


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words that lie in a window of `window` words found twice or more. Windows are compared exactly, by ranks of
    halves: ranks of runs of 1, 2, 4 and 8 words come from ranks of pairs of shorter runs."""
    n = len(ids) - window + 1
    if n < 2 or len(np.unique(ids)) == len(ids):
        return 0
    ranks, size = ids.astype(np.int64), 1
    while size < window:
        step = min(size, window - size)
        pairs = ranks[: len(ranks) - step] * (int(ranks.max()) + 1) + ranks[step:]
        ranks = np.unique(pairs, return_inverse=True)[1]
        size += step
    twice = np.bincount(ranks)[ranks] > 1
    if not twice.any():
        return 0
    cover = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + window, -1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """The five base statistics and the trees' statistics of a whole text; null is empty."""
    raw = (text or "").encode()
    words = raw.split()  # bytes split at exactly the white space that counts here
    n = len(words)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    chars = len(text or "") - int(counts[_SPACES].sum())
    symbols = int(counts[_SYMBOLS].sum())
    rank: dict[bytes, int] = {}
    ids = np.fromiter((rank.setdefault(w, len(rank)) for w in words), np.int64, n)
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    dup = len(lines) - len(set(lines))
    repeated = repeated_words(ids)
    upper, per = int(counts[65:91].sum()), max(n, 1)
    trees = [
        float(np.log1p(n)), chars / per, symbols / per, dup / max(len(lines), 1), repeated / per, upper / max(chars, 1),
        int(counts[33] + counts[63]) / per, int(counts[124]) / per, int(counts[48:58].sum()) / max(chars, 1), len(rank) / per, n / max(len(lines), 1),
    ]
    return [n, chars, symbols, dup, repeated], trees


@dataclass
class Forest:
    """Trees as node arrays: cut value, statistic, children (a leaf is its own child) and leaf values."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of good quality of rows of statistics."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.cut[at], self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(axis=1))))


def train(x: np.ndarray, y: np.ndarray, signs: list[int], trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 48, least: float = 5.0, ridge: float = 2.0) -> Forest:
    """Boosted trees with logistic loss. sign -1 or 1: the score never rises (falls) with that statistic.

    A cut that breaks a sign is not taken, and both children's leaves stay on their side of the middle
    of their values. Without rows of both classes the forest is empty and scores the share of good rows.
    """
    share = (y.sum() + 0.5) / (len(y) + 1.0) if len(y) else 0.5
    base = float(np.log(share / (1 - share)))
    nodes: list[list[float]] = []
    roots: list[int] = []
    raw = np.full(len(y), base)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T] if len(y) else []
    binned = [np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)]

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, left: int, low: float, high: float) -> int:
        gs, hs = g[rows].sum(), h[rows].sum()
        here = len(nodes)
        nodes.append([0, 0.0, here, here, float(np.clip(-gs / (hs + ridge), low, high)) * rate])
        best = (1e-6, None)
        for f, (c, b) in enumerate(zip(cuts, binned)) if left else ():
            gl, hl = np.cumsum(np.bincount(b[rows], g[rows], len(c) + 1))[:-1], np.cumsum(np.bincount(b[rows], h[rows], len(c) + 1))[:-1]
            gr, hr = gs - gl, hs - hl
            vl, vr = np.clip(-gl / (hl + ridge), low, high), np.clip(-gr / (hr + ridge), low, high)
            gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - gs**2 / (hs + ridge)
            gain[(hl < least / 4) | (hr < least / 4) | (signs[f] * (vr - vl) < 0)] = 0
            if len(gain) and gain.max() > best[0]:
                k = int(gain.argmax())
                best = (gain[k], (f, k, float(c[k]), (vl[k] + vr[k]) / 2))
        if best[1]:
            f, k, cut, middle = best[1]
            side = binned[f][rows] <= k
            a, b = ((low, middle), (middle, high)) if signs[f] > 0 else ((middle, high), (low, middle)) if signs[f] < 0 else ((low, high), (low, high))
            nodes[here][:4] = [f, cut, grow(rows[side], g, h, left - 1, *a), grow(rows[~side], g, h, left - 1, *b)]
        return here

    def forest() -> Forest:
        a = np.array(nodes if nodes else [[0, 0.0, 0, 0, 0.0]])
        return Forest(a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3].astype(int), a[:, 4], np.array(roots, int), depth, base)

    if len(np.unique(y)) > 1:
        for _ in range(trees):
            p = 1 / (1 + np.exp(-raw))
            roots.append(grow(np.arange(len(y)), p - y, p * (1 - p), depth, -4.0, 4.0))
            only = forest()
            only.roots, only.base = np.array(roots[-1:]), 0.0
            s = only.scores(x)
            raw += np.log(s / (1 - s))
    return forest()


def labelled_statistics(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of at most `rows` documents: of bounded size whatever the corpus."""
    taken = labels.select("doc_id", "quality").where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
    taken = taken.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(rows)

    def run(batches: Iterable) -> Iterator:
        import pandas as pd

        for pdf in batches:
            yield pd.DataFrame({"x": [statistics(t)[1] for t in pdf["text"]], "y": pdf["quality"].astype("float64"), "doc_id": pdf["doc_id"]})

    found = docs.select("doc_id", "text").join(F.broadcast(taken), "doc_id").mapInPandas(run, "x array<double>, y double, doc_id long").orderBy("doc_id", "y", "x").limit(rows).collect()
    return np.array([r["x"] for r in found]).reshape(-1, len(FEATURES)), np.array([r["y"] for r in found])


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Forest:
    return train(*labelled_statistics(docs, labels, rows), list(FEATURES.values()))


def quality_rules(docs: DataFrame, forest: Forest, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the base statistics, base_failed, kept and score of every whole text.

    base_failed: fewer than MIN_WORDS words, or more than MAX_REPEATED percent of them in repeated windows. kept: not
    base_failed and a score of threshold or more. A null or empty text has no words and fails.
    Nothing is shuffled; equal rows have equal results; extra columns are ignored.
    """

    def run(batches: Iterable) -> Iterator:
        import pandas as pd

        for pdf in batches:
            found = [statistics(t) for t in pdf["text"]]
            base = np.array([b for b, _ in found], np.int64).reshape(-1, len(BASE))
            scores = forest.scores(np.array([x for _, x in found]).reshape(-1, len(FEATURES)))
            out = pd.DataFrame(base, columns=list(BASE))
            out.insert(0, "doc_id", pdf["doc_id"].astype("Int64"))
            out["base_failed"] = (base[:, 0] < MIN_WORDS) | (100 * base[:, 4] > MAX_REPEATED * base[:, 0])
            out["kept"] = ~out["base_failed"] & (scores >= threshold)
            out["score"] = scores
            yield out

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in BASE) + ", base_failed boolean, kept boolean, score double"
    return docs.select("doc_id", "text").mapInPandas(run, schema)
