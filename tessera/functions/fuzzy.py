"""String similarities that Spark has no function for, as Arrow UDFs over whole batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, with the rows of the table as bits of an integer."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    open_ = full
    for c in b:
        hit = open_ & places.get(c, 0)
        open_ = ((open_ + hit) | (open_ - hit)) & full
    return len(a) - open_.bit_count()


def lcs_batch(a: list[str], b: list[str]) -> np.ndarray:
    """lcs() of many pairs at once: one 64-bit word a pair, a step for each place of the second strings. Pairs of longer strings
    are done one by one."""
    out = np.zeros(len(a), np.int64)
    short = [i for i, (x, y) in enumerate(zip(a, b)) if x and y and min(len(x), len(y)) <= 64]
    done = set(short)
    for i, (x, y) in enumerate(zip(a, b)):
        if x and y and i not in done:
            out[i] = lcs(x, y)
    for begin in range(0, len(short), 4096):
        rows = sorted(short[begin : begin + 4096], key=lambda i: -max(len(a[i]), len(b[i])))
        first, second = zip(*[sorted((a[i], b[i]), key=len) for i in rows])
        width = len(second[0])
        x = np.array([list(t.ljust(64, "\0").encode("utf-32-le")) for t in first], np.uint8).view("<u4")
        y = np.array([list(t.ljust(width, "\1").encode("utf-32-le")) for t in second], np.uint8).view("<u4")
        open_ = np.full(len(rows), ~np.uint64(0))
        ends = np.searchsorted(-np.array([len(t) for t in second]), -np.arange(1, width + 1), side="right")
        for j in range(width):
            n = ends[j]  # rows whose longer string has this place
            hit = open_[:n] & np.packbits(x[:n] == y[:n, j, None], axis=1, bitorder="little").view("<u8")[:, 0]
            open_[:n] = (open_[:n] + hit) | (open_[:n] - hit)
        out[rows] = np.bitwise_count(~open_)
    return out


def ratio_batch(a: list[str], b: list[str]) -> np.ndarray:
    total = np.array([len(x) + len(y) for x, y in zip(a, b)], np.float64)
    return np.where(total > 0, 2 * lcs_batch(a, b) / np.maximum(total, 1), 1.0)


def token_sort_batch(a: list[str], b: list[str]) -> np.ndarray:
    return ratio_batch(*[[" ".join(sorted(t.split())) for t in side] for side in (a, b)])


def token_set_batch(a: list[str], b: list[str]) -> np.ndarray:
    """Common words are the beginning of both joined sides, so only these two need a table."""
    rest, left, right, out = [], [], [], np.zeros(len(a))
    for i, (p, q) in enumerate(zip(a, b)):
        x, y = set(p.split()), set(q.split())
        if not x or not y:
            continue
        both, only_a, only_b = sorted(x & y), sorted(x - y), sorted(y - x)
        if both and not (only_a and only_b):
            out[i] = 1.0
            continue
        common, u, v = " ".join(both), " ".join(both + only_a), " ".join(both + only_b)
        if both:
            out[i] = max(2 * len(common) / (len(common) + len(t)) for t in (u, v))
        rest.append(i)
        left.append(u)
        right.append(v)
    if rest:
        out[rest] = np.maximum(out[rest], ratio_batch(left, right))
    return out


def partial_batch(a: list[str], b: list[str]) -> np.ndarray:
    """All windows of all pairs in one batch."""
    rows, left, right = [], [], []
    for i, (p, q) in enumerate(zip(a, b)):
        for short, long in ((p, q), (q, p)) if len(p) == len(q) else ((p, q),) if len(p) < len(q) else ((q, p),):
            windows = {long[max(0, k) : k + len(short)] for k in range(1 - len(short), len(long))} if p and q else ()
            rows += [i] * len(windows)
            left += [short] * len(windows)
            right += windows
    out = np.zeros(len(a))
    if rows:
        np.maximum.at(out, rows, ratio_batch(left, right))
    return out


def ratio(a: str, b: str) -> float:
    """Indel similarity: 2 * LCS / (len(a) + len(b)); 1 for two empty strings."""
    return 2 * lcs(a, b) / (len(a) + len(b)) if a or b else 1.0


def token_sort(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set(a: str, b: str) -> float:
    """The best ratio among the common words, and these followed by either side's others. 0 if a side has no words."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, only_a, only_b = sorted(x & y), sorted(x - y), sorted(y - x)
    if both and not (only_a and only_b):
        return 1.0
    common, left, right = " ".join(both), " ".join(both + only_a), " ".join(both + only_b)
    return max([ratio(left, right)] + [ratio(common, x) for x in (left, right) if both])


def partial(a: str, b: str) -> float:
    """The best ratio of the shorter string with any window of the longer that is no longer than it."""
    if not a or not b:
        return 0.0
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    m, n = len(short), len(long)
    windows = {long[max(0, i) : i + m] for i in range(1 - m, n)}
    best = max(ratio(short, w) for w in windows)
    if len(a) == len(b):
        best = max([best, *(ratio(long, short[max(0, i) : i + m]) for i in range(1 - m, m))])
    return best


def jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity, raised for up to four common first characters if it is over 0.7."""
    if not a and not b:
        return 1.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken = [False] * len(b)
    left = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                left.append(c)
                break
    m = len(left)
    if not m:
        return 0.0
    right = [c for c, t in zip(b, taken) if t]
    swaps = sum(x != y for x, y in zip(left, right)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    common = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4])) if x != y), min(len(a), len(b), 4))
    return jaro + 0.1 * common * (1 - jaro) if jaro > 0.7 else jaro


def jaro_winkler_batch(a: list[str], b: list[str]) -> np.ndarray:
    return np.array([jaro_winkler(x, y) for x, y in zip(a, b)])


#: Scorers of whole batches. The plain functions above say what they give.
SCORERS = {"ratio": ratio_batch, "token_sort": token_sort_batch, "token_set": token_set_batch, "partial": partial_batch, "jaro_winkler": jaro_winkler_batch}


def similarity(kind: str, a: Column, b: Column) -> Column:
    """A scorer of SCORERS, rounded to six places; 0 if either string is null or empty."""
    scorer = SCORERS[kind]

    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        a, b = x.fillna("").tolist(), y.fillna("").tolist()
        some = np.array([bool(p and q) for p, q in zip(a, b)], bool)
        out = [np.round(scorer(a[i : i + 1000], b[i : i + 1000]), 6) for i in range(0, len(a), 1000)]
        return pd.Series(np.where(some, np.concatenate(out), 0.0) if out else np.zeros(0))

    return F.pandas_udf(run, "double", F.PandasUDFType.SCALAR)(a, b)


def acronyms(core: Column) -> list[Column]:
    """Three short forms of a name of two words or more (else empty): first letter and the rest, two first letters and the
    rest, all first letters."""
    w = F.split(core, " ")
    first = lambda i: F.substring(F.get(w, F.lit(i)), 1, 1)
    after = lambda i: F.array_join(F.slice(w, i, F.size(w)), "")
    forms = [F.concat(first(0), after(2)), F.concat(first(0), first(1), after(3)), F.array_join(F.transform(w, lambda t: F.substring(t, 1, 1)), "")]
    return [F.when(F.size(w) >= 2, form).otherwise(F.lit("")) for form in forms]
