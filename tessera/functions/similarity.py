"""Pair features as column expressions over word arrays; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import let, words

#: Distinct words kept of each field: names, addresses, skeletons, numbers, units.
WIDTHS = {"name": 8, "addr": 16, "phon": 8, "num": 8, "unit": 4}


def first_words(text: Column, width: int) -> Column:
    return F.slice(F.array_distinct(words(text)), 1, width)


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct members; 0 if either side is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def rounded(x: Column, places: int) -> Column:
    """x to some places as SQL engines do it, halves of the scaled double away from zero; Spark's round() takes the decimal digits that print x."""
    return F.round(x * float(10**places)) / float(10**places)


def total(weights: Column) -> Column:
    return F.aggregate(weights, F.lit(0.0), lambda s, w: s + w)


def flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("int")


def most(weights: Column) -> Column:
    return F.coalesce(F.array_max(weights), F.lit(0.0))


def in_words(entries: Column, others: Column, inside: bool = True) -> Column:
    """Weights of entries (word, w, df) whose word is (not) in others."""
    hit = lambda e: F.array_contains(others, e["word"])
    return F.transform(F.filter(entries, lambda e: hit(e) if inside else ~hit(e)), lambda e: e["w"])


def all_words(entries: Column) -> Column:
    return F.transform(entries, lambda e: e["word"])


def weight_sums(q: Column, s: Column, prefix: str) -> dict[str, Column]:
    """Sums that weighted_features() needs, to be worked out in a projection before: of shared words and of either side's."""
    return {f"{prefix}_sh_": total(in_words(q, all_words(s))), f"{prefix}_tq_": total(F.transform(q, lambda e: e["w"])), f"{prefix}_ts_": total(F.transform(s, lambda e: e["w"]))}


def weighted_features(q: Column, s: Column, prefix: str) -> dict[str, Column]:
    """Weighted Jaccard and coverages of two arrays of (word, w, df), with weight_sums() beside them."""
    qw, sw = all_words(q), all_words(s)
    shared, tq, ts = (F.col(f"{prefix}_{c}_") for c in ("sh", "tq", "ts"))
    return {
        f"{prefix}_wjacc": share(shared, tq + ts - shared), f"{prefix}_wcov_min": share(shared, F.least(tq, ts)),
        f"{prefix}_wcov_q": share(shared, tq), f"{prefix}_wcov_s": share(shared, ts), f"{prefix}_shared": F.size(F.array_intersect(qw, sw)),
        f"{prefix}_maxw_shared": most(in_words(q, sw)), f"{prefix}_maxw_unq_q": most(in_words(q, sw, False)), f"{prefix}_maxw_unq_s": most(in_words(s, qw, False)),
        f"{prefix}_cnt_q": F.size(q), f"{prefix}_cnt_s": F.size(s),
    }


def near(x: Column, y: Column) -> Column:
    """One substitution, insertion or deletion apart at most."""
    return F.levenshtein(x, y) <= 1


def near_misses(q: Column, s: Column) -> Column:
    """How many of the query's unmatched numbers of two digits or more are near one of the other side."""
    long = lambda a: F.filter(a, lambda n: F.length(n) >= 2)
    return let(long(s), lambda t: F.size(F.filter(F.array_except(long(q), s), lambda x: F.exists(t, lambda y: near(x, y)))))


def number_features(q: Column, s: Column) -> dict[str, Column]:
    """Number overlap, near misses (column near_) and conflict."""
    both = F.array_intersect(q, s)
    long = lambda a: F.filter(a, lambda n: F.length(n) >= 2)
    close = F.col("near_")
    return {
        "num_jacc": jaccard(q, s), "num_shared": F.size(both), "num_maxlen_shared": F.coalesce(F.array_max(F.transform(both, lambda n: F.length(n))), F.lit(0)),
        "num_near": close, "num_conflict": flag((F.size(long(q)) > 0) & (F.size(long(s)) > 0) & (F.size(both) == 0) & (close == 0)),
        "num_cnt_q": F.size(q), "num_cnt_s": F.size(s),
    }


def relation(x: Column, y: Column) -> Column:
    """0 unrelated, 1 equal, 2 one digit replaced, 3 one digit more or less."""
    one = F.levenshtein(x, y) == 1
    return F.when(x == y, 1).when(one & (F.length(x) == F.length(y)), 2).when(one, 3).otherwise(0)


def longest(numbers: Column) -> Column:
    """The first longest; null if there is none."""
    return F.array_min(F.transform(numbers, lambda n, i: F.struct((-F.length(n)).alias("l"), i.alias("i"), n.alias("n"))))["n"]


def number_differences(q: Column, s: Column) -> dict[str, Column]:
    """Numbers on one side only; of the query's, those whose first near Source-1 number differs by a replaced (added) digit."""
    only = F.array_except(q, s)
    first = lambda x: F.get(F.filter(F.transform(s, lambda y: relation(x, y)), lambda r: r > 1), F.lit(0))
    kinds = F.transform(only, first)
    of = lambda k: F.size(F.filter(kinds, lambda r: r == k))
    rel = relation(longest(q), longest(s))
    return {
        "num_q_only": F.size(only), "num_s_only": F.size(F.array_except(s, q)), "num_sub1": of(2), "num_indel1": of(3),
        "lnum_rel": F.when((F.size(q) == 0) | (F.size(s) == 0), -1).when(rel == 0, 4).otherwise(rel),
    }


def longest_similarity(q: Column, s: Column) -> Column:
    """Normalized edit similarity of the longest numbers; 0 if either side has none."""
    a, b = longest(q), longest(s)
    return F.when((F.size(q) == 0) | (F.size(s) == 0), F.lit(0.0)).otherwise(1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)))


def equality(a: Column, b: Column, name: str) -> dict[str, Column]:
    """Equal and conflicting values of a field; empty ones are neither."""
    both = (a != "") & (b != "")
    return {f"{name}_eq": flag(both & (a == b)), f"{name}_conflict": flag(both & (a != b))}


def set_equality(a: Column, b: Column, name: str) -> dict[str, Column]:
    some = (F.size(a) > 0) & (F.size(b) > 0)
    return {f"{name}_eq": flag(some & (F.array_sort(a) == F.array_sort(b))), f"{name}_conflict": flag(some & (F.size(F.array_intersect(a, b)) == 0))}


def v1_features(name1: Column, addr1: Column, nums1: Column, name2: Column, addr2: Column, nums2: Column) -> dict[str, Column]:
    """The eight v1 features that need no edit distance; token-sort ratios are in fuzzy."""
    least = lambda t, n: F.array_distinct(F.filter(words(t), lambda w: F.length(w) >= n))
    digits = lambda t: F.array_distinct(F.filter(words(t), lambda w: w.rlike("^[0-9]+$") & (w != "0")))
    n1, n2, a1, a2, x1, x2 = least(name1, 2), least(name2, 2), least(addr1, 3), least(addr2, 3), digits(nums1), digits(nums2)
    ratio = lambda a, b: F.when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0.0)).otherwise(F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b)))
    inside = (F.length(name1) >= 4) & (F.length(name2) >= 4) & (F.contains(name1, name2) | F.contains(name2, name1))
    return {
        "name_jaccard": jaccard(n1, n2), "addr_jaccard": jaccard(a1, a2), "num_jaccard": jaccard(x1, x2),
        "name_len_ratio": ratio(name1, name2), "addr_len_ratio": ratio(addr1, addr2), "name_contains": flag(inside),
        "num_set_equal": flag((F.size(x1) > 0) & (F.array_sort(x1) == F.array_sort(x2))),
        "name_in_address": flag(F.arrays_overlap(n1, a2) | F.arrays_overlap(n2, a1)),
    }
