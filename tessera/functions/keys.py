"""Blocking keys of a record, as arrays of strings by kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import let, words

_digits = r"^[0-9]+$"


def by_length(a: Column, n: int) -> Column:
    """The n longest distinct words, longest first, equal lengths by word."""
    ranked = F.array_sort(F.transform(F.array_distinct(a), lambda x: F.struct((-F.length(x)).alias("l"), x.alias("w"))))
    return F.transform(F.slice(ranked, 1, n), lambda s: s["w"])


def pairs(a: Column) -> Column:
    """Sorted pairs of the 8 longest distinct words."""
    of = lambda u: F.flatten(F.transform(u, lambda x, i: F.transform(F.slice(u, i + 2, F.lit(8)), lambda y: F.concat(x, F.lit("_"), y))))
    return let(F.array_sort(by_length(a, 8)), of)


def signature(numbers: Column) -> Column:
    return let(F.array_sort(F.array_distinct(numbers)), lambda d: F.when(F.size(d) >= 2, F.array(F.array_join(d, "#"))).otherwise(_none()))


def crossed(a: Column, b: Column) -> Column:
    return F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.concat(x, F.lit("|"), y))))


def prefix(a: Column) -> Column:
    """First five letters of the first longest word, if it has five."""
    first = F.array_min(F.transform(a, lambda x, i: F.struct((-F.length(x)).alias("l"), i.alias("i"), x.alias("w"))))["w"]
    return F.coalesce(let(first, lambda f: F.when(F.length(f) >= 5, F.array(F.substring(f, 1, 5)))), _none())


def ngrams(text: Column, n: int = 4, most: int = 12) -> Column:
    """Distinct n-grams of a text's letters and digits: all, or `most` at even distances."""

    def of(s: Column) -> Column:
        m = F.length(s) - (n - 1)
        at = F.when(m <= most, F.sequence(F.lit(0), F.greatest(m - 1, F.lit(0)))).otherwise(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.floor(i * (m - 1) / (most - 1)).cast("int")))
        return F.when(m <= 0, _none()).otherwise(F.array_distinct(F.transform(at, lambda p: F.substr(s, p + 1, F.lit(n)))))

    return let(F.regexp_replace(text, "[^0-9a-z]", ""), of)


def _none() -> Column:
    return F.array().cast("array<string>")


def long_words(text: Column, pattern: str | None = None) -> Column:
    """Words of three characters or more: no numbers, or only those of a pattern."""
    good = (lambda t: t.rlike(pattern)) if pattern else (lambda t: ~t.rlike(_digits))
    return F.filter(words(text), lambda t: (F.length(t) >= 3) & good(t))


def exact_name(a: Column) -> Column:
    return let(F.array_sort(F.array_distinct(a)), lambda d: F.when(F.size(d) > 0, F.array(F.array_join(d, " "))).otherwise(_none()))


def of_length(a: Column, n: int) -> Column:
    return F.filter(a, lambda t: F.length(t) >= n)


def with_v1_lists(records: DataFrame) -> DataFrame:
    """records with the word and number lists that keys are made of: w_, a_, n_, four_."""
    df = records.withColumns({
        "w_": long_words(F.col("name_core")), "a_": long_words(F.col("addr_normalized")), "n_": F.filter(words(F.col("addr_numbers")), lambda t: t.rlike(_digits) & (t != "0")),
    })
    return df.withColumn("four_", of_length(F.col("a_"), 4))


def v1_keys() -> dict[str, Column]:
    """Keys of with_v1_lists()."""
    w, a, n, four = (F.col(c) for c in ("w_", "a_", "n_", "four_"))
    return {
        "name": w, "npair": pairs(w), "addr": a, "apair": pairs(four), "num": of_length(n, 3), "sig": signature(n),
        "comp": crossed(F.slice(of_length(n, 2), 1, 5), F.slice(four, 1, 5)), "pref": prefix(w), "exact": exact_name(w),
    }


def with_v3_lists(records: DataFrame) -> DataFrame:
    """records with the lists that keys are made of: words, skeletons, numbers, units, and the choices among them."""
    df = records.withColumns({
        "w_": long_words(F.col("core")), "a_": long_words(F.col("ad"), "^[a-z]+$"), "n_": words(F.col("nums")), "p_": of_length(words(F.col("phon")), 3), "u_": words(F.col("units")),
    })
    a = F.col("a_")
    df = df.withColumns({"top_": by_length(F.col("w_"), 4), "four_": of_length(a, 4), "last_": F.array_distinct(F.when(F.size(a) > 2, F.slice(a, F.size(a) - 1, F.lit(2))).otherwise(a))})
    return df.withColumns({"two_": F.array_join(F.array_sort(F.slice("top_", 1, 2)), "_"), "placed_": F.concat("last_", F.slice("n_", 1, 3))})


def v3_keys() -> dict[str, Column]:
    """Keys of with_v3_lists()."""
    w, a, n, top, four, last, two = (F.col(f"{c}_") for c in ("w", "a", "n", "top", "four", "last", "two"))
    return {
        "name": w, "npair": pairs(w), "phon": F.col("p_"), "addr": a, "apair": pairs(F.slice(four, 1, 8)), "num": of_length(n, 3), "sig": signature(n),
        "comp": crossed(F.slice(of_length(n, 2), 1, 5), F.slice(four, 1, 5)), "unit": F.col("u_"), "pref": prefix(w), "ngname": ngrams(F.col("core")), "ngaddr": ngrams(F.col("ad")),
        "nloc": F.flatten(F.transform(top, lambda x: F.transform(F.filter(last, lambda c: c != x), lambda c: F.concat(x, F.lit("|"), c)))),
        "nnum": crossed(top, F.slice(n, 1, 4)),
        "ploc": F.when(F.size(top) >= 2, F.transform("placed_", lambda c: F.concat(two, F.lit("|"), c))).otherwise(_none()), "exact": exact_name(w),
    }


def long_form(keys: dict[str, Column]) -> Column:
    """One array of distinct (kind, key) structs."""

    def tagged(kind: str, found: Column) -> Column:
        return F.transform(F.array_distinct(found), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("key")))

    return F.concat(*[tagged(kind, found) for kind, found in keys.items()])
