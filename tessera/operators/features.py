"""Pair features: per-record arrays are made once, pairs are joined to them, and all but string ratios are JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import fuzzy
from tessera.functions import similarity as S

W = S.WIDTHS


def fields(records: DataFrame) -> DataFrame:
    """Word arrays of normalized records, each cut to its width; standalone numbers leave the address words."""
    f = {
        "names": S.first_words(F.col("core"), W["name"]), "addrs": S.first_words(F.regexp_replace("ad", r"\b\d+\b", " "), W["addr"]),
        "phons": S.first_words(F.col("phon"), W["phon"]), "numbers": S.first_words(F.col("nums"), W["num"]), "unit_list": S.first_words(F.col("units"), W["unit"]),
        "forms": F.filter(F.split("sfx", " "), lambda x: x != ""),
    }
    return records.withColumns(f)


def word_stats(s1: DataFrame) -> DataFrame:
    """(country, word, df_name, df_addr, w_name, w_addr) over Source-1 fields: ln((n + 1) / (df + 1)) / ln(n + 1)."""
    both = s1.select("country", F.explode(F.concat(_tagged("names", 0), _tagged("addrs", 1))).alias("x"))
    df = both.groupBy("country", F.col("x.word").alias("word")).agg(F.count_if(F.col("x.k") == 0).alias("df_name"), F.count_if(F.col("x.k") == 1).alias("df_addr"))
    sizes = s1.groupBy("country").agg(F.count("*").alias("n_"))
    weight = lambda c: F.log((F.col("n_") + 1) / (F.col(c) + 1)) / F.log(F.col("n_") + 1)
    return df.join(sizes, "country").select("country", "word", "df_name", "df_addr", weight("df_name").alias("w_name"), weight("df_addr").alias("w_addr"))


def _tagged(column: str, k: int):
    return F.transform(column, lambda w: F.struct(w.alias("word"), F.lit(k).alias("k")))


def weighted(records: DataFrame, stats: DataFrame) -> DataFrame:
    """records of fields() with names_w and addrs_w: arrays of (word, w, df), in the words' order. Words that no Source-1 record has weigh 1."""
    x = F.concat(F.transform("names", lambda w, i: F.struct(F.lit(0).alias("k"), i.alias("i"), w.alias("word"))), F.transform("addrs", lambda w, i: F.struct(F.lit(1).alias("k"), i.alias("i"), w.alias("word"))))
    rows = records.select("country", "entity_id", F.explode(x).alias("x")).select("country", "entity_id", "x.*").join(stats, ["country", "word"], "left")
    df = F.coalesce(F.when(F.col("k") == 0, F.col("df_name")).otherwise(F.col("df_addr")), F.lit(0))
    w = F.coalesce(F.when(F.col("k") == 0, F.col("w_name")).otherwise(F.col("w_addr")), F.lit(1.0))
    entry = F.struct("k", "i", "word", w.alias("w"), df.alias("df"))
    lists = rows.groupBy("country", "entity_id").agg(F.array_sort(F.collect_list(entry)).alias("all_"))
    part = lambda k: F.transform(F.filter(F.coalesce("all_", F.array()), lambda e: e["k"] == k), lambda e: F.struct(e["word"].alias("word"), e["w"].alias("w"), e["df"].alias("df")))
    return records.join(lists, ["country", "entity_id"], "left").withColumns({"names_w": part(0), "addrs_w": part(1)}).drop("all_")


def both_sides(pairs: DataFrame, records: DataFrame, q: str = "q_id", s: str = "s_id") -> DataFrame:
    """pairs with the records of both ids as structs q and s, and the sums that several features share. What nobody asks
    for of these is pruned."""
    side = records.select("country", F.struct(*[c for c in records.columns if c != "country"]).alias("r_"))
    left = side.select("country", F.col("r_.entity_id").alias(q), F.col("r_").alias("q"))
    right = side.select("country", F.col("r_.entity_id").alias(s), F.col("r_").alias("s"))
    both = pairs.join(left, ["country", q]).join(right, ["country", s])
    a, b = F.col("q"), F.col("s")
    sums = S.weight_sums(a["names_w"], b["names_w"], "n") | S.weight_sums(a["addrs_w"], b["addrs_w"], "a")
    return both.withColumns(sums | {"near_": S.near_misses(a["numbers"], b["numbers"])})


def kernel_features() -> dict[str, Column]:
    """The 34 features of overlaps and conflicts."""
    q, s = F.col("q"), F.col("s")
    names, addrs = S.weighted_features(q["names_w"], s["names_w"], "n"), S.weighted_features(q["addrs_w"], s["addrs_w"], "a")
    units = S.set_equality(q["unit_list"], s["unit_list"], "unit")
    inside = F.greatest(S.most(S.in_words(q["names_w"], s["addrs"])), S.most(S.in_words(s["names_w"], q["addrs"])))
    return {
        **names, "n_first_eq": S.flag((F.size(q["names"]) > 0) & (F.get(q["names"], F.lit(0)) == F.get(s["names"], F.lit(0)))),
        "n_unseen_q": F.size(F.filter(q["names_w"], lambda e: e["df"] == 0)), "ph_jacc": S.jaccard(q["phons"], s["phons"]),
        **{k: addrs[k] for k in ("a_wjacc", "a_wcov_min", "a_maxw_shared", "a_cnt_q", "a_cnt_s")}, **S.number_features(q["numbers"], s["numbers"]),
        "unit_shared": F.size(F.array_intersect(q["unit_list"], s["unit_list"])), "unit_conflict": units["unit_conflict"],
        **S.equality(q["pin"], s["pin"], "pin"), **S.equality(q["st"], s["st"], "st"), **S.set_equality(q["forms"], s["forms"], "sfx"), "name_in_addr": inside,
    }


def string_features() -> dict[str, Column]:
    """The 12 string similarities; a field that is empty on either side gives 0."""
    q, s = F.col("q"), F.col("s")
    tight = lambda r: F.replace(r["core"], F.lit(" "), F.lit(""))
    sim = fuzzy.similarity
    forms = [sim("ratio", tight(q), f) for f in fuzzy.acronyms(s["core"])] + [sim("ratio", tight(s), fuzzy.acronyms(q["core"])[2])]
    some = (q["core"] != "") & (s["core"] != "")
    return {
        "n_ratio": sim("ratio", q["core"], s["core"]), "n_tsort": sim("token_sort", q["core"], s["core"]), "n_tset": sim("token_set", q["core"], s["core"]),
        "n_partial": sim("partial", tight(q), tight(s)), "n_jw": sim("jaro_winkler", tight(q), tight(s)), "ph_tset": sim("token_set", q["phon"], s["phon"]),
        "n_acr": F.when(some, F.greatest(*forms)).otherwise(F.lit(0.0)), "a_tset": sim("token_set", q["ad"], s["ad"]), "a_tsort": sim("token_sort", q["ad"], s["ad"]),
        "a_partial": sim("partial", q["ad"], s["ad"]), "nums_tset": sim("token_set", q["nums"], s["nums"]), "lnum_sim": S.longest_similarity(q["numbers"], s["numbers"]),
    }


def flag_features() -> dict[str, Column]:
    q, s = F.col("q"), F.col("s")
    return {
        "dom": q["dom"].cast("int"), "scr": q["scr"].cast("int"), "s3": S.flag(q["entity_id"].startswith("S3-")), "addr_empty_q": S.flag(q["ad"] == ""),
        "addr_empty_s": S.flag(s["ad"] == ""), "name_len_q": F.length(q["core"]), "name_len_s": F.length(s["core"]), "name_empty_q": S.flag(q["core"] == ""),
    }


def retrieval_features(pairs: DataFrame) -> DataFrame:
    """pairs with ret_rank, ret_log, ret_rel, ret_gap_q, ret_ncand and ret_next_gap, from rank and score within a query."""
    w = Window.partitionBy("country", "q_id").orderBy("rank")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    best, second = F.first("score").over(whole), F.coalesce(F.nth_value("score", 2).over(whole), F.lit(0.0))
    nxt = F.coalesce(F.lead("score").over(w), F.lit(0.0))
    r6 = lambda c: S.rounded(c, 6)
    return pairs.withColumns({
        "ret_rank": F.col("rank"), "ret_log": r6(F.log1p("score")), "ret_rel": r6(S.share(F.col("score"), best)), "ret_gap_q": r6(S.share(best - second, best)),
        "ret_ncand": F.count("*").over(whole), "ret_next_gap": r6(S.share(F.col("score") - nxt, F.col("score"))),
    })


def pair_features(pairs: DataFrame, records: DataFrame, strings: bool = True) -> DataFrame:
    """(country, q_id, s_id) and the kernel, string, flag and number-difference features, doubles rounded to six places."""
    both = both_sides(pairs.select("country", "q_id", "s_id"), records)
    q, s = F.col("q"), F.col("s")
    columns = kernel_features() | flag_features() | S.number_differences(q["numbers"], s["numbers"]) | (string_features() if strings else {"lnum_sim": S.longest_similarity(q["numbers"], s["numbers"])})
    out = both.select("country", "q_id", "s_id", *[c.alias(k) for k, c in columns.items()])
    return out.select("country", "q_id", "s_id", *[(F.round(c, 6).alias(c) if dict(out.dtypes)[c] == "double" else F.col(c)) for c in columns])
