"""Learns how Indic tokens are spelled in Latin from records and their owners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import fuzzy
from tessera.functions import tables as T
from tessera.functions import text as X

MIN_COUNT, MIN_SHARE, MIN_SKELETON = 2, 0.5, 3
#: Least similarity of skeletons for an aligned token.
LEAST = {"name": 0.5, "addr": 0.6}


def aligned(pairs: DataFrame, kind: str) -> DataFrame:
    """(token, target) from pairs (q_id, native, latin_tokens): by position in names of equal length, else the owner's token with
    the most similar skeleton, the first of equals."""
    native = F.filter(F.split(F.replace("native", F.lit("&"), F.lit(" ")), T.SPLIT_CLASS), lambda t: t != "")
    native = F.transform(native, lambda t: F.translate(t, T.ZERO_WIDTH, ""))
    rows = pairs.withColumn("native_", native).where((F.size("native_") > 0) & (F.size("latin_tokens") > 0))
    rows = rows.select("q_id", "latin_tokens", F.size("native_").alias("n_"), F.posexplode("native_").alias("i", "token")).where(X.has_indic(F.col("token")))
    same = (F.col("n_") == F.size("latin_tokens")) & F.lit(kind == "name")
    by_place = rows.where(same).select("token", F.get("latin_tokens", F.col("i")).alias("target"))
    own = rows.where(~same).withColumn("skeleton", X.phon(X.folded(X.romanize(F.col("token")))))
    each = own.select("q_id", "i", "token", "skeleton", F.posexplode("latin_tokens").alias("j", "target"))
    scored = each.withColumn("sim", fuzzy.similarity("ratio", F.col("skeleton"), X.phon(F.col("target"))))
    best = scored.groupBy("q_id", "i", "token").agg(F.max(F.struct("sim", (-F.col("j")).alias("j"), "target")).alias("b")).where(F.col("b.sim") >= LEAST[kind])
    return by_place.unionByName(best.select("token", F.col("b.target").alias("target")))


def majority(found: DataFrame, key: Column) -> DataFrame:
    """(token, target): targets that a token (or its normalized form) has twice or more and in half of all cases or more."""
    counts = found.groupBy(key.alias("token"), "target").agg(F.count("*").alias("n"))
    w = Window.partitionBy("token")
    ranked = counts.withColumns({"rn_": F.row_number().over(w.orderBy(F.desc("n"), "target")), "all_": F.sum("n").over(w)})
    return ranked.where((F.col("rn_") <= 1) & (F.col("n") >= MIN_COUNT) & (F.col("n") >= MIN_SHARE * F.col("all_"))).select("token", "target")


def vocabulary(names: DataFrame, least: int = 3) -> DataFrame:
    """(token, target): skeletons of three letters or more and the most frequent Source-1 word that has each; of equals the first."""
    tokens = names.where(X.is_ascii(F.col("name"))).select(F.explode(F.split(F.lower("name"), "[^0-9a-z]+")).alias("w")).where(F.col("w").rlike("^[a-z]{3,}$"))
    counts = tokens.groupBy("w").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    form = X.mapped(F.col("w"), T.LEGAL_FORMS)
    rows = counts.select(X.phon(form).alias("token"), form.alias("target"), "n", "w").where(F.length("token") >= MIN_SKELETON)
    best = rows.groupBy("token").agg(F.min(F.struct((-F.col("n")).alias("n"), "w", "target")).alias("b"))
    return best.select("token", F.col("b.target").alias("target"))


def learn(queries: DataFrame, s1: DataFrame, owners: DataFrame) -> dict[str, DataFrame]:
    """The five maps: name, name_d, addr, addr_d (d: block-normalized tokens) and vphon, as (token, target) tables."""
    indic = queries.where(X.has_indic(F.col("name")) | X.has_indic(F.col("address"))).select(F.col("entity_id").alias("q_id"), "name", "address")
    own = s1.select(F.col("entity_id").alias("s_id"), F.col("name").alias("s_name"), F.col("address").alias("s_address"))
    pairs = indic.join(owners, "q_id").join(own, "s_id")
    names = pairs.where(X.has_indic(F.col("name"))).select("q_id", F.col("name").alias("native"), X.canonical(X.name_words(X.blank_if_null(F.col("s_name")))).alias("latin_tokens"))
    addresses = pairs.where(X.has_indic(F.col("address"))).select("q_id", F.col("address").alias("native"), X.raw_tokens(F.col("s_address")).alias("latin_tokens"))
    found = {"name": aligned(names, "name"), "addr": aligned(addresses, "addr")}
    out = {kind: majority(f, F.col("token")) for kind, f in found.items()}
    out |= {f"{kind}_d": majority(f, X.block_normalized(F.col("token"))) for kind, f in found.items()}
    return out | {"vphon": vocabulary(s1)}


def as_dict(table: DataFrame, most: int = 2_000_000) -> dict[str, str]:
    """A learned map for Python workers; refuses one larger than a vocabulary can be."""
    rows = table.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a map of more than {most} words")
    return {r["token"]: r["target"] for r in rows}
