"""Raw records (entity_id, source, country, name, address) to normalized ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text


def in_latin(df: DataFrame, translit: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """df with name and address in Latin letters, by learned maps; scr_: whether the name had Indic letters; parts_: which parts
    of the address had.

    Only texts with Indic letters reach Python.
    """
    marked = df.withColumns({"scr_": text.has_indic(F.col("name")), "parts_": text.native_parts(F.col("address"))})
    return marked.withColumns({"name": text.latin(F.col("name"), "name", translit), "address": text.latin(F.col("address"), "addr", translit)})


def with_name(df: DataFrame) -> DataFrame:
    """df with nm, core, phon, sfx and dom of column name. Each step is a projection of its own, so nothing is worked out twice."""
    df = df.withColumn("t_", text.blank_if_null(F.col("name")))
    df = df.withColumns({"label_": text.domain_label(F.col("t_")), "words_": text.name_words(F.col("t_"))})
    plain = F.col("label_") == ""
    df = df.withColumns({
        "tokens_": F.when(plain, text.canonical(F.col("words_"))).otherwise(F.array("label_")),
        "legal_": F.when(plain, text.legal_forms(F.col("words_"))).otherwise(F.array().cast("array<string>")),
    })
    df = df.withColumn("core_", text.core_of(F.col("tokens_")))
    return df.withColumns({
        "nm": F.array_join("tokens_", " "), "core": F.array_join("core_", " "), "phon": F.array_join(text.skeletons(F.col("core_")), " "),
        "sfx": F.array_join(F.array_sort(F.array_distinct("legal_")), " "), "dom": F.when(plain, 0).otherwise(1).cast("byte"),
    }).drop("t_", "label_", "words_", "tokens_", "legal_", "core_")


def with_address(df: DataFrame) -> DataFrame:
    """df with ad, st, nums, units and pin of columns address and country, and parts_ if in_latin() made it."""
    native = F.col("parts_") if "parts_" in df.columns else F.array().cast("array<boolean>")
    df = df.withColumns({"c_": F.lower("country"), "t_": text.blank_if_null(F.col("address"))})
    df = df.withColumn("lines_", text.address_lines(F.col("t_"), F.col("c_"), native))
    df = df.withColumn("words_", text.address_words(F.col("lines_"), F.col("c_")))
    df = df.withColumn("nums_", text.address_numbers(F.col("words_")))
    codes = F.filter("lines_", lambda x: x["code"].isNotNull())
    return df.withColumns({
        "ad": F.array_join("words_", " "), "st": F.coalesce(text.last_of(codes)["code"], F.lit("")), "nums": F.array_join("nums_", " "),
        "units": F.array_join(text.address_units(F.col("words_")), " "), "pin": F.coalesce(text.last_of(F.filter("nums_", lambda n: F.length(n) == 6)), F.lit("")),
    }).drop("c_", "t_", "lines_", "words_", "nums_")


def normalized(df: DataFrame, native: bool = True, translit: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """The 13 columns of a normalized record, and source. native: whether Indic letters may occur; without them no row
    leaves the JVM. Null and blank fields give empty columns; unknown countries use the common rules."""
    df = in_latin(df, translit) if native else df.withColumn("scr_", text.has_indic(F.col("name")))
    out = with_address(with_name(df)).withColumn("scr", F.when(F.col("scr_") & (F.col("dom") == 0), 1).otherwise(0).cast("byte"))
    return out.select("entity_id", "source", "country", "nm", "core", "phon", "sfx", "dom", "scr", "ad", "st", "nums", "units", "pin")
