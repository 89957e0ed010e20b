"""v1 normalizer: cleaning, legal suffixes, name cores and numbers."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import tables as T
from tessera.functions.text import any_of, is_ascii, latin, mapped, words

SEPARATORS, BRACKETS = r"[,;:\-_/]+", r"[()\[\]{}\"']"


def clean_text(text: Column) -> Column:
    """Lower case; & spelled out; separators, brackets and quotes as spaces; no spaces or points at the ends."""
    t = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"^\s+|\s+$", "")
    t = F.when(any_of(t, ["nan", "null"]), F.lit("")).otherwise(t)
    t = F.regexp_replace(F.replace(t, F.lit("&"), F.lit(" and ")), "<<|>>", "")
    t = F.regexp_replace(F.regexp_replace(t, SEPARATORS, " "), BRACKETS, " ")
    return F.btrim(F.regexp_replace(t, r"\s+", " "), F.lit(" ."))


def unaccented(text: Column) -> Column:
    """Latin letters without accents; Indic signs stay."""
    one = {c: p for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]) if len(p := unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode()) == 1}
    plain = F.regexp_replace(F.translate(text, "".join(one), "".join(one.values())), r"[\x{300}-\x{36F}]", "")
    return F.when(is_ascii(text), text).otherwise(plain)


def states_in_latin(text: Column) -> Column:
    """Native-script names of Indian states in English; texts without Indic letters pass by."""
    out = text
    for native, english in T.V1_INDIA_STATES.items():
        out = F.replace(out, F.lit(native), F.lit(english))
    return F.when(text.rlike(r"[\x{900}-\x{DFF}]"), out).otherwise(text)


def recleaned(text: Column, native: bool = False) -> Column:
    """A cleaned text after transliteration: separators and brackets again, accents off. & and points stay as they are.

    native: other words in Indic letters are written in Latin ones, too; only such texts reach Python.
    """
    t = states_in_latin(text)
    t = latin(t, "v1") if native else t
    t = F.regexp_replace(F.regexp_replace(F.lower(t), SEPARATORS, " "), BRACKETS, " ")
    return F.lower(unaccented(F.trim(F.regexp_replace(t, r"\s+", " "))))


def standard_suffixes(name: Column) -> Column:
    def one(t: Column) -> Column:
        plain = F.replace(F.btrim(t, F.lit(".,;:()[]")), F.lit("."), F.lit(""))
        return F.when(any_of(plain, list(T.V1_LEGAL_FORMS)), mapped(plain, T.V1_LEGAL_FORMS)).otherwise(t)

    return F.array_join(F.transform(words(name), one), " ")


def name_core(name: Column) -> Column:
    cleaned = F.transform(words(name), lambda t: F.regexp_replace(t, r"[^a-z0-9\x{900}-\x{DFF}]", ""))
    core = F.filter(cleaned, lambda t: (F.length(t) > 1) & ~any_of(t, T.V1_NAME_STOP))
    return F.when(F.size(core) > 0, F.array_join(core, " ")).otherwise(name)


def numbers(text: Column) -> Column:
    return F.array_join(F.regexp_extract_all(text, F.lit(r"\d+"), F.lit(0)), " ")


def record_columns(name: Column, address: Column, native: bool = False) -> dict[str, Column]:
    """name_clean, name_normalized, name_core, addr_clean, addr_normalized, addr_numbers. native: see recleaned()."""
    n, a = recleaned(clean_text(name), native), recleaned(clean_text(address), native)
    standard = standard_suffixes(n)
    return {
        "name_clean": clean_text(name), "name_normalized": standard, "name_core": name_core(standard),
        "addr_clean": clean_text(address), "addr_normalized": a, "addr_numbers": numbers(a),
    }
