"""Queries of the text functions over record views."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text
from tessera.plans import sqltext as S
from tessera.plans.base import Registry
from tessera.plans.fixtures import NORMALIZED_SQL, RECORDS_SQL, documents, norm, records

R = Registry()
WORDS_SQL = "ws AS (SELECT DISTINCT unnest(string_split_regex(lower(trim(text)), '\\s+')) AS word FROM documents)"


def _words(spark, sf):
    return documents(spark, sf).select(F.explode(F.split(F.lower(F.trim("text")), r"\s+")).alias("word")).distinct()


@R.query(f"WITH {WORDS_SQL} SELECT word, {S.phon('word')} AS skeleton FROM ws WHERE regexp_matches(word, '^[a-z]+$')")
def phon_skeleton(spark, sf):
    return _words(spark, sf).where(F.col("word").rlike("^[a-z]+$")).select("word", text.phon(F.col("word")).alias("skeleton"))


@R.query(f"WITH {WORDS_SQL} SELECT word, {S.folded('word')} AS plain FROM ws")
def accent_fold(spark, sf):
    return _words(spark, sf).select("word", text.folded(F.col("word")).alias("plain"))


@R.query("SELECT doc_id, regexp_matches(text, '^[\\x00-\\x7F]*$') AS ascii, regexp_matches(text, '[\\x{900}-\\x{DFF}]') AS indic FROM documents")
def ascii_filter(spark, sf):
    return documents(spark, sf).select("doc_id", text.is_ascii(F.col("text")).alias("ascii"), text.has_indic(F.col("text")).alias("indic"))


@R.query("""WITH v(t) AS (VALUES ('परफेक्ट'), ('தமிழ்'), ('abc'), ('ಕರ್ನಾಟಕ'))
SELECT t, array_to_string(list_transform(string_split(t, ''), lambda c: CASE WHEN unicode(c) BETWEEN 2304 AND 3583 THEN chr(2304 + (unicode(c) & 127)) ELSE c END), '') AS block FROM v""")
def indic_block(spark, sf):
    v = spark.createDataFrame([("परफेक्ट",), ("தமிழ்",), ("abc",), ("ಕರ್ನಾಟಕ",)], "t string")
    return v.select("t", text.block_normalized(F.col("t")).alias("block"))


@R.query()
def indic_romanize(spark, sf):
    """No oracle: a state machine; golden values are in the tests."""
    v = spark.createDataFrame([("परफेक्ट",), ("ಕರ್ನಾಟಕ",), ("हरियाणा",), ("தமிழ் நாடு",)], "t string")
    return v.select("t", text.latin(F.col("t"), "addr").alias("latin"), text.romanize(F.col("t")).alias("letters"))


@R.query(f"WITH {RECORDS_SQL} SELECT entity_id, {S.joined(S.raw_tokens('name'))} AS tokens FROM records")
def raw_tokens(spark, sf):
    return records(spark, sf).select("entity_id", F.array_join(text.raw_tokens(F.col("name")), " ").alias("tokens"))


@R.query(f"WITH {RECORDS_SQL} SELECT entity_id, {S.joined(S.merged_letters(S.raw_tokens('name')))} AS tokens FROM records")
def merge_letters(spark, sf):
    return records(spark, sf).select("entity_id", F.array_join(text.merged_letters(text.raw_tokens(F.col("name"))), " ").alias("tokens"))


@R.query(f"WITH v AS (SELECT DISTINCT translate(lower(p_name), 'oeast', '03457') AS w FROM part) SELECT w, {S.joined(S.each(S.words('w'), S.leet('t')))} AS repaired FROM v")
def leet_repair(spark, sf):
    v = spark.read.parquet(f"{sf}/part.parquet").select(F.translate(F.lower("p_name"), "oeast", "03457").alias("w")).distinct()
    return v.select("w", F.array_join(F.transform(text.words(F.col("w")), text.leet_repaired), " ").alias("repaired"))


_HOST = "regexp_replace(url, '^https?://([^/]+).*$', '\\1')"


@R.query(f"WITH v AS (SELECT DISTINCT {_HOST} AS host FROM pages) SELECT host, replace(regexp_extract(lower(host), {S.lit(S.T.DOMAIN)}, 1), '-', '') AS label FROM v")
def domain_name(spark, sf):
    v = spark.read.parquet(f"{sf}/pages.parquet").select(F.regexp_replace("url", "^https?://([^/]+).*$", "$1").alias("host")).distinct()
    return v.select("host", text.domain_label(F.col("host")).alias("label"))


_NORM = f"WITH {NORMALIZED_SQL} SELECT entity_id, COLUMNS_ FROM norm"


def _from_norm(name: str, *columns: str) -> None:
    R.add(name, lambda spark, sf: norm(spark, sf).select("entity_id", *columns), _NORM.replace("COLUMNS_", ", ".join(columns)))


_from_norm("name_tokens", "nm", "dom", "scr")
_from_norm("name_core", "core")
_from_norm("legal_canon", "sfx")
_from_norm("name_phon", "phon")
_from_norm("address_tokens", "ad")
_from_norm("address_state", "st")
_from_norm("address_numbers", "nums")
_from_norm("unit_tokens", "units")
_from_norm("pin_last6", "pin")
_from_norm("normalized_records", "source", "country", "nm", "core", "phon", "sfx", "dom", "scr", "ad", "st", "nums", "units", "pin")
