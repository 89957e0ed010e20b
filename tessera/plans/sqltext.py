"""The normalizer's functions as DuckDB expressions, written on their own to check the column functions."""

from __future__ import annotations

from tessera.functions import tables as T


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strings(values) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


def mapped(x: str, table: dict[str, str]) -> str:
    if not table:
        return x
    return f"coalesce(({strings(table.values())})[list_position({strings(table)}, {x})], {x})"


def looked_up(x: str, table: dict[str, str]) -> str:
    return f"(({strings(table.values())})[list_position({strings(table)}, {x})])"


def isin(x: str, values) -> str:
    return f"({x} IN ({', '.join(lit(v) for v in values)}))"


def joined(a: str, by: str = " ") -> str:
    return f"coalesce(array_to_string({a}, {lit(by)}), '')"


def kept(a: str, condition: str, var: str = "t") -> str:
    return f"list_filter({a}, lambda {var}: {condition})"


def each(a: str, x: str, var: str = "t") -> str:
    return f"list_transform({a}, lambda {var}: {x})"


def words(x: str) -> str:
    return kept(f"string_split({x}, ' ')", "t <> ''")


def distinct(a: str) -> str:
    """First occurrences in order."""
    return f"list_filter({a}, lambda t, i: list_position({a}, t) = i)"


def folded(x: str) -> str:
    return f"lower(regexp_replace(strip_accents({x}), '[^\\x00-\\x7F]', '', 'g'))"


def phon(x: str) -> str:
    w = f"replace(replace(replace(lower({x}), 'chh', 'ch'), 'ch', '#'), 'ck', 'k')"
    w = f"regexp_replace(regexp_replace({w}, 'c([eiy])', 's\\1', 'g'), 'g([ei])', 'j\\1', 'g')"
    for a, b in T.SOUNDS:
        w = f"replace({w}, '{a}', '{b}')"
    w = f"regexp_replace({w}, 'j$', 's')"
    # One list holds the word so that it is written once.
    w = f"list_transform([{w}], lambda w: regexp_replace(left(w, 1), '[aeiouy]', '') || regexp_replace(substr(w, 2), '[aeiouyh]', '', 'g'))"
    return f"replace(list_transform({w}, lambda s: coalesce(array_to_string(list_filter(string_split(s, ''), lambda c, i: i = 1 OR c <> substr(s, i - 1, 1)), ''), ''))[1], '#', 'c')"


def blank_if_null(x: str) -> str:
    return f"list_transform([regexp_replace(coalesce({x}, ''), '^\\s+|\\s+$', '', 'g')], lambda b: CASE WHEN {isin('lower(b)', T.NULL_WORDS)} THEN '' ELSE b END)[1]"


def raw_tokens(x: str) -> str:
    split = T.SPLIT_CLASS
    return kept(f"regexp_split_to_array({folded(f'regexp_replace({x}, {lit(split)}, {lit(chr(32))}, {lit(chr(103))})')}, '[^0-9a-z]+')", "t <> ''")


def merged_letters(a: str) -> str:
    marked = joined(each(a, "CASE WHEN regexp_matches(t, '^[a-z]$') THEN '<' || t || '>' ELSE t END"))
    return words(f"replace(replace(replace({marked}, '> <', ''), '<', ''), '>', '')")


def leet(x: str) -> str:
    letters = f"length(regexp_replace({x}, '[^a-z]', '', 'g'))"
    return f"CASE WHEN NOT regexp_matches({x}, '^(?:[a-z]+|[0-9]+)$') AND {letters} >= 3 AND length({x}) - {letters} <= 2 THEN translate({x}, '{T.LEET_FROM}', '{T.LEET_TO}') ELSE {x} END"


def name_ctes(source: str, key: str, name: str, out: str = "names") -> str:
    """CTEs that add tokens, legal, core and the name columns to a source's rows."""
    forms = sorted({*T.LEGAL_FORMS, *T.LEGAL_FORMS.values()})
    return f"""
{out}0 AS (SELECT *, {blank_if_null(name)} AS text_ FROM {source}),
{out}1 AS (SELECT *, replace(regexp_extract(lower(text_), {lit(T.DOMAIN)}, 1), '-', '') AS label_,
  {each(merged_letters(raw_tokens("regexp_replace(replace(text_, '&', ' and '), '[''’]', '', 'g')")), leet('t'))} AS repaired_ FROM {out}0),
{out}2 AS (SELECT *, {each('repaired_', mapped('t', T.LEGAL_FORMS))} AS canon_,
  CASE WHEN label_ <> '' THEN [] ELSE {each(kept('repaired_', isin('t', T.LEGAL_FORMS)), mapped('t', T.LEGAL_FORMS))} END AS legal_ FROM {out}1),
{out}3 AS (SELECT *, CASE WHEN label_ <> '' THEN [label_] ELSE list_filter(canon_, lambda t, i: i = 1 OR t <> canon_[i - 1]) END AS tokens_ FROM {out}2),
{out}4 AS (SELECT *, {kept('tokens_', f"NOT {isin('t', forms)} AND NOT {isin('t', T.NAME_STOP)} AND length(t) > 1")} AS strict_,
  {kept('tokens_', f"NOT {isin('t', T.NAME_STOP)}")} AS loose_ FROM {out}3),
{out}5 AS (SELECT *, CASE WHEN len(strict_) > 0 THEN strict_ ELSE loose_ END AS core_ FROM {out}4),
{out} AS (SELECT * EXCLUDE (text_, label_, repaired_, canon_, legal_, tokens_, strict_, loose_, core_),
  {joined('tokens_')} AS nm, {joined('core_')} AS core,
  {joined(kept(each(kept('core_', "NOT regexp_matches(t, '^[0-9]+$')"), phon('t')), "t <> ''"))} AS phon,
  {joined('list_sort(list_distinct(legal_))')} AS sfx,
  (label_ <> '')::TINYINT AS dom, (label_ = '' AND regexp_matches(text_, '[\\x{{900}}-\\x{{DFF}}]'))::TINYINT AS scr FROM {out}5)"""


def by_country(country: str, make) -> str:
    return "CASE " + " ".join(f"WHEN {country} = '{c}' THEN {make(c)}" for c in T.STATES) + f" ELSE {make(None)} END"


def unit_letters(country: str | None) -> str:
    banned = T.NOT_UNIT_LETTERS.get(country, T.NOT_UNIT_DEFAULT)
    return "".join(c for c in "abcdefghijklmnopqrstuvwxyz" if c not in banned)


def address_ctes(source: str, address: str, country: str, key: str, out: str = "addresses") -> str:
    """CTEs that add the address columns to a source's rows; key names a row."""
    apart = "|".join(T.HYPHEN_KEPT_APART)
    part = "replace(part_, '&', ' and ')"
    part = f"regexp_replace({part}, '\\b((?i:{apart}))-0*(\\d+)\\b', '\\1 \\2', 'g')"
    part = f"regexp_replace({part}, '\\b([A-Za-z]{{1,2}})-0*(\\d+)\\b', '\\1\\2', 'g')"
    part = f"regexp_replace({part}, '\\b0*(\\d+)-([A-Za-z])\\b', '\\1\\2', 'g')"

    def units(name: str | None) -> str:
        x = unit_letters(name)
        return f"regexp_replace(regexp_replace(line0_, '\\b([{x}])\\s*0*(\\d+)\\b', '\\1\\2', 'g'), '\\b0*(\\d+)\\s?([{x}])\\b', '\\1\\2', 'g')"

    code = by_country(country, lambda c: looked_up("line_", T.STATES[c]) if c in T.STATES else "NULL")
    abbr = by_country(country, lambda c: mapped("w_", T.ADDRESS_WORDS | T.ADDRESS_WORDS_BY_COUNTRY.get(c, {})))
    return f"""
{out}0 AS (SELECT {key} AS k_, {country} AS {country}, unnest(ps_) AS part_, unnest(range(len(ps_))) AS i_ FROM
  (SELECT *, regexp_split_to_array(regexp_replace({blank_if_null(address)}, '<\\s*null\\s*>', ' ', 'gi'), '[,;]+') AS ps_ FROM {source})),
{out}1 AS (SELECT k_, i_, {country}, regexp_replace({joined(raw_tokens(part))}, {lit(T.ORDINAL)}, '\\1', 'g') AS line0_ FROM {out}0),
{out}2 AS (SELECT k_, i_, {country}, {by_country(country, units)} AS line_ FROM {out}1),
{out}3 AS (SELECT *, {code} AS code_ FROM {out}2 WHERE line_ <> ''),
{out}4 AS (SELECT k_, i_, {country}, unnest({words('line_')}) AS w_, unnest(range(len({words('line_')}))) AS j_ FROM {out}3 WHERE code_ IS NULL),
{out}5 AS (SELECT k_, i_, j_, {abbr} AS t_ FROM {out}4),
{out}6 AS (SELECT k_, list(t_ ORDER BY i_, j_) AS ts_ FROM {out}5 WHERE t_ <> '' GROUP BY k_),
{out}7 AS (SELECT k_, arg_max(code_, i_) AS st_ FROM {out}3 WHERE code_ IS NOT NULL GROUP BY k_),
{out}8 AS (SELECT k_, ts_, {kept("flatten(" + each('ts_', "list_transform(regexp_extract_all(t, '\\d+'), lambda n: ltrim(n, '0'))") + ")", "t <> ''")} AS ns_,
  {kept('ts_', "regexp_matches(t, '[0-9]') AND NOT regexp_matches(t, '^[0-9]+$')")} AS us_ FROM {out}6),
{out}9 AS (SELECT k_, ts_, {distinct('ns_')} AS ns_, {distinct('us_')} AS us_ FROM {out}8),
{out} AS (SELECT s.*, {joined('ts_')} AS ad, coalesce(st_, '') AS st, {joined('ns_')} AS nums, {joined('us_')} AS units,
  coalesce(list_filter(ns_, lambda n: length(n) = 6)[-1], '') AS pin
  FROM {source} s LEFT JOIN {out}9 a ON s.{key} = a.k_ LEFT JOIN {out}7 b ON s.{key} = b.k_)"""
