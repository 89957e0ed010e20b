"""Pair features as DuckDB SQL."""

from __future__ import annotations

from tessera.functions.similarity import WIDTHS as W
from tessera.plans import sqltext as S


def fields(source: str, out: str) -> str:
    """CTEs: word lists of records, and out with the weighted lists."""
    return f"""
{out}w AS (SELECT *, {S.words('core')} AS w1,
  {S.words("regexp_replace(ad, '\\b[0-9]+\\b', ' ', 'g')")} AS w2, {S.words('phon')} AS w3, {S.words('nums')} AS w4, {S.words('units')} AS w5 FROM {source}),
{out}f AS (SELECT * EXCLUDE (w1, w2, w3, w4, w5), ({S.distinct('w1')})[1:{W['name']}] AS names, ({S.distinct('w2')})[1:{W['addr']}] AS addrs, ({S.distinct('w3')})[1:{W['phon']}] AS phons,
  ({S.distinct('w4')})[1:{W['num']}] AS numbers, ({S.distinct('w5')})[1:{W['unit']}] AS unit_list, {S.words('sfx')} AS forms FROM {out}w),
{out}x AS (SELECT country, entity_id, source, 0 AS k, unnest(names) AS word, unnest(range(len(names))) AS i FROM {out}f
  UNION ALL SELECT country, entity_id, source, 1, unnest(addrs), unnest(range(len(addrs))) FROM {out}f),
{out}n AS (SELECT country, count(*) AS n FROM {out}f WHERE source = 'S1' GROUP BY country),
{out}stats AS (SELECT x.country, word, count_if(k = 0) AS df_name, count_if(k = 1) AS df_addr, ln((any_value(n) + 1)::DOUBLE / (count_if(k = 0) + 1)) / ln(any_value(n) + 1) AS w_name,
  ln((any_value(n) + 1)::DOUBLE / (count_if(k = 1) + 1)) / ln(any_value(n) + 1) AS w_addr FROM {out}x x JOIN {out}n n ON x.country = n.country WHERE source = 'S1' GROUP BY x.country, word),
{out}e AS (SELECT x.country, x.entity_id, k, list({{'word': x.word, 'w': coalesce(CASE WHEN k = 0 THEN w_name ELSE w_addr END, 1), 'df': coalesce(CASE WHEN k = 0 THEN df_name ELSE df_addr END, 0)}} ORDER BY i) AS es
  FROM {out}x x LEFT JOIN {out}stats s ON x.country = s.country AND x.word = s.word GROUP BY ALL),
{out} AS (SELECT f.*, coalesce(a.es, []) AS names_w, coalesce(b.es, []) AS addrs_w FROM {out}f f
  LEFT JOIN {out}e a ON f.entity_id = a.entity_id AND f.country = a.country AND a.k = 0 LEFT JOIN {out}e b ON f.entity_id = b.entity_id AND f.country = b.country AND b.k = 1)"""


def both(pairs: str, records: str, out: str) -> str:
    cols = "names addrs phons numbers unit_list forms names_w addrs_w core phon ad nums pin st dom scr".split()
    return f"""{out} AS (SELECT p.country, p.q_id, p.s_id, {', '.join(f'q.{c} AS q_{c}, s.{c} AS s_{c}' for c in cols)} FROM {pairs} p
  JOIN {records} q ON p.country = q.country AND p.q_id = q.entity_id JOIN {records} s ON p.country = s.country AND p.s_id = s.entity_id)"""


def jaccard(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b}))) END"


def share(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN ({a})::DOUBLE / ({b}) ELSE 0.0 END"


def _ws(entries: str, others: str, inside: bool = True) -> str:
    return f"list_transform(list_filter({entries}, lambda e: {'' if inside else 'NOT '}list_contains({others}, e.word)), lambda e: e.w)"


def _sum(a: str) -> str:
    return f"coalesce(list_sum({a}), 0.0)"


def _max(a: str) -> str:
    return f"coalesce(list_max({a}), 0.0)"


def flag(x: str) -> str:
    return f"coalesce({x}, false)::INT"


def except_(a: str, b: str) -> str:
    return f"list_filter({a}, lambda z: NOT list_contains({b}, z))"


def weighted(q: str, s: str, qw: str, sw: str, p: str) -> dict[str, str]:
    shared, tq, ts = _sum(_ws(q, sw)), _sum(f"list_transform({q}, lambda e: e.w)"), _sum(f"list_transform({s}, lambda e: e.w)")
    return {
        f"{p}_wjacc": share(shared, f"({tq} + {ts} - {shared})"), f"{p}_wcov_min": share(shared, f"least({tq}, {ts})"), f"{p}_wcov_q": share(shared, tq), f"{p}_wcov_s": share(shared, ts),
        f"{p}_shared": f"len(list_intersect({qw}, {sw}))", f"{p}_maxw_shared": _max(_ws(q, sw)), f"{p}_maxw_unq_q": _max(_ws(q, sw, False)), f"{p}_maxw_unq_s": _max(_ws(s, qw, False)),
        f"{p}_cnt_q": f"len({q})", f"{p}_cnt_s": f"len({s})",
    }


def numbers(q: str, s: str) -> dict[str, str]:
    long = lambda a: f"list_filter({a}, lambda n: length(n) >= 2)"
    hits = f"list_intersect({q}, {s})"
    close = f"len(list_filter({except_(long(q), s)}, lambda x: len(list_filter({long(s)}, lambda y: levenshtein(x, y) <= 1)) > 0))"
    return {
        "num_jacc": jaccard(q, s), "num_shared": f"len({hits})", "num_maxlen_shared": f"coalesce(list_max(list_transform({hits}, lambda n: length(n))), 0)", "num_near": close,
        "num_conflict": flag(f"len({long(q)}) > 0 AND len({long(s)}) > 0 AND len({hits}) = 0 AND {close} = 0"), "num_cnt_q": f"len({q})", "num_cnt_s": f"len({s})",
    }


def relation(x: str, y: str) -> str:
    return f"CASE WHEN {x} = {y} THEN 1 WHEN levenshtein({x}, {y}) = 1 AND length({x}) = length({y}) THEN 2 WHEN levenshtein({x}, {y}) = 1 THEN 3 ELSE 0 END"


def longest(a: str) -> str:
    return f"list_sort(list_transform({a}, lambda n, i: {{'l': -length(n), 'i': i, 'n': n}}))[1].n"


def number_differences(q: str, s: str) -> dict[str, str]:
    kinds = f"list_transform({except_(q, s)}, lambda x: list_filter(list_transform({s}, lambda y: {relation('x', 'y')}), lambda r: r > 1)[1])"
    of = lambda k: f"len(list_filter({kinds}, lambda r: r = {k}))"
    rel = relation(longest(q), longest(s))
    return {
        "num_q_only": f"len({except_(q, s)})", "num_s_only": f"len({except_(s, q)})", "num_sub1": of(2), "num_indel1": of(3),
        "lnum_rel": f"CASE WHEN len({q}) = 0 OR len({s}) = 0 THEN -1 WHEN ({rel}) = 0 THEN 4 ELSE ({rel}) END",
    }


def equality(a: str, b: str, name: str) -> dict[str, str]:
    return {f"{name}_eq": flag(f"{a} <> '' AND {b} <> '' AND {a} = {b}"), f"{name}_conflict": flag(f"{a} <> '' AND {b} <> '' AND {a} <> {b}")}


def set_equality(a: str, b: str, name: str) -> dict[str, str]:
    some = f"len({a}) > 0 AND len({b}) > 0"
    return {f"{name}_eq": flag(f"{some} AND list_sort({a}) = list_sort({b})"), f"{name}_conflict": flag(f"{some} AND len(list_intersect({a}, {b})) = 0")}


def kernel() -> dict[str, str]:
    names = weighted("q_names_w", "s_names_w", "q_names", "s_names", "n")
    addrs = weighted("q_addrs_w", "s_addrs_w", "q_addrs", "s_addrs", "a")
    return {
        **names, "n_first_eq": flag("len(q_names) > 0 AND q_names[1] = s_names[1]"), "n_unseen_q": "len(list_filter(q_names_w, lambda e: e.df = 0))", "ph_jacc": jaccard("q_phons", "s_phons"),
        **{k: addrs[k] for k in ("a_wjacc", "a_wcov_min", "a_maxw_shared", "a_cnt_q", "a_cnt_s")}, **numbers("q_numbers", "s_numbers"),
        "unit_shared": "len(list_intersect(q_unit_list, s_unit_list))", "unit_conflict": set_equality("q_unit_list", "s_unit_list", "unit")["unit_conflict"],
        **equality("q_pin", "s_pin", "pin"), **equality("q_st", "s_st", "st"), **set_equality("q_forms", "s_forms", "sfx"),
        "name_in_addr": f"greatest({_max(_ws('q_names_w', 's_addrs'))}, {_max(_ws('s_names_w', 'q_addrs'))})",
    }


def flags() -> dict[str, str]:
    return {
        "dom": "q_dom::INT", "scr": "q_scr::INT", "s3": flag("starts_with(q_id, 'S3-')"), "addr_empty_q": flag("q_ad = ''"), "addr_empty_s": flag("s_ad = ''"),
        "name_len_q": "length(q_core)", "name_len_s": "length(s_core)", "name_empty_q": flag("q_core = ''"),
    }


LONGEST_SIM = f"CASE WHEN len(q_numbers) = 0 OR len(s_numbers) = 0 THEN 0.0 ELSE 1 - levenshtein({longest('q_numbers')}, {longest('s_numbers')})::DOUBLE / greatest(length({longest('q_numbers')}), length({longest('s_numbers')})) END"
DOUBLES = {"n_wjacc", "n_wcov_min", "n_wcov_q", "n_wcov_s", "n_maxw_shared", "n_maxw_unq_q", "n_maxw_unq_s", "ph_jacc", "a_wjacc", "a_wcov_min", "a_maxw_shared", "num_jacc", "name_in_addr", "lnum_sim"}


def selected(columns: dict[str, str]) -> str:
    return ", ".join(f"round({x}, 6) AS {c}" if c in DOUBLES else f"{x} AS {c}" for c, x in columns.items())
