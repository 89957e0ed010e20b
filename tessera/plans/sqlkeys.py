"""Blocking keys, index and retrieval as DuckDB SQL."""

from __future__ import annotations

from tessera.functions import tables as T
from tessera.plans import sqltext as S


def by_length(a: str, n: int) -> str:
    return f"list_transform(list_sort(list_transform(list_distinct({a}), lambda x: {{'l': -length(x), 'w': x}}))[1:{n}], lambda s: s.w)"


def _pairs(u: str) -> str:
    return f"flatten(list_transform({u}, lambda x, i: list_transform({u}[i + 1:], lambda y: x || '_' || y)))"


def _crossed(a: str, b: str) -> str:
    return f"flatten(list_transform({a}, lambda x: list_transform({b}, lambda y: x || '|' || y)))"


def _signature(n: str) -> str:
    return f"CASE WHEN len(list_distinct({n})) >= 2 THEN [array_to_string(list_sort(list_distinct({n})), '#')] ELSE [] END"


def _prefix(a: str) -> str:
    first = f"list_sort(list_transform({a}, lambda x, i: {{'l': -length(x), 'i': i, 'w': x}}))[1].w"
    return f"CASE WHEN length({first}) >= 5 THEN [left({first}, 5)] ELSE [] END"


def _ngrams(s: str) -> str:
    at = f"CASE WHEN length({s}) - 3 <= 12 THEN range(length({s}) - 3) ELSE list_transform(range(12), lambda i: (i * (length({s}) - 4)) // 11) END"
    return f"CASE WHEN length({s}) <= 3 THEN [] ELSE list_distinct(list_transform({at}, lambda p: substr({s}, (p + 1)::BIGINT, 4))) END"


def v3_keys(source: str, out: str) -> str:
    """CTEs of (country, id, kind, key) for a CTE of normalized records."""
    kinds = {
        "name": "w", "npair": _pairs("w8"), "phon": "p", "addr": "a", "apair": _pairs("a8"), "num": "n3", "sig": _signature("n"),
        "comp": _crossed("n2", "a5"), "unit": "u", "pref": _prefix("w"), "ngname": _ngrams("cs"), "ngaddr": _ngrams("ads"),
        "nloc": "flatten(list_transform(top4, lambda x: list_transform(list_filter(loc, lambda c: c <> x), lambda c: x || '|' || c)))",
        "nnum": _crossed("top4", "n[1:4]"),
        "ploc": "CASE WHEN len(top4) >= 2 THEN list_transform(list_concat(loc, n[1:3]), lambda c: array_to_string(list_sort(top4[1:2]), '_') || '|' || c) ELSE [] END",
        "exact": "CASE WHEN len(w) > 0 THEN [array_to_string(list_sort(list_distinct(w)), ' ')] ELSE [] END",
    }
    lists = f"""
{out}a AS (SELECT country, entity_id AS id, {S.kept(S.words('core'), "length(t) >= 3 AND NOT regexp_matches(t, '^[0-9]+$')")} AS w,
  {S.kept(S.words('ad'), "length(t) >= 3 AND regexp_matches(t, '^[a-z]+$')")} AS a, {S.words('nums')} AS n, {S.words('units')} AS u,
  {S.kept(S.words('phon'), 'length(t) >= 3')} AS p, regexp_replace(core, '[^0-9a-z]', '', 'g') AS cs, regexp_replace(ad, '[^0-9a-z]', '', 'g') AS ads FROM {source}),
{out}b AS (SELECT *, list_sort({by_length('w', 8)}) AS w8, {by_length('w', 4)} AS top4, {S.kept('a', 'length(t) >= 4')} AS a4, a[-2:] AS l2,
  {S.kept('n', 'length(t) >= 3')} AS n3, {S.kept('n', 'length(t) >= 2')}[1:5] AS n2 FROM {out}a),
{out}c AS (SELECT *, {S.distinct('l2')} AS loc, list_sort({by_length('a4[1:8]', 8)}) AS a8, a4[1:5] AS a5 FROM {out}b)"""
    rows = "\nUNION ALL ".join(f"SELECT country, id, '{kind}' AS kind, unnest(list_distinct({x})) AS key FROM {out}c" for kind, x in kinds.items())
    return f"{lists},\n{out} AS ({rows})"


def v1_keys(source: str, out: str) -> str:
    kinds = {
        "name": "w", "npair": _pairs("w8"), "addr": "a", "apair": _pairs("a8"), "num": "n3", "sig": _signature("n"), "comp": _crossed("n2", "a5"),
        "pref": _prefix("w"), "exact": "CASE WHEN len(w) > 0 THEN [array_to_string(list_sort(list_distinct(w)), ' ')] ELSE [] END",
    }
    long = "length(t) >= 3 AND NOT regexp_matches(t, '^[0-9]+$')"
    lists = f"""
{out}a AS (SELECT country, entity_id AS id, {S.kept(S.words('name_core'), long)} AS w, {S.kept(S.words('addr_normalized'), long)} AS a,
  {S.kept(S.words('addr_numbers'), "regexp_matches(t, '^[0-9]+$') AND t <> '0'")} AS n FROM {source}),
{out}b AS (SELECT *, list_sort({by_length('w', 8)}) AS w8, {S.kept('a', 'length(t) >= 4')} AS a4, {S.kept('n', 'length(t) >= 3')} AS n3, {S.kept('n', 'length(t) >= 2')}[1:5] AS n2 FROM {out}a),
{out}c AS (SELECT *, list_sort({by_length('a4', 8)}) AS a8, a4[1:5] AS a5 FROM {out}b)"""
    rows = "\nUNION ALL ".join(f"SELECT country, id, '{kind}' AS kind, unnest(list_distinct({x})) AS key FROM {out}c" for kind, x in kinds.items())
    return f"{lists},\n{out} AS ({rows})"


def resolved(keys: str, groups: str, out: str, small: int = T.EXACT_SMALL, large: int = T.EXACT_LARGE) -> str:
    return f"""
{out}e AS (SELECT k.country, k.id, k.key AS exact, g.n FROM {keys} k JOIN {groups} g ON k.country = g.country AND k.key = g.exact WHERE k.kind = 'exact' AND g.n <= {large}),
{out} AS (SELECT country, id, kind, key FROM {keys} WHERE kind <> 'exact'
  UNION ALL SELECT country, id, 'exact', 'ex|' || exact FROM {out}e WHERE n <= {small}
  UNION ALL SELECT e.country, e.id, 'exact', CASE WHEN k.kind = 'sig' THEN 'exs|' ELSE 'exn|' END || exact || '|' || k.key
    FROM {out}e e JOIN {keys} k ON e.country = k.country AND e.id = k.id AND k.kind IN ('sig', 'num') WHERE e.n > {small})"""


def groups(keys: str, out: str) -> str:
    return f"{out} AS (SELECT country, key AS exact, count(*) AS n FROM {keys} WHERE kind = 'exact' GROUP BY ALL)"


def weights(keys: str, specs: dict, out: str, scale: float = 1.0) -> str:
    caps = " ".join(f"WHEN kind = '{k}' THEN {max(20, int(c * scale))}" for k, (c, _) in specs.items() if c)
    factors = " ".join(f"WHEN kind = '{k}' THEN {w}::DOUBLE" for k, (_, w) in specs.items())
    return f"""
{out}n AS (SELECT country, count(DISTINCT id) AS n FROM {keys} GROUP BY country),
{out}d AS (SELECT country, kind, key, count(*) AS df FROM {keys} GROUP BY ALL),
{out} AS (SELECT d.country, kind, key, df, CASE WHEN kind = 'exact' THEN {T.EXACT_WEIGHT}::DOUBLE ELSE (CASE {factors} END) * ln((n + 1)::DOUBLE / df) END AS w
  FROM {out}d d JOIN {out}n n ON d.country = n.country
  WHERE df <= CASE WHEN kind = 'exact' THEN 4611686018427387904 {caps} ELSE least(25000, greatest(80, n // 400)) END)"""


def top_k(query_keys: str, index_keys: str, w: str, k: int, out: str) -> str:
    return f"""
{out}s AS (SELECT q.country, q.id AS q_id, i.id AS s_id, round(sum(w.w), 6) AS score FROM {query_keys} q
  JOIN {index_keys} i ON q.country = i.country AND q.kind = i.kind AND q.key = i.key
  JOIN {w} w ON q.country = w.country AND q.kind = w.kind AND q.key = w.key GROUP BY ALL),
{out} AS (SELECT country, q_id, s_id, rn - 1 AS rank, score FROM
  (SELECT *, row_number() OVER (PARTITION BY country, q_id ORDER BY score DESC, s_id) AS rn FROM {out}s) WHERE rn <= {k})"""


def retrieval(norm: str, k: int, out: str, scale: float = 1.0) -> str:
    """CTEs from a CTE of normalized records to the k best Source-1 candidates of the others."""
    return ",".join([
        f"{out}i AS (SELECT * FROM {norm} WHERE source = 'S1'), {out}q AS (SELECT * FROM {norm} WHERE source <> 'S1')",
        v3_keys(f"{out}i", f"{out}ik"), v3_keys(f"{out}q", f"{out}qk"), groups(f"{out}ik", f"{out}g"), resolved(f"{out}ik", f"{out}g", f"{out}ir"),
        resolved(f"{out}qk", f"{out}g", f"{out}qr"), weights(f"{out}ir", T.V3_KEYS, f"{out}w", scale), top_k(f"{out}qr", f"{out}ir", f"{out}w", k, out),
    ])
