"""Queries of pair features over retrieved pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import fuzzy
from tessera.functions import similarity as S
from tessera.operators import difftab
from tessera.operators import features as O
from tessera.plans import sqlfeat as Q
from tessera.plans import sqltext as T
from tessera.plans.base import Registry
from tessera.plans.fixtures import GOLD_SQL, gold, norm, stage
from tessera.plans.retrieval_queries import RETRIEVED, V1_SQL, candidates, v1_records

R = Registry()


def encoded(spark, sf):
    def make():
        f = O.fields(norm(spark, sf))
        return O.weighted(f, O.word_stats(f.where("source = 'S1'")))

    return stage(spark, sf, "encoded", make)


def features(spark, sf):
    """Pair features of all retrieved candidates."""
    return stage(spark, sf, "features", lambda: O.pair_features(candidates(spark, sf), encoded(spark, sf), strings=False))


ENCODED_SQL = f"{RETRIEVED}, {Q.fields('norm', 'enc')}"
PAIRS_SQL = f"{ENCODED_SQL}, {Q.both('cand', 'enc', 'prs')}"
GROUPS = {
    "weighted_jaccard": [c for c in Q.kernel() if c.startswith("n_")], "phonetic_jaccard": ["ph_jacc"], "address_jaccard": [c for c in Q.kernel() if c.startswith("a_")],
    "number_overlap": list(Q.numbers("a", "b")), "unit_match": ["unit_shared", "unit_conflict"], "pin_state_match": ["pin_eq", "pin_conflict", "st_eq", "st_conflict"],
    "legal_form_match": ["sfx_eq", "sfx_conflict"], "name_in_address": ["name_in_addr"], "number_relation": list(Q.number_differences("a", "b")), "record_flags": list(Q.flags()), "longest_number_sim": ["lnum_sim"],
}
_ALL = Q.kernel() | Q.flags() | Q.number_differences("q_numbers", "s_numbers") | {"lnum_sim": Q.LONGEST_SIM}
for _name, _columns in GROUPS.items():
    R.add(_name, lambda spark, sf, c=tuple(_columns): features(spark, sf).select("country", "q_id", "s_id", *c), f"WITH {PAIRS_SQL} SELECT country, q_id, s_id, {Q.selected({c: _ALL[c] for c in _columns})} FROM prs")


@R.query(f"WITH {ENCODED_SQL} SELECT country, word, df_name, df_addr, round(w_name, 6) AS w_name, round(w_addr, 6) AS w_addr FROM encstats")
def word_weights(spark, sf):
    f = O.fields(norm(spark, sf).where("source = 'S1'"))
    return O.word_stats(f).withColumns({c: F.round(c, 6) for c in ("w_name", "w_addr")})


@R.query(f"""WITH {RETRIEVED}, b AS (SELECT *, first_value(score) OVER w AS best, coalesce(nth_value(score, 2) OVER w, 0) AS second, coalesce(lead(score) OVER (PARTITION BY country, q_id ORDER BY rank), 0) AS nxt,
  count(*) OVER w AS n FROM cand WINDOW w AS (PARTITION BY country, q_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT country, q_id, s_id, rank AS ret_rank, round(ln(1 + score), 6) AS ret_log, round(score / best, 6) AS ret_rel, round((best - second) / best, 6) AS ret_gap_q, n AS ret_ncand, round((score - nxt) / score, 6) AS ret_next_gap FROM b""")
def retrieval_features(spark, sf):
    return O.retrieval_features(candidates(spark, sf)).select("country", "q_id", "s_id", "ret_rank", "ret_log", "ret_rel", "ret_gap_q", "ret_ncand", "ret_next_gap")


@R.query(f"""WITH {PAIRS_SQL} SELECT country, q_id, s_id, CASE WHEN q_core = '' OR s_core = '' THEN 0 ELSE round(jaro_winkler_similarity(replace(q_core, ' ', ''), replace(s_core, ' ', '')), 6) END AS n_jw FROM prs""")
def jaro_winkler(spark, sf):
    both = O.both_sides(candidates(spark, sf).select("country", "q_id", "s_id"), encoded(spark, sf))
    tight = lambda r: F.replace(F.col(r)["core"], F.lit(" "), F.lit(""))
    return both.select("country", "q_id", "s_id", fuzzy.similarity("jaro_winkler", tight("q"), tight("s")).alias("n_jw"))


@R.query()
def string_similarities(spark, sf):
    """No oracle: indel, token-set and partial ratios have no SQL function; tests compare them with plain tables."""
    both = O.both_sides(candidates(spark, sf).select("country", "q_id", "s_id"), encoded(spark, sf))
    return both.select("country", "q_id", "s_id", *[c.alias(k) for k, c in O.string_features().items()])


_V1 = ("name_core", "addr_normalized", "addr_numbers")
_least = lambda x, n: f"list_distinct({T.kept(T.words(x), f'length(t) >= {n}')})"
_digits = lambda x: f"list_distinct({T.kept(T.words(x), chr(39).join(['regexp_matches(t, ', '^[0-9]+$', ') AND t <> ', '0', '']))})"
_len = lambda a, b: f"CASE WHEN length({a}) = 0 OR length({b}) = 0 THEN 0.0 ELSE least(length({a}), length({b}))::DOUBLE / greatest(length({a}), length({b})) END"


@R.query(f"""WITH {RETRIEVED}, v1a AS{V1_SQL.split("v1a AS")[1]},
p AS (SELECT n.country, q_id, s_id, q.name_core AS n1, q.addr_normalized AS a1, q.addr_numbers AS x1, s.name_core AS n2, s.addr_normalized AS a2, s.addr_numbers AS x2
  FROM cand n JOIN v1 q ON n.q_id = q.entity_id JOIN v1 s ON n.s_id = s.entity_id),
l AS (SELECT *, {_least('n1', 2)} AS nt1, {_least('n2', 2)} AS nt2, {_least('a1', 3)} AS at1, {_least('a2', 3)} AS at2, {_digits('x1')} AS d1, {_digits('x2')} AS d2 FROM p)
SELECT country, q_id, s_id, round({Q.jaccard('nt1', 'nt2')}, 6) AS name_jaccard, round({Q.jaccard('at1', 'at2')}, 6) AS addr_jaccard, round({Q.jaccard('d1', 'd2')}, 6) AS num_jaccard,
  round({_len('n1', 'n2')}, 6) AS name_len_ratio, round({_len('a1', 'a2')}, 6) AS addr_len_ratio, {Q.flag('length(n1) >= 4 AND length(n2) >= 4 AND (contains(n1, n2) OR contains(n2, n1))')} AS name_contains,
  {Q.flag('len(d1) > 0 AND list_sort(d1) = list_sort(d2)')} AS num_set_equal, {Q.flag('list_has_any(nt1, at2) OR list_has_any(nt2, at1)')} AS name_in_address FROM l""")
def pair_jaccard(spark, sf):
    """The v1 pair features without edit distances."""
    r = v1_records(spark, sf).select("entity_id", *_V1)
    q = r.select(F.col("entity_id").alias("q_id"), *[F.col(c).alias(f"q_{c}") for c in _V1])
    s = r.select(F.col("entity_id").alias("s_id"), *[F.col(c).alias(f"s_{c}") for c in _V1])
    both = candidates(spark, sf).select("country", "q_id", "s_id").join(q, "q_id").join(s, "s_id")
    cols = S.v1_features(*[F.col(f"{x}_{c}") for x in "qs" for c in _V1])
    return both.select("country", "q_id", "s_id", *[F.round(c, 6).alias(k) if k.endswith(("jaccard", "ratio")) else c.alias(k) for k, c in cols.items()])


def labelled(spark, sf, ranks: int):
    """Pairs under a rank with both cores and numbers, and whether the candidate is the owner."""
    n = norm(spark, sf).select("country", "entity_id", "core", "nums")
    side = lambda x: n.select("country", F.col("entity_id").alias(f"{x}_id"), F.col("core").alias(f"{x}_core"), F.col("nums").alias(f"{x}_nums"))
    g = gold(spark, sf).withColumnRenamed("s_id", "own_id")
    p = candidates(spark, sf).where(F.col("rank") < ranks).join(side("q"), ["country", "q_id"]).join(side("s"), ["country", "s_id"]).join(g, "q_id", "left")
    return p.withColumn("y", F.coalesce(F.col("own_id") == F.col("s_id"), F.lit(False)))


LABELLED = """{}, {}, lab AS (SELECT c.country, c.q_id, c.s_id, q.core AS q_core, s.core AS s_core, q.nums AS q_nums, s.nums AS s_nums, coalesce(g.s_id = c.s_id, false) AS y
  FROM cand c JOIN norm q ON q.entity_id = c.q_id JOIN norm s ON s.entity_id = c.s_id LEFT JOIN gold g ON g.q_id = c.q_id WHERE rank < {})"""
_CORES = f"list_distinct({T.words('q_core')}) AS qc, list_distinct({T.words('s_core')}) AS sc"
#: These tables are small, so words count from twice on.
LEAST = 2
_CLIP = f"least(greatest(ln((a + 0.5) / greatest(na, 1)) - ln((b + 0.5) / greatest(nb, 1)), -{difftab.CLIP}), {difftab.CLIP})"
SUPERVISED = f"""{LABELLED.format(RETRIEVED, GOLD_SQL, 5)}, lp AS (SELECT y, {_CORES} FROM lab), lg AS (SELECT * FROM lp WHERE list_has_any(qc, sc)),
tot AS (SELECT count_if(y) AS na, count_if(NOT y) AS nb FROM lg), lw AS (SELECT y, 'add' AS side, unnest({Q.except_('qc', 'sc')}) AS word FROM lg UNION ALL SELECT y, 'drop', unnest({Q.except_('sc', 'qc')}) FROM lg),
lc AS (SELECT side, word, count_if(y) AS a, count_if(NOT y) AS b FROM lw GROUP BY ALL),
sup AS (SELECT 'all' AS country, side, word, round({_CLIP}, 6) AS lo FROM lc, tot WHERE a + b >= {LEAST})"""
PROXY = f"""{LABELLED.format(RETRIEVED, GOLD_SQL, 3)}, lp AS (SELECT country, {_CORES}, {T.words('q_nums')} AS qn, {T.words('s_nums')} AS sn FROM lab),
lg AS (SELECT country, len({Q.except_('sn', 'qn')}) = 0 AS y, {Q.except_('qc', 'sc')} AS ad_, {Q.except_('sc', 'qc')} AS dr_ FROM lp WHERE list_has_any(qc, sc) AND len(qn) > 0 AND len(sn) > 0),
lw AS (SELECT country, y, 'add' AS side, unnest(ad_) AS word FROM lg WHERE len(dr_) <= 1 UNION ALL SELECT country, y, 'drop', unnest(dr_) FROM lg WHERE len(ad_) <= 1),
lc AS (SELECT country, side, word, count_if(y) AS a, count_if(NOT y) AS b FROM lw GROUP BY ALL), tot AS (SELECT country, side, sum(a) AS na, sum(b) AS nb FROM lc GROUP BY ALL),
prx AS (SELECT lc.country, lc.side, word, round({_CLIP}, 6) AS lo FROM lc JOIN tot ON lc.country = tot.country AND lc.side = tot.side WHERE a + b >= {LEAST})"""


@R.query(f"WITH {SUPERVISED} SELECT * FROM sup")
def diff_supervised(spark, sf):
    """One table for all countries."""
    return difftab.supervised(labelled(spark, sf, 5).withColumn("country", F.lit("all")), LEAST)


@R.query(f"WITH {PROXY} SELECT * FROM prx")
def diff_proxy(spark, sf):
    return difftab.proxy(labelled(spark, sf, 3), LEAST)


def _lo(a: str, b: str, side: str, name: str) -> str:
    found = f"list_filter(list_transform({Q.except_(a, b)}, lambda w: los[list_position(ks, '{side}|' || w)]), lambda v: v IS NOT NULL)"
    return f"coalesce(list_min({found}), 0) AS {name}_min, coalesce(list_max({found}), 0) AS {name}_max, round(coalesce(list_sum({found}), 0), 6) AS {name}_sum, len({found}) AS {name}_n, len({Q.except_(a, b)}) - len({found}) AS {name}_unk"


@R.query(f"""WITH {PROXY}, maps AS (SELECT country, list(side || '|' || word) AS ks, list(lo) AS los FROM prx GROUP BY country),
cw AS (SELECT l.country, q_id, s_id, {_CORES}, ks, los FROM lab l JOIN maps m ON l.country = m.country)
SELECT country, q_id, s_id, {_lo('qc', 'sc', 'add', 'px_add')}, {_lo('sc', 'qc', 'drop', 'px_drop')} FROM cw""")
def diff_features(spark, sf):
    """Log-odds summaries of added and dropped words, from the label-free table of each country."""
    pairs = labelled(spark, sf, 3)
    table = difftab.proxy(pairs, LEAST)
    known = table.select("country").distinct()
    keys = pairs.join(known, "country").select("country", "q_id", "s_id")
    return keys.join(difftab.summaries(pairs, table, "px"), ["country", "q_id", "s_id"], "left").na.fill(0)
