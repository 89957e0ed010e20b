"""Queries of blocking keys, the index and retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import basic
from tessera.functions import tables as T
from tessera.operators import retrieve as O
from tessera.plans import sqlkeys as K
from tessera.plans import sqltext as S
from tessera.plans.base import Registry
from tessera.plans.fixtures import GOLD_SQL, NORMALIZED_SQL, RECORDS_SQL, gold, norm, records, stage

R = Registry()
TOP_K = 20


def clean_sql(x: str) -> str:
    t = f"regexp_replace(lower(coalesce({x}, '')), '^\\s+|\\s+$', '', 'g')"
    t = f"list_transform([{t}], lambda b: CASE WHEN b IN ('nan', 'null') THEN '' ELSE b END)[1]"
    t = f"regexp_replace(replace({t}, '&', ' and '), '<<|>>', '', 'g')"
    t = f"regexp_replace(regexp_replace({t}, '[,;:\\-_/]+', ' ', 'g'), '[()\\[\\]{{}}\"'']', ' ', 'g')"
    return f"trim(regexp_replace({t}, '\\s+', ' ', 'g'), ' .')"


def reclean_sql(x: str) -> str:
    t = f"regexp_replace(regexp_replace(lower({x}), '[,;:\\-_/]+', ' ', 'g'), '[()\\[\\]{{}}\"'']', ' ', 'g')"
    return f"lower(strip_accents(trim(regexp_replace({t}, '\\s+', ' ', 'g'))))"


_plain = "replace(trim(t, '.,;:()[]'), '.', '')"
_suffix = f"CASE WHEN {S.isin(_plain, T.V1_LEGAL_FORMS)} THEN {S.mapped(_plain, T.V1_LEGAL_FORMS)} ELSE t END"
V1_SQL = f"""{RECORDS_SQL},
v1a AS (SELECT entity_id, source, country, {clean_sql('name')} AS name_clean, {clean_sql('address')} AS addr_clean FROM records),
v1b AS (SELECT *, {S.joined(S.each(S.words(reclean_sql('name_clean')), _suffix))} AS name_normalized, {reclean_sql('addr_clean')} AS addr_normalized FROM v1a),
v1c AS (SELECT *, {S.joined(S.kept(S.each(S.words('name_normalized'), "regexp_replace(t, '[^a-z0-9]', '', 'g')"), f"length(t) > 1 AND NOT {S.isin('t', T.V1_NAME_STOP)}"))} AS core_ FROM v1b),
v1 AS (SELECT entity_id, source, country, name_clean, name_normalized, CASE WHEN core_ <> '' THEN core_ ELSE name_normalized END AS name_core, addr_clean, addr_normalized,
  array_to_string(regexp_extract_all(addr_normalized, '\\d+'), ' ') AS addr_numbers FROM v1c)"""


def v1_records(spark: SparkSession, sf: str) -> DataFrame:
    columns = basic.record_columns(F.col("name"), F.col("address"))
    return records(spark, sf).select("entity_id", "source", "country", *[c.alias(k) for k, c in columns.items()])


@R.query(f"WITH {V1_SQL} SELECT * FROM v1")
def v1_records_query(spark, sf):
    return v1_records(spark, sf)


for _name in ("name_clean", "name_normalized", "name_core", "addr_normalized", "addr_numbers"):
    R.add(f"v1_{_name}", lambda spark, sf, c=_name: v1_records(spark, sf).select("entity_id", c), f"WITH {V1_SQL} SELECT entity_id, {_name} FROM v1")

_K3 = f"WITH {NORMALIZED_SQL}, {K.v3_keys('norm', 'ks')} "
_K1 = f"WITH {V1_SQL}, {K.v1_keys('v1', 'ks')} "
for _kind in [*T.V3_KEYS, "exact"]:
    R.add(f"keys_{_kind}", lambda spark, sf, k=_kind: O.v3_record_keys(norm(spark, sf)).where(F.col("kind") == k), f"{_K3} SELECT country, id, kind, key FROM ks WHERE kind = '{_kind}'")
R.add("keys_v1", lambda spark, sf: O.v1_record_keys(v1_records(spark, sf)), f"{_K1} SELECT country, id, kind, key FROM ks")


def index_keys(spark, sf) -> DataFrame:
    return stage(spark, sf, "index-keys", lambda: O.v3_record_keys(norm(spark, sf).where("source = 'S1'")))


_INDEX = f"WITH {NORMALIZED_SQL}, s1 AS (SELECT * FROM norm WHERE source = 'S1'), {K.v3_keys('s1', 'ik')}, {K.groups('ik', 'gr')}, {K.resolved('ik', 'gr', 'ir')}"


@R.query(f"{_INDEX} SELECT country, exact, n FROM gr")
def exact_groups(spark, sf):
    return O.exact_groups(index_keys(spark, sf))


@R.query(f"{_INDEX.replace(f'n <= {T.EXACT_SMALL}', 'n <= 1').replace(f'n > {T.EXACT_SMALL}', 'n > 1')} SELECT country, id, kind, key FROM ir WHERE kind = 'exact'")
def exact_rule(spark, sf):
    """The exact-name rule with the small-group bound at 1, so that both of its arms run on these tables."""
    ik = index_keys(spark, sf)
    return O.resolved(ik, O.exact_groups(ik), small=1).where("kind = 'exact'")


@R.query(f"{_INDEX}, {K.weights('ir', T.V3_KEYS, 'kw')} SELECT country, kind, key, df, round(w, 6) AS w FROM kw")
def key_df_idf(spark, sf):
    ik = index_keys(spark, sf)
    return O.key_weights(O.resolved(ik, O.exact_groups(ik)), T.V3_KEYS).withColumn("w", F.round("w", 6))


@R.query(f"{_INDEX}, {K.weights('ir', T.V3_KEYS, 'kw', 0.001)} SELECT country, kind, count(*) AS keys, max(df) AS most FROM kw GROUP BY country, kind")
def key_caps(spark, sf):
    """Keys left of each kind when caps are scaled down to their floor."""
    ik = index_keys(spark, sf)
    return O.key_weights(O.resolved(ik, O.exact_groups(ik)), T.V3_KEYS, 0.001).groupBy("country", "kind").agg(F.count("*").alias("keys"), F.max("df").alias("most"))


def retrieved(spark, sf, k: int = TOP_K, scale: float = 1.0) -> DataFrame:
    n = norm(spark, sf)
    return O.retrieve(n.where("source = 'S1'"), n.where("source <> 'S1'"), k, scale)


def candidates(spark, sf) -> DataFrame:
    return stage(spark, sf, "candidates", lambda: retrieved(spark, sf))


RETRIEVED = f"{NORMALIZED_SQL}, {K.retrieval('norm', TOP_K, 'cand')}"


@R.query(f"WITH {RETRIEVED} SELECT * FROM cand")
def topk_retrieval(spark, sf):
    return retrieved(spark, sf)


@R.query(f"WITH {NORMALIZED_SQL}, {K.retrieval('norm', 3, 'cand', 0.001)} SELECT * FROM cand")
def topk_retrieval_capped(spark, sf):
    return retrieved(spark, sf, 3, 0.001)


@R.query(f"""WITH {V1_SQL}, c1 AS (SELECT * FROM v1 WHERE source <> 'S1'), s1 AS (SELECT * FROM v1 WHERE source = 'S1'), {K.v1_keys('c1', 'ck')}, {K.v1_keys('s1', 'sk')},
{K.groups('ck', 'gr')}, {K.resolved('ck', 'gr', 'cr')}, {K.resolved('sk', 'gr', 'sr')}, {K.weights('cr', T.V1_KEYS, 'kw')}, {K.top_k('sr', 'cr', 'kw', 200, 'cand')}
SELECT country, q_id AS s1_id, s_id AS candidate_id, rank, score FROM cand WHERE score >= 1.0""")
def v1_blocking(spark, sf):
    r = v1_records(spark, sf)
    return O.block(r.where("source = 'S1'"), r.where("source <> 'S1'"))


_HITS = f"""WITH {RETRIEVED}, {GOLD_SQL},
hits AS (SELECT g.q_id, min(c.rank) AS rank FROM gold g LEFT JOIN cand c ON g.q_id = c.q_id AND g.s_id = c.s_id GROUP BY g.q_id)"""


def owner_ranks(spark, sf) -> DataFrame:
    g, c = gold(spark, sf), candidates(spark, sf).select("q_id", "s_id", "rank")
    return g.join(c, ["q_id", "s_id"], "left").groupBy("q_id").agg(F.min("rank").alias("rank"))


_KS = (1, 2, 3, 5, 10, 20)


@R.query(_HITS + " SELECT " + ", ".join(f"round(avg(coalesce(rank < {k}, false)::INT), 6) AS recall_{k}" for k in _KS) + ", count(*) AS n FROM hits")
def owner_recall_at_k(spark, sf):
    return owner_ranks(spark, sf).agg(*[F.round(F.avg(F.coalesce(F.col("rank") < k, F.lit(False)).cast("int")), 6).alias(f"recall_{k}") for k in _KS], F.count("*").alias("n"))


@R.query(_HITS + " SELECT CASE WHEN rank IS NULL THEN 'missed' WHEN rank < 10 THEN '<10' WHEN rank < 25 THEN '<25' WHEN rank < 50 THEN '<50' WHEN rank < 100 THEN '<100' ELSE '>=100' END AS bucket, count(*) AS n FROM hits GROUP BY 1")
def rank_histogram(spark, sf):
    r = F.col("rank")
    bucket = F.when(r.isNull(), "missed").when(r < 10, "<10").when(r < 25, "<25").when(r < 50, "<50").when(r < 100, "<100").otherwise(">=100")
    return owner_ranks(spark, sf).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


@R.query(f"""WITH {RETRIEVED}, q AS (SELECT country, entity_id AS q_id FROM norm WHERE source <> 'S1'),
sizes AS (SELECT q.country, q.q_id, count(c.s_id) AS n FROM q LEFT JOIN cand c ON q.q_id = c.q_id AND q.country = c.country GROUP BY ALL)
SELECT country, round(avg(n), 6) AS mean, median(n)::DOUBLE AS middle, count_if(n = 0) AS none, round(avg((n >= {TOP_K})::INT), 6) AS full_share, count(*) AS queries FROM sizes GROUP BY country""")
def candidate_stats(spark, sf):
    q = norm(spark, sf).where("source <> 'S1'").select("country", F.col("entity_id").alias("q_id"))
    sizes = q.join(candidates(spark, sf).select("country", "q_id", "s_id"), ["country", "q_id"], "left").groupBy("country", "q_id").agg(F.count("s_id").alias("n"))
    return sizes.groupBy("country").agg(
        F.round(F.avg("n"), 6).alias("mean"), F.median("n").alias("middle"), F.count_if(F.col("n") == 0).alias("none"),
        F.round(F.avg((F.col("n") >= TOP_K).cast("int")), 6).alias("full_share"), F.count("*").alias("queries"),
    )


@R.query(f"""WITH {RETRIEVED}, sizes AS (SELECT country, count_if(source = 'S1') AS s, count_if(source <> 'S1') AS q FROM norm GROUP BY country),
found AS (SELECT country, count(*) AS pairs FROM cand GROUP BY country)
SELECT s.country, pairs, s * q AS possible, round(1 - pairs::DOUBLE / (s * q), 6) AS reduction FROM sizes s JOIN found USING (country)""")
def reduction_ratio(spark, sf):
    sizes = norm(spark, sf).groupBy("country").agg(F.count_if(F.col("source") == "S1").alias("s"), F.count_if(F.col("source") != "S1").alias("q"))
    pairs = candidates(spark, sf).groupBy("country").agg(F.count("*").alias("pairs"))
    return sizes.join(pairs, "country").select("country", "pairs", (F.col("s") * F.col("q")).alias("possible"), F.round(1 - F.col("pairs") / (F.col("s") * F.col("q")), 6).alias("reduction"))


_DIAG = f"""{_HITS}, kk AS (SELECT * FROM candir UNION ALL SELECT * FROM candqr),
miss AS (SELECT g.q_id, g.s_id FROM gold g JOIN hits h ON g.q_id = h.q_id WHERE h.rank IS NULL OR h.rank >= 1),
shared AS (SELECT m.q_id, a.kind, count(w.key) AS kept FROM miss m JOIN candqr a ON a.id = m.q_id JOIN candir b ON b.id = m.s_id AND a.country = b.country AND a.kind = b.kind AND a.key = b.key
  LEFT JOIN candw w ON w.country = a.country AND w.kind = a.kind AND w.key = a.key GROUP BY ALL)
SELECT kind, count(*) AS shared, count_if(kept > 0) AS kept FROM shared GROUP BY kind"""


@R.query(_DIAG)
def miss_diagnosis(spark, sf):
    """For queries whose owner isn't ranked first: kinds with keys in common, and with keys that the caps keep."""
    n = norm(spark, sf)
    ik, qk = index_keys(spark, sf), O.v3_record_keys(n.where("source <> 'S1'"))
    groups = O.exact_groups(ik)
    ik, qk = O.resolved(ik, groups), O.resolved(qk, groups)
    weights = O.key_weights(ik, T.V3_KEYS).select("country", "kind", "key", F.lit(1).alias("ok"))
    miss = owner_ranks(spark, sf).where("rank IS NULL OR rank >= 1").select("q_id").join(gold(spark, sf), "q_id")
    a = miss.join(qk.withColumnRenamed("id", "q_id"), "q_id")
    both = a.join(ik.withColumnRenamed("id", "s_id"), ["s_id", "country", "kind", "key"]).join(weights, ["country", "kind", "key"], "left")
    return both.groupBy("q_id", "kind").agg(F.count("ok").alias("k")).groupBy("kind").agg(F.count("*").alias("shared"), F.count_if(F.col("k") > 0).alias("kept"))
