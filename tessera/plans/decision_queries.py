"""Queries of splits, context, decisions, metrics, files, validation and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.similarity import rounded
from tessera.operators import context as C
from tessera.operators import decide as D
from tessera.operators import features as FE
from tessera.operators import metrics as M
from tessera.operators import report as RP
from tessera.operators import splits as SP
from tessera.operators import validate as V
from tessera.plans import sqlfeat as Q
from tessera.plans import sqltext as T
from tessera.plans.base import Registry
from tessera.plans.feature_queries import encoded, gold
from tessera.plans.fixtures import GOLD_SQL, NORMALIZED_SQL, RECORDS_SQL, norm, read, records, stage
from tessera.plans.retrieval_queries import RETRIEVED, candidates
from tessera.sources import files as IO

R = Registry()
MD5 = "md5"


def bucket_sql(x: str, mod: int) -> str:
    return f"(('0x' || substr(md5({x}), 1, 8))::BIGINT % {mod})"


# ---- splits


@R.query(f"""WITH {RECORDS_SQL} SELECT entity_id, {bucket_sql('entity_id', 1000)} AS bucket, CASE WHEN {bucket_sql('entity_id', 100)} < 4 THEN 2 WHEN {bucket_sql('entity_id', 100)} < 8 THEN 1 ELSE 0 END AS role,
{bucket_sql('entity_id', 2)} AS fold, {bucket_sql("'blank|' || entity_id", 100)} < 20 AS blank, {bucket_sql('entity_id', 10)} = 0 AS valid,
CASE WHEN {bucket_sql('entity_id', 100)} < 70 THEN 'fit' WHEN {bucket_sql('entity_id', 100)} < 85 THEN 'threshold' ELSE 'report' END AS v1_split FROM records""")
def bucket_roles(spark, sf):
    i = F.col("entity_id")
    return records(spark, sf).select("entity_id", SP.bucket(i, 1000, MD5).alias("bucket"), SP.role(i, how=MD5).alias("role"), SP.fold(i, MD5).alias("fold"), SP.blanked(i, MD5).alias("blank"), (SP.bucket(i, 10, MD5) == 0).alias("valid"), SP.v1_split(i, MD5).alias("v1_split"))


@R.query()
def crc_buckets(spark, sf):
    """The production bucket, CRC-32; no oracle, since DuckDB has no such function. The tests compare it with zlib."""
    return records(spark, sf).select("entity_id", SP.bucket(F.col("entity_id"), 1000).alias("bucket"))


@R.query(f"""WITH {RECORDS_SQL}, {GOLD_SQL}, kept AS (SELECT entity_id FROM records WHERE source = 'S1' AND {bucket_sql('entity_id', 1000)} < 300)
SELECT entity_id, true AS indexed FROM kept UNION ALL
SELECT r.entity_id, false FROM records r LEFT JOIN gold g ON g.q_id = r.entity_id LEFT JOIN kept k ON k.entity_id = g.s_id
WHERE r.source <> 'S1' AND (k.entity_id IS NOT NULL OR (g.s_id IS NULL AND {bucket_sql('r.entity_id', 1000)} < 300))""")
def dev_slice(spark, sf):
    r = records(spark, sf).select("entity_id", "source")
    s1, q = SP.dev_filter(r.where("source = 'S1'"), r.where("source <> 'S1'"), gold(spark, sf), 0.3, MD5)
    return s1.select("entity_id", F.lit(True).alias("indexed")).unionByName(q.select("entity_id", F.lit(False).alias("indexed")))


@R.query(f"WITH {RECORDS_SQL} SELECT entity_id FROM records WHERE source = 'S1' AND {bucket_sql(chr(39) + 'orphan|' + chr(39) + ' || entity_id', 1000)} >= 200")
def orphan_slice(spark, sf):
    return SP.orphan_filter(records(spark, sf).where("source = 'S1'"), 0.2, MD5).select("entity_id")


@R.query(f"WITH {RECORDS_SQL} SELECT entity_id FROM records ORDER BY md5('7|' || entity_id), entity_id LIMIT 100")
def record_sample(spark, sf):
    """A sampling operator: 100 records by the order of a salted hash."""
    return SP.sampled(records(spark, sf).select("entity_id"), "entity_id", 100, "7")


@R.query(f"""WITH {RETRIEVED}, {GOLD_SQL}, p AS (SELECT c.s_id AS s1_id, c.q_id AS candidate_id, coalesce(g.s_id = c.s_id, false) AS y FROM cand c LEFT JOIN gold g ON g.q_id = c.q_id),
r AS (SELECT *, row_number() OVER (PARTITION BY s1_id, y ORDER BY md5(s1_id || '|' || candidate_id), candidate_id) AS rn, greatest(sum(y::INT) OVER (PARTITION BY s1_id), 1) AS n FROM p)
SELECT s1_id, candidate_id, y FROM r WHERE y OR rn <= n * 2""")
def negative_sampling(spark, sf):
    g = gold(spark, sf).withColumnRenamed("s_id", "own_id")
    p = candidates(spark, sf).join(g, "q_id", "left").select(F.col("s_id").alias("s1_id"), F.col("q_id").alias("candidate_id"), F.coalesce(F.col("own_id") == F.col("s_id"), F.lit(False)).alias("y"))
    return SP.negatives(p, 2)


# ---- scored pairs, context


def scored(spark, sf):
    """Retrieved pairs with p, a stand-in for a model's probability."""
    c = FE.retrieval_features(candidates(spark, sf))
    p = rounded(F.col("score") / (F.col("score") + 30) * F.col("ret_rel"), 6)
    return stage(spark, sf, "scored", lambda: c.select("country", "q_id", "s_id", p.alias("p")))


SCORED = f"""{RETRIEVED}, sc0 AS (SELECT *, round(score / first_value(score) OVER (PARTITION BY country, q_id ORDER BY rank), 6) AS rel FROM cand),
scored AS (SELECT country, q_id, s_id, round(score / (score + 30) * rel, 6) AS p FROM sc0)"""
BEST = f"""{SCORED}, best AS (SELECT country, q_id, s_id, p FROM (SELECT *, row_number() OVER (PARTITION BY country, q_id ORDER BY p DESC, s_id) AS rn FROM scored) WHERE rn = 1)"""


def best(spark, sf):
    return C.best_owner(scored(spark, sf))


@R.query(f"WITH {BEST} SELECT * FROM best")
def best_owner(spark, sf):
    return best(spark, sf)


@R.query(f"""WITH {SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY country, q_id ORDER BY p DESC, s_id) - 1 AS qr, row_number() OVER (PARTITION BY country, s_id ORDER BY p DESC, q_id) - 1 AS sr FROM scored),
x AS (SELECT *, max(p) FILTER (qr = 0) OVER q AS q1, coalesce(max(p) FILTER (qr = 1) OVER q, 0) AS q2, max(p) FILTER (sr = 0) OVER s AS s1, coalesce(max(p) FILTER (sr = 1) OVER s, 0) AS s2,
  sum(p) OVER q AS qs, sum((p > 0.1)::INT) OVER q AS qn, sum(p) OVER s AS ss, count(*) OVER s AS sn FROM r WINDOW q AS (PARTITION BY country, q_id), s AS (PARTITION BY country, s_id))
SELECT country, q_id, s_id, p AS p1, qr AS p1_rank, CASE WHEN qr = 0 THEN q2 ELSE q1 END AS p1_max_other, round(p - CASE WHEN qr = 0 THEN q2 ELSE q1 END, 6) AS p1_gap, round(qs, 6) AS q_psum, qn AS q_n01,
  round(ss - p, 6) AS s_psum_other, CASE WHEN sr = 0 THEN s2 ELSE s1 END AS s_pmax_other, sr AS s_rank, sn AS s_n FROM x""")
def stage1_context(spark, sf):
    return C.context_features(scored(spark, sf))


TOP_M = 3
_top = "SELECT country, q_id, s_id FROM (SELECT *, row_number() OVER (PARTITION BY country, q_id ORDER BY p DESC, s_id) AS rn FROM scored) WHERE rn <= 3"
_SIB = """{best}, top AS ({top}), mem AS (SELECT country, s_id, q_id AS mem_id, p AS mem_p FROM (SELECT *, row_number() OVER (PARTITION BY country, s_id ORDER BY p DESC, q_id) AS rn FROM best WHERE p >= {tau}) WHERE rn <= {cap} + 1),
sib AS (SELECT t.country, t.q_id, t.s_id, m.mem_id, m.mem_p FROM top t JOIN mem m ON t.country = m.country AND t.s_id = m.s_id WHERE t.q_id <> m.mem_id)"""


def top_pairs(spark, sf):
    return C.context_features(scored(spark, sf)).where(F.col("p1_rank") < TOP_M).select("country", "q_id", "s_id")


@R.query(f"""WITH {SCORED}, {GOLD_SQL}, top AS ({_top}), r AS (SELECT t.country, t.q_id, t.s_id, {bucket_sql('t.s_id', 100)} < 8 OR coalesce({bucket_sql('g.s_id', 100)} < 8, false) AS held FROM top t LEFT JOIN gold g ON g.q_id = t.q_id)
SELECT country, q_id FROM r GROUP BY ALL HAVING bool_or(held)""")
def stage2_relevant(spark, sf):
    """Records whose second stage tuning and the report need."""
    return SP.relevant(top_pairs(spark, sf), gold(spark, sf), how=MD5)


for _name, _tau, _cap in (("sibling_pairs", 0.5, 10), ("neighbour_pairs", 0.0, 15)):
    R.add(_name, lambda spark, sf, t=_tau, c=_cap: C.sibling_pairs(top_pairs(spark, sf), best(spark, sf), t, c), f"WITH {_SIB.format(best=BEST, top=_top, tau=_tau, cap=_cap)} SELECT * FROM sib")


def similar(spark, sf, siblings):
    """Features of (q_id, mem_id), each pair of records once."""
    pairs = siblings.select("country", "q_id", "mem_id").distinct()
    both = FE.both_sides(pairs, encoded(spark, sf), "q_id", "mem_id")
    k = FE.kernel_features()
    return both.select("country", "q_id", "mem_id", *[(F.round(k[c], 6) if "jacc" in c else k[c]).alias(c) for c in ("n_wjacc", "a_wjacc", "num_jacc", "num_near", "unit_shared")])


_k = Q.kernel()
_SIM = ", ".join((f"round({_k[c]}, 6)" if "jacc" in c else _k[c]) + f" AS {c}" for c in ("n_wjacc", "a_wjacc", "num_jacc", "num_near", "unit_shared"))


@R.query(f"""WITH {_SIB.format(best=BEST, top=_top, tau=0.5, cap=10)}, {Q.fields('norm', 'enc')}, sp AS (SELECT DISTINCT country, q_id, mem_id AS s_id FROM sib), {Q.both('sp', 'enc', 'sprs')},
sim AS (SELECT country, q_id, s_id AS mem_id, {_SIM} FROM sprs), j AS (SELECT s.*, n_wjacc, a_wjacc, num_jacc, num_near, unit_shared FROM sib s JOIN sim m ON s.q_id = m.q_id AND s.mem_id = m.mem_id AND s.country = m.country)
SELECT country, q_id, s_id, count(*) AS sib_n, count_if(NOT starts_with(mem_id, 'S3-')) AS sib_n_s2, count_if(starts_with(mem_id, 'S3-')) AS sib_n_s3, max(mem_p) AS sib_max_p, round(round(sum(mem_p), 6) / count(*), 9) AS sib_mean_p,
  max(n_wjacc) AS sib_n_wjacc, max(a_wjacc) AS sib_a_wjacc, max(num_jacc) AS sib_num_jacc, max(num_near) AS sib_num_near, max(unit_shared) AS sib_unit, round(max(0.5 * n_wjacc + 0.3 * a_wjacc + 0.2 * num_jacc), 9) AS sib_best FROM j GROUP BY ALL""")
def sibling_agg(spark, sf):
    s = stage(spark, sf, "siblings", lambda: C.sibling_pairs(top_pairs(spark, sf), best(spark, sf)))
    return C.sibling_features(s, similar(spark, sf, s))


# ---- decisions and metrics

THRESHOLD, FLOOR = 0.4, 0.25


@R.query(f"WITH {BEST} SELECT * FROM best WHERE p >= {THRESHOLD}")
def threshold_decide(spark, sf):
    return D.by_threshold(best(spark, sf), THRESHOLD)


def _ef_sql(extra: float) -> str:
    return f"""WITH RECURSIVE {BEST}, bf AS (SELECT *, row_number() OVER (PARTITION BY country, s_id ORDER BY p DESC, q_id) AS rn FROM best WHERE p >= {FLOOR}),
ents AS (SELECT country, s_id, count(*) AS n FROM bf GROUP BY ALL), ks AS (SELECT country, s_id, n, unnest(range(0, n + 1)) AS k FROM ents),
st(country, s_id, n, k, i, a, u, pr) AS (SELECT country, s_id, n, k, 0::BIGINT, 0::BIGINT, 0::BIGINT, 1.0::DOUBLE FROM ks UNION ALL
  SELECT st.country, st.s_id, st.n, st.k, st.i + 1, st.a + CASE WHEN st.i < st.k THEN h ELSE 0 END, st.u + CASE WHEN st.i < st.k THEN 0 ELSE h END, sum(st.pr * CASE WHEN h = 1 THEN b.p ELSE 1 - b.p END)
  FROM st JOIN bf b ON b.country = st.country AND b.s_id = st.s_id AND b.rn = st.i + 1, (VALUES (0), (1)) v(h) GROUP BY ALL),
val AS (SELECT country, s_id, k, round(sum(CASE WHEN k = 0 THEN CASE WHEN u = 0 THEN pr * exp(-{extra}) ELSE 0 END ELSE pr * 1.25 * a / (0.25 * (a + u + {extra}) + k) END), 9) AS v FROM st WHERE i = n GROUP BY ALL),
pick AS (SELECT country, s_id, k FROM (SELECT *, row_number() OVER (PARTITION BY country, s_id ORDER BY v DESC, k) AS r FROM val) WHERE r = 1)
SELECT b.country, b.q_id, b.s_id, b.p FROM bf b JOIN pick p ON b.country = p.country AND b.s_id = p.s_id WHERE b.rn <= p.k"""


@R.query(_ef_sql(0.0))
def expected_f_decide(spark, sf):
    return D.by_expected_f(best(spark, sf), FLOOR)


@R.query(_ef_sql(0.25))
def expected_f_extra(spark, sf):
    return D.by_expected_f(best(spark, sf), FLOOR, 0.25)


def entities(spark, sf):
    return norm(spark, sf).where("source = 'S1'").select("country", F.col("entity_id").alias("s_id"))


ENTITIES = "ent AS (SELECT country, entity_id AS s_id FROM norm WHERE source = 'S1')"
_SCORES = """both_ AS (SELECT coalesce(t.s_id, p.s_id) AS s_id, t.q_id AS tq, p.q_id AS pq FROM (SELECT DISTINCT s_id, q_id FROM gold) t FULL JOIN (SELECT DISTINCT s_id, q_id FROM pred) p ON t.s_id = p.s_id AND t.q_id = p.q_id),
cnt AS (SELECT e.country, e.s_id, count(tq) AS n_true, count(pq) AS n_pred, count_if(tq IS NOT NULL AND pq IS NOT NULL) AS hit FROM ent e LEFT JOIN both_ b ON e.s_id = b.s_id GROUP BY ALL),
pr AS (SELECT *, CASE WHEN n_true = 0 THEN (n_pred = 0)::INT::DOUBLE WHEN hit = 0 THEN 0 ELSE hit::DOUBLE / n_pred END AS precision, CASE WHEN n_true = 0 THEN (n_pred = 0)::INT::DOUBLE WHEN hit = 0 THEN 0 ELSE hit::DOUBLE / n_true END AS recall FROM cnt),
scr AS (SELECT *, CASE WHEN n_true = 0 THEN (n_pred = 0)::INT::DOUBLE WHEN hit = 0 THEN 0 ELSE 1.25 * precision * recall / (0.25 * precision + recall) END AS f05 FROM pr)"""
_PRED = f"WITH {BEST}, {GOLD_SQL}, {ENTITIES}, pred AS (SELECT s_id, q_id FROM best WHERE p >= {THRESHOLD}), {_SCORES}"


@R.query(f"{_PRED} SELECT country, s_id, n_true, n_pred, hit, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f05, 6) AS f05 FROM scr")
def entity_f05(spark, sf):
    out = M.entity_scores(entities(spark, sf), gold(spark, sf), threshold_decide(spark, sf))
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f05")})


@R.query(f"""{_PRED}, g AS (SELECT *, CASE WHEN n_true = 0 THEN 'matches=0' WHEN n_true = 1 THEN 'matches=1' WHEN n_true <= 3 THEN 'matches=2-3' ELSE 'matches=4+' END AS grp FROM scr)
SELECT grp, country, round(avg(f05), 6) AS f05, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(coalesce(avg((n_pred > 0)::INT) FILTER (n_true = 0), 0), 6) AS singleton_fp, count(*) AS n FROM g GROUP BY GROUPING SETS ((), (grp), (country))""")
def macro_f05_groups(spark, sf):
    return M.report(M.entity_scores(entities(spark, sf), gold(spark, sf), threshold_decide(spark, sf)))


def sweep(spark, sf, pairs, thresholds=D.THRESHOLDS):
    """Macro F0.5 of pairs at every threshold of a grid."""
    grid = F.explode(F.array(*map(F.lit, thresholds))).alias("thr")
    e = entities(spark, sf).select("country", "s_id", grid)
    key = lambda: F.concat_ws("@", "thr", "s_id").alias("s_id")
    truth = gold(spark, sf).select("q_id", "s_id", grid).select("q_id", key())
    pred = pairs.select("q_id", "s_id", "p", grid).where("p >= thr").select("q_id", key())
    scores = M.entity_scores(e.select("country", key()), truth, pred)
    return scores.groupBy(F.substring_index("s_id", "@", 1).cast("double").alias("thr")).agg(F.round(F.avg("f05"), 6).alias("f05"))


def _sweep_sql(pairs: str, thresholds: list[float]) -> str:
    grid = ", ".join(f"({t}::DOUBLE)" for t in thresholds)
    return f"""WITH {BEST}, {GOLD_SQL.replace('gold AS', 'gold0 AS')}, ent0 AS (SELECT country, entity_id AS s_id FROM norm WHERE source = 'S1'), grid(thr) AS (VALUES {grid}),
ent AS (SELECT country, thr || '@' || s_id AS s_id FROM ent0, grid), gold AS (SELECT q_id, thr || '@' || s_id AS s_id FROM gold0, grid), pred AS (SELECT q_id, thr || '@' || s_id AS s_id FROM {pairs} JOIN grid ON p >= thr), {_SCORES},
swp AS (SELECT split_part(s_id, '@', 1)::DOUBLE AS thr, round(avg(f05), 6) AS f05 FROM scr GROUP BY 1)"""


_SWEEP = _sweep_sql("best", D.THRESHOLDS)


@R.query(f"{_sweep_sql('scored', D.V1_THRESHOLDS)} SELECT * FROM swp")
def v1_threshold_sweep(spark, sf):
    """The first generation keeps every pair over a threshold, not only a record's best."""
    return sweep(spark, sf, scored(spark, sf), D.V1_THRESHOLDS)


@R.query(f"{_SWEEP} SELECT * FROM swp")
def threshold_sweep(spark, sf):
    return sweep(spark, sf, best(spark, sf))


@R.query(f"{_SWEEP} SELECT thr, f05 FROM swp ORDER BY f05 DESC, thr LIMIT 1")
def best_rule(spark, sf):
    """The lowest of the best thresholds."""
    return sweep(spark, sf, best(spark, sf)).agg(F.max(F.struct("f05", (-F.col("thr")).alias("t"))).alias("x")).select((-F.col("x.t")).alias("thr"), F.col("x.f05").alias("f05"))


@R.query(f"""WITH {SCORED}, {GOLD_SQL}, ev AS (SELECT coalesce(g.s_id = s.s_id, false) AS y, p, least(p * 1.1, 1) AS b FROM scored s LEFT JOIN gold g ON g.q_id = s.q_id), w AS (SELECT unnest(range(11)) / 10.0::DOUBLE AS w),
m AS (SELECT w, y, least(greatest(w * p + (1 - w) * b, 1e-6), 1 - 1e-6) AS c FROM ev, w) SELECT w, round(-avg(CASE WHEN y THEN ln(c) ELSE ln(1 - c) END), 6) AS loss FROM m GROUP BY w""")
def blend_grid_logloss(spark, sf):
    """Log loss of blends of two models over a grid of weights."""
    g = gold(spark, sf).withColumnRenamed("s_id", "own_id")
    ev = scored(spark, sf).join(g, "q_id", "left").select(F.coalesce(F.col("own_id") == F.col("s_id"), F.lit(False)).alias("y"), "p", F.least(F.col("p") * 1.1, F.lit(1.0)).alias("b"))
    rows = ev.withColumn("w", F.explode(F.array(*[F.lit(i / 10) for i in range(11)]))).withColumn("c", F.col("w") * F.col("p") + (1 - F.col("w")) * F.col("b"))
    return rows.groupBy("w").agg(M.log_loss(rows, "y", "c").alias("loss"))


# ---- files


@R.query(f"WITH {RECORDS_SQL} SELECT DISTINCT country FROM records WHERE source = 'S1'")
def country_distinct(spark, sf):
    return IO.countries(records(spark, sf).where("source = 'S1'"))


@R.query("""WITH v(s, l) AS (VALUES ('S1-1', 'S2-1, S3-4,S2-1'), ('S1-2', ''), ('S1-3', NULL), ('S1-4', 'nan'), ('S1-5', 'S3-9')),
x AS (SELECT s AS s_id, list_filter(list_transform(string_split(coalesce(l, ''), ','), lambda t: trim(t)), lambda t: t NOT IN ('', 'nan')) AS a FROM v),
y AS (SELECT s_id, list_filter(a, lambda t, i: list_position(a, t) = i) AS a FROM x) SELECT s_id, unnest(range(len(a))) AS nth, unnest(a) AS q_id FROM y""")
def tsv_gold_explode(spark, sf):
    v = spark.createDataFrame([("S1-1", "S2-1, S3-4,S2-1"), ("S1-2", ""), ("S1-3", None), ("S1-4", "nan"), ("S1-5", "S3-9")], "s string, l string")
    return IO.exploded(v, "s", "l")


def order_lists(spark, sf):
    """A list of order keys for each customer, as one string."""
    o = read(spark, sf, "orders")
    return o.groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: F.concat(F.lit("S2-"), x.cast("string"))), ",").alias("ids"))


_LISTS = "lists AS (SELECT o_custkey, string_agg('S2-' || o_orderkey, ',' ORDER BY o_orderkey) AS ids FROM orders GROUP BY 1)"


@R.query(f"WITH {_LISTS}, x AS (SELECT o_custkey::VARCHAR AS s_id, string_split(ids, ',') AS a FROM lists) SELECT s_id, unnest(range(len(a))) AS nth, unnest(a) AS q_id FROM x")
def candidate_file(spark, sf):
    return IO.exploded(order_lists(spark, sf).withColumn("s", F.col("o_custkey").cast("string")), "s", "ids")


@R.query(f"WITH {_LISTS} SELECT o_custkey, array_to_string(string_split(ids, ',')[1:3], ',') AS ids FROM lists")
def truncated_lists(spark, sf):
    return order_lists(spark, sf).select("o_custkey", F.array_join(IO.id_list(F.col("ids"), 3), ",").alias("ids"))


@R.query(f"WITH {_LISTS} SELECT DISTINCT unnest(string_split(ids, ',')) AS id FROM lists")
def needed_ids(spark, sf):
    return IO.exploded(order_lists(spark, sf), "o_custkey", "ids", "id").select("id").distinct()


@R.query(f"""WITH {RECORDS_SQL}, need AS (SELECT entity_id FROM records WHERE {bucket_sql('entity_id', 3)} = 0)
SELECT r.entity_id, r.name FROM records r JOIN need n ON r.entity_id = n.entity_id""")
def wanted_records(spark, sf):
    r = records(spark, sf).select("entity_id", "source", "name")
    need = r.where(SP.bucket(F.col("entity_id"), 3, MD5) == 0).select("entity_id")
    return IO.wanted_records(need, *[r.where(F.col("source") == s).select("entity_id", "name") for s in ("S1", "S2", "S3")], r.select("entity_id", F.upper("name").alias("name")))


@R.query(f"WITH {RECORDS_SQL} SELECT source, entity_id FROM records WHERE source = 'S2' UNION ALL SELECT source, entity_id FROM records WHERE source = 'S3'")
def source_union(spark, sf):
    r = records(spark, sf).select("source", "entity_id")
    return r.where("source = 'S2'").unionByName(r.where("source = 'S3'"))


_RESULT = f"{BEST}, {ENTITIES}, lst AS (SELECT s_id, string_agg(q_id, ',' ORDER BY -p, q_id) AS ids FROM best WHERE p >= {THRESHOLD} GROUP BY s_id)"


def result(spark, sf, blank: str = ""):
    """Result lines; those of a blank country's entities are empty, whichever country their matches have."""
    e = entities(spark, sf).select(F.col("s_id").alias("id"), F.col("country").eqNullSafe(blank).alias("blank"))
    lines = IO.result_lines(e.where("NOT blank"), threshold_decide(spark, sf).withColumn("rank", -F.col("p")))
    return lines.unionByName(e.where("blank").select(F.col("id").alias("s_id"), F.lit("").alias("ids")))


@R.query(f"WITH {_RESULT} SELECT e.s_id, coalesce(ids, '') AS ids FROM ent e LEFT JOIN lst l ON e.s_id = l.s_id")
def result_file(spark, sf):
    return result(spark, sf)


@R.query(f"WITH {_RESULT} SELECT e.s_id, CASE WHEN e.country = 'france' THEN '' ELSE coalesce(ids, '') END AS ids FROM ent e LEFT JOIN lst l ON e.s_id = l.s_id")
def recut_blank(spark, sf):
    """The decision from saved probabilities with one country's rows emptied."""
    return result(spark, sf, "france")


@R.query(f"""WITH {_RESULT}, t AS (SELECT e.country, count(*) AS entities, count(l.ids) AS rows FROM ent e LEFT JOIN lst l ON e.s_id = l.s_id GROUP BY e.country)
SELECT country, country = 'france' AS blanked, entities, round(entities::DOUBLE / sum(entities) OVER (), 6) AS share, rows FROM t""")
def probe_counts(spark, sf):
    return RP.probe_counts(result(spark, sf), entities(spark, sf), ["france"])


@R.query(f"WITH {_RESULT} SELECT e.s_id, CASE WHEN e.country = 'france' THEN '' ELSE coalesce(ids, '') END AS ids FROM ent e LEFT JOIN lst l ON e.s_id = l.s_id")
def probe_make(spark, sf):
    """The result file with one country's lines emptied."""
    return RP.emptied(result(spark, sf), entities(spark, sf), ["france"])


# ---- validation

LINES = ["source1_entity_id\tmatched_entity_ids", "S1-1\tS2-1,S3-2", "S1-2\t", "S1-2\tS2-4", "S1-3\tS2-5,S2-5", "S1-4\tS1-9,X-1", "no tab here", "S1-99\tS2-77"]
_LINES_SQL = ", ".join(f"({i}, {T.lit(x)})" for i, x in enumerate(LINES))


@R.query(f"""WITH f(nth, line) AS (VALUES {_LINES_SQL}), req(id) AS (VALUES ('S1-1'), ('S1-2'), ('S1-3'), ('S1-4'), ('S1-5')), ok(id) AS (VALUES ('S2-1'), ('S3-2'), ('S2-4'), ('S2-5')),
r AS (SELECT nth, trim(split_part(line, chr(9), 1)) AS s, substr(line, instr(line, chr(9)) + 1) AS ids FROM f WHERE nth > 0 AND instr(line, chr(9)) > 0),
i AS (SELECT nth, s, id FROM (SELECT nth, s, trim(unnest(string_split(ids, ','))) AS id FROM r) WHERE id <> ''),
b AS (SELECT 'header' AS rule, line AS x FROM f WHERE nth = 0 AND line <> 'source1_entity_id' || chr(9) || 'matched_entity_ids'
UNION ALL SELECT 'no tab', line FROM f WHERE nth > 0 AND instr(line, chr(9)) = 0 UNION ALL SELECT 'duplicate row', s FROM r GROUP BY s HAVING count(*) > 1
UNION ALL SELECT 'duplicate id', s || ':' || id FROM i GROUP BY nth, s, id HAVING count(*) > 1 UNION ALL SELECT 'own source', s || ':' || id FROM i WHERE starts_with(id, 'S1-')
UNION ALL SELECT 'bad prefix', s || ':' || id FROM i WHERE NOT regexp_matches(id, '^S[123]-') UNION ALL SELECT 'missing row', id FROM req WHERE id NOT IN (SELECT s FROM r)
UNION ALL SELECT DISTINCT 'extra row', s FROM r WHERE s NOT IN (SELECT id FROM req) UNION ALL SELECT DISTINCT 'unknown id', id FROM i WHERE regexp_matches(id, '^S[23]-') AND id NOT IN (SELECT id FROM ok))
SELECT rule, 'error' AS severity, count(*) AS n, array_to_string(list_sort(list_distinct(list(x)))[1:5], ' ') AS examples FROM b GROUP BY rule""")
def validator_findings(spark, sf):
    ids = lambda text: spark.createDataFrame([(x,) for x in text.split()], "id string")
    return V.findings(spark.createDataFrame(list(enumerate(LINES)), "nth int, line string"), ids("S1-1 S1-2 S1-3 S1-4 S1-5"), LINES[0], ids("S2-1 S3-2 S2-4 S2-5"))


@R.query(f"""WITH {BEST}, lost AS (SELECT b.s_id || ':' || b.q_id AS x FROM best b LEFT JOIN cand c ON c.s_id = b.s_id AND c.q_id = b.q_id AND c.score >= 60 WHERE c.q_id IS NULL)
SELECT 'not a candidate' AS rule, 'warning' AS severity, count(*) AS n, array_to_string(list_sort(list_distinct(list(x)))[1:5], ' ') AS examples FROM lost HAVING count(*) > 0""")
def candidate_subset(spark, sf):
    return V.not_candidates(best(spark, sf), candidates(spark, sf).where("score >= 60"))


# ---- reports


@R.query(f"""WITH {RECORDS_SQL}, n AS (SELECT count(*) AS n, count_if(name = '') AS a, count_if(address = '') AS b, count_if(country = '') AS c FROM records)
SELECT unnest(['name', 'address', 'country']) AS "column", n, unnest([a, b, c]) AS nulls, round(unnest([a, b, c])::DOUBLE / n, 6) AS share FROM n""")
def eda_nulls(spark, sf):
    return RP.null_counts(records(spark, sf).select("name", "address", "country"))


@R.query(f"WITH {RECORDS_SQL} SELECT country AS value, count(*) AS n FROM records GROUP BY country")
def eda_value_counts(spark, sf):
    return RP.value_counts(records(spark, sf), "country")


@R.query(f"""WITH {RECORDS_SQL}, l AS (SELECT source AS key, 'name' AS "column", length(name) AS l FROM records UNION ALL SELECT source, 'address', length(address) FROM records)
SELECT key, "column", round(avg(l), 6) AS mean, median(l)::DOUBLE AS middle, min(l) AS least, max(l) AS largest FROM l GROUP BY ALL""")
def eda_lengths(spark, sf):
    return RP.length_stats(records(spark, sf), "source", ["name", "address"])


@R.query(f"""WITH {RECORDS_SQL}, {GOLD_SQL}, m AS (SELECT s_id, count_if(starts_with(q_id, 'S2-')) AS s2, count_if(starts_with(q_id, 'S3-')) AS s3 FROM gold GROUP BY s_id)
SELECT coalesce(s2, 0) AS s2, coalesce(s3, 0) AS s3, count(*) AS n FROM records r LEFT JOIN m ON m.s_id = r.entity_id WHERE source = 'S1' GROUP BY ALL""")
def eda_match_counts(spark, sf):
    return RP.match_counts(records(spark, sf).where("source = 'S1'").select(F.col("entity_id").alias("s_id")), gold(spark, sf))


@R.query(f"WITH {RECORDS_SQL} SELECT entity_id FROM records WHERE lower(country) LIKE '%ind%'")
def country_like(spark, sf):
    return records(spark, sf).where(F.lower("country").like("%ind%")).select("entity_id")


_KIND = f"""WITH {BEST}, {GOLD_SQL}, k AS (SELECT b.country, b.q_id, b.p, b.s_id AS b, g.s_id AS own, EXISTS (SELECT 1 FROM cand c WHERE c.q_id = b.q_id AND c.s_id = g.s_id) AS found FROM best b LEFT JOIN gold g ON g.q_id = b.q_id),
kinds AS (SELECT *, CASE WHEN own IS NULL THEN CASE WHEN p >= 0.5 THEN 'unowned kept' ELSE 'unowned left' END WHEN NOT found THEN 'not retrieved' WHEN b <> own THEN 'outranked' WHEN p < 0.5 THEN 'low p' ELSE 'right' END AS kind FROM k)"""


def judged(spark, sf):
    g = gold(spark, sf).withColumnRenamed("s_id", "own")
    found = candidates(spark, sf).select("q_id", F.col("s_id").alias("own"), F.lit(True).alias("found"))
    b = best(spark, sf).join(g, "q_id", "left").join(found, ["q_id", "own"], "left").withColumn("found", F.coalesce("found", F.lit(False)))
    return b.withColumn("kind", RP.error_kind(F.col("own"), F.col("found"), F.col("s_id"), F.col("p")))


@R.query(f"{_KIND} SELECT country, kind, count(*) AS n FROM kinds GROUP BY ALL")
def error_taxonomy(spark, sf):
    return judged(spark, sf).groupBy("country", "kind").agg(F.count("*").alias("n"))


@R.query(f"""{_KIND}, t(t) AS (VALUES (0.3::DOUBLE), (0.5), (0.7), (0.9)) SELECT t, round(avg((b = own AND p >= t)::INT) FILTER (own IS NOT NULL), 6) AS right_kept, round(avg((b <> own AND p >= t)::INT) FILTER (own IS NOT NULL), 6) AS wrong_kept,
round(avg((p >= t)::INT) FILTER (own IS NULL), 6) AS unowned_kept FROM kinds, t GROUP BY t""")
def kept_rates(spark, sf):
    rows = judged(spark, sf).withColumn("t", F.explode(F.array(*map(F.lit, (0.3, 0.5, 0.7, 0.9)))))
    rate = lambda condition, among: F.round(F.avg(F.when(among, condition.cast("int"))), 6)
    owned, kept = F.col("own").isNotNull(), F.col("p") >= F.col("t")
    return rows.groupBy("t").agg(rate((F.col("s_id") == F.col("own")) & kept, owned).alias("right_kept"), rate((F.col("s_id") != F.col("own")) & kept, owned).alias("wrong_kept"), rate(kept, ~owned).alias("unowned_kept"))


@R.query(f"{_KIND} SELECT country, count(*) AS owned, round(avg(found::INT), 6) AS in_candidates, round(avg((b = own)::INT), 6) AS top1 FROM kinds WHERE own IS NOT NULL GROUP BY country")
def stage1_report(spark, sf):
    owned = judged(spark, sf).where("own IS NOT NULL")
    return owned.groupBy("country").agg(F.count("*").alias("owned"), F.round(F.avg(F.col("found").cast("int")), 6).alias("in_candidates"), F.round(F.avg((F.col("s_id") == F.col("own")).cast("int")), 6).alias("top1"))


_SHARES = f"WITH {NORMALIZED_SQL}, {GOLD_SQL}, e AS (SELECT n.country, n.entity_id, count(g.q_id) AS m FROM norm n LEFT JOIN gold g ON g.s_id = n.entity_id WHERE source = 'S1' GROUP BY ALL)"


@R.query(f"{_SHARES} SELECT country, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share, round(avg((m = 0)::INT), 6) AS singletons, round(round(avg((m = 0)::INT), 6) + (0.9 - 0.7) / round(count(*)::DOUBLE / sum(count(*)) OVER (), 6), 6) AS f05 FROM e GROUP BY country")
def probe_solve(spark, sf):
    from pyspark.sql import Window

    owned = gold(spark, sf).groupBy("s_id").agg(F.count("*").alias("m"))
    e = entities(spark, sf).join(owned, "s_id", "left").na.fill(0, ["m"])
    shares = e.groupBy("country").agg(F.count("*").alias("n"), F.round(F.avg((F.col("m") == 0).cast("int")), 6).alias("singletons"))
    shares = shares.select("country", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("share"), "singletons")
    return RP.leaderboard(shares, 0.9, 0.7)
