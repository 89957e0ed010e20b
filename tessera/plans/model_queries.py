"""Queries of models and whole pipelines. Their rows depend on training, so they have no oracle; the tests hold them to truths."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import context, model, translit
from tessera.plans import linkage
from tessera.plans import sqltext as S
from tessera.plans.base import Registry
from tessera.plans.decision_queries import BEST, best
from tessera.plans.feature_queries import features, labelled
from tessera.plans.fixtures import GOLD_SQL, RECORDS_SQL, gold, records

R = Registry()


def training_rows(spark, sf):
    y = labelled(spark, sf, linkage.Settings.top_k).select("country", "q_id", "s_id", "y")
    return features(spark, sf).join(y, ["country", "q_id", "s_id"])


@R.query()
def cross_fitted_scores(spark, sf):
    rows = training_rows(spark, sf)
    return model.cross_fit(rows, linkage.columns_of(rows), "gbt", 10).select("country", "q_id", "s_id", F.round("p", 6).alias("p"))


@R.query()
def feature_importance(spark, sf):
    rows = training_rows(spark, sf)
    names = linkage.columns_of(rows)
    return spark.createDataFrame(model.importance(model.fit(rows, names, "rf", 20), names), "feature string, gain double")


@R.query(f"""WITH {BEST}, {GOLD_SQL}, k(x, y) AS (VALUES (0.1::DOUBLE, 0.0::DOUBLE), (0.5, 0.4), (0.5, 0.6), (0.9, 1.0))
SELECT q_id, round(CASE WHEN p <= 0.1 THEN 0.0 WHEN p <= 0.5 THEN (p - 0.1) / 0.4 * 0.4 WHEN p <= 0.9 THEN 0.6 + (p - 0.5) / 0.4 * 0.4 ELSE 1.0 END, 6) AS c FROM best""")
def calibration_knots(spark, sf):
    """Probabilities of best pairs through given calibration knots."""
    return best(spark, sf).select("q_id", F.round(model.interpolated(F.col("p"), [(0.1, 0.0), (0.5, 0.4), (0.5, 0.6), (0.9, 1.0)]), 6).alias("c"))


@R.query()
def isotonic_calibration(spark, sf):
    g = gold(spark, sf).withColumnRenamed("s_id", "own")
    rows = best(spark, sf).join(g, "q_id", "left").withColumn("y", F.coalesce(F.col("own") == F.col("s_id"), F.lit(False)))
    return rows.select("q_id", F.round(model.interpolated(F.col("p"), model.calibrate(rows)), 6).alias("c"))


_VOCAB = f"""WITH {RECORDS_SQL}, t AS (SELECT unnest(regexp_split_to_array(lower(name), '[^0-9a-z]+')) AS w FROM records WHERE regexp_matches(name, '^[\\x00-\\x7F]*$')),
c AS (SELECT w, count(*) AS n FROM t WHERE regexp_matches(w, '^[a-z]{{3,}}$') GROUP BY w HAVING count(*) >= 3), f AS (SELECT n, w, {S.mapped('w', S.T.LEGAL_FORMS)} AS target FROM c),
s AS (SELECT n, w, target, {S.phon('target')} AS token FROM f) SELECT token, target FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY n DESC, w) AS rn FROM s WHERE length(token) >= 3) WHERE rn = 1"""


@R.query(_VOCAB)
def vocab_skeletons(spark, sf):
    return translit.vocabulary(records(spark, sf))


@R.query()
def translit_learn(spark, sf):
    """Transliteration maps from a few records in native script and their owners."""
    s1 = spark.createDataFrame([(f"S1-{i}", "Perfect Traders Private Limited", "11 Gandhi Road, Chennai") for i in range(4)], "entity_id string, name string, address string")
    q = spark.createDataFrame([(f"S2-{i}", "परफेक्ट ट्रेडर्स प्राइवेट लिमिटेड", "11 गांधी रोड, चेन्नई") for i in range(4)], "entity_id string, name string, address string")
    owners = spark.createDataFrame([(f"S2-{i}", f"S1-{i}") for i in range(4)], "q_id string, s_id string")
    maps = translit.learn(q, s1, owners)
    from functools import reduce

    return reduce(lambda a, b: a.unionByName(b), [m.select(F.lit(k).alias("kind"), "token", "target") for k, m in maps.items()])


@R.query()
def linkage_v3(spark, sf):
    return linkage.run_v3(records(spark, sf), gold(spark, sf), linkage.Settings(least_words=2, tune_pct=40))


@R.query()
def linkage_v1(spark, sf):
    return linkage.run_v1(records(spark, sf), gold(spark, sf))


@R.query(f"WITH {BEST}, {GOLD_SQL}, v AS (SELECT b.q_id, b.p, g.s_id IS NOT NULL AND g.s_id = b.s_id AS y FROM best b LEFT JOIN gold g ON g.q_id = b.q_id) SELECT y, count(*) AS n, round(min(p), 6) AS low, round(max(p), 6) AS high FROM v GROUP BY y")
def best_pair_labels(spark, sf):
    g = gold(spark, sf).withColumnRenamed("s_id", "own")
    rows = context.best_owner(best(spark, sf)).join(g, "q_id", "left").withColumn("y", F.coalesce(F.col("own") == F.col("s_id"), F.lit(False)))
    return rows.groupBy("y").agg(F.count("*").alias("n"), F.round(F.min("p"), 6).alias("low"), F.round(F.max("p"), 6).alias("high"))
