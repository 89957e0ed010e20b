"""Queries over scores of candidates against their SQL, on tables made for it."""

import random

import duckdb
import pytest

import __spark_entry__ as entry
from tessera.plans import fixtures
from tessera.plans.retrieval_queries import RETRIEVED
from test_registry import ORACLES, rows_of

#: Queries that show scores, or what is made of them.
SCORED = ["retrieval_features", "stage1_context", "best_owner", "calibration_knots", "expected_f_decide", "expected_f_extra", "recut_blank", "result_file", "sibling_pairs"]


def same(spark, duck, name, sf, sql):
    df, want = entry.registry.queries()[name](spark, sf), duck.execute(sql)
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, want.fetchall()) != []


@pytest.fixture(scope="module")
def halves(spark, tmp_path_factory):
    """Candidates whose quotients and probabilities end in a 5 at the seventh place."""
    tenths = [(2 * k + 1) / 2e5 for k in range(490_000, 16_000, -1501)]
    lists = [[10.0, *(round(x, 6) for x in tenths)], *([round(19.99992 - i * 16e-5, 6), 10.0] for i in range(40))]
    rows = [("us", f"S2-{3 * i + 1}", f"S1-{3 * (i + n)}", n, x) for i, scores in enumerate(lists) for n, x in enumerate(scores)]
    cand = spark.createDataFrame(rows, "country string, q_id string, s_id string, rank int, score double")
    sf = str(tmp_path_factory.mktemp("halves"))
    fixtures._stages[spark.sparkContext.applicationId, sf, "candidates"] = cand
    con = duckdb.connect()
    con.execute("CREATE TABLE given (country VARCHAR, q_id VARCHAR, s_id VARCHAR, rank BIGINT, score DOUBLE)")
    con.executemany("INSERT INTO given VALUES (?, ?, ?, ?, ?)", rows)
    return sf, con


@pytest.mark.parametrize("name", ["retrieval_features", "stage1_context"])
def test_halves_are_rounded_as_in_the_sql(spark, halves, name):
    sf, con = halves
    assert RETRIEVED in ORACLES[name]
    same(spark, con, name, sf, ORACLES[name].replace(RETRIEVED, "cand AS (SELECT * FROM given)"))


@pytest.fixture(scope="module")
def edges(tmp_path_factory):
    """Documents with words whose ASCII letters and numbers begin after another letter, in index records and queries."""
    r = random.Random(5)
    words = [f"ö{a}b-0{n}" for a in "rst" for n in range(1, 5)] + [f"w{a}{b}" for a in "klmn" for b in "aeiou"]
    texts = []
    for _ in range(90):
        texts.append(" ".join(r.sample(words, 7)) if not texts or r.random() < 0.6 else r.choice(texts[-9:]))
    sf = str(tmp_path_factory.mktemp("edges"))
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, 'de')", list(enumerate(texts)))
    con.execute(f"COPY documents TO '{sf}/documents.parquet'")
    return sf, con


@pytest.mark.parametrize("name", SCORED)
def test_word_edges_reach_no_score(spark, edges, name):
    sf, con = edges
    same(spark, con, name, sf, ORACLES[name])


def test_blank_country_is_the_entitys(spark, tmp_path):
    """Candidates of another country than their entity's: the list to empty goes by the entity."""
    ents = [("us", "S1-0"), ("france", "S1-3"), ("france", "S1-6"), ("india", "S1-9")]
    pairs = [("us", "S2-1", "S1-0"), ("us", "S2-4", "S1-3"), ("france", "S3-2", "S1-3"), ("france", "S3-5", "S1-9"), ("india", "S2-7", "S1-9")]
    rows = [(*x, 0, 100.0 + i) for i, x in enumerate(pairs)]
    stages = {
        "norm": spark.createDataFrame(ents, "country string, entity_id string").selectExpr("*", "'S1' AS source"),
        "candidates": spark.createDataFrame(rows, "country string, q_id string, s_id string, rank int, score double"),
    }
    fixtures._stages.update({(spark.sparkContext.applicationId, str(tmp_path), k): v for k, v in stages.items()})
    con = duckdb.connect()
    con.execute("CREATE TABLE normed (country VARCHAR, entity_id VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO normed VALUES (?, ?, 'S1')", ents)
    con.execute("CREATE TABLE given (country VARCHAR, q_id VARCHAR, s_id VARCHAR, rank BIGINT, score DOUBLE)")
    con.executemany("INSERT INTO given VALUES (?, ?, ?, ?, ?)", rows)
    assert RETRIEVED in ORACLES["recut_blank"]
    same(spark, con, "recut_blank", str(tmp_path), ORACLES["recut_blank"].replace(RETRIEVED, "norm AS (SELECT * FROM normed), cand AS (SELECT * FROM given)"))
