import pytest
from pyspark.sql import functions as F

from tessera.functions import tables as T
from tessera.operators import retrieve
from tessera.streaming import link

NORM = "entity_id string, source string, country string, core string, phon string, ad string, nums string, units string"


def test_owner_is_found_first(spark):
    rows = [
        ("S1-0", "S1", "in", "sharma traders", "srm trdrs", "gandhi road chennai", "12 600001", ""), ("S1-1", "S1", "in", "perfect health", "prfkt hlt", "park street kolkata", "77 700016", ""),
        ("S1-2", "S1", "in", "global foods", "glbl fds", "mg road pune", "5 411001", ""), ("S2-a", "S2", "in", "sharma tradrs", "srm trdrs", "gandhi road chennai", "12", ""),
        ("S3-b", "S3", "in", "paraphekt health", "prfkt hlt", "park street", "77", ""), ("S3-c", "S3", "us", "perfect health", "prfkt hlt", "park street", "77", ""),
    ]
    df = spark.createDataFrame(rows, NORM)
    got = retrieve.retrieve(df.where("source = 'S1'"), df.where("source <> 'S1'"), 3)
    first = {r.q_id: r.s_id for r in got.where("rank = 0").collect()}
    assert first == {"S2-a": "S1-0", "S3-b": "S1-1"}  # another country has no index, so no candidates


def test_caps_and_weights(spark):
    keys = spark.createDataFrame([("in", f"S1-{i}", "name", "common") for i in range(30)] + [("in", "S1-0", "name", "rare"), ("in", "S1-1", "exact", "ex|x")], "country string, id string, kind string, key string")
    w = {r.key: r for r in retrieve.key_weights(keys, T.V3_KEYS, 0.001).collect()}
    assert set(w) == {"rare", "ex|x"} and w["ex|x"].w == T.EXACT_WEIGHT
    assert abs(w["rare"].w - 3.4339872) < 1e-6


def test_exact_rule(spark):
    keys = [("in", f"i{i}", "exact", "a b") for i in range(5)] + [("in", "i0", "num", "1234"), ("in", "i0", "sig", "12#1234")]
    df = spark.createDataFrame(keys, "country string, id string, kind string, key string")
    groups = retrieve.exact_groups(df)
    of = lambda **k: {r.key for r in retrieve.resolved(df, groups, **k).where("kind = 'exact'").collect()}
    assert of() == {"ex|a b"} and of(small=4) == {"exn|a b|1234", "exs|a b|12#1234"} and of(small=2, large=4) == set()


def test_plan_prunes_top_k_before_the_sort(spark):
    pairs = spark.createDataFrame([("in", "q", "s", 1.0)], "country string, q_id string, s_id string, score double")
    plan = retrieve.top_k(pairs, 2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_stream_gives_the_batch_result(spark, tmp_path):
    from tessera.plans import fixtures

    sf = "/root/testdata/sf0.001"
    raw = fixtures.records(spark, sf)
    n = fixtures.norm(spark, sf)
    index = link.Index(n.where("source = 'S1'"))
    raw.where("source <> 'S1'").repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(raw.schema).parquet(str(tmp_path / "in"))
    link.link_stream(stream, index, str(tmp_path / "out"), str(tmp_path / "check"), 5).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    want = retrieve.retrieve(n.where("source = 'S1'"), n.where("source <> 'S1'"), 5)
    assert got.count() == want.count() and got.exceptAll(want.select(*got.columns)).isEmpty()
    assert got.agg(F.max("rank")).first()[0] <= 4


def test_hot_keys_in_parts(spark):
    """Dealing keys over parts changes no pair and no score, and no part makes many more pairs than it may."""
    q = spark.createDataFrame([("in", f"S2-{i}", "name", k) for i in range(300) for k in ("hot", f"own{i % 7}")], "country string, id string, kind string, key string")
    s = spark.createDataFrame([("in", f"S1-{i}", "name", k) for i in range(20) for k in ("hot", f"own{i % 7}")], "country string, id string, kind string, key string")
    w = retrieve.key_weights(s, T.V3_KEYS)
    assert {r.key: r.parts for r in retrieve.key_parts(q, w, 1000).collect()} == {"hot": 6}
    rows = lambda most: sorted(map(tuple, retrieve.scored_pairs(q, s, w, most).collect()))
    assert rows(10**9) == rows(1000) == rows(1) and len(rows(1)) == 6000


def test_stages_are_removed(spark):
    from tessera.sources import files, stage

    with pytest.raises(KeyError), stage.stages_removed(spark):
        inner = stage.staged(spark.range(3), "gone").inputFiles()[0]
        raise KeyError
    kept = stage.staged(spark.range(3), "kept").inputFiles()[0]
    assert not files.there(spark, inner) and files.there(spark, kept)


def test_best_pairs_equal_the_plain_join(spark):
    """Blocks, parts and steps change no pair, score or rank; records with two rows and ids that sort unlike numbers are kept."""
    import random

    r = random.Random(3)
    rows = lambda x, n: [(r.choice(["in", "us"]), f"{x}-{i}", "name", f"k{int(r.paretovariate(0.6)) % 40}") for i in range(n) for _ in range(6)]
    q = spark.createDataFrame([*rows("S2", 90), ("fr", "S2-x", "name", "k1")], "country string, id string, kind string, key string")
    s = spark.createDataFrame(rows("S1", 70), "country string, id string, kind string, key string")
    w = retrieve.key_weights(s, T.V3_KEYS)
    want = retrieve.top_k(retrieve.scored_pairs(q, s, w), 5, 1.0)
    ids, own = retrieve.numbered(s.withColumnRenamed("id", "entity_id"))
    order = [(x.country, x.id) for x in ids.orderBy("nth").collect()]
    assert order == sorted(order) and sorted(x.nth for x in ids.collect()) == list(range(len(order)))
    for block in (200_000, 16):
        known, lists = retrieve.postings(own.withColumnRenamed("entity_id", "id").select(*s.columns), w, block)
        got = retrieve.best_pairs(q, known, lists, ids, 5, 1.0, block, 300)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []


def test_retrieval_shuffles_no_pairs(spark):
    rows = [(f"S{i % 3 + 1}-{i}", f"S{i % 3 + 1}", "in", f"sharma traders w{i % 4}", "srm trdrs", "gandhi road", f"{i % 5 + 10} 600001", "") for i in range(60)]
    df = spark.createDataFrame(rows, NORM)
    found = retrieve.retrieve(df.where("source = 'S1'"), df.where("source <> 'S1'"), 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "sum(w" not in plan and "Window" not in plan and found.count() == 120
    none = retrieve.retrieve(df.where("source = 'S9'"), df.where("source <> 'S1'"), 3)
    assert none.isEmpty()
