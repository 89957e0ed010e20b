import itertools
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.functions import fuzzy
from tessera.operators import context, decide, metrics, model, splits
from tessera.sources import files


def brute_k(ps, extra):
    """The best k by all outcomes."""
    def value(k):
        out = 0.0
        for hit in itertools.product((0, 1), repeat=len(ps)):
            w = math.prod(p if h else 1 - p for p, h in zip(ps, hit))
            a, u = sum(hit[:k]), sum(hit[k:])
            out += w * ((not any(hit)) * math.exp(-extra) if k == 0 else 1.25 * a / (0.25 * (a + u + extra) + k))
        return round(out, 9)

    return max(range(len(ps) + 1), key=lambda k: (value(k), -k))


@pytest.mark.parametrize("extra", [0.0, 0.25])
def test_expected_f(spark, extra):
    rng = random.Random(4)
    lists = [[0.9, 0.2], [0.3], [0.95, 0.9, 0.8]] + [sorted((round(rng.random(), 3) for _ in range(rng.randint(1, 6))), reverse=True) for _ in range(25)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, ps array<double>")
    got = [r.k for r in df.select("i", decide.best_k(F.col("ps"), extra).alias("k")).orderBy("i").collect()]
    assert got == [brute_k(x, extra) for x in lists]
    assert extra or got[:3] == [1, 0, 3]


def test_select(spark):
    best = spark.createDataFrame([("c", "q0", "s0", 0.9), ("c", "q1", "s0", 0.4), ("c", "q2", "s1", 0.7)], "country string, q_id string, s_id string, p double")
    assert {r.q_id for r in decide.by_expected_f(best, 0.05).collect()} == {"q0", "q2"}
    assert {r.q_id for r in decide.by_threshold(best, 0.4).collect()} == {"q0", "q1", "q2"}


def test_macro_f05(spark):
    pairs = lambda text: spark.createDataFrame([tuple(x.split(":")) for x in text.split()], "s_id string, q_id string")
    e = spark.createDataFrame([("c", "1"), ("c", "2"), ("c", "3")], "country string, s_id string")
    scores = metrics.entity_scores(e, pairs("1:a 1:b 3:c"), pairs("1:a 1:b 1:x"))
    total = metrics.report(scores).where("grp is null and country is null").first()
    assert abs(total.f05 - (0.7142857142857143 + 1.0) / 3) < 1e-6 and total.n == 3 and total.singleton_fp == 0


def test_context_of_ties(spark):
    p = spark.createDataFrame([("c", "q", "s1", 0.5), ("c", "q", "s2", 0.5), ("c", "r", "s2", 0.5)], "country string, q_id string, s_id string, p double")
    out = {(r.q_id, r.s_id): r for r in context.context_features(p).collect()}
    assert out["q", "s1"].p1_rank == 0 and out["q", "s2"].p1_max_other == 0.5 and out["r", "s2"].p1_max_other == 0.0 and out["r", "s2"].s_pmax_other == 0.5
    assert context.best_owner(p).where("q_id = 'q'").first().s_id == "s1"


def test_buckets(spark):
    df = spark.createDataFrame([("S1-1",), ("S2-é",)], "i string")
    assert [r.b for r in df.select(splits.bucket(F.col("i"), 1000).alias("b")).collect()] == [zlib.crc32(x.encode()) % 1000 for x in ("S1-1", "S2-é")]


def test_fuzzy_batches_equal_plain_scorers():
    rng = random.Random(3)
    make = lambda: " ".join("".join(rng.choice("abcé1") for _ in range(rng.randint(0, 7))) for _ in range(rng.randint(0, 8)))
    a, b = [make() for _ in range(400)] + ["a" * 80, "x"], [make() for _ in range(400)] + ["ab" * 70, ""]
    for kind in ("ratio", "token_sort", "token_set", "partial"):
        plain = getattr(fuzzy, kind)
        assert all(abs(x - plain(p, q)) < 1e-12 for x, p, q in zip(fuzzy.SCORERS[kind](a, b), a, b) if p and q)
    assert fuzzy.lcs("abcbdab", "bdcaba") == 4
    assert abs(fuzzy.jaro_winkler("martha", "marhta") - 0.961111) < 1e-6 and fuzzy.token_set("a b", "b a c") == 1.0
    assert fuzzy.partial("abcd", "xxabcdyy") == 1.0 and abs(fuzzy.ratio("abcd", "abce") - 0.75) < 1e-12


def test_models(spark):
    rng = random.Random(1)
    rows = [("c", f"q{i}", f"s{j}", float(j == 0) + rng.random() * 0.5, rng.random(), j == 0) for i in range(150) for j in range(3)]
    df = spark.createDataFrame(rows, "country string, q_id string, s_id string, f double, g double, y boolean")
    out = model.cross_fit(df, ["f", "g"], "gbt", 5, F.col("q_id") == "q0")
    assert out.count() == len(rows) and out.agg(F.avg(F.when((F.col("p") > 0.5) == F.col("y"), 1).otherwise(0))).first()[0] > 0.95
    both = out.withColumn("noise", F.lit(0.5))
    assert model.blend_weights(both, ["p", "noise"], "y")[0] >= 0.9
    knots = model.calibrate(out)
    assert all(x[1] <= y[1] for x, y in zip(knots, knots[1:]))
    fitted = model.fit(df, ["f", "g"], "rf", 5)
    assert model.importance(fitted, ["f", "g"])[0][0] == "f"


def test_model_files(spark, tmp_path):
    df = spark.createDataFrame([("c", f"q{i}", "s", float(i % 2), i % 2 == 1) for i in range(40)], "country string, q_id string, s_id string, f double, y boolean")
    fitted = model.fit(df, ["f"], "rf", 3)
    model.save({"rf": fitted}, {"threshold": 0.5}, str(tmp_path / "m"), spark)
    models, meta = model.load(str(tmp_path / "m"), ["rf"], spark)
    assert meta == {"threshold": 0.5}
    assert model.predict(models["rf"], df).exceptAll(model.predict(fitted, df)).isEmpty()


def test_files(spark, tmp_path):
    (tmp_path / "in.tsv").write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\tNA\t"quoted\tus\nS1-2\t\tx\t\n')
    df = files.read_tsv(spark, str(tmp_path / "in.tsv"))
    assert [tuple(r) for r in df.orderBy("entity_id").collect()] == [("S1-1", "NA", '"quoted', "us"), ("S1-2", "", "x", "")]
    assert files.missing_inferred(df).where("business_name = ''").count() == 2
    assert files.countries(df).count() == 1
    matches = spark.createDataFrame([("S1-1", "S2-2", 1), ("S1-1", "S2-1", 2), ("S1-1", "S2-2", 3)], "s_id string, q_id string, rank int")
    lines = files.result_lines(files.ids(df), matches)
    assert {tuple(r) for r in lines.collect()} == {("S1-1", "S2-2,S2-1"), ("S1-2", "")}
    files.write_tsv(lines, str(tmp_path / "out"), ("source1_entity_id", "matched_entity_ids"))
    back = spark.read.csv(str(tmp_path / "out"), sep="\t", header=True)
    assert back.columns == ["source1_entity_id", "matched_entity_ids"] and back.count() == 2


def test_long_lists_go_the_other_way(spark):
    rng = random.Random(8)
    lists = [sorted((rng.random() for _ in range(n)), reverse=True) for n in (1, 3, 8, 13, 30, 90)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, ps array<double>")
    got = [r.k for r in df.select("i", decide.chosen_k(F.col("ps"), 0.1).alias("k")).orderBy("i").collect()]
    assert got == [decide.best_k_of_many(decide.np.array(x), 0.1) for x in lists]
    assert got[:3] == [brute_k(x, 0.1) for x in lists[:3]]


def plain_k(ps, extra):
    """The best k by the distributions of hits before and after each place."""
    def hits(xs):
        d = [1.0]
        for p in xs:
            d = [(d[j] if j < len(d) else 0) * (1 - p) + (d[j - 1] * p if j else 0) for j in range(len(d) + 1)]
        return d

    values = [round(math.prod(1 - p for p in ps) * math.exp(-extra), 9)]
    for k in range(1, len(ps) + 1):
        left, right = hits(ps[:k]), hits(ps[k:])
        values.append(round(sum(x * y * 1.25 * a / (0.25 * (a + u + extra) + k) for a, x in enumerate(left) for u, y in enumerate(right)), 9))
    return values.index(max(values))


@pytest.mark.parametrize("extra", [0.0, 0.5])
def test_long_lists_equal_the_plain_sum(extra):
    rng = random.Random(9)
    lists = [sorted((rng.random() ** power for _ in range(n)), reverse=True) for n in (1, 2, 5, 17, 26, 60) for power in (0.2, 1, 4, 30)]
    lists += [[1.0] * 7, [0.0] * 7, [1.0, 0.5, 0.0]]
    assert [decide.best_k_of_many(decide.np.array(x), extra) for x in lists] == [plain_k(x, extra) for x in lists]


def test_tuned_rule(spark):
    best = spark.createDataFrame([("c", "q0", "s0", 0.9), ("c", "q1", "s0", 0.4), ("c", "q2", "s1", 0.3)], "country string, q_id string, s_id string, p double")
    e = spark.createDataFrame([("c", "s0"), ("c", "s1")], "country string, s_id string")
    truth = spark.createDataFrame([("q0", "s0"), ("q1", "s0")], "q_id string, s_id string")
    rule, f = decide.tuned(best, e, truth)
    assert rule == {"method": "thr", "thr": 0.325} and f == 1.0
    assert len(decide.rules()) == 39 + 15 and len(decide.V1_THRESHOLDS) == 38


def test_tuned_rule_equals_rules_one_by_one(spark):
    rng = random.Random(10)
    pairs = [("c", f"q{i}", f"s{rng.randint(0, 9) ** 2 // 8}", round(rng.random(), 3), round(rng.random(), 2)) for i in range(60)]
    best = spark.createDataFrame(pairs, "country string, q_id string, s_id string, p double, c double")
    e = spark.createDataFrame([("c", f"s{i}") for i in range(0, 12, 2)], "country string, s_id string")
    truth = spark.createDataFrame([(q, s if rng.random() < 0.6 else f"s{rng.randint(0, 11)}") for _, q, s, _, _ in pairs], "q_id string, s_id string")
    tried = [{"method": "thr", "thr": t} for t in (0.1, 0.5, 0.9)] + [{"method": "ef", "floor": f, "extra": x} for f in (0.02, 0.3) for x in (0.0, 0.5)]
    near = best.join(e.select("s_id"), "s_id", "left_semi")
    each = [round(metrics.entity_scores(e, truth, decide.apply_rule(near, rule)).agg(F.avg("f05")).first()[0], 9) for rule in tried]
    for some, values in ((tried, each), (tried[:3], each[:3]), (tried[::-1], each[::-1])):
        assert decide.tuned(best, e, truth, some) == (some[values.index(max(values))], max(values))
    assert decide.tuned(best, e.where("false"), truth, tried) == (tried[0], 0.0)
