"""Decisions: a threshold on the best pair of a record, or the number of records that maximizes an entity's expected F0.5."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.metrics import f_half

# The grids.
#: Rules that are tried: thresholds first (ties go to the first), then floors and unseen matches of the expected-F rule.
THRESHOLDS = [round(0.1 + 0.025 * i, 3) for i in range(35)] + [0.96, 0.97, 0.98, 0.99]
FLOORS, EXTRAS = [0.02, 0.05, 0.1, 0.2, 0.3], [0.0, 0.25, 0.5]
#: Thresholds of the first generation: 27 even steps, and finer ones near 1.
V1_THRESHOLDS = sorted({round(0.3 + 0.025 * i, 3) for i in range(27)} | {0.96, 0.97, 0.975, 0.98, 0.985, 0.99, 0.993, 0.995, 0.997, 0.998, 0.999})
#: Probabilities that an entity may have for its fold to stay in the JVM.
FOLDED = 12


def by_threshold(best: DataFrame, threshold: float) -> DataFrame:
    return best.where(F.col("p") >= threshold)


def hits(ps: Column) -> Column:
    """Poisson-binomial: probabilities of 0, 1, ... successes of independent trials."""
    def one(d: Column, p: Column) -> Column:
        at = lambda j: F.coalesce(F.get(d, j), F.lit(0.0))
        return F.transform(F.sequence(F.lit(0), F.size(d)), lambda j: at(j) * (1 - p) + at(j - 1) * p)

    return F.aggregate(ps, F.array(F.lit(1.0)), one)


def expected_f(ps: Column, k: Column, extra: float) -> Column:
    """Expected F0.5 of keeping the k first of probabilities in descending order; extra matches are missed anyway.

    k = 0 scores 1 if there is no match at all: the product of 1 - p, times exp(-extra).
    """
    right, missed = hits(F.slice(ps, 1, k)), hits(F.slice(ps, k + 1, F.greatest(F.size(ps) - k, F.lit(1))))
    of = lambda a, u: 1.25 * a / (0.25 * (a + u + extra) + k)
    rest = F.when(k == F.size(ps), F.array(F.lit(1.0))).otherwise(missed)
    total = F.aggregate(
        F.transform(right, lambda pa, a: F.aggregate(F.transform(rest, lambda pu, u: pu * of(a, u)), F.lit(0.0), lambda s, x: s + x) * pa),
        F.lit(0.0), lambda s, x: s + x,
    )
    none = F.aggregate(ps, F.lit(1.0), lambda s, p: s * (1 - p)) * F.exp(F.lit(-float(extra)))
    return F.when(k == 0, none).otherwise(total)


def best_k(ps: Column, extra: float = 0.0) -> Column:
    """How many of an entity's records to keep: the smallest k with the largest expected F0.5 (to nine places)."""
    values = F.transform(F.sequence(F.lit(0), F.size(ps)), lambda k: F.struct((-F.round(expected_f(ps, k, extra), 9)).alias("v"), k.alias("k")))
    return F.array_min(values)["k"]


def best_k_of_many(ps: np.ndarray, extra: float = 0.0) -> int:
    """best_k() for long lists, in n**2 steps and n**1.5 memory.

    E[a / (a + u + extra + 4k)] takes, for each a, the mean of 1 / (a + 4k + extra + u) over the hits u after the first k. Those means for
    k - 1 follow from those for k by one more trial. Distributions of beginnings are kept at every step-th place and remade between.
    """
    n = len(ps)
    step = math.isqrt(n) + 1
    grown = lambda d, p: np.convolve(d, [1 - p, p])
    kept, head = [], np.ones(1)
    for i, p in enumerate(ps):
        if i % step == 0:
            kept.append(head)
        head = grown(head, p)
    at = np.arange(5 * n + 1.0)
    at[0] = 1  # not used
    mean = 1 / (at + extra)
    values = np.zeros(n + 1)
    values[0] = np.prod(1 - ps) * np.exp(-extra)
    for b in reversed(range(len(kept))):
        heads = [kept[b]]
        for p in ps[b * step : (b + 1) * step]:
            heads.append(grown(heads[-1], p))
        for k in range(b * step + len(heads) - 1, b * step, -1):
            values[k] = 5 * (heads.pop() * np.arange(k + 1)) @ mean[4 * k : 5 * k + 1]
            p, most = ps[k - 1], 5 * k - 4
            mean = p * mean[1 : most + 1] + (1 - p) * mean[:most]
    return int(np.argmax(np.round(values, 9)))


def many_k(ps: Column, extra: float = 0.0) -> Column:
    """best_k_of_many() as a column."""

    def run(lists: pd.Series) -> pd.Series:
        return lists.map(lambda x: best_k_of_many(np.asarray(x), extra), na_action="ignore").astype("Int32")

    return F.pandas_udf(run, "int", F.PandasUDFType.SCALAR)(ps)


def chosen_k(ps: Column, extra: float = 0.0) -> Column:
    """best_k() in the JVM for lists of up to FOLDED probabilities; only longer ones go to Python."""
    return F.coalesce(many_k(F.when(F.size(ps) > FOLDED, ps), extra), F.when(F.size(ps) <= FOLDED, best_k(ps, extra)))


def by_expected_f(best: DataFrame, floor: float = 0.05, extra: float = 0.0) -> DataFrame:
    """Rows of best pairs with p >= floor whose calibrated probability (column c, else p) is among their entity's best k.

    The probabilities of all records that choose one entity meet in one row; long lists cost the square of their length.
    """
    c = "c" if "c" in best.columns else "p"
    rows = best.where(F.col("p") >= floor)
    lists = rows.groupBy("country", "s_id").agg(F.transform(F.array_sort(F.collect_list(-F.col(c))), lambda x: -x).alias("ps_"))
    ks = lists.select("country", "s_id", chosen_k(F.col("ps_"), extra).alias("k_"))
    w = Window.partitionBy("country", "s_id").orderBy(F.desc(c), "q_id")
    return rows.withColumn("rn_", F.row_number().over(w)).join(ks, ["country", "s_id"]).where(F.col("rn_") <= F.col("k_")).drop("rn_", "k_")


def apply_rule(best: DataFrame, rule: dict) -> DataFrame:
    """Best pairs by a rule: {"method": "thr", "thr": ...} or {"method": "ef", "floor": ..., "extra": ...}."""
    return by_threshold(best, rule["thr"]) if rule["method"] == "thr" else by_expected_f(best, rule["floor"], rule["extra"])


def rules() -> list[dict]:
    """All rules in the order in which they are tried."""
    return [{"method": "thr", "thr": t} for t in THRESHOLDS] + [{"method": "ef", "floor": f, "extra": x} for f in FLOORS for x in EXTRAS]


def tuned(best: DataFrame, entities: DataFrame, truth: DataFrame, tried: list[dict] | None = None) -> tuple[dict, float]:
    """The first of the rules with the largest macro F0.5 over entities, and that value.

    Each entity's pairs are read once: counts for all thresholds are summed before the shuffle, expected-F rules share one list and are
    folded in Python, where fifteen folds make no large plan. A number for each rule comes back.
    """
    tried = tried or rules()
    own = truth.select("s_id", "q_id").distinct().join(entities.select("s_id"), "s_id", "left_semi")
    near = best.join(entities.select("s_id"), "s_id", "left_semi").select("s_id", "q_id", "p", F.col("c" if "c" in best.columns else "p").alias("c_"))
    near = near.join(own.withColumn("y_", F.lit(True)), ["s_id", "q_id"], "left").withColumn("y_", F.col("y_").isNotNull())
    sums = []
    for i, rule in enumerate(tried):
        if rule["method"] == "thr":
            taken = F.col("p") >= rule["thr"]
            sums += [F.count_if(taken).alias(f"n{i}"), F.count_if(taken & F.col("y_")).alias(f"hit{i}")]
    folded = {i: rule for i, rule in enumerate(tried) if rule["method"] == "ef"}
    if folded:
        sums.append(F.array_sort(F.collect_list(F.struct((-F.col("c_")).alias("d"), "q_id", "p", "y_"))).alias("all_"))
    found = near.groupBy("s_id").agg(*sums)
    over = lambda floor: F.filter("all_", lambda x: x["p"] >= floor)
    lists = {rule["floor"]: over(rule["floor"]) for rule in folded.values()}
    found = found.withColumns({f"n{i}": many_k(F.transform(lists[r["floor"]], lambda x: -x["d"]), r["extra"]) for i, r in folded.items()})
    found = found.withColumns({f"hit{i}": F.size(F.filter(F.slice(lists[r["floor"]], F.lit(1), F.col(f"n{i}")), lambda x: x["y_"])) for i, r in folded.items()})
    rows = entities.select("s_id").distinct().join(own.groupBy("s_id").agg(F.count("*").alias("n_true")), "s_id", "left").join(found, "s_id", "left")
    of = lambda c: F.coalesce(c, F.lit(0))
    values = rows.agg(*[F.round(F.avg(f_half(of("n_true"), of(f"n{i}"), of(f"hit{i}"))), 9) for i in range(len(tried))]).first()
    if values[0] is None:
        return tried[0], 0.0
    f, i = max((f, -i) for i, f in enumerate(values))
    return tried[-i], f
