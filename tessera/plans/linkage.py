"""The linkage pipelines end to end.

fit_v3: normalize, retrieve, fit cross-fitted models of pairs, add context, fit again, calibrate, choose a rule, save. predict_v3
scores records without owners by the saved models; recut decides from saved scores. run_v3: both on the same records. run_v1: clean,
block, one model, one threshold. Stages are tables in the shared folder, which outlive lost executors.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import asdict, dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import basic, fuzzy, text
from tessera.functions import similarity as S
from tessera.operators import context, decide, difftab, features, metrics, model, retrieve, translit
from tessera.operators.normalize import normalized
from tessera.operators.splits import blanked, role, v1_split
from tessera.sources.stage import staged

KEYS = ["country", "q_id", "s_id"]
#: Kinds of second-stage models, which are blended.
KINDS = ("gbt", "rf")


@dataclass
class Settings:
    """Parameters that are part of the results."""

    top_k: int = 20
    top_m: int = 3
    tau: float = 0.5
    report_pct: int = 4
    tune_pct: int = 4
    rounds: int = 20
    threshold: float = 0.5
    strings: bool = True
    native: bool = True
    least_words: int = difftab.MIN_COUNT
    rules: list[dict] | None = None


@dataclass
class Fitted:
    """What linking new records takes: settings, models by name, the word table, learned transliterations, and numbers and names
    (weights, knots, rule, report) in meta."""

    settings: Settings
    models: dict[str, PipelineModel]
    words: DataFrame
    maps: dict[str, dict[str, str]]
    meta: dict

    def save(self, spark: SparkSession, path: str) -> None:
        self.words.write.mode("overwrite").parquet(f"{path}/words")
        rows = [(kind, token, target) for kind, table in self.maps.items() for token, target in table.items()]
        spark.createDataFrame(rows, "kind string, token string, target string").write.mode("overwrite").parquet(f"{path}/maps")
        model.save(self.models, {"settings": asdict(self.settings), "models": sorted(self.models)} | self.meta, path, spark)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Fitted":
        meta = model.load(path, [], spark)[1]
        models, _ = model.load(path, meta["models"], spark)
        maps: dict[str, dict[str, str]] = {}
        for r in spark.read.parquet(f"{path}/maps").collect():
            maps.setdefault(r["kind"], {})[r["token"]] = r["target"]
        return cls(Settings(**meta["settings"]), models, spark.read.parquet(f"{path}/words"), maps, meta)


def labelled(pairs: DataFrame, records: DataFrame, owners: DataFrame | None, settings: Settings) -> DataFrame:
    """pairs with both cores and numbers, y (the candidate is the owner) and held (the owner is a report or tune entity). Without
    owners nothing is known and all is held out."""
    side = lambda x: records.select("country", F.col("entity_id").alias(f"{x}_id"), F.col("core").alias(f"{x}_core"), F.col("nums").alias(f"{x}_nums"))
    rows = pairs.join(side("q"), ["country", "q_id"]).join(side("s"), ["country", "s_id"])
    if owners is None:
        return rows.withColumns({"y": F.lit(False), "held": F.lit(True)})
    rows = rows.join(owners.select("q_id", F.col("s_id").alias("own_")), "q_id", "left")
    held = F.coalesce(role(F.col("own_"), settings.report_pct, settings.tune_pct) > 0, F.lit(False))
    return rows.withColumns({"y": F.coalesce(F.col("own_") == F.col("s_id"), F.lit(False)), "held": held}).drop("own_")


def word_table(rows: DataFrame, settings: Settings) -> DataFrame:
    """Log-odds of added and dropped words from labelled pairs that aren't held out, all countries together."""
    one = rows.withColumn("country", F.lit("all"))
    return staged(difftab.supervised(one.where((F.col("rank") < 5) & ~F.col("held")), settings.least_words), "words")


def difference_features(rows: DataFrame, table: DataFrame, settings: Settings, fitting: bool) -> DataFrame:
    """rows with the log-odds summaries of added and dropped words: d_ from labels (hidden for a fifth of the records that models
    are fitted on), px_ from kept numbers, by country."""
    near = difftab.proxy(rows.where(F.col("rank") < 3), settings.least_words)
    px = difftab.summaries(rows, near, "px")
    d = difftab.summaries(rows.withColumn("country", F.lit("all")), table, "d", blanked(F.col("q_id")) if fitting else None).drop("country")
    return rows.join(px, KEYS, "left").join(d, KEYS[1:], "left").na.fill(0)


def stage1_rows(records: DataFrame, owners: DataFrame | None, settings: Settings, table: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Retrieved pairs with all features of one pair, y and held; the coded records that they were made from; the word table, learned
    here unless one is given."""
    s1 = records.where("source = 'S1'")
    pairs = staged(features.retrieval_features(retrieve.retrieve(s1, records.where("source <> 'S1'"), settings.top_k)), "pairs")
    fields = features.fields(records)
    coded = staged(features.weighted(fields, features.word_stats(fields.where("source = 'S1'"))), "coded")
    found = features.pair_features(pairs, coded, settings.strings)
    rows = staged(labelled(pairs, records, owners, settings), "labelled")
    table = word_table(rows, settings) if table is None else table
    rows = difference_features(rows, table, settings, owners is not None).drop("rank", "score", "q_core", "s_core", "q_nums", "s_nums")
    return staged(rows.join(found, KEYS), "stage1"), coded, table


def columns_of(rows: DataFrame) -> list[str]:
    return [f.name for f in rows.schema if f.name not in (*KEYS, "y", "held", "p")]


def siblings(pairs: DataFrame, best: DataFrame, coded: DataFrame, tau: float, cap: int, prefix: str) -> DataFrame:
    """Summaries of the other records that chose a pair's entity."""
    found = staged(context.sibling_pairs(pairs, best, tau, cap), prefix)
    both = features.both_sides(found.select("country", "q_id", "mem_id").distinct(), coded, "q_id", "mem_id")
    kernel = features.kernel_features()
    similar = both.select("country", "q_id", "mem_id", *[kernel[c].alias(c) for c in ("n_wjacc", "a_wjacc", "num_jacc", "num_near", "unit_shared")])
    return context.sibling_features(found, similar, prefix)


def stage2_rows(scored: DataFrame, coded: DataFrame, settings: Settings) -> DataFrame:
    """The top_m pairs of every query with the context of stage-1 probabilities, confident siblings and all neighbours."""
    ctx = staged(context.context_features(scored.select(*KEYS, "p")).where(F.col("p1_rank") < settings.top_m), "context")
    best = context.best_owner(scored.select(*KEYS, "p"))
    rows = scored.drop("p").join(ctx, KEYS)
    for tau, cap, prefix in ((settings.tau, 10, "sib"), (0.0, 15, "nb")):
        rows = rows.join(siblings(ctx.select(*KEYS), best, coded, tau, cap, prefix), KEYS, "left")
    return staged(rows.na.fill(0), "stage2")


def learned_maps(records: DataFrame, owners: DataFrame, settings: Settings) -> dict[str, dict[str, str]]:
    """Transliterations from records in native script and their owners that aren't held out; none if no record has such letters."""
    s1, others = records.where("source = 'S1'"), records.where("source <> 'S1'")
    native = text.has_indic(F.col("name")) | text.has_indic(F.col("address"))
    if not settings.native or others.where(native).isEmpty():
        return {}
    known = owners.where(role(F.col("s_id"), settings.report_pct, settings.tune_pct) == 0)
    return {kind: translit.as_dict(table) for kind, table in translit.learn(others, s1, known).items()}


def _scored2(models: dict[str, PipelineModel], rows: DataFrame) -> DataFrame:
    for kind in KINDS:
        rows = staged(model.score_folds([models[f"{kind}_{f}"] for f in (0, 1)], rows, F.col("held")).withColumnRenamed("p", f"p_{kind}"), "p2")
    return rows


def _fitted(records: DataFrame, owners: DataFrame, settings: Settings) -> tuple[Fitted, DataFrame]:
    """The models, and all scored pairs of the records that they were fitted on, with y and p."""
    maps = learned_maps(records, owners, settings)
    norm = staged(normalized(records, settings.native, maps), "normalized")
    one, coded, table = stage1_rows(norm, owners, settings)
    held, models = F.col("held"), {}
    models |= {f"one_{f}": m for f, m in enumerate(model.fit_folds(one, columns_of(one), "gbt", settings.rounds, held))}
    two = stage2_rows(staged(model.score_folds([models["one_0"], models["one_1"]], one, held), "p1"), coded, settings)
    for kind in KINDS:
        models |= {f"{kind}_{f}": m for f, m in enumerate(model.fit_folds(two, columns_of(two), kind, settings.rounds, held))}
    parts = _scored2(models, two)
    entities = norm.where("source = 'S1'").select("country", F.col("entity_id").alias("s_id")).withColumn("role", role(F.col("s_id"), settings.report_pct, settings.tune_pct))
    # Weights, calibration and the rule come from tune entities; tables without one leave all.
    if (tuning := entities.where("role = 1")).isEmpty():
        tuning = entities
    near = parts.join(tuning.select("s_id"), "s_id", "left_semi")
    weights = model.blend_weights(parts if near.isEmpty() else near, [f"p_{k}" for k in KINDS])
    pairs = staged(parts.withColumn("p", model.blend([f"p_{k}" for k in KINDS], weights)).select(*KEYS, "y", "p"), "scored")
    best = staged(context.best_owner(pairs), "best")
    near = best.join(tuning.select("s_id"), "s_id", "left_semi")
    meta = {"weights": weights, "knots": model.calibrate(best if near.isEmpty() else near)}
    best = staged(best.withColumn("c", model.interpolated(F.col("p"), meta["knots"])), "calibrated")
    rule, f = decide.tuned(best, tuning.select("country", "s_id"), owners, settings.rules)
    report = entities.where("role = 2").select("country", "s_id")
    scores = metrics.entity_scores(report, owners.join(report, "s_id", "left_semi"), decide.apply_rule(best, rule).join(report, "s_id", "left_semi"))
    meta |= {"rule": rule, "tune_f05": f, "report_f05": scores.agg(F.round(F.avg("f05"), 6)).first()[0]}
    return Fitted(settings, models, table, maps, meta), pairs


def fit_v3(records: DataFrame, owners: DataFrame, path: str, settings: Settings | None = None) -> dict:
    """Fits all models on raw records and known owners (q_id, s_id) and saves them; returns the meta data, with the macro F0.5 of
    tune entities (under the chosen rule) and of report entities, which nothing was fitted on."""
    fitted, _ = _fitted(records, owners, settings or Settings())
    fitted.save(records.sparkSession, path)
    return fitted.meta


def predict_v3(records: DataFrame, path: str) -> DataFrame:
    """(country, q_id, s_id, p) of the top pairs of raw records without known owners, by saved models; both folds' mean counts."""
    fitted = Fitted.load(records.sparkSession, path)
    norm = staged(normalized(records, fitted.settings.native, fitted.maps), "normalized")
    one, coded, _ = stage1_rows(norm, None, fitted.settings, fitted.words)
    scored = staged(model.score_folds([fitted.models["one_0"], fitted.models["one_1"]], one, F.col("held")), "p1")
    parts = _scored2(fitted.models, stage2_rows(scored, coded, fitted.settings))
    return parts.select(*KEYS, model.blend([f"p_{k}" for k in KINDS], fitted.meta["weights"]).alias("p"))


def recut(pairs: DataFrame, meta: dict, rule: dict | None = None, blank: Iterable[str] = ()) -> DataFrame:
    """(country, q_id, s_id, p) of matches: decisions from scored pairs by the tuned rule or another; none in blank countries."""
    best = context.best_owner(pairs.where(~F.col("country").isin(list(blank))))
    best = staged(best.withColumn("c", model.interpolated(F.col("p"), meta["knots"])), "calibrated")
    return decide.apply_rule(best, rule or meta["rule"]).select(*KEYS, F.round("p", 6).alias("p"))


def run_v3(records: DataFrame, owners: DataFrame, settings: Settings | None = None) -> DataFrame:
    """(country, q_id, s_id, p): each record's owner, of raw records and known owners (q_id, s_id)."""
    fitted, pairs = _fitted(records, owners, settings or Settings())
    return recut(pairs, fitted.meta)


def run_v1(records: DataFrame, owners: DataFrame, rounds: int = 20, threshold: float | None = None) -> DataFrame:
    """(country, q_id, s_id, p) of pairs over one threshold, of the first generation. Entities are split 70/15/15: the model is
    fitted on the first part; without a threshold, the lowest of the best ones on the second is taken."""
    cols = basic.record_columns(F.col("name"), F.col("address"), native=True)
    cleaned = staged(records.select("entity_id", "source", "country", *[c.alias(k) for k, c in cols.items()]), "cleaned")
    pairs = staged(retrieve.block(cleaned.where("source = 'S1'"), cleaned.where("source <> 'S1'")), "blocked")
    need = ("name_core", "addr_normalized", "addr_numbers")
    side = lambda name, x: cleaned.select(F.col("entity_id").alias(name), *[F.col(c).alias(f"{x}_{c}") for c in need])
    both = pairs.join(side("candidate_id", "q"), "candidate_id").join(side("s1_id", "s"), "s1_id")
    made = S.v1_features(*[F.col(f"{x}_{c}") for x in "qs" for c in need])
    made |= {"name_sort": fuzzy.similarity("token_sort", F.col("q_name_core"), F.col("s_name_core")), "addr_sort": fuzzy.similarity("token_sort", F.col("q_addr_normalized"), F.col("s_addr_normalized"))}
    own = owners.select("q_id", F.col("s_id").alias("own_"))
    rows = both.select("country", F.col("candidate_id").alias("q_id"), F.col("s1_id").alias("s_id"), *[c.alias(k) for k, c in made.items()])
    rows = staged(rows.join(own, "q_id", "left").withColumn("y", F.coalesce(F.col("own_") == F.col("s_id"), F.lit(False))).drop("own_"), "v1-rows")
    fitted = model.fit(rows.where(v1_split(F.col("s_id")) == "fit"), list(made), "gbt", rounds)
    scored = staged(model.predict(fitted, rows).select(*KEYS, "p"), "v1-scored")
    if threshold is None:
        entities = cleaned.where("source = 'S1'").select("country", F.col("entity_id").alias("s_id")).where(v1_split(F.col("s_id")) == "threshold")
        threshold = decide.tuned(scored, entities, owners, [{"method": "thr", "thr": t} for t in decide.V1_THRESHOLDS])[0]["thr"]
    return decide.by_threshold(scored, threshold).select(*KEYS, F.round("p", 6).alias("p"))
