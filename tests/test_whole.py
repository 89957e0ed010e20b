"""Registered queries do the whole job of their operators."""

import inspect

from tessera.plans import feature_queries, linkage, model_queries, retrieval_queries


def test_linkage_runs_with_all_features_and_rounds(monkeypatch):
    seen = {}
    monkeypatch.setattr(model_queries, "records", lambda *a: None)
    monkeypatch.setattr(model_queries, "gold", lambda *a: None)
    monkeypatch.setattr(linkage, "run_v3", lambda r, g, settings=None: seen.update(v3=settings or linkage.Settings()))
    rounds = inspect.signature(linkage.run_v1).parameters["rounds"].default
    monkeypatch.setattr(linkage, "run_v1", lambda r, g, rounds=rounds, **k: seen.update(v1=rounds))
    model_queries.linkage_v3(None, "")
    model_queries.linkage_v1(None, "")
    plain = linkage.Settings()
    assert (seen["v3"].strings, seen["v3"].native, seen["v3"].rounds) == (plain.strings, plain.native, plain.rounds) == (True, True, 20)
    assert seen["v1"] == rounds == 20


def test_queries_without_sql_take_all_candidates(spark):
    sf = "/root/testdata/sf0.001"
    n = retrieval_queries.candidates(spark, sf).count()
    assert feature_queries.string_similarities(spark, sf).count() == n
    assert model_queries.training_rows(spark, sf).count() == n
