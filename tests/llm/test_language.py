import math
import zlib

import numpy as np
from cases import documents, empty, rows

from tessera.llm import language


def plain_kernel(a, b):
    out = 0.0
    for n in range(3):
        x, y = ({g for g in s if language.STARTS[n] <= g < language.STARTS[n + 1]} for s in (a.tolist(), b.tolist()))
        out += len(x & y) / math.sqrt(len(x) * len(y)) if x and y else 0
    return out


def test_grams_and_kernel():
    a = language.grams("Abc, déf!")
    symbols = [0, 1, 2, 3, 0, 4, 27 + ord("é") % 37, 6, 0]
    want = set(symbols) | {64 + x * 64 + y for x, y in zip(symbols, symbols[1:])} | {64 + 4096 + (x * 64 + y) * 64 + z for x, y, z in zip(symbols, symbols[1:], symbols[2:])}
    assert set(a.tolist()) == want
    assert len(language.grams("12 !?")) == len(language.grams(None)) == 0
    texts = [language.grams(t) for t in ("one two three", "deux trois quatre", "two three four")]
    model = language.fit([(texts[0], "en"), (texts[1], "fr")], landmarks=2)
    model.weights = np.eye(2, dtype=np.float32)
    assert np.allclose(model.scores(texts), [[plain_kernel(t, m) for m in texts[:2]] for t in texts], atol=1e-5)


def test_contract(spark):
    docs = documents(spark)
    model = language.train(docs)
    out = language.language_id(docs, model).collect()
    assert len(out) == len(rows())
    by = {}
    for r in out:
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
        by.setdefault(r.doc_id, r)
    for d in (5, 6, 7, 13):
        assert by[d].lang_pred == "und" and by[d].score == 0
    assert set(model.languages) <= {"en", "fr", "de"} and by[1].lang_pred in model.languages
    assert language.identify(empty(spark)).collect() == []
    nothing = language.train(docs.withColumn("lang", language.F.lit(None).cast("string")))
    assert {r.lang_pred for r in language.language_id(docs, nothing).collect()} == {"und"}
    assert language.keep_known(docs, nothing).count() == len(rows())
    kept = language.keep_known(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.select("doc_id").collect()}.isdisjoint({5, 6, 7, 13})


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in out) / len(out) > 0.97


def test_rare_languages_are_learned(spark):
    """Each of 30 languages has its own letters; the sample asked for is smaller than the number of languages."""
    texts = [(i, " ".join(chr(0x4E00 + 40 * (i % 30) + (i * k) % 37) * 3 for k in range(1, 30)), f"l{i % 30}") for i in range(900)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    assert len(language.train(docs, rows=20).languages) == 30
