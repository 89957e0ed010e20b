from pyspark.sql import functions as F

import corpus_pipeline
from cases import documents, empty
from tessera.llm.common import written

SF = "/root/testdata/sf0.001"


def test_stages_keep_what_they_should(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = docs.count()
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = written(stage(spark, docs, SF), "test")
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.schema == docs.schema, name
            docs = out
        if name in ("language ID", "line dedup"):
            assert out.count() == n  # clean documents stay
    ends = out.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("m"))
    assert ends.where("n <> m OR n > 4096").count() == 0


def test_run_and_odd_cases(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
    for docs in (documents(spark), empty(spark)):
        for _, stage in corpus_pipeline.STAGES:
            docs = written(stage(spark, docs, SF), "test")
