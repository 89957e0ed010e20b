"""Stages of a plan kept as Parquet tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


_own: dict[str, str] = {}
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a local session without it gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if context.applicationId not in _own:
        _own[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="tessera-")
    return _own[context.applicationId]


def staged(df: DataFrame, name: str, *partitions: str) -> DataFrame:
    """df written once and read back: later plans start from its files, also after an executor is lost."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stages/{name}-{uuid.uuid4().hex}"
    if (made := _made.get()) is not None:
        made.append(path)
    df.write.partitionBy(*partitions).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def stages_removed(spark: SparkSession) -> Iterator[None]:
    """Removes the stages that are made inside, by this thread, at the end, also after an error. What is made of them must be written by then."""
    token = _made.set([])
    try:
        yield
    finally:
        made = _made.get()
        _made.reset(token)
        for name in made:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
