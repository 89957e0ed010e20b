"""New records come as files; each micro-batch is linked to a static index and its candidates are appended.

The index is static tables (ids, keys with weights, postings, exact groups). Every query is independent of the others, so a
batch needs no state; Spark's checkpoint makes each file count once. A batch's own stages are removed with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tessera.functions import tables as T
from tessera.operators import retrieve
from tessera.operators.normalize import normalized
from tessera.sources.stage import staged, stages_removed


class Index:
    """Postings of Source-1 records, made once."""

    def __init__(self, s1: DataFrame, scale: float = 1.0):
        self.ids, s1 = retrieve.numbered(s1)
        keys = staged(retrieve.v3_record_keys(s1), "index-keys")
        self.groups = staged(retrieve.exact_groups(keys), "index-groups")
        keys = staged(retrieve.resolved(keys, self.groups), "index-resolved")
        self.known, self.postings = retrieve.postings(keys, retrieve.key_weights(keys, T.V3_KEYS, scale))

    def candidates(self, records: DataFrame, k: int = 20) -> DataFrame:
        keys = retrieve.resolved(retrieve.v3_record_keys(records), self.groups)
        return retrieve.best_pairs(keys, self.known, self.postings, self.ids, k)


def link_stream(records: DataFrame, index: Index, path: str, checkpoint: str, k: int = 20) -> StreamingQuery:
    """Starts the stream of raw records (entity_id, source, country, name, address) into a Parquet table of candidates."""

    def batch(df: DataFrame, nth: int) -> None:
        with stages_removed(df.sparkSession):
            index.candidates(normalized(df), k).write.mode("overwrite").parquet(f"{path}/batch={nth}")

    return records.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
