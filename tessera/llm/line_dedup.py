"""Line dedup: repeated lines are found by hash and removed by compressed keep bitmaps.

Only hashes, ids and positions are shuffled while lines are compared. They are
range-partitioned by hash with a secondary sort by document and position, and one pass over
each run tells the first document of a key from the others. The result is a bitmap of kept
lines for each document that loses some, run-length encoded; texts are joined once, at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import SPACES, ascii_lower, row_columns, whole_row, written

#: A key with more than this fraction of all long lines is handled by sums instead of a run.
HOT_SHARE = 1024
#: Items that the frequency sketch tracks; it finds every key above HOT_SHARE.
SKETCH_ITEMS = 8192
#: Stands for a null id: below every other.
NO_ID = -(2**63)


def _keyed(docs: DataFrame, *more: Column) -> DataFrame:
    """id_, fp_ name a document; documents equal in both are one. text_ is its text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(*more, F.coalesce(F.col("doc_id"), F.lit(NO_ID)).alias("id_"), text.alias("text_"), F.xxhash64(text).alias("fp_"))


def line_occurrences(docs: DataFrame, min_chars: int) -> DataFrame:
    """(h1_, h2_, id_, fp_, pos_) of every line whose key has min_chars code points or more."""
    key = ascii_lower(F.btrim(F.col("line_"), F.lit(SPACES)))
    return (
        _keyed(docs)
        .select("id_", "fp_", F.posexplode(F.split("text_", "\n")).alias("pos_", "line_"))
        .select("id_", "fp_", "pos_", key.alias("key_"))
        .where(F.char_length("key_") >= min_chars)
        .select(F.xxhash64("key_").alias("h1_"), F.xxhash64(F.lit("second"), "key_").alias("h2_"), "id_", "fp_", "pos_")
    )


def _dropped_in_runs(found: DataFrame, min_docs: int) -> DataFrame:
    """Streams each key's run from its largest id down; rows after the first id go."""
    run = Window.partitionBy("h1_", "h2_").orderBy(F.desc("id_"))
    return (
        found.repartitionByRange("h1_", "h2_")
        .sortWithinPartitions("h1_", "h2_", F.desc("id_"), "pos_")
        .withColumn("nth_", F.dense_rank().over(run))
        .withColumn("n_", F.max("nth_").over(Window.partitionBy("h1_", "h2_")))
        .where((F.col("nth_") > 1) & (F.col("n_") >= min_docs))
        .select("id_", "fp_", "pos_")
    )


def _dropped_by_sums(found: DataFrame, min_docs: int) -> DataFrame:
    """The same for at most HOT_SHARE keys: their counts are summed before the shuffle."""
    stats = (
        found.groupBy("h1_", "h2_", "id_").agg(F.count("*").alias("rows_"))
        .groupBy("h1_", "h2_").agg(F.count("*").alias("n_"), F.max("id_").alias("last_"))
        .where(F.col("n_") >= min_docs)
    )
    return found.join(F.broadcast(stats), ["h1_", "h2_"]).where("id_ <> last_").select("id_", "fp_", "pos_")


def keep_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, hot_share: int = HOT_SHARE) -> DataFrame:
    """(id_, fp_, dropped_, keep_runs_) of every document that loses lines.

    A line's key is the line without `[\\x20\\x09-\\x0D]` at its ends, A-Z lower-cased. A key of
    min_chars code points or more, found in min_docs documents (distinct ids) or more, loses all
    lines but those of the largest id. keep_runs_ is the keep bitmap in runs of (first line, number of
    lines). A null or empty text is one empty line, which stays; null ids are one id below all
    others; rows equal in id and text are one document. Extra columns are ignored.
    """
    found = written(line_occurrences(docs, min_chars), "lines")
    sketch = found.agg(F.expr(f"approx_top_k(h1_, {hot_share}, {max(SKETCH_ITEMS, 2 * hot_share)})").alias("top_"), F.count("*").alias("all_"))
    hot = sketch.select(F.explode("top_").alias("x_"), "all_").where(F.col("x_.count") * hot_share >= F.col("all_")).select(F.col("x_.item").alias("h1_"))
    hot = F.broadcast(hot)  # hot_share rows at most
    gone = _dropped_in_runs(found.join(hot, "h1_", "left_anti"), min_docs).unionAll(_dropped_by_sums(found.join(hot, "h1_", "left_semi"), min_docs))
    at = gone.groupBy("id_", "fp_").agg(F.array_sort(F.collect_set("pos_")).alias("at_"))
    size = F.size("at_")
    runs = F.transform(
        F.sequence(F.lit(0), size),
        lambda i: F.struct(
            F.when(i == 0, 0).otherwise(F.get("at_", i - 1) + 1).alias("first"),
            (F.when(i == size, F.lit(2**31 - 1)).otherwise(F.get("at_", i)) - F.when(i == 0, 0).otherwise(F.get("at_", i - 1) + 1)).alias("n"),
        ),
    )
    return at.select("id_", "fp_", size.cast("long").alias("dropped_"), F.filter(runs, lambda r: r["n"] > 0).alias("keep_runs_"))


def line_dedup(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, hot_share: int = HOT_SHARE) -> DataFrame:
    """docs with text_kept (lines that stay, joined by \\n), n_lines and n_dropped; see keep_bitmaps."""
    maps = keep_bitmaps(docs, min_chars, min_docs, hot_share)
    # The list of one list of lines is there so that a text is split once, not for each run.
    of = lambda lines: F.array_join(F.flatten(F.transform("keep_runs_", lambda r: F.slice(lines, r["first"] + 1, r["n"]))), "\n")
    kept = F.get(F.transform(F.array(F.split("text_", "\n")), of), F.lit(0))
    n_lines = (F.octet_length("text_") - F.octet_length(F.replace("text_", F.lit("\n"), F.lit(""))) + 1).cast("long")
    own = [row for name, row in zip(docs.columns, row_columns(docs)) if name not in ("text_kept", "n_lines", "n_dropped")]
    out = _keyed(docs, whole_row(docs)).join(maps, ["id_", "fp_"], "left").select(
        "row_",
        F.when(F.col("dropped_").isNull(), F.col("text_")).otherwise(kept).alias("text_kept"),
        n_lines.alias("n_lines"),
        F.coalesce("dropped_", F.lit(0)).cast("long").alias("n_dropped"),
    )
    return out.select(*own, "text_kept", "n_lines", "n_dropped")


def digest(docs: DataFrame) -> DataFrame:
    out = line_dedup(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text_kept", 256).alias("kept_sha256"))


ORACLE = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT rid, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
s AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.rid, k.doc_id, k.line, k.pos, s.last IS NOT NULL AND k.doc_id <> s.last AS gone FROM k LEFT JOIN s USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count_if(gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY rid, doc_id
"""
