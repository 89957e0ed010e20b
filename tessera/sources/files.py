"""Delimited files of records, id lists and results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD = T.StructType([T.StructField(c, T.StringType()) for c in ("entity_id", "business_name", "business_address", "country")])
GOLD = T.StructType([T.StructField(c, T.StringType()) for c in ("source1_entity_id", "matched_entity_ids")])
#: What the second reader takes for a missing value.
MISSING = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def read_tsv(spark: SparkSession, path: str, schema: T.StructType = RECORD, columns: list[str] | None = None) -> DataFrame:
    """A tab-separated file with a header, all text. Nothing stands for null but an absent field, which becomes empty."""
    df = spark.read.csv(path, schema=schema, sep="\t", header=True, quote="", escape="", nullValue="\u0000", emptyValue="")
    return df.na.fill("").select(columns or df.columns)


def there(spark: SparkSession, path: str) -> bool:
    """Whether a path, on any file system that Spark knows, exists."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def present(spark: SparkSession, paths: list[str]) -> list[str]:
    """The paths that exist; a warning for each that doesn't."""
    import warnings

    found = [p for p in paths if there(spark, p)]
    for p in sorted(set(paths) - set(found)):
        warnings.warn(f"{p} is missing and skipped", stacklevel=2)
    return found


def missing_inferred(df: DataFrame) -> DataFrame:
    """Text columns with the usual spellings of a missing value as empty."""
    return df.select(*[F.when(F.col(f.name).isin(MISSING) | F.col(f.name).isNull(), F.lit("")).otherwise(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in df.schema])


def records(path_df: DataFrame, country: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """A normalized table cut to a country and to columns, nulls as empty text; both reach the scan."""
    df = path_df if country is None else path_df.where(F.col("country") == country)
    return df.select(columns or df.columns).na.fill("")


def countries(s1: DataFrame) -> DataFrame:
    return s1.select("country").where(F.col("country").isNotNull() & (F.col("country") != "")).distinct()


def ids(df: DataFrame, column: str = "entity_id") -> DataFrame:
    return df.select(F.trim(column).alias("id")).where("id <> ''").distinct()


def id_list(text: Column, most: int = 0) -> Column:
    """The ids of a comma-separated list, trimmed, in order, each once; at most `most` of them if it is given."""
    out = F.array_distinct(F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.trim(x)), lambda x: ~x.isin("", "nan")))
    return F.slice(out, 1, most) if most else out


def exploded(lists: DataFrame, key: str, column: str, name: str = "q_id") -> DataFrame:
    """(s_id, nth, id) of id lists, nth from 0."""
    return lists.select(F.col(key).alias("s_id"), F.posexplode(id_list(F.col(column))).alias("nth", name)).select("s_id", "nth", name)


def wanted_records(need: DataFrame, *tables: DataFrame) -> DataFrame:
    """Rows of the ids in need (column entity_id), from the first table that has them."""
    from functools import reduce

    tagged = [t.join(need.select("entity_id").distinct(), "entity_id", "left_semi").withColumn("from_", F.lit(i)) for i, t in enumerate(tables)]
    rows = reduce(DataFrame.unionByName, tagged)
    first = rows.groupBy("entity_id").agg(F.min_by(F.struct(*[c for c in rows.columns if c not in ("entity_id", "from_")]), "from_").alias("r_"))
    return first.select("entity_id", "r_.*")


def result_lines(s1_ids: DataFrame, matches: DataFrame, rank: str = "rank") -> DataFrame:
    """(s_id, ids): a row for every Source-1 id, its distinct matches (s_id, q_id, rank) joined by commas in their order."""
    lists = matches.groupBy("s_id").agg(F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct(rank, "q_id"))), lambda x: x["q_id"])), ",").alias("ids"))
    return s1_ids.select(F.col("id").alias("s_id")).join(lists, "s_id", "left").na.fill("", ["ids"])


def write_tsv(lines: DataFrame, path: str, header: tuple[str, str], order: str = "s_id") -> None:
    """Result lines in order, as parts of one range each with a header; concatenated parts are the whole file."""
    lines.orderBy(order).select(F.col("s_id").alias(header[0]), F.col("ids").alias(header[1])).write.mode("overwrite").csv(path, sep="\t", header=True, quote="", emptyValue="")


def write_results(spark: SparkSession, s1_ids: DataFrame, pairs: DataFrame, matches: DataFrame, out: str) -> None:
    """matching_results.tsv and candidate_pairs.tsv, folders of parts, under out: a row for every Source-1 id, the most likely first."""
    for name, column, rows in (("matching_results", "matched_entity_ids", matches), ("candidate_pairs", "candidate_entity_ids", pairs)):
        lines = result_lines(s1_ids, rows.select("s_id", "q_id", (-F.round("p", 6)).alias("rank")))
        write_tsv(lines, f"{out}/{name}.tsv", ("source1_entity_id", column))
