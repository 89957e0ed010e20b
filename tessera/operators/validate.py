"""Checks of a result file of id lists: findings by rule, with their number and first examples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EXAMPLES, PARTS = 5, 512


def findings(lines: DataFrame, required: DataFrame, header: str, valid: DataFrame | None = None) -> DataFrame:
    """(rule, severity, n, examples) of the rules that are broken.

    lines: (nth, line) of a file, nth from 0, the header first. required: the ids (column id) that need a row each. valid: the ids
    that lists may hold, if they are to be checked.
    """
    head = lines.where("nth = 0")
    body = lines.where("nth > 0").withColumn("at_", F.instr("line", "\t"))
    rows = body.where("at_ > 0").select("nth", F.trim(F.substr("line", F.lit(1), F.col("at_") - 1)).alias("s"), F.substr("line", F.col("at_") + 1, F.length("line")).alias("ids"))
    ids = rows.select("nth", "s", F.explode(F.filter(F.transform(F.split("ids", ","), lambda x: F.trim(x)), lambda x: x != "")).alias("id"))
    rules = [
        ("header", head.where(F.col("line") != header).select(F.col("line").alias("x"))),
        ("no tab", body.where("at_ = 0").select(F.col("line").alias("x"))),
        ("duplicate row", rows.groupBy("s").count().where("count > 1").select(F.col("s").alias("x"))),
        ("duplicate id", ids.groupBy("nth", "s", "id").count().where("count > 1").select(F.concat("s", F.lit(":"), "id").alias("x"))),
        ("own source", ids.where(F.col("id").startswith("S1-")).select(F.concat("s", F.lit(":"), "id").alias("x"))),
        ("bad prefix", ids.where(~F.col("id").rlike("^S[123]-")).select(F.concat("s", F.lit(":"), "id").alias("x"))),
        ("missing row", required.select(F.col("id").alias("x")).join(rows.select(F.col("s").alias("x")), "x", "left_anti")),
        ("extra row", rows.select(F.col("s").alias("x")).distinct().join(required.select(F.col("id").alias("x")), "x", "left_anti")),
    ]
    if valid is not None:
        rules.append(("unknown id", ids.where(F.col("id").rlike("^S[23]-")).select(F.col("id").alias("x")).distinct().join(valid.select(F.col("id").alias("x")), "x", "left_anti")))
    found = reduce(DataFrame.unionByName, [df.select(F.lit(rule).alias("rule"), "x") for rule, df in rules])
    return summary(found, "error")


def summary(found: DataFrame, severity: str) -> DataFrame:
    """Findings (rule, x) by rule; the examples are the lowest distinct ones. Numbers are summed before the shuffle; examples
    are ranked in PARTS parts of a rule first, so no task sorts all findings of one."""
    total = found.groupBy("rule").agg(F.count("*").alias("n"))
    rank = lambda *by: F.row_number().over(Window.partitionBy("rule", *by).orderBy("x"))
    some = found.distinct().withColumn("part_", F.pmod(F.xxhash64("x"), F.lit(PARTS))).withColumn("rn_", rank("part_")).where(F.col("rn_") <= EXAMPLES)
    some = some.withColumn("rn_", rank()).where(F.col("rn_") <= EXAMPLES)
    examples = some.groupBy("rule").agg(F.array_join(F.array_sort(F.collect_list("x")), " ").alias("examples"))
    return total.join(examples, "rule").select("rule", F.lit(severity).alias("severity"), "n", "examples")


def not_candidates(matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """A warning for matches (s_id, q_id) that aren't among the candidates."""
    lost = matches.select("s_id", "q_id").join(candidates.select("s_id", "q_id"), ["s_id", "q_id"], "left_anti")
    return summary(lost.select(F.lit("not a candidate").alias("rule"), F.concat("s_id", F.lit(":"), "q_id").alias("x")), "warning")
