"""python -m tessera COMMAND: the linkage pipelines over tab-separated files.

link    --s1 F --others F [F ...] --gold F --out DIR [--first]   the whole pipeline (--first: of the first generation)
fit     --s1 F --others F [F ...] --gold F --model DIR           fits and saves all models
predict --s1 F --others F [F ...] --model DIR --pairs DIR --out DIR   links records without known owners
recut   --s1 F --model DIR --pairs DIR --out DIR                 decides again from saved pairs, by the tuned rule or
        [--thr P | --floor P --extra N] [--blank COUNTRY,...]    another; none in blank countries
check   --result F --s1 F [--valid F ...] [--candidates F]       findings in a result file
probe   --result F --s1 F --blank COUNTRY,... --out DIR          the result file with the lists of some countries emptied, and how
        [--candidates F]                                         many lines that is; the candidate file goes with it unchanged

fit and predict leave alone what is there already, unless --force is given.
"""

from __future__ import annotations

import argparse
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import report, validate
from tessera.plans import linkage
from tessera.sources import files
from tessera.sources.stage import stages_removed


def raw_records(spark: SparkSession, s1: str, others: list[str]) -> DataFrame:
    """All files as raw records; the source comes from the id's prefix."""
    tables = [files.read_tsv(spark, p) for p in (s1, *files.present(spark, others))]
    rows = reduce(DataFrame.unionByName, tables)
    return rows.select("entity_id", F.substring("entity_id", 1, 2).alias("source"), "country", F.col("business_name").alias("name"), F.col("business_address").alias("address"))


def owners_of(spark: SparkSession, gold: str) -> DataFrame:
    return files.exploded(files.read_tsv(spark, gold, files.GOLD), "source1_entity_id", "matched_entity_ids").select("q_id", "s_id")


def fit(spark: SparkSession, args: argparse.Namespace) -> None:
    if not args.force and files.there(spark, f"{args.model}/meta/_SUCCESS"):  # written last
        print(f"skip: {args.model} is there")
        return
    meta = linkage.fit_v3(raw_records(spark, args.s1, args.others), owners_of(spark, args.gold), args.model)
    print(f"rule {meta['rule']}, F0.5 of tune entities {meta['tune_f05']}, of report entities {meta['report_f05']}")


def predict(spark: SparkSession, args: argparse.Namespace) -> None:
    if not args.force and files.there(spark, f"{args.pairs}/_SUCCESS"):
        print(f"skip: {args.pairs} is there")
    else:
        linkage.predict_v3(raw_records(spark, args.s1, args.others), args.model).write.mode("overwrite").parquet(args.pairs)
    args.thr = args.floor = args.extra = None
    args.blank = ""
    recut(spark, args)


def recut(spark: SparkSession, args: argparse.Namespace) -> None:
    rule = None
    if args.thr is not None:
        rule = {"method": "thr", "thr": args.thr}
    elif args.floor is not None or args.extra is not None:
        rule = {"method": "ef", "floor": 0.05 if args.floor is None else args.floor, "extra": args.extra or 0.0}
    pairs = spark.read.parquet(args.pairs)
    matches = linkage.recut(pairs, linkage.model.load(args.model, [], spark)[1], rule, [c for c in args.blank.split(",") if c])
    files.write_results(spark, files.ids(files.read_tsv(spark, args.s1)), pairs, matches, args.out)


def link(spark: SparkSession, args: argparse.Namespace) -> None:
    records = raw_records(spark, args.s1, args.others)
    owners = owners_of(spark, args.gold)
    run = linkage.run_v1 if args.first else linkage.run_v3
    matches = run(records, owners).withColumn("rank", -F.col("p"))
    lines = files.result_lines(files.ids(records.where("source = 'S1'")), matches)
    files.write_tsv(lines, args.out, ("source1_entity_id", "matched_entity_ids"))


def check(spark: SparkSession, args: argparse.Namespace) -> int:
    """Number of findings; each is printed with its first examples."""
    text = spark.read.text(args.result)
    header = "source1_entity_id\tmatched_entity_ids"
    lines = text.select(F.when(F.col("value") == header, 0).otherwise(1).alias("nth"), F.col("value").alias("line"))
    lines = lines.withColumn("nth", F.when(F.col("nth") > 0, F.monotonically_increasing_id() + 1).otherwise(0))
    valid = reduce(DataFrame.unionByName, [files.ids(files.read_tsv(spark, p)) for p in args.valid]) if args.valid else None
    found = validate.findings(lines, files.ids(files.read_tsv(spark, args.s1)), header, valid).collect()
    if args.candidates:
        lists = lambda path: files.exploded(files.read_tsv(spark, path, files.GOLD).where("source1_entity_id <> 'source1_entity_id'"), "source1_entity_id", "matched_entity_ids")
        found += validate.not_candidates(lists(args.result), lists(args.candidates)).collect()
    for r in found:
        print(f"{r.severity}: {r.rule}: {r.n}: {r.examples}")
    return len(found)


def result_lists(spark: SparkSession, path: str) -> DataFrame:
    """(s_id, ids) of a result or candidate file or folder."""
    rows = files.read_tsv(spark, path, files.GOLD).toDF("s_id", "ids")
    return rows.where(F.col("s_id") != "source1_entity_id")


def probe(spark: SparkSession, args: argparse.Namespace) -> None:
    blank = [c for c in args.blank.split(",") if c]
    s1 = files.read_tsv(spark, args.s1).select(F.col("entity_id").alias("s_id"), "country")
    lines = result_lists(spark, args.result)
    files.write_tsv(report.emptied(lines, s1, blank), f"{args.out}/matching_results.tsv", ("source1_entity_id", "matched_entity_ids"))
    if args.candidates:
        files.write_tsv(result_lists(spark, args.candidates), f"{args.out}/candidate_pairs.tsv", ("source1_entity_id", "candidate_entity_ids"))
    for r in report.probe_counts(lines, s1, blank).orderBy("country").collect():
        print(f"{r.country}: {'blanked' if r.blanked else 'kept'}, {r.entities} entities ({r.share:.4f} of all), {r['rows']} lines with matches")


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tessera", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    a = commands.add_parser("link")
    for name in ("--s1", "--gold", "--out"):
        a.add_argument(name, required=True)
    a.add_argument("--others", nargs="+", required=True)
    a.add_argument("--first", action="store_true")
    options = {
        "fit": ("--s1", "--gold", "--model"), "predict": ("--s1", "--model", "--pairs", "--out"), "recut": ("--s1", "--model", "--pairs", "--out"),
    }
    for command, names in options.items():
        c = commands.add_parser(command)
        for name in names:
            c.add_argument(name, required=True)
        if command == "recut":
            for name in ("--thr", "--floor", "--extra"):
                c.add_argument(name, type=float)
            c.add_argument("--blank", default="")
        else:
            c.add_argument("--others", nargs="+", required=True)
            c.add_argument("--force", action="store_true")
    b = commands.add_parser("check")
    b.add_argument("--candidates")
    b.add_argument("--result", required=True)
    b.add_argument("--s1", required=True)
    b.add_argument("--valid", nargs="*", default=[])
    d = commands.add_parser("probe")
    d.add_argument("--candidates")
    for name in ("--result", "--s1", "--blank", "--out"):
        d.add_argument(name, required=True)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("tessera").getOrCreate()  # master and memory come from spark-submit
    with stages_removed(spark):
        if args.command == "check":
            return int(check(spark, args) > 0)
        {"link": link, "fit": fit, "predict": predict, "recut": recut, "probe": probe}[args.command](spark, args)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
