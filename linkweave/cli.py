"""Command lines, for spark-submit or ``python -m linkweave.cli``.

normalize   raw records (tab-separated) to normalised records (Parquet)
block       normalised records to candidates with their blocking report
train       normalised records, truth and neighbours to models and rules
predict     normalised records and a trained folder to both output tables
export      records with names in Indic scripts, and the canonical records of their countries
validate    problems of two output tables, a row each; exit status 1 if there are any
score       macro F of an output table
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import blocking, metrics
from .operators.validate import validate
from .plans import train as training
from .plans.views import from_raw
from .session import ship
from .sources import tables


def sides(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(canonical records, queries) of a table of normalised records: ids of the first begin with S1-."""
    rows = tables.read_parquet(spark, path)
    return rows.where("startswith(id, 'S1-')"), rows.where("NOT startswith(id, 'S1-')")


def neighbours(spark: SparkSession, path: str | None) -> DataFrame:
    if path:
        return tables.read_parquet(spark, path, ["q_id", "s1_id", "cos"])
    return spark.createDataFrame([], "q_id string, s1_id string, cos double")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="linkweave", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, *paths: str) -> argparse.ArgumentParser:
        one = commands.add_parser(name)
        for p in paths:
            one.add_argument(f"--{p}", required=True)
        return one

    normalize = command("normalize", "out")
    normalize.add_argument("--raw", required=True, nargs="+")
    block = command("block", "records", "truth", "out")
    train = command("train", "records", "truth", "model")
    predict = command("predict", "records", "model", "out")
    command("export", "records", "out")
    command("validate", "records", "matching", "candidates")
    command("score", "records", "truth", "matching")
    for one in (train, predict):
        one.add_argument("--neighbours")
    for one in (block, train):
        one.add_argument("--k", type=int, default=training.Settings.k)
        one.add_argument("--df-cap", type=int, default=training.Settings.df_cap)
    train.add_argument("--extra", type=int, default=training.Settings.extra)
    train.add_argument("--rounds", type=int, default=training.Settings.rounds)
    train.add_argument("--number", default="CAST(regexp_extract(s1_id, '([0-9]+)$', 1) AS BIGINT)", help="SQL for the number of a canonical record")
    predict.add_argument("--threshold", type=float)
    return top


def run(spark: SparkSession, arguments: list[str]) -> int:
    a = parser().parse_args(arguments)
    if a.command == "normalize":
        from_raw(tables.union_sources(*(tables.read_tsv(spark, p) for p in a.raw))).write.mode("overwrite").parquet(a.out)
        return 0
    s1, q = sides(spark, a.records)
    if a.command == "block":
        found = blocking.block(s1, q, a.k, a.df_cap)
        found.write.mode("overwrite").parquet(f"{a.out}/candidates")
        truth = tables.truth_vector(q, tables.read_truth(spark, a.truth))
        blocking.BlockingReport(a.k)(spark.read.parquet(f"{a.out}/candidates"), truth, s1).orderBy("k").show(a.k)
    elif a.command == "train":
        settings = training.Settings(k=a.k, df_cap=a.df_cap, extra=a.extra, rounds=a.rounds)
        found = training.train(s1, q, tables.read_truth(spark, a.truth), neighbours(spark, a.neighbours), a.number, a.model, settings)
        print(found["rule1"], found["rule2"])
    elif a.command == "predict":
        training.predict(s1, q, neighbours(spark, a.neighbours), a.model, a.out, a.threshold)
    elif a.command == "export":
        for name, rows in zip(("queries", "canonical"), tables.native_bundle(q, s1)):
            rows.write.mode("overwrite").parquet(f"{a.out}/{name}")
    elif a.command == "validate":
        one = lambda path, column: tables.read_tsv(spark, path, tables.schema_of("source1_entity_id", column))
        problems = validate(one(a.matching, "matched_entity_ids"), one(a.candidates, "candidate_entity_ids"), s1, q)
        n = problems.count()
        problems.orderBy("check", "id").show(50, truncate=False)
        return int(n > 0)
    else:
        assigned = tables.read_truth(spark, a.matching).withColumnRenamed("true_s1_id", "s1_id")
        truth = tables.read_truth(spark, a.truth)
        metrics.fbeta(assigned, truth, s1).withColumn("f", F.round("f", 6)).show()
    return 0


def main() -> None:
    spark = SparkSession.builder.appName("linkweave").getOrCreate()
    ship(spark)
    sys.exit(run(spark, sys.argv[1:]))


if __name__ == "__main__":
    main()
