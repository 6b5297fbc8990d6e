"""Readers and writers of record tables, ground truth and list files; explicit schemas, no inference."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import fixed


def schema_of(*columns: str) -> StructType:
    """Columns of text."""
    return StructType([StructField(c, StringType()) for c in columns])


RAW = schema_of("entity_id", "business_name", "business_address", "country")
TRUTH = schema_of("source1_entity_id", "matched_entity_ids")


def read_tsv(spark: SparkSession, path: str, schema: StructType = RAW) -> DataFrame:
    """All columns as text; quotes are literal and empty fields are empty texts."""
    frame = spark.read.schema(schema).option("sep", "\t").option("header", True).option("quote", "").option("mode", "PERMISSIVE").csv(path)
    return frame.na.fill("")


def write_tsv(frame: DataFrame, path: str) -> None:
    frame.write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", "").option("emptyValue", "").csv(path)


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    frame = spark.read.parquet(path)
    return frame.select(*columns) if columns else frame


def union_sources(*sources: DataFrame) -> DataFrame:
    """All queries as one table."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s)
    return out


def explode_lists(lists: DataFrame) -> DataFrame:
    """(s1_id, q_id) from a table of a record id and a comma-joined list."""
    key, ids = lists.columns[:2]
    return lists.where(F.col(ids) != "").select(F.col(key).alias("s1_id"), F.explode(F.split(ids, ",")).alias("q_id"))


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """(q_id, true_s1_id) of matched queries."""
    return explode_lists(read_tsv(spark, path, TRUTH)).select("q_id", F.col("s1_id").alias("true_s1_id"))


def truth_vector(q: DataFrame, pairs: DataFrame) -> DataFrame:
    """(q_id, true_s1_id) of every query, null where it has no record."""
    return q.select(F.col("id").alias("q_id")).join(pairs, "q_id", "left")


def lists(pairs: DataFrame, s1: DataFrame, column: str = "matched_entity_ids") -> DataFrame:
    """A row for every canonical record with its ids joined in order, empty where it has none."""
    joined = pairs.groupBy("s1_id").agg(F.array_join(F.array_sort(F.collect_list(F.col("q_id").cast("string"))), ",").alias(column))
    all_ = s1.select(F.col("id").alias("s1_id")).join(joined, "s1_id", "left")
    return all_.select(F.col("s1_id").alias("source1_entity_id"), F.coalesce(column, F.lit("")).alias(column))


def native_bundle(q: DataFrame, s1: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Queries with a name in an Indic script, and the canonical records of their countries."""
    named = q.where(F.col("raw_name").rlike(fixed.NATIVE))
    return named, s1.join(named.select("country").distinct(), "country", "left_semi")


def input_state(spark: SparkSession, paths: list[str]) -> list[tuple[str, int, int]]:
    """(path, bytes, last change) of every file that ``paths`` are, or hold."""
    found = []
    for path in paths:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(place, True)
        while files.hasNext():
            file = files.next()
            found.append((file.getPath().toString(), file.getLen(), file.getModificationTime()))
    return sorted(found)


def cached(spark: SparkSession, root: str, name: str, settings: dict, build, inputs: list[str] | None = None) -> DataFrame:
    """A written table for a name, its settings and input files; built once, and anew when one of these changes."""
    key = hashlib.sha256(json.dumps([settings, input_state(spark, inputs or [])], sort_keys=True).encode()).hexdigest()[:16]
    path = f"{root}/{name}-{key}"
    file = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(file):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_metadata(spark: SparkSession, path: str, values: dict) -> None:
    """A JSON sidecar of thresholds, settings and feature order."""
    spark.createDataFrame([(json.dumps(values, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_metadata(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])


def copy_table(frame: DataFrame, path: str) -> None:
    """Write an unchanged list table beside a derived one."""
    frame.write.mode("overwrite").parquet(path)
