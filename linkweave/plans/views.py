"""Record-linkage views over the driver's tables: parts as records, embeddings as vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize_records, skeletons, words


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part as a normalised record: its type is the country, its size the number, its brand the address word."""
    name = F.lower("p_name")
    brand = F.regexp_replace(F.lower("p_brand"), "[^a-z0-9]", "")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("long").alias("id"),
        F.col("p_type").alias("country"),
        name.alias("n_core"),
        name.alias("n_full"),
        F.array(name).alias("n_alias"),
        F.array(F.replace(name, F.lit(" "), F.lit(""))).alias("n_nospace"),
        F.array_join(skeletons(words(name)), " ").alias("n_skel"),
        F.concat_ws(" ", F.col("p_size").cast("string"), brand).alias("a_norm"),
        F.array(F.col("p_size").cast("string")).alias("a_nums"),
        F.array(brand).alias("a_words"),
        F.lit(0).alias("is_web"),
        F.lit(0).alias("has_alias"),
        F.col("p_name").alias("raw_name"),
        F.col("p_brand").alias("raw_addr"),
    )


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(canonical records, queries)."""
    rec = records(spark, sf_dir)
    return rec.where("id % 4 = 0"), rec.where("id % 4 <> 0")


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part as a raw record (entity_id, business_name, business_address, country): legal forms, aliases, web names, streets, states."""
    name = """CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN concat(upper(p_name), ', Inc.')
        WHEN 2 THEN concat('Holding ', p_type, ' dba ', p_name) WHEN 3 THEN concat('The ', p_name, ' Services & Co')
        ELSE concat('www.', replace(p_name, ' ', ''), '.com') END"""
    address = """CASE WHEN p_partkey % 7 = 0 THEN '' ELSE concat(p_size, ' ', p_type, ' Street, ', p_partkey % 90, ' ', replace(p_brand, '#', ' '), ' Road, ',
        CASE p_partkey % 3 WHEN 0 THEN 'New York' WHEN 1 THEN 'Tamil Nadu' ELSE 'Lyon' END) END"""
    source = "CASE WHEN p_partkey % 4 = 0 THEN 'S1-' WHEN p_partkey % 2 = 1 THEN 'S2-' ELSE 'S3-' END"
    return table(spark, sf_dir, "part").selectExpr(f"concat({source}, p_partkey) AS entity_id", f"{name} AS business_name", f"{address} AS business_address", "p_type AS country")


def from_raw(raw: DataFrame) -> DataFrame:
    """Normalised records of raw ones, with the names that blocking and features read."""
    rows = normalize_records(raw, exotic=True)
    return rows.withColumnsRenamed({"entity_id": "id", "business_name": "raw_name", "business_address": "raw_addr"})


def raw_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``truth`` with the ids of the raw records."""
    found = truth(*sides(spark, sf_dir)).where("true_s1_id IS NOT NULL")
    return found.selectExpr("concat(IF(q_id % 2 = 1, 'S2-', 'S3-'), q_id) AS q_id", "concat('S1-', true_s1_id) AS true_s1_id")


def truth(s1: DataFrame, q: DataFrame) -> DataFrame:
    """(q_id, true_s1_id) of every query: the smallest canonical record with its country and name and a size at most 5 away."""
    left = q.select(F.col("id").alias("q_id"), "country", "n_core", F.col("a_nums")[0].cast("int").alias("size"))
    right = s1.select(F.col("id").alias("s1_id"), "country", "n_core", F.col("a_nums")[0].cast("int").alias("s_size"))
    # One row for each size of a name keeps the join's output small, however many records share a name.
    right = right.groupBy("country", "n_core", "s_size").agg(F.min("s1_id").alias("s1_id"))
    near = left.join(right, ["country", "n_core"]).where("abs(size - s_size) <= 5").groupBy("q_id").agg(F.min("s1_id").alias("true_s1_id"))
    return left.select("q_id").join(near, "q_id", "left")


def vectors(spark: SparkSession, sf_dir: str, modulus: int = 5, by_label: bool = False) -> tuple[DataFrame, DataFrame]:
    """(canonical vectors, query vectors), in one group or by label."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), (F.col("label") if by_label else F.lit(0)).alias("group"), F.col("embedding").alias("vec"))
    return rows.where(f"id % {modulus} = 0"), rows.where(f"id % {modulus} <> 0")
