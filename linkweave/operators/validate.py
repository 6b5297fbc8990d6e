"""Checks of the two output tables; every problem is a row (check, id, detail)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MATCHED, CANDIDATES = ["source1_entity_id", "matched_entity_ids"], ["source1_entity_id", "candidate_entity_ids"]


def _exploded(lists: DataFrame) -> DataFrame:
    key, ids = lists.columns
    return lists.select(F.col(key).alias("s1_id"), F.explode(F.split(F.coalesce(ids, F.lit("")), ",")).alias("id")).where("id <> ''")


def _issue(rows: DataFrame, check: str, key: str, detail=None) -> DataFrame:
    return rows.select(F.lit(check).alias("check"), F.col(key).cast("string").alias("id"), (F.lit("") if detail is None else detail.cast("string")).alias("detail"))


def validate(matching: DataFrame, candidates: DataFrame, s1: DataFrame, q: DataFrame, check_ids: bool = True) -> DataFrame:
    """Headers, ids, duplicates, coverage of the canonical records, matches within candidates, one record for each query."""
    parts, spark = [], matching.sparkSession
    for name, lists, header in (("matching", matching, MATCHED), ("candidates", candidates, CANDIDATES)):
        if lists.columns != header:
            parts.append(spark.createDataFrame([(f"{name} header", ",".join(lists.columns), ",".join(header))], "check string, id string, detail string"))
            if len(lists.columns) != 2:
                return parts[0]
        key = lists.columns[0]
        rows = lists.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
        parts.append(_issue(rows, f"{name} duplicate row", key, F.col("n")))
        known = s1.select(F.col("id").alias(key))
        parts.append(_issue(known.join(lists.select(key), key, "left_anti"), f"{name} missing record", key))
        parts.append(_issue(lists.select(key).distinct().join(known, key, "left_anti"), f"{name} unknown record", key))
        ids = _exploded(lists)
        twice = ids.groupBy("s1_id", "id").agg(F.count("*").alias("n")).where("n > 1")
        parts.append(_issue(twice, f"{name} duplicate id", "s1_id", F.col("id")))
        if check_ids:
            parts.append(_issue(ids.where("NOT (startswith(id, 'S2-') OR startswith(id, 'S3-'))"), f"{name} id prefix", "s1_id", F.col("id")))
            parts.append(_issue(ids.join(q.select("id"), "id", "left_anti"), f"{name} unknown id", "s1_id", F.col("id")))
    matched = _exploded(matching)
    parts.append(_issue(matched.distinct().join(_exploded(candidates), ["s1_id", "id"], "left_anti"), "match not a candidate", "s1_id", F.col("id")))
    shared = matched.groupBy("id").agg(F.count_distinct("s1_id").alias("n")).where("n > 1")
    parts.append(_issue(shared, "id in several records", "id", F.col("n")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
