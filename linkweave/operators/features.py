"""Features of candidate pairs: pair similarity, and the competition among candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import similarity

RECORD = ("n_core", "n_full", "n_alias", "n_nospace", "n_skel", "a_norm", "a_words", "a_nums", "is_web", "has_alias")


def attach(candidates: DataFrame, s1: DataFrame, q: DataFrame, columns: tuple[str, ...] = RECORD) -> DataFrame:
    """Record columns beside each pair, prefixed q_ and s_; equi-joins that Spark broadcasts only if a side is small."""
    left = q.select(F.col("id").alias("q_id"), *(F.col(c).alias(f"q_{c}") for c in columns))
    right = s1.select(F.col("id").alias("s1_id"), *(F.col(c).alias(f"s_{c}") for c in columns))
    return candidates.join(left, "q_id").join(right, "s1_id")


def native_features(pairs: DataFrame) -> DataFrame:
    """Set, number and flag features beside the pair columns; the record columns go."""
    made = similarity.name_features() | similarity.number_features() | similarity.address_features() | similarity.flag_features()
    attached = {f"{side}_{c}" for side in "qs" for c in RECORD}
    held = [c for c in pairs.columns if c not in attached]
    return pairs.select(*held, *(v.alias(k) for k, v in made.items()))


def pair_features(candidates: DataFrame, s1: DataFrame, q: DataFrame) -> DataFrame:
    """All 35 pair features; the fuzzy ones come from one Arrow function."""
    made = similarity.name_features() | similarity.number_features() | similarity.address_features() | similarity.flag_features()
    pairs = attach(candidates, s1, q).withColumn("_fuzzy", similarity.fuzzy())
    return pairs.select(*candidates.columns, "_fuzzy.*", *(v.alias(k) for k, v in made.items()))


def with_context(candidates: DataFrame) -> DataFrame:
    """How a candidate compares with its query's others, and how crowded its canonical record is."""
    by_q, by_s = Window.partitionBy("q_id"), Window.partitionBy("s1_id")
    top = F.max("score").over(by_q)
    second = F.coalesce(F.max(F.when(F.col("rank") == 1, F.col("score"))).over(by_q), F.lit(0.0))
    first = (F.col("rank") == 0).cast("long")
    return candidates.withColumns({"blk_margin": F.col("score") - top, "q_ncand": F.count("*").over(by_q), "blk_gap12": top - second}).withColumns(
        {"s1_ncand": F.count("*").over(by_s), "s1_rank0_cnt": F.sum(first).over(by_s), "blk_score": F.col("score"), "blk_rank": F.col("rank")}
    )


def uncertain(scored: DataFrame, s1: DataFrame, q: DataFrame, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """Pairs between two probabilities as texts "name | address"; costly scorers only see these."""
    text = lambda df, key, to: df.select(F.col("id").alias(key), F.concat_ws(" | ", F.coalesce("raw_name", F.lit("")), F.coalesce("raw_addr", F.lit(""))).alias(to))
    return scored.where((F.col("p") > low) & (F.col("p") < high)).join(text(q, "q_id", "a"), "q_id").join(text(s1, "s1_id", "b"), "s1_id")
