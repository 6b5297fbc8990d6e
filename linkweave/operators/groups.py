"""Group features: what the other claims on the same canonical record look like."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed


def group_features(scored: DataFrame, s1: DataFrame, q: DataFrame) -> DataFrame:
    """Eighteen features of each pair (q_id, s1_id, p).

    A claim weighs its p if it is its query's best, else 0. For house number and name: how much of the record's claims agree with
    this query's value, and with the record's own; empty values agree with nothing on the other side.
    """
    by_q, by_s = Window.partitionBy("q_id"), Window.partitionBy("s1_id")
    order = by_q.orderBy(F.desc("p"), "s1_id")
    first = lambda c: F.coalesce(F.get(F.col(c), F.lit(0)), F.lit(""))
    value = lambda c, mark: F.when(c == "", mark).otherwise(c)
    left = q.select(F.col("id").alias("q_id"), value(first("a_nums"), "<e>q").alias("q_num"), value(F.col("n_core"), "<e>q").alias("q_name"))
    right = s1.select(F.col("id").alias("s1_id"), value(first("a_nums"), "<e>s").alias("s_num"), value(F.col("n_core"), "<e>s").alias("s_name"))
    rows = scored.select("q_id", "s1_id", F.col("p").alias("p1")).withColumn("p", F.col("p1"))
    rows = rows.withColumns({"_place": F.row_number().over(order), "_top": F.max("p").over(by_q)})
    second = F.coalesce(F.max(F.when(F.col("_place") == 2, F.col("p"))).over(by_q), F.lit(0.0))
    best = F.col("_place") == 1
    rows = rows.withColumns({
        "p1_gap_best": F.col("_top") - F.col("p"),
        "p1_is_best": best.cast("int"),
        "p1_second_q": F.when(best, second).otherwise(F.col("_top")),
        "w": F.when(best, F.col("p")).otherwise(0.0),
    }).drop("_place", "_top")
    claim = (F.col("w") > 0.5).cast("int")
    rows = rows.withColumns({
        "g_psum_other": F.sum("w").over(by_s) - F.col("w"),
        "g_n_claim": F.sum(claim).over(by_s) - claim,
        "g_n": F.count("*").over(by_s),
        "g_rank": F.row_number().over(by_s.orderBy(F.desc("w"), "q_id")),
    })
    rows = rows.join(left, "q_id").join(right, "s1_id")
    for tag in ("num", "name"):
        mine, own = F.col(f"q_{tag}"), F.col(f"s_{tag}")
        same = (mine == own).cast("int")
        mate = Window.partitionBy("s1_id", f"q_{tag}")
        # The record's own value: claims that agree with it, summed over the record's partition.
        rows = rows.withColumns({
            f"g_{tag}_me_w": F.sum("w").over(mate) - F.col("w"),
            f"g_{tag}_s1_w": F.sum(F.when(mine == own, F.col("w")).otherwise(0.0)).over(by_s) - F.when(mine == own, F.col("w")).otherwise(0.0),
            f"g_{tag}_me_n": F.count("*").over(mate) - 1,
            f"g_{tag}_s1_n": F.sum(same).over(by_s) - same,
            f"g_{tag}_eq": same,
        })
    return rows.drop("p", "w", "q_num", "q_name", "s_num", "s_name")


def robust(features: DataFrame) -> DataFrame:
    """Without the features that rest on a record's own support: twelve remain."""
    return features.drop(*fixed.SELF_SUPPORT)
