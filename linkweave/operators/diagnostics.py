"""Where matches are lost, how outputs differ, and what a denser test split would do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import edit_kind
from ..functions.text import first_number
from .blocking import top_k
from .features import with_context
from .metrics import fbeta_by_entity


def dropped(number: Column, percent: int, seed: int = 0) -> Column:
    """Whether a canonical record is left out: a fixed choice by its number."""
    return F.pmod(number + F.lit(seed), F.lit(100)) < percent


def drop_entities(candidates: DataFrame, truth: DataFrame, gone: DataFrame, k_use: int = 3) -> tuple[DataFrame, DataFrame]:
    """(candidates ranked again with their context, truth) after the canonical records ``gone`` (s1_id) have left."""
    left = candidates.select("q_id", "s1_id", "score").join(gone, "s1_id", "left_anti")
    without = truth.join(gone.select(F.col("s1_id").alias("true_s1_id"), F.lit(True).alias("_gone")), "true_s1_id", "left")
    without = without.select("q_id", F.when(F.col("_gone").isNull(), F.col("true_s1_id")).alias("true_s1_id"))
    return with_context(top_k(left, k_use)), without


def loss_oracles(assigned: DataFrame, candidates: DataFrame, truth: DataFrame, s1: DataFrame) -> DataFrame:
    """(oracle, f): macro F as it is, without false merges, with all true pairs in the candidates, with both, and perfect."""
    reach = candidates.select("q_id", F.col("s1_id").alias("true_s1_id"), F.lit(True).alias("inside")).distinct()
    rows = truth.join(assigned.select("q_id", "s1_id"), "q_id", "full").join(reach, ["q_id", "true_s1_id"], "left")
    right = F.col("s1_id") == F.col("true_s1_id")
    kept = F.when(right, F.col("s1_id"))
    found = F.when(F.col("inside"), F.col("true_s1_id"))
    ways = {
        "as it is": F.col("s1_id"),
        "no false merges": kept,
        "accept candidates": F.coalesce(found, F.col("s1_id")),
        "perfect matcher": F.coalesce(found, kept),
        "perfect": F.col("true_s1_id"),
    }
    # Every way of a query in one pass: a union would plan and run the candidates once for each way.
    each = rows.select("q_id", F.explode(F.array(*(F.struct(F.lit(name).alias("oracle"), way.alias("s1_id")) for name, way in ways.items()))).alias("way")).select("q_id", "way.*")
    grid = s1.select(F.col("id").alias("s1_id")).withColumn("oracle", F.explode(F.array(*map(F.lit, ways))))
    return fbeta_by_entity(each.where("s1_id IS NOT NULL"), truth, grid, by=["oracle"]).groupBy("oracle").agg(F.avg("f").alias("f"))


def error_kinds(assigned: DataFrame, candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """(error, n): blocked out, rejected inside the candidates, distractor merged, wrong record."""
    reach = candidates.select("q_id", F.col("s1_id").alias("true_s1_id"), F.lit(True).alias("inside")).distinct()
    rows = truth.join(assigned.select("q_id", "s1_id"), "q_id", "left").join(reach, ["q_id", "true_s1_id"], "left")
    true, got = F.col("true_s1_id").isNotNull(), F.col("s1_id").isNotNull()
    kind = (
        F.when(true & F.col("inside").isNull(), "blocked out").when(true & ~got, "rejected")
        .when(~true & got, "distractor merged").when(true & (F.col("s1_id") != F.col("true_s1_id")), "wrong record")
    )
    return rows.select(kind.alias("error")).where("error IS NOT NULL").groupBy("error").agg(F.count("*").alias("n"))


def diff_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """(side, q_id, s1_id): pairs that only one of two outputs has."""
    one = lambda x, y, name: x.select("q_id", "s1_id").subtract(y.select("q_id", "s1_id")).withColumn("side", F.lit(name))
    return one(a, b, "a").unionByName(one(b, a, "b"))


def profile(pairs: DataFrame, s1: DataFrame, q: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Size of a set of pairs, with the shares of differing numbers, equal names and siblings."""
    by = by or []
    left = q.select(F.col("id").alias("q_id"), first_number(F.col("a_nums")).alias("a"), F.col("n_core").alias("qn"))
    right = s1.select(F.col("id").alias("s1_id"), first_number(F.col("a_nums")).alias("b"), F.col("n_core").alias("sn"))
    rows = pairs.join(left, "q_id").join(right, "s1_id")
    both = (F.col("a") != "") & (F.col("b") != "")
    differ, same = (both & (F.col("a") != F.col("b"))).cast("double"), (F.col("qn") == F.col("sn")).cast("double")
    return rows.groupBy(*by).agg(F.count("*").alias("n"), (F.sum(differ) / F.sum(both.cast("double"))).alias("num_mismatch"), F.avg(same).alias("same_name"), F.avg(differ * same).alias("sibling_like"))


def edit_kinds(pairs: DataFrame, s1: DataFrame, q: DataFrame, substrings: bool = True) -> DataFrame:
    """Pairs with kind and gap of their first numbers."""
    left = q.select(F.col("id").alias("q_id"), first_number(F.col("a_nums")).alias("a"))
    right = s1.select(F.col("id").alias("s1_id"), first_number(F.col("a_nums")).alias("b"))
    rows = pairs.join(left, "q_id").join(right, "s1_id")
    gap = F.abs(F.left("a", F.lit(15)).cast("bigint") - F.left("b", F.lit(15)).cast("bigint"))
    return rows.withColumn("kind", edit_kind(F.col("a"), F.col("b"), substrings)).withColumn("gap", gap)


def gap_bin(gap: Column, edges: tuple[int, ...] = (0, 2, 5, 10, 20, 50, 100, 1_000_000_000)) -> Column:
    """The right-closed bin of a gap, by its upper edge; a gap of 0 has none."""
    out = F.lit(None).cast("bigint")
    for low, high in reversed(list(zip(edges, edges[1:]))):
        out = F.when((gap > low) & (gap <= high), F.lit(high)).otherwise(out)
    return out


def capped_histogram(counts: DataFrame, column: str, cap: int = 12) -> DataFrame:
    """(bin, n): how many rows have each value; larger ones count as ``cap``."""
    return counts.groupBy(F.least(F.col(column), F.lit(cap)).alias("bin")).agg(F.count("*").alias("n"))


def value_shares(rows: DataFrame, column: str) -> DataFrame:
    """(value, n, share)."""
    n = rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    total = rows.agg(F.count("*").alias("total"))
    return n.crossJoin(F.broadcast(total)).select("value", "n", (F.col("n") / F.col("total")).alias("share"))  # one row beside each


def crosstab(rows: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """Counts of each row value, a column for each of ``values``; 0 where there are none."""
    return rows.groupBy(row).pivot(column, values).count().na.fill(0)
