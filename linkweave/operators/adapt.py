"""Adapting scores and matches to a test split whose mix differs from training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import first_number, words


def sibling_group(q: str = "q_", s: str = "s_") -> Column:
    """0: numbers differ, same core name; 1: numbers differ, other name; null: else."""
    a, b = first_number(F.col(f"{q}a_nums")), first_number(F.col(f"{s}a_nums"))
    differ = (a != "") & (b != "") & (a != b)
    return F.when(differ & (F.col(f"{q}n_core") == F.col(f"{s}n_core")), 0).when(differ, 1)


def sibling_weights(train: DataFrame, test: DataFrame, n_train: DataFrame, n_test: DataFrame) -> DataFrame:
    """(grp, n_tr, pos_tr, n_te, pi_tr, pi_te, weight) over first-ranked pairs with a column grp; train has label.

    The true matches for each canonical record are taken as unchanged. Empty groups, and priors of 0 or 1, have weight 1.
    """
    tr = train.where("rank = 0 AND grp IS NOT NULL").groupBy("grp").agg(F.count("*").alias("n_tr"), F.sum("label").alias("pos_tr"))
    te = test.where("rank = 0 AND grp IS NOT NULL").groupBy("grp").agg(F.count("*").alias("n_te"))
    sizes = n_train.agg(F.count("*").alias("s_tr")).crossJoin(n_test.agg(F.count("*").alias("s_te")))  # one row
    both = tr.join(te, "grp", "full").na.fill(0, ["n_tr", "pos_tr", "n_te"]).crossJoin(F.broadcast(sizes))
    pi_tr = F.when(F.col("n_tr") > 0, F.col("pos_tr") / F.col("n_tr")).otherwise(0.0)
    pi_te = F.when(F.col("n_te") > 0, F.least(F.col("pos_tr") * F.col("s_te") / F.col("s_tr") / F.col("n_te"), F.col("pi_tr"))).otherwise(F.col("pi_tr"))
    both = both.withColumn("pi_tr", pi_tr).withColumn("pi_te", pi_te)
    sound = (F.col("pi_tr") > 0) & (F.col("pi_tr") < 1) & (F.col("pi_te") < 1)
    odds = lambda p: p / (1 - p)
    return both.withColumn("weight", F.when(sound, odds(F.col("pi_te")) / odds(F.col("pi_tr"))).otherwise(1.0)).drop("s_tr", "s_te")


def shift_prior(scored: DataFrame, weights: DataFrame) -> DataFrame:
    """p with the odds of sibling pairs multiplied by their group's weight."""
    two = F.broadcast(weights.select("grp", "weight"))  # one row for each of two groups
    odds = F.col("p") / F.greatest(1 - F.col("p"), F.lit(1e-6)) * F.coalesce("weight", F.lit(1.0))
    return scored.join(two, "grp", "left").withColumn("p", odds / (1 + odds)).drop("weight")


def coverage(q: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(country, coverage, n): share of a country's name words, longer than one character, that the vocabulary (word) has."""
    tokens = q.select("country", F.explode(words(F.col("n_full"))).alias("word")).where(F.length("word") > 1)
    counts = tokens.groupBy("country", "word").agg(F.count("*").alias("n"))
    known = counts.join(vocabulary.select("word", F.lit(1).alias("known")).distinct(), "word", "left")
    return known.groupBy("country").agg((F.sum(F.when(F.col("known") == 1, F.col("n")).otherwise(0)) / F.sum("n")).alias("coverage"), F.sum("n").alias("n"))


def low_coverage(covered: DataFrame, least: float = 0.8) -> DataFrame:
    return covered.where(F.col("coverage") < least).select("country")


def restore_exact(base: DataFrame, fallback: DataFrame, s1: DataFrame, q: DataFrame, low: DataFrame) -> DataFrame:
    """base with pairs of the fallback in low-coverage countries whose core name and first number are equal.

    A query that the base has assigned keeps its assignment.
    """
    s = s1.join(low, "country", "left_semi").select(F.col("id").alias("s1_id"), F.col("n_core").alias("s_core"), first_number(F.col("a_nums")).alias("s_num"))
    r = q.select(F.col("id").alias("q_id"), F.col("n_core").alias("q_core"), first_number(F.col("a_nums")).alias("q_num"))
    new = fallback.select("q_id", "s1_id").join(base.select("q_id", "s1_id"), ["q_id", "s1_id"], "left_anti")
    new = new.join(base.select("q_id"), "q_id", "left_anti").join(s, "s1_id").join(r, "q_id")
    same = (F.col("s_core") == F.col("q_core")) & (F.col("s_num") == F.col("q_num")) & (F.col("q_num") != "")
    return base.select("q_id", "s1_id").unionByName(new.where(same).select("q_id", "s1_id"))


def route(high: DataFrame, low_: DataFrame, s1: DataFrame, low: DataFrame) -> DataFrame:
    """(s1_id, ids): each canonical record's list from the model for its country's coverage."""
    country = s1.select(F.col("id").alias("s1_id"), "country").join(low.withColumn("is_low", F.lit(True)), "country", "left")
    both = country.join(high.withColumnRenamed("ids", "high"), "s1_id", "left").join(low_.withColumnRenamed("ids", "low"), "s1_id", "left")
    return both.select("s1_id", F.coalesce(F.when(F.col("is_low"), F.col("low")).otherwise(F.col("high")), F.lit("")).alias("ids"))
