"""Precision-weighted macro F, recall, and the area under the ROC curve."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def f_score(pred: Column, true: Column, hit: Column, beta: float = 0.5) -> Column:
    """F of one entity: 1 if nothing is predicted and nothing true, 0 without a hit."""
    b2 = beta * beta
    precision, recall = hit / pred, hit / true
    f = (1 + b2) * precision * recall / (b2 * precision + recall)
    return F.when((pred == 0) & (true == 0), 1.0).when(hit == 0, 0.0).otherwise(f)


def fbeta_by_entity(assigned: DataFrame, truth: DataFrame, s1: DataFrame, beta: float = 0.5, by: list[str] | None = None) -> DataFrame:
    """(s1_id, n_pred, n_true, n_hit, f) for every row of ``s1``; ``by`` names further keys that s1 and assigned share."""
    by = by or []
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    judged = assigned.join(truth.select("q_id", "true_s1_id"), "q_id", "left")
    pred = judged.groupBy("s1_id", *by).agg(F.count("*").alias("n_pred"), F.sum((F.col("s1_id") == F.col("true_s1_id")).cast("long")).alias("n_hit"))
    true = truth.where("true_s1_id IS NOT NULL").groupBy(F.col("true_s1_id").alias("s1_id")).agg(F.count("*").alias("n_true"))
    all_ = s1.join(pred, ["s1_id", *by], "left").join(true, "s1_id", "left")
    all_ = all_.withColumns({c: zero(c) for c in ("n_pred", "n_true", "n_hit")})
    return all_.withColumn("f", f_score(F.col("n_pred"), F.col("n_true"), F.col("n_hit"), beta))


def fbeta(assigned: DataFrame, truth: DataFrame, s1: DataFrame, beta: float = 0.5) -> DataFrame:
    """Macro F over all canonical records, matched or not."""
    return fbeta_by_entity(assigned, truth, s1.select(F.col("id").alias("s1_id")), beta).agg(F.avg("f").alias("f"), F.count("*").alias("n"))


def fbeta_by_country(assigned: DataFrame, truth: DataFrame, s1: DataFrame, beta: float = 0.5) -> DataFrame:
    rows = s1.select(F.col("id").alias("s1_id"), "country")
    return fbeta_by_entity(assigned, truth, rows, beta).groupBy("country").agg(F.avg("f").alias("f"), F.count("*").alias("n"))


def fbeta_of_sets(sets: DataFrame, beta: float = 0.5) -> DataFrame:
    """The same measure over rows of two arrays, pred and true."""
    pred, true = F.array_distinct("pred"), F.array_distinct("true")
    return sets.agg(F.avg(f_score(F.size(pred), F.size(true), F.size(F.array_intersect(pred, true)), beta)).alias("f"))


def match_density(assigned: DataFrame, s1: DataFrame) -> DataFrame:
    """(country, mean_matches, empty_share): matches for each canonical record."""
    n = s1.select(F.col("id").alias("s1_id"), "country").join(assigned.groupBy("s1_id").agg(F.count("*").alias("n")), "s1_id", "left")
    return n.groupBy("country").agg(F.avg(F.coalesce("n", F.lit(0))).alias("mean_matches"), F.avg(F.col("n").isNull().cast("double")).alias("empty_share"))


def roc_auc(scored: DataFrame, label: str = "label", score: str = "score", buckets: int = 256) -> DataFrame:
    """Area by rank sums, ties at their mean rank.

    Counts for each score come first, so the running sum is over different scores, in buckets between fixed scores: a
    score's bucket depends on the score alone, whatever is run again. Offsets of the buckets are summed apart, so no task
    holds all scores.
    """
    per = scored.groupBy(score).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.count("*").alias("n"))
    shares = [i / buckets for i in range(1, buckets)] or [0.5]
    cuts = scored.agg(F.percentile_approx(F.col(score).cast("double"), shares, 10_000).alias("c")).first()["c"] or []  # `buckets` numbers
    above = F.array(*map(F.lit, sorted(set(cuts)))) if cuts else F.array().cast("array<double>")
    parts = per.withColumn("_part", F.size(F.filter(above, lambda c: c < F.col(score))))
    inside = Window.partitionBy("_part").orderBy(score)
    below = parts.withColumn("_below", F.sum("n").over(inside) - F.col("n"))
    sizes = parts.groupBy("_part").agg(F.sum("n").alias("_n"))  # a row for each bucket
    offsets = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    ranked = below.join(offsets, "_part").withColumn("rank", F.col("_before") + F.col("_below") + (F.col("n") + 1) / 2)
    sums = ranked.agg(F.sum(F.col("pos") * F.col("rank")).alias("r"), F.sum("pos").alias("p"), F.sum(F.col("n") - F.col("pos")).alias("q"))
    return sums.select(((F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("q"))).alias("auc"), F.col("p").alias("positives"), F.col("q").alias("negatives"))


def recall_ceiling(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """(positive_rate, recall): true pairs among the candidates."""
    hits = candidates.join(truth, "q_id", "left").agg(F.sum(F.coalesce((F.col("s1_id") == F.col("true_s1_id")).cast("long"), F.lit(0))).alias("hit"), F.count("*").alias("n"))
    matched = truth.agg(F.count("true_s1_id").alias("matched"))
    return hits.crossJoin(F.broadcast(matched)).select((F.col("hit") / F.col("n")).alias("positive_rate"), (F.col("hit") / F.col("matched")).alias("recall"))  # one row each
