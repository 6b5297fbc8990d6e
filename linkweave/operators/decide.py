"""From scored pairs to at most one canonical record for each query, and the search for the best rule."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .metrics import fbeta, fbeta_by_entity


def best_candidate(scored: DataFrame) -> DataFrame:
    """The candidate with the highest p of each query; ties go to the smaller s1_id."""
    place = F.row_number().over(Window.partitionBy("q_id").orderBy(F.desc("p"), "s1_id"))
    return scored.withColumn("_place", place).where(F.col("_place") == 1).drop("_place")


def assign(scored: DataFrame, threshold: float) -> DataFrame:
    """(q_id, s1_id, p): the best candidate where p exceeds the threshold."""
    return best_candidate(scored).where(F.col("p") > threshold).select("q_id", "s1_id", "p")


def assign_expected_f(scored: DataFrame, beta: float = 0.5, miss_rate: float = 0.0, min_p: float = 0.05) -> DataFrame:
    """(q_id, s1_id, p): for each canonical record the m best claims that maximise its expected F; the smallest such m.

    Taking none scores the chance that there is no true claim at all.
    """
    b2 = beta * beta
    claims = best_candidate(scored).where(F.col("p") > min_p).select("q_id", "s1_id", "p")
    by_s = Window.partitionBy("s1_id")
    in_order = by_s.orderBy(F.desc("p"), "q_id")
    so_far = F.sum("p").over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    none_true = F.when(F.max("p").over(by_s) >= 1, 0.0).otherwise(F.exp(F.sum(F.when(F.col("p") < 1, F.log(1 - F.col("p")))).over(by_s)))
    claims = claims.withColumns({"m": F.row_number().over(in_order), "_true": F.sum("p").over(by_s) + miss_rate, "_sum": so_far, "_none": none_true * F.exp(F.lit(-miss_rate))})
    claims = claims.withColumn("f", F.round((1 + b2) * F.col("_sum") / (b2 * F.col("_true") + F.col("m")), 12))
    chosen = claims.withColumn("_best", F.max("f").over(by_s)).withColumn("_take", F.min(F.when(F.col("f") == F.col("_best"), F.col("m"))).over(by_s))
    return chosen.where((F.col("_best") > F.round("_none", 12)) & (F.col("m") <= F.col("_take"))).select("q_id", "s1_id", "p")


@dataclass(frozen=True)
class Rule:
    """How probabilities become matches: by a threshold ("thr") or by expected F ("expf" with a miss rate)."""

    kind: str
    value: float

    def __call__(self, scored: DataFrame) -> DataFrame:
        return assign(scored, self.value) if self.kind == "thr" else assign_expected_f(scored, miss_rate=self.value)


def thresholds(first: float = 0.3, last: float = 0.925, step: float = 0.025) -> list[float]:
    return [round(first + i * step, 6) for i in range(round((last - first) / step) + 1)]


def sweep(scored: DataFrame, truth: DataFrame, s1: DataFrame, values: list[float], beta: float = 0.5) -> DataFrame:
    """(threshold, f): macro F of every threshold in one job.

    A claim counts for every threshold below its p, so the thresholds are exploded beside each best candidate.
    """
    best = best_candidate(scored).select("q_id", "s1_id", "p")
    each = best.withColumn("threshold", F.explode(F.filter(F.array(*map(F.lit, values)), lambda t: t < F.col("p"))))
    grid = s1.select(F.col("id").alias("s1_id")).withColumn("threshold", F.explode(F.array(*map(F.lit, values))))
    return fbeta_by_entity(each, truth, grid, beta, ["threshold"]).groupBy("threshold").agg(F.avg("f").alias("f"))


def search(scored: DataFrame, truth: DataFrame, s1: DataFrame, values: list[float] | None = None, miss_rate: float = 0.1, beta: float = 0.5) -> DataFrame:
    """(kind, value, f): macro F of every threshold and of expected F with a miss rate."""
    by_threshold = sweep(scored, truth, s1, values or thresholds(), beta).select(F.lit("thr").alias("kind"), F.col("threshold").alias("value"), "f")
    by_f = fbeta(assign_expected_f(scored, beta, miss_rate), truth, s1, beta).select(F.lit("expf").alias("kind"), F.lit(miss_rate).alias("value"), "f")
    return by_threshold.unionByName(by_f)


def chosen(found: DataFrame) -> Rule:
    """The rule with the best F; of equal ones the larger value, then a threshold."""
    best = found.withColumn("f", F.round("f", 9)).orderBy(F.desc("f"), F.desc("value"), F.desc("kind")).first()
    return Rule(best["kind"], best["value"])


def best_rule(swept: DataFrame) -> DataFrame:
    """The threshold with the best F; the smallest of equal ones."""
    return swept.withColumn("f", F.round("f", 9)).orderBy(F.desc("f"), "threshold").limit(1)


def fold_of(number: Column) -> Column:
    """Fold 0 or 1 by canonical record, so that all pairs of one record are in one fold."""
    return F.pmod(F.pmod(number * F.lit(2654435761), F.lit(4294967296)), F.lit(2)).cast("int")
