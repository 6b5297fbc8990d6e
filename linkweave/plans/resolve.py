"""The whole way from records to lists. The candidates are written once; what follows is one lazy plan over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.blocking import block
from ..operators.decide import Rule
from ..operators.features import attach, native_features, with_context
from ..operators.model import scorecard
from ..session import keeper
from ..sources.tables import lists
from . import views

K, DF_CAP, THRESHOLD = 3, 2000, 0.5


def candidates(spark: SparkSession, sf_dir: str, k: int = K, df_cap: int = DF_CAP) -> DataFrame:
    """Written by each call: a query that needs them twice passes them on as ``found``."""
    s1, q = views.sides(spark, sf_dir)
    return block(s1, q, k, df_cap, keeper(spark, "blocking"))


def featured(spark: SparkSession, sf_dir: str, k: int = K, df_cap: int = DF_CAP, found: DataFrame | None = None) -> DataFrame:
    s1, q = views.sides(spark, sf_dir)
    return native_features(attach(with_context(candidates(spark, sf_dir, k, df_cap) if found is None else found), s1, q))


def scored(spark: SparkSession, sf_dir: str, k: int = K, df_cap: int = DF_CAP, found: DataFrame | None = None) -> DataFrame:
    return scorecard(featured(spark, sf_dir, k, df_cap, found))


def kept_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(q_id, s1_id, p) of all candidates, written once for queries that read them several times."""
    return keeper(spark, "scored")(scored(spark, sf_dir).select("q_id", "s1_id", "p"), "pairs")


def assigned(spark: SparkSession, sf_dir: str, rule: Rule | None = None, found: DataFrame | None = None) -> DataFrame:
    return (rule or Rule("thr", THRESHOLD))(scored(spark, sf_dir, found=found))


def resolve_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every canonical record with the queries that belong to it."""
    s1, _ = views.sides(spark, sf_dir)
    return lists(assigned(spark, sf_dir), s1)
