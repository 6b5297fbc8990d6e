"""Training and prediction from end to end: candidates widened by neighbours, two stages of trees, rules from a search.

Training writes the features, both models and their metadata (feature order, rules, settings) below one folder; prediction
reads them and needs nothing else. Stage 1 scores training pairs out of fold, for the rules and for the group features of
stage 2; on new data its full model does, as no fold has seen them.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import similarity
from ..operators import model
from ..operators.blocking import block
from ..operators.decide import Rule, chosen, search
from ..operators.features import pair_features, with_context
from ..operators.groups import group_features, robust
from ..operators.neighbours import add_candidates
from ..sources.tables import lists, read_metadata, write_metadata, write_tsv

CONTEXT = ("blk_score", "blk_rank", "blk_margin", "q_ncand", "blk_gap12", "s1_ncand", "s1_rank0_cnt")
NUMBERS = ("num_first_eq", "num_first_suffix", "num_jacc", "num_any", "num_first_in", "num_q_n", "num_s_n")
NAMES, ADDRESSES = ("n_jacc", "n_first_eq", "n_len_q", "n_len_s", "acro"), ("a_words_jacc", "a_words_cover_q", "a_words_cover_s", "a_empty_q", "a_empty_s")
FLAGS = ("q_web", "s_web", "q_alias", "s_alias")
#: Features of stage 1, in the order that the model is saved with.
STAGE1 = [*similarity.FUZZY, *NAMES, *NUMBERS, *ADDRESSES, *FLAGS, *CONTEXT, "emb_cos", "is_emb"]


@dataclass(frozen=True)
class Settings:
    """Candidates of each query by blocking, the cap on frequent keys, neighbours added, rounds and depth of the trees, the miss rate of expected F."""

    k: int = 3
    df_cap: int = 2000
    extra: int = 2
    rounds: int = 20
    depth: int = 5
    miss_rate: float = 0.1


def widened(s1: DataFrame, q: DataFrame, knn: DataFrame, settings: Settings) -> DataFrame:
    """Blocking candidates and new neighbours, with the context of the whole set: margins and counts see the added pairs too."""
    return with_context(add_candidates(block(s1, q, settings.k, settings.df_cap), knn, s1, q, settings.extra))


def featured(s1: DataFrame, q: DataFrame, knn: DataFrame, settings: Settings) -> DataFrame:
    """All features of the widened candidates; a query without neighbours has -1 for its cosine."""
    return pair_features(widened(s1, q, knn, settings), s1, q).na.fill(-1.0, ["emb_cos"])


def labelled(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """label 1 for true pairs, 0 for others; queries without a record have none."""
    true = truth.select("q_id", F.col("true_s1_id").alias("s1_id"), F.lit(1.0).alias("label"))
    return pairs.join(true, ["q_id", "s1_id"], "left").na.fill(0.0, ["label"])


def _written(frame: DataFrame, path: str) -> DataFrame:
    frame.write.mode("overwrite").parquet(path)
    return frame.sparkSession.read.parquet(path)


def _with_groups(scored: DataFrame, s1: DataFrame, q: DataFrame) -> tuple[DataFrame, list[str]]:
    """The features with the robust group features beside them, and the names of these."""
    groups = robust(group_features(scored, s1, q))
    names = [c for c in groups.columns if c not in ("q_id", "s1_id")]
    return scored.drop("p").join(groups, ["q_id", "s1_id"]), names


def train(s1: DataFrame, q: DataFrame, truth: DataFrame, knn: DataFrame, number: str, root: str, settings: Settings = Settings()) -> dict:
    """Fit both stages, choose a rule for each from its out-of-fold scores, and write everything below ``root``; the metadata.

    ``number`` is an SQL expression over s1_id: the number of the canonical record, by whose parity folds are made.
    """
    fit = {"rounds": settings.rounds, "depth": settings.depth}
    rows = labelled(featured(s1, q, knn, settings), truth).withColumn("s1_number", F.expr(number))
    rows = _written(rows, f"{root}/features")
    first = _written(model.out_of_fold(rows, STAGE1, "s1_number", **fit).drop("fold"), f"{root}/scores-1")
    rule1 = chosen(search(first, truth, s1, miss_rate=settings.miss_rate))
    joined, names = _with_groups(first, s1, q)
    joined = _written(joined, f"{root}/features-2")
    stage2 = STAGE1 + names
    second = _written(model.out_of_fold(joined, stage2, "s1_number", **fit).select("q_id", "s1_id", "p"), f"{root}/scores-2")
    rule2 = chosen(search(second, truth, s1, miss_rate=settings.miss_rate))
    model.save(model.trees(STAGE1, **fit).fit(rows), f"{root}/model-1")
    model.save(model.trees(stage2, **fit).fit(joined), f"{root}/model-2")
    metadata = {"features1": STAGE1, "features2": stage2, "rule1": asdict(rule1), "rule2": asdict(rule2), "settings": asdict(settings)}
    write_metadata(s1.sparkSession, f"{root}/metadata", metadata)
    return metadata


def scored(s1: DataFrame, q: DataFrame, knn: DataFrame, root: str) -> tuple[DataFrame, DataFrame, dict]:
    """(stage 1, stage 2, metadata): pairs with p of the saved full models, their features in the saved order."""
    metadata = read_metadata(s1.sparkSession, f"{root}/metadata")
    rows = featured(s1, q, knn, Settings(**metadata["settings"])).select("q_id", "s1_id", *metadata["features1"])
    first = model.predict(model.load(f"{root}/model-1"), rows)
    joined, _ = _with_groups(first, s1, q)
    second = model.predict(model.load(f"{root}/model-2"), joined.select("q_id", "s1_id", *metadata["features2"]))
    return first, second, metadata


def predict(s1: DataFrame, q: DataFrame, knn: DataFrame, root: str, out: str, threshold: float | None = None) -> dict[str, DataFrame]:
    """Both tables of either stage below ``out``, as files of tab-separated values; ``threshold`` overrides the saved rules."""
    first, second, metadata = scored(s1, q, knn, root)
    first, second = _written(first.select("q_id", "s1_id", "p"), f"{out}/scores-1"), _written(second.select("q_id", "s1_id", "p"), f"{out}/scores-2")
    tables = {}
    for name, pairs, rule in (("stage1", first, metadata["rule1"]), ("stage2", second, metadata["rule2"])):
        rule = Rule(**rule) if threshold is None else Rule("thr", threshold)
        tables[f"{name}/candidate_pairs"] = lists(pairs, s1, "candidate_entity_ids")
        tables[f"{name}/matching_results"] = lists(rule(pairs), s1)
    for name, table in tables.items():
        write_tsv(table, f"{out}/{name}")
    return tables
