"""A training corpus from raw documents: reject, deduplicate, cut repeats, mask personal data, pack.

Each stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and returns a DataFrame; all but the
last return the columns of ``documents``. Near duplicates are documents whose sets of five-word
shingles have a similarity of 0.8 or more. Empty tables pass through; nulls, ties, repeated rows and very long texts have the
results that the operators define.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.llm import jaccard, packing, pii, quality, repeats
from linkweave.llm._store import Scratch


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars after the text has changed."""
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.length("text").cast(kind))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts: rows, nulls, empty and repeated ones too, stay or go by their text's score alone.

    Without a label to learn from, the score of no evidence decides for all.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return quality.accepted(docs, quality.trained(docs, labels))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each group of near duplicates; rows with a null doc_id and texts without words stay."""
    return jaccard.representatives(docs, words=5, percent=80)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without strings of 50 bytes that an earlier document holds; all rows stay, with empty texts if nothing is left, null ones null."""
    return _counted(repeats.without_repeats(docs))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data masked; all rows stay, null texts null."""
    return _counted(pii.personal_data(docs, redact=True))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens, placed in sequences; null and empty texts are one piece of one token, each row is packed."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("suffix-array dedup", suffix_array_dedup),
    ("PII", personal_data),
    ("best-fit packing", best_fit_packing),
]

#: SQL can't express the classifier, the random field and the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each result is written once, in the shared folder."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.table(docs, f"stage-{i}")
    return docs
