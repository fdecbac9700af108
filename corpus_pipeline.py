"""A training-data pipeline over `documents`: toxic documents go, near-duplicates go, repeated passages go, the rest is
packed into sequences. Each stage is written as Parquet in the shared folder and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import packing, simhash, substrings, toxicity
from quire.llm.shared import fold, stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5, learnt from the labelled rows outside the held-out fold."""
    labels = table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(fold(F.col("doc_id"), 5) != 0))
    return toxicity.with_scores(docs, model).where("toxic_score < 0.5").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group of near copies: five-word shingles, a resemblance of 0.8 or more. SimHash
    proposes pairs first, shared rare shingles those that it can't see; all are compared exactly. Rows that repeat a kept id stay, as do rows without an id."""
    found = simhash.near_copies(docs)
    least = found.where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.where("doc_id is not null").join(least, "doc_id", "left_semi")
    return kept.unionByName(docs.where("doc_id is null")).select(*docs.columns)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words that an earlier one has in a window of 13; other texts stay as they are."""
    cut = substrings.remove_repeats(docs)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    columns = {"text": text, "n_chars": F.when(F.col("n_removed") > 0, F.length("kept_text")).otherwise(F.col("n_chars"))}
    return cut.select(*(columns.get(c, F.col(c)).alias(c) for c in docs.columns))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document, or each part of a long one, goes: bin and offset."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_duplicates),
    ("substring dedup", cut_repeated_passages),
    ("best-fit packing", pack_sequences),
]
#: Fingerprints, a trained model and best-fit order are beyond SQL; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
