"""The corpus pipeline: toxicity, near-duplicates, benchmark decontamination, secrets, mixture.

Each stage takes all that the stage before it kept. The first three drop documents, the fourth masks secrets in their
texts, the last says how many copies of each document the mixture takes. An empty table stays empty in every stage, and
columns beyond those of documents are carried along.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkward.llm import base, decontamination, mixing, secret_scans, simhash, toxicity

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that score as toxic; the lexicon is learned from labelled documents of the stage's input.

    Null and empty texts score as texts without a hit and stay. Without labels nothing is dropped.
    """
    base.tune(spark)
    return toxicity.reject(spark, docs, toxicity.fit(spark, docs, base.table(spark, sf_dir, "labels")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of least doc_id of each set of linked documents.

    Two documents are linked where their fingerprints differ in at most 4 bits, as op8 links them, and where the sets of
    their shingles of five words have a Jaccard likeness of 0.8 or more: trees with a wider radius find the candidates,
    and the sets decide. Null and empty texts are one set. Of repeated ids the least text hash stays, of repeated rows one.
    """
    base.tune(spark)
    return simhash.keep_one(spark, docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark item. Null and empty texts hold none and stay."""
    base.tune(spark)
    return decontamination.clean(spark, docs, base.table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask secrets in the texts; n_chars is that of the masked text (0 for a null text, which stays null). All rows stay."""
    base.tune(spark)
    return secret_scans.redact_column(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents, then size, source_size, target, taken and copies; all rows stay, some with 0 copies.

    Null texts have size 0 and take nothing; null sources are one source. A column of documents that has one of the new
    names is kept in its place.
    """
    base.tune(spark)
    others = tuple(c for c in docs.columns if c != "doc_id")
    mixed = mixing.mix(spark, docs, keep=others)
    return mixed.select("doc_id", *others, *(c for c in ("size", "source_size", "target", "taken", "copies") if c not in others))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("mixture", mixing_stage),
]
#: The stages are beyond SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; what a stage returns is written as Parquet and read again."""
    docs = base.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs, _ = base.written(spark, stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
