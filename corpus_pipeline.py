"""From raw documents to token files: five stages, each an operator of tidelog.llm on all that the stage before kept.

Defined results, beside those in the operators' docstrings: a null text counts as an empty one in every stage; rows without
doc_id, or that share one, are rows of their own, of which a component of near duplicates keeps one; columns of documents come
through the first four stages as they are, whatever their names, but for text and n_chars of a document that the mix cuts; an
empty table gives an empty result, and without labels all documents that the classifier scores 0.5 or more stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidelog.llm import common, decontam, jaccard, mixing, quality, tokens


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among them, predicts to be good."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality.score(docs.withColumns({f"_own_{c}": docs[c] for c in ("score", "predicted") if c in docs.columns}), model)
    return scored.filter("predicted = 1").select(*(scored[f"_own_{c}"].alias(c) if f"_own_{c}" in scored.columns else scored[c] for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts with a similarity of 0.8 or more."""
    return jaccard.representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix takes a document; the last of a source is cut after the word that fills its budget."""
    return mixing.mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the written token container holds of each row."""
    return tokens.round_trip(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("mixing_sources", mixing_sources),
    ("token_ids", token_ids),
]

#: SQL can express neither the classifier nor the tokenizer; tests/llm holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.saved(docs)
    return docs
