"""The corpus pipeline: stages run one after another, each written as Parquet and read back.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and but for the last returns the
columns of documents. A stage only decides by its operator; what it removes is gone for all that follow.

Defined results, for every stage: an empty table gives no rows; columns beyond those of documents, whatever their names,
pass through the first four stages; texts of any length are read whole; rows that repeat are each decided by the same
rule. What a stage does with nulls, empty texts and ties stands at the stage.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldt import scratch
from veldt.llm import linededup, mixing, packing, simhash, toxicity


def _sized(docs: DataFrame) -> DataFrame:
    """n_chars of the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def _stage(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A stage's result is written before the next begins, so what an earlier stage kept for itself can go then."""

    @functools.wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with scratch.tagged(spark, "corpus_pipeline"):
            return f(spark, docs, sf_dir)

    return run_stage


@_stage
def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; rows of a rejected doc_id and text go together. Null and empty texts
    score as texts without evidence and stay, unless labels are toxic nearly throughout; a null doc_id is never labelled;
    without labels of both classes every score is the share of toxic labels."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.clean(docs, model)


@_stage
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that match an earlier line go; documents stay, if need be without text. A null text stays null, empty lines
    stay; of equal lines the first by doc_id (null last), text and place stays."""
    return _sized(linededup.clean(docs))


@_stage
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints, the document with the least doc_id stays (null last, then the least hash of
    the text); documents whose five-word shingles are similar to an earlier document's go too. Null, empty and blank texts
    are copies of each other. Rows that repeat a doc_id with unlike texts are documents of their own; of rows that repeat
    both one stays."""
    return simhash.clean(docs, similar_shingle=5)


@_stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target weights: a document comes once for each pass over its source that takes words of it. A null
    source is the last of the sources; documents without words are taken by none; ties in doc_id go by size and text."""
    return _sized(mixing.mixed_documents(docs))


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Batches of documents of like lengths. A null text has length 0; ties in length stand in the order of a hash of
    doc_id."""
    return packing.pack(docs)


STAGES = [("toxicity", toxic), ("line_dedup", lines), ("simhash", near_copies), ("mixing", mix), ("packing", pack)]

#: The stages' models and pseudorandom draws have no SQL form; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.kept(stage(spark, docs, sf_dir), name)
    return docs
