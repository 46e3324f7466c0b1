"""The corpus pipeline: quality, toxicity, near-duplicates, mixing to target weights, tokens.

Each stage is a function (spark, docs, sf_dir) -> DataFrame. run() writes what a stage
returns as Parquet in the shared folder and reads it again as the next stage's docs, so
that a lost executor costs at most one stage; tables that a stage kept meanwhile go then. All stages but the last return the columns
of documents.

Odd rows: null texts are empty; empty, blank and very long texts are judged, kept and
encoded like others, whole. Rows are judged each by its own text, so null and repeated
doc_ids, and repeated rows, don't matter to the classifiers; what they mean to the other
stages is said there. Columns other than those of documents are ignored, whatever their
names. Empty tables stay empty.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from cuesheet import scratch
from cuesheet.llm import minhash, mixing, pieces, quality, toxicity
from cuesheet.llm.queries import PIECE_MODEL
from cuesheet.shipping import ship

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier doesn't reject (score of at least 0.3), each by its own text, whatever its doc_id. An empty text has the score of no features."""
    ship(spark)
    judged = quality.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "quality", threshold=0.3, carry=COLUMNS[1:])
    return judged.where("predicted = 1").select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the toxicity models don't reject (score below 0.7), each by its own text, whatever its doc_id. An empty text has the score of no words."""
    ship(spark)
    judged = toxicity.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "toxic", threshold=0.7, carry=COLUMNS[1:])
    return judged.where("predicted = 0").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group linked by five-word shingles at 0.8 or more.

    Rows with a null or repeated doc_id are documents of their own, and of such rows equal in doc_id
    and text one stays; rows without words are in no group and stay. See minhash.dedup.
    """
    ship(spark)
    return minhash.dedup(docs, shingle=5, percent=80).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that sources weigh the square roots of their sizes, in a shuffled order.

    A null source is a source; rows of one doc_id, or without one of one text, get equal counts.
    """
    ship(spark)
    return mixing.mix(docs, power=0.5, epochs=1.0, seed=17).select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens and round_trip of every row; null and empty texts have no ids."""
    ship(spark)
    return pieces.encode(docs, PIECE_MODEL).select("doc_id", "ids", "n_tokens", "round_trip")


STAGES = [("quality", keep_quality), ("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("mixing", mix_sources), ("tokens", tokenize)]

#: Trained classifiers and a tokenizer: SQL can't express these stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        docs = scratch.settled(functools.partial(stage, spark, docs, sf_dir), name)
        if before is not None:
            scratch.drop(before)
        before = docs
    return docs
