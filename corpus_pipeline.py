"""The training-data pipeline: stages that each read what the one before has written.

    run(spark, sf_dir)  the whole pipeline over the documents of ``sf_dir``

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import public_tokenizers  # noqa: E402
from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from plumbline.llm import byte_bpe, decontaminate, exact_dedup, near_dedup, toxicity  # noqa: E402
from plumbline.llm.common import documents, fresh  # noqa: E402
from plumbline.session import materialize, release  # noqa: E402

#: Documents scored from here on go.
TOXIC_FROM = 0.3
RANKS = "byte_bpe_multi_50k.tiktoken"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents under the toxicity threshold, by a lexicon learnt from the labelled ones."""
    model = toxicity.train_by_contract(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = fresh(docs, "toxicity_score")
    return toxicity.score(docs, model, name=score).where(F.col(score) < TOXIC_FROM).drop(score)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return near_dedup.drop_near_copies(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and n_tokens of each document, and whether its ids decode to its text again."""
    coded = byte_bpe.encode(
        docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, ids="ids", decoded="decoded", keep=["doc_id", "text"]
    )
    back = F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return coded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), back.alias("round_trip"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("byte_bpe", encode),
]

#: Near copies and token ids are beyond SQL; tests compare the rows with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name)
        release(before)
    return docs
