"""From raw documents to packed training sequences: STAGES in order, and run() over all of them.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return
the columns of documents. The result is one row per packed piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from splinewright.llm import mixing, ngramjoin, packing, toxicity
from splinewright.llm._common import Workspace, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity machine rejects go; it learns from the labelled rows outside the held-out fold."""
    model = toxicity.train_on(docs, table(spark, sf_dir, "labels"))
    return toxicity.scores(docs, model, "__toxicity").where(F.col("__toxicity") < toxicity.THRESHOLD).drop("__toxicity")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word Jaccard similarity of 0.8 or more, the smallest id stays."""
    return ngramjoin.deduplicate(docs, n=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    return packing.pack(docs, packing.default_tokenizer())


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: Neither the trained scores nor packing can be written in SQL. Tests compare the join with brute force, scores with
#: texts scored one by one, the mix with its report, and the packing with the tokenizer's counts and the bound.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = ws.stage(docs, name)
    return docs
