"""From documents to sharded training text: quality rules, near duplicates, benchmark passages, mixing, shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.

Rows that stages may meet, and what becomes of them: a null or empty text, or one without words, has too few words and
goes in the first stage (given to a later stage, it stays: it is no duplicate, holds no item, and has size 1). Rows with
equal doc_id and text are one document from the second stage on; rows with equal doc_id and other texts are documents of
their own, as are those with a null doc_id. Of equal scores the smallest doc_id stays, a null one counting as smallest
for order and losing to any other as the name of a group. A null source is a source of its own. Very long texts are read
whole. Further columns are carried; one named size, shard or slot gives way to the last stage's. Empty tables give empty
results with the same columns; without labels of both kinds the field has fixed weights.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import documents, staged, table
from tidemark.llm.decontamination import drop_contaminated
from tidemark.llm.mixing import plan_mixture, realise
from tidemark.llm.near_duplicates import drop_near_duplicates
from tidemark.llm.quality import keep_good
from tidemark.llm.sharding import shard_by_bytes


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the line field reject go; a null text has no words, so its row goes."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the smallest doc_id stays; texts without words are no duplicates, and stay."""
    return drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, up to its edits, go; null and empty texts and items hold and are nothing."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document stays, those of small sources up to 1.5 times on average; rows that are read twice come twice."""
    return realise(docs, plan_mixture(docs), epoch="__epoch", order="__mix_order").select(*docs.columns)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Eight shards of near equal bytes, with each row's slot; a null text has size 1."""
    return shard_by_bytes(docs, 8)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("mixture", mixture), ("shards", shards)]

#: SQL can't express the fitted field nor the edit matching.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
