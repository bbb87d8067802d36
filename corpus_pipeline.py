"""The corpus pipeline: quality rules, line dedup, near-dedup by SimHash, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before has kept; run() writes every
stage's result as Parquet to the shared folder and reads it again, so a lost executor costs one stage at most.
SQL can't express the stages; the tests hold them against brute force.

All stages but the last return the columns of documents, whatever further ones there are and whatever their names. An empty table gives
empty tables. Rows, not ids, are what stages decide on: rows that share a doc_id, or have none, are documents of their own if their texts differ.
Very long texts are treated whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from prismview.llm import common, linededup, packing, pii, quality, simhash
from prismview.llm.queries import tokenizer


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go. Null and empty texts have no words, so they go; a null lang counts as a language. Repeated rows share one verdict."""
    return quality.keep(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs go, and documents of which nothing is left. First is what has the least doc_id, null last, then the least hash of its text; null and empty
    texts stay. Rows equal in id and text stay alike."""
    return linededup.without_repeats(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the least doc_id, null last, then the least hash of its text. Null and empty texts are one group. Of rows
    equal in id and text one stays."""
    return simhash.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind, as <EMAIL>. Null stays null; no row goes. Of spans that overlap the first counts, of those that begin together the shorter."""
    return pii.mask(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of 4096 tokens. Null counts as empty, so it is its end token alone; a null doc_id comes first; repeated rows are packed each."""
    return packing.pack(docs, tokenizer("word_bpe_49k.json"))


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("simhash_dedup", simhash_dedup), ("personal_data", personal_data), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    folder = common.shared_path(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
