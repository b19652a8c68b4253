"""The corpus pipeline: five operators of riskweave.llm over the documents, one after another."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm import bpe, mixing, oddsketch, suffixes, toxicity
from riskweave.llm.common import stored, table

TOXIC_FROM = 0.3
#: Near-duplicates of the pipeline share four fifths of their shingles of five words (op4: of four).
NEAR = oddsketch.Settings(words=5)
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject; null and empty texts stay."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity.scored(F.col("text"), model) < TOXIC_FROM)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, that of smallest id; rows without id come last.

    Rows are compared, not ids, so of a document that came twice and of copies without id one row
    stays too: the next stage would take the text of all of them. Rows without words stay."""
    if docs._jdf.queryExecution().analyzed().nodeName().partition(" ")[0] not in ("Relation", "LogicalRelation"):
        docs = stored(docs, "documents")  # a row's key is its place in a file
    key = F.xxhash64("_metadata.file_path", "_metadata.row_index").alias("row_key")
    keyed = docs.select(key, F.struct(*[f"`{c}`" for c in docs.columns]).alias("doc"))
    rows = oddsketch.near_duplicates(keyed.selectExpr("row_key AS doc_id", "doc.text"), NEAR).selectExpr("doc_id AS row_key", "component_id")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")
    kept = keyed.selectExpr("row_key", "doc.doc_id").join(rows, "row_key").groupBy("component_id").agg(F.min_by("row_key", order).alias("row_key"))
    return keyed.join(kept.select("row_key"), "row_key", "left_semi").select(*[F.col(f"doc.`{c}`") for c in docs.columns])


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings that repeat anywhere in what is left."""
    return suffixes.without_repeats(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated and cut as the mix of their sources takes them."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row of the mix, with their digests and that of the decoded text."""
    return bpe.digests(docs, RANKS, public_tokenizers.PATTERN, keep_ids=True)


STAGES = [
    ("toxicity", clean),
    ("near_duplicates", distinct),
    ("repeated_strings", without_repeats),
    ("mixing", mixed),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: Neither the learned score nor the merges of the tokenizer can be said in SQL.
ORACLE_SQL = None
