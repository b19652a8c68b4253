"""The registered queries: each applies one operator to its whole table and derives the columns asked for."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm import bpe, chat, heapmeans, mixing, oddsketch, phrases, quality, resync, rpforest, suffixes, topk, toxicity, wrappers
from riskweave.llm.common import table
from riskweave.llm.labelled import held_out


def op1_projection_forest(s: SparkSession, d: str) -> DataFrame:
    return rpforest.near_vectors(table(s, d, "embeddings"))


def op2_toxicity(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents")
    model = toxicity.fit(docs, table(s, d, "labels"))
    return _judged(docs, toxicity.scored(F.col("text"), model), 0.3)


def op3_mix_sources(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    return mixing.mix(docs).drop("source", "epochs")


def op4_odd_sketch_dedup(s: SparkSession, d: str) -> DataFrame:
    return oddsketch.near_duplicates(table(s, d, "documents"))


def op5_suffix_dedup(s: SparkSession, d: str) -> DataFrame:
    return suffixes.digests(table(s, d, "documents"))


def op6_byte_bpe(s: SparkSession, d: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.digests(table(s, d, "documents"), path, public_tokenizers.PATTERN)


def op7_wrapper_text(s: SparkSession, d: str) -> DataFrame:
    return wrappers.extract(table(s, d, "pages"))


def op8_exact_top_k(s: SparkSession, d: str) -> DataFrame:
    vectors = topk.quantised(table(s, d, "embeddings"))
    return topk.top_k(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op9_quality(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents")
    model = quality.fit(docs, table(s, d, "labels"))
    return _judged(docs, quality.scored(F.col("text"), model), 0.7)


def _judged(docs: DataFrame, score: Column, least: float) -> DataFrame:
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score")).withColumn(
        "predicted", (F.col("score") >= least).cast("int")
    )


def op10_chat_format(s: SparkSession, d: str) -> DataFrame:
    told = "</s>[INST] ok [/INST]"
    extra = s.createDataFrame(
        [(-1, 0, "user", told), (-1, 1, "assistant", told)], "conv_id long, turn long, role string, text string"
    )
    turns = table(s, d, "conversations").select(*extra.columns).unionByName(extra)
    return chat.read_back(chat.format_conversations(turns))


def op11_heap_clusters(s: SparkSession, d: str) -> DataFrame:
    return heapmeans.clustered(table(s, d, "embeddings"))


def op12_phrases(s: SparkSession, d: str) -> DataFrame:
    return phrases.collocations(table(s, d, "documents"))


def op13_token_counts(s: SparkSession, d: str) -> DataFrame:
    return resync.token_counts(table(s, d, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_projection_forest": op1_projection_forest,
        "op2_toxicity": op2_toxicity,
        "op3_mix_sources": op3_mix_sources,
        "op4_odd_sketch_dedup": op4_odd_sketch_dedup,
        "op5_suffix_dedup": op5_suffix_dedup,
        "op6_byte_bpe": op6_byte_bpe,
        "op7_wrapper_text": op7_wrapper_text,
        "op8_exact_top_k": op8_exact_top_k,
        "op9_quality": op9_quality,
        "op10_chat_format": op10_chat_format,
        "op11_heap_clusters": op11_heap_clusters,
        "op12_phrases": op12_phrases,
        "op13_token_counts": op13_token_counts,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_projection_forest": rpforest.SQL,
        "op3_mix_sources": mixing.SQL,
        "op8_exact_top_k": topk.SQL,
        "op11_heap_clusters": heapmeans.SQL,
        "op12_phrases": phrases.SQL,
    }
