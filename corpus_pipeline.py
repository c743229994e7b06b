"""Corpus pipeline: quality filter, near-copy removal, source mixing, packing. Each stage reads what the one before kept.

Columns of the documents, whatever their names, pass all stages but the last unchanged (source_mix cuts one text, and
its n_chars, a source). Rows that repeat a doc_id are judged, mixed and packed each; of near copies those of the
smallest doc_id stay; null texts count as empty; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.llm import jaccard, mixing, packing, quality, scratch
from pagelens.llm.queries import table, word_tokenizer


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labelled ones, gives a score of 0.5 or more."""
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    kept = quality.score(docs, model, docs.columns)
    return kept.filter(F.col(quality.score_name(docs.columns)) >= 0.5).select(*(f"`{c}`" for c in docs.columns))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return jaccard.one_of_each(docs, width=5, percent=80)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources as documents, a row for each copy taken."""
    return mixing.materialise(mixing.mix(docs, weights=(5, 2, 1), share=1.5, most=2.0), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens: a row for each piece of a document."""
    # fewer chunks remembered than by default: the stages before it leave executors less memory than a query alone has
    return packing.pack(docs.select("doc_id", "text"), word_tokenizer(), 0, 2048, cache_chunks=150_000)


STAGES = [("quality", quality_filter), ("near_copies", near_copies), ("mix", source_mix), ("pack", pack)]

#: The classifier cannot be written in SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is written as Parquet and read again."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            scratch.drop(spark, before)
        before = docs
    return docs
