"""Corpus pipeline over documents: language ID, exact dedup, near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir); docs has the columns doc_id, text, lang, source, n_chars, in any order and with
others of any name if need be. All stages but the last return the columns of docs.

Stages decide on rows, each known by its place in the table (ROW), not on doc_ids: rows that share a doc_id, or have
none, are judged each for itself, and of rows that repeat one stays after deduplication. The columns that a stage adds
while it works have names of their own, beginning with _tallyward.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyward.llm.common import ROW, numbered, small, stored, table
from tallyward.llm.language_id import of_documents
from tallyward.llm.mixing import mixed_texts
from tallyward.llm.ngram_join import jaccard_classes
from tallyward.llm.packing import pack_documents
from tallyward.llm.stream_dedup import dedup

LANG = "_tallyward_lang"


def without(rows: DataFrame, dropped: DataFrame, name: str) -> DataFrame:
    """The numbered rows but for those that dropped (ROW) names."""
    return rows.join(small(stored(dropped.select(ROW), name), 200_000), ROW, "left_anti")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; lang becomes the language found."""
    rows = numbered(docs)
    found = stored(of_documents(rows, ROW), "pipeline-languages")
    changed = found.where("kept and not (lang <=> declared)").select(ROW, F.col("lang").alias(LANG))
    kept = without(rows, found.where("not kept"), "pipeline-rejected")
    return kept.join(small(stored(changed, "pipeline-relabelled"), 200_000), ROW, "left").withColumn("lang", F.coalesce(LANG, "lang")).select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal normalised texts."""
    return without(numbered(docs), dedup(docs).where("not kept"), "pipeline-copies").select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates: that of the smallest doc_id."""
    found = stored(jaccard_classes(docs).where("component is not null").select(ROW, "doc_id", "component"), "pipeline-linked")
    first = stored(found.groupBy("component").agg(F.min(F.struct("doc_id", ROW)).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "pipeline-components")
    dropped = found.join(small(first, 100_000), "component").where(F.col(ROW) != F.col(f"first.{ROW}"))
    return without(numbered(docs), dropped, "pipeline-near").select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: whole copies of a document for whole passes, and the words that the shards draw of it."""
    return mixed_texts(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's pieces with their bins."""
    return pack_documents(docs)


STAGES = [("language_id", language), ("exact_dedup", exact), ("ngram_jaccard", near), ("mixing", mixing), ("packing", packing)]
#: Language models and prefix joins are beyond SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
