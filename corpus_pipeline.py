"""A corpus pipeline of five stages: quality, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and is written as Parquet and read again by
its caller before the next. All but the last return the columns of documents.

Stages judge rows, not ids: rows that share a doc_id, or have none, stay or go each by its
own text, and of exactly repeated rows one stays in near-dedup. Null and blank texts fail
the quality stage's base rules; the other stages let them pass, and packing gives a piece
of one token for each. Further columns pass through, whatever their names. Without labels
the quality stage applies its base rules only, without benchmark items decontamination
keeps all; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomveil.llm import decontam, minhash, packing, quality, queries, scratch


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the likelihood ratio fitted on this corpus."""
    return quality.filter_documents(docs, queries.read(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that ten or more of them hold."""
    return queries.deduped_lines(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates."""
    return minhash.without_near_duplicates(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item."""
    return decontam.drop_contaminated(docs, queries.read(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequences and offsets."""
    return packing.pack_documents(docs, queries.tokenizer_path())


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("decontamination", benchmark_stage),
    ("packing", packing_stage),
]

#: Hashing, sketching and tokenization have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage wrote on its way goes once its result is written."""
    docs = queries.read(spark, sf_dir, "documents")
    first = scratch.mark()
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), f"stage-{name}")
        scratch.drop_since(spark, first, keep=1)
    return docs
