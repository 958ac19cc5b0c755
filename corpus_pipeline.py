"""Corpus pipeline: quality, near-duplicates, benchmark, source mix, token files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next one's docs; a stage's table is deleted when the next one is
written.  All but the last return the columns of documents.  Near-duplicates are documents
whose 5-word shingle sets have a similarity of 0.8 or more.

Cases: null and empty texts are scored like any others; those that pass stay through all
stages, as they are near-duplicates of nothing and hold no benchmark passage, and become one
end id.  Rows without a doc_id stay too.  Of rows that repeat a doc_id near-dedup leaves
one.  A null source is a source of its own.  Ties go to the smaller doc_id.  Columns
beside those of documents pass through all stages but the last.  Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mixfield.llm import decontaminate, mixing, neardup, packing, quality_gam
from mixfield.llm._store import drop, stash
from mixfield.llm.registry import END_ID, QUALITY, WINDOW, table, vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    return quality_gam.keep_good(docs, table(spark, sf_dir, "labels"), QUALITY)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return neardup.keep_one(docs, 5, 80)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"), WINDOW)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources replicated to their target weights, in a global shuffle."""
    return mixing.mix(docs).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed token files, read back: doc_id, start, n_tokens, ids_crc32."""
    return packing.tokenise(docs, vocabulary("word_bpe_49k.json"), END_ID)


STAGES = [("quality classifier", quality), ("minhash near-dedup", near_dedup), ("benchmark decontamination", decontaminated), ("mixing sources", mixed), ("token binary output", tokens)]

#: The first and the last stage are a learned model and a tokenizer, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stash(docs, f"pipeline-{k}")
            drop(before)
    return docs
