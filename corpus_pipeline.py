"""From raw documents to token ids: toxic documents go, repeated lines go, one document of each group of near copies stays, sources
are mixed to their target weights, and texts are encoded. Each stage calls one operator of talweg.llm on all rows that its
predecessor kept; all stages but the last return the columns of documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talweg.llm import bpe, chosen_path, line_dedup, mixing, toxicity
from talweg.llm._shared import free, stored


def toxic_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that a factorization machine, taught by the labels outside the held-out quarter, rejects."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~toxicity.held_out("doc_id"))
    return toxicity.without_toxic(docs, toxicity.train(docs, labels), toxicity.THRESHOLD)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without repeated and nearly repeated lines; documents all of whose lines are found elsewhere go, n_chars follows the text."""
    info = free("lines_", docs)
    out = line_dedup.dedup(docs).filter(~F.col(f"{info}.emptied"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(f"{info}.removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id."""
    gone = chosen_path.near_duplicates(docs).filter("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mix."""
    return mixing.in_order(*mixing.mix(docs)).select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests, ids and position of every document; positions grow in the order of the mix, which is the order
    in which its files were written."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True, place=mixing.written_place())


STAGES = [("toxicity", toxic_filter), ("line dedup", repeated_lines), ("near dedup", near_copies), ("source mix", source_mix), ("byte-level BPE", token_ids)]

#: SQL cannot express the machine's scores, SimHash groups or token merges; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each earlier one is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
