"""A training corpus from documents: toxic ones go, one of each group of near duplicates stays, repeated passages go, the rest is packed."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helioscope.llm import packing, simhash, substring, toxicity
from helioscope.llm.common import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a model trained on all labels scores under the threshold. Null ids go through the model as all others."""
    model = toxicity.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.kept(docs.select(*COLUMNS), model)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8 or more) the document with the least id; of rows that repeat both id and text one."""
    docs = docs.select(*COLUMNS)
    gone = simhash.similar(docs).where(F.col("doc_id") != F.col("group")).select("row").distinct()
    row = F.xxhash64(F.col("doc_id").cast("bigint"), F.coalesce(F.col("text"), F.lit("")))
    return docs.withColumn("row", row).join(gone, "row", "left_anti").dropDuplicates(["row"]).select(*COLUMNS)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 25 words or more that a document with a smaller id has; what is left empty stays as an empty text."""
    found = substring.dedup(docs, window=25, carry=("text", "lang", "source", "n_chars"))
    whole = F.col("n_removed") == 0
    text = F.when(whole, F.col("text")).otherwise(F.col("kept"))
    n_chars = F.when(whole, F.col("n_chars")).otherwise(F.length("kept").cast("bigint"))
    return found.select("doc_id", text.alias("text"), "lang", "source", n_chars.alias("n_chars"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 4096 ids."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("substring_dedup", substring_stage),
    ("packing", packing_stage),
]

#: A trained model and a tokenizer can't be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written as Parquet in the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name}")
    return docs
