"""The queries of this subpackage, each applied to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, flac, knn, packing, pitman_yor, simhash, substring, suffix, toxicity, warc
from .common import written

#: Where the public tokenizers' files are: a parameter of the operators.
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, folder = warc.archive(table(spark, sf_dir, "pages"))
    return warc.read_archives(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode_decode(table(spark, sf_dir, "documents"), BYTE_BPE))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), WORD_BPE)


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digests(substring.dedup(table(spark, sf_dir, "documents")))


def op6_kdtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = written(knn.integer_vectors(table(spark, sf_dir, "embeddings")), "knn-vectors")
    return knn.top_k(vectors, vectors.where("vec_id % 50 = 0"))


def op7_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score(table(spark, sf_dir, "documents"))


def op8_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.digests(suffix.dedup(table(spark, sf_dir, "documents")))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digests(simhash.near_duplicates(simhash.fingerprints(table(spark, sf_dir, "documents"))))


def op10_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.digests(flac.from_media(flac.to_media(table(spark, sf_dir, "documents"))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_warc": op2_warc,
    "op3_bpe": op3_bpe,
    "op4_packing": op4_packing,
    "op5_substring": op5_substring,
    "op6_kdtree": op6_kdtree,
    "op7_pitman_yor": op7_pitman_yor,
    "op8_suffix": op8_suffix,
    "op9_simhash": op9_simhash,
    "op10_flac": op10_flac,
}
ORACLES: dict[str, str] = {
    "op6_kdtree": """
        WITH v AS (
            SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5""",
}
