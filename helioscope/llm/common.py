"""What the operators of this subpackage share: the shared folder, written tables, words, row keys."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but space and the ASCII controls from tab to carriage return.
WORD = re.compile(r"[^\x20\x09-\x0D]+")

#: A-Z only; other letters keep their case.
LOWER = {c: c + 32 for c in range(65, 91)}

#: Where intermediate tables go if the session names no folder (tests on one machine).
LOCAL_SHARED = "/tmp/checkpoints/helioscope"


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads them (the finaliser of SplitMix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which the driver and all executors see."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{LOCAL_SHARED}"
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str, *partition_by: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: lineage ends here, and lost executors lose nothing."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path) if not partition_by else spark.read.parquet(path)


def discard(table: DataFrame) -> None:
    """Deletes the files of a written table that nothing reads any more."""
    spark = table.sparkSession
    for parent in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id bigint, text string): other columns go, so that none of them can clash; a null text is empty."""
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def spread(spark: SparkSession, least: int = 1) -> int:
    """Partitions for a shuffle: what the session says, at least `least`."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that `column` holds about `most` bytes in each: a worker's memory follows that, not the batch setting."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        lens = np.nan_to_num(np.asarray(pc.binary_length(col).to_numpy(zero_copy_only=False), dtype=np.float64))
        group = (np.cumsum(lens) // most).astype(np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


#: What each byte adds to a word's hash: capitals as small letters. Any odd number does as the base.
VALUES = mix64(np.array([LOWER.get(b, b) for b in range(256)], np.uint64) + np.uint64(1))
GAPS = np.isin(np.arange(256), [32, *range(9, 14)])
BASE = 0x9E3779B97F4A7C15
PIECE = 1 << 20
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    """BASE and its inverse modulo 2^64, to the powers 0 to n - 1."""
    if len(_powers[0]) < n:
        for i, b in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            out = np.full(n, b, np.uint64)
            out[0] = 1
            _powers[i] = np.cumprod(out, dtype=np.uint64)
    return _powers


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, lower-cased in A-Z, of an array of strings, and how many each string has: a mixed polynomial of the bytes, for a whole piece at a time."""
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    at -= at[0]
    n = len(raw)
    gap = GAPS[raw]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    starts = np.flatnonzero(~gap & (edge[:-1] | np.append(True, gap[:-1])[:n]))
    ends = np.flatnonzero(~gap & (edge[1:] | np.append(gap[1:], True)[:n])) + 1
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        a = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, a + PIECE, "right")))
        span = int(ends[j - 1]) - a
        up, down = powers(max(span, PIECE))
        total = np.zeros(span + 1, np.uint64)
        np.cumsum(VALUES[raw[a : a + span]] * up[:span], out=total[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        out[i:j] = mix64((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
        i = j
    return out, np.diff(np.searchsorted(starts, at))


def binary_rows(blobs: list[bytes]) -> pa.Array:
    return pa.array(blobs, pa.binary())
