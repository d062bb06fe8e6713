"""Reading and writing formats: Spark's own readers where they exist, binary files parsed in Arrow batches where they don't."""

from __future__ import annotations

import io
import json
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

READERS = ("parquet", "orc", "json", "csv", "text", "binaryFile")


def read_csv(spark: SparkSession, path: str, schema: StructType | str, missing: str = "", header: bool = True, bad: str = "PERMISSIVE") -> DataFrame:
    """A typed CSV: no inference; `missing` is null; rows that don't fit are null, dropped or an error by `bad`."""
    return spark.read.csv(path, schema=schema, header=header, nullValue=missing, mode=bad, enforceSchema=True)


def infer_csv(spark: SparkSession, path: str, sample: float = 1.0) -> StructType:
    """Column types by a sampled pass, for use with read_csv."""
    return spark.read.csv(path, header=True, inferSchema=True, samplingRatio=sample).schema


def write(df: DataFrame, path: str, fmt: str = "parquet", by: list[str] = (), mode: str = "errorifexists", **options) -> None:
    writer = df.write.mode(mode).format(fmt).options(**options)
    (writer.partitionBy(*by) if by else writer).save(path)


def read_jdbc(spark: SparkSession, url: str, table: str, column: str, low: int, high: int, parts: int, **options) -> DataFrame:
    """A table over JDBC, in ranges of one column, so that tasks read side by side."""
    return spark.read.jdbc(url, table, column=column, lowerBound=low, upperBound=high, numPartitions=parts, properties=options)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """(path, i, values array<double>): rows of NPY arrays of numbers; a one-dimensional array has rows of one value."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, raw in zip(pdf["path"], pdf["content"]):
                a = np.load(io.BytesIO(raw), allow_pickle=False)
                a = a.reshape(len(a), -1) if a.ndim else a.reshape(1, 1)
                for k in range(0, len(a), 10_000):
                    part = a[k : k + 10_000].astype(float)
                    yield pd.DataFrame({"path": name, "i": np.arange(k, k + len(part)), "values": list(part)})

    return _files(spark, path).mapInPandas(run, "path string, i bigint, values array<double>")


def read_edge_list(spark: SparkSession, path: str) -> DataFrame:
    """(src string, dst string, weight double) of lines "src dst [weight]" parted by white space; blank lines and comments (#) are left out, a missing weight is null."""
    p = F.split("value", "\\s+")
    lines = spark.read.text(path).select(F.trim("value").alias("value")).where("value <> '' AND NOT startswith(value, '#')").where(F.size(p) > 1)
    return lines.select(p[0].alias("src"), p[1].alias("dst"), F.try_element_at(p, F.lit(3)).try_cast("double").alias("weight"))


def write_edge_list(edges: DataFrame, path: str, weighted: bool = False, mode: str = "errorifexists") -> None:
    """Lines "src dst" or "src dst weight", one file a partition."""
    edges.select(F.concat_ws(" ", "src", "dst", *(["weight"] if weighted else []))).write.mode(mode).text(path)


def npy_bytes(values: Column) -> Column:
    """An array<double> as the bytes of a one-dimensional NPY file of little-endian doubles; null for null."""

    @F.pandas_udf("binary")
    def run(rows: pd.Series) -> pd.Series:
        def one(row: np.ndarray) -> bytes:
            out = io.BytesIO()
            np.save(out, np.asarray(row, "<f8"), allow_pickle=False)
            return out.getvalue()

        return rows.map(one, na_action="ignore")

    return run(values)


def read_matrix_market(spark: SparkSession, path: str) -> DataFrame:
    """(i, j, v) of Matrix Market coordinate files, counted from zero; symmetric files give both halves. The banner's kind is read from the text itself."""
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.col("value").alias("line"))
    banner = lines.where(F.col("line").startswith("%%MatrixMarket")).select("file", F.lower("line").contains(" symmetric").alias("symmetric"), F.lower("line").contains(" pattern").alias("pattern"))
    cells = lines.where(~F.col("line").startswith("%")).select("file", F.split(F.trim("line"), "[ \t]+").alias("p")).join(F.broadcast(banner), "file")
    # the size line has three numbers as well: it is the only one without a value in pattern files, and is told by order otherwise
    first = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.regexp_extract("value", r"(?m)^[ \t]*([0-9]+[ \t]+[0-9]+[ \t]+[0-9]+)[ \t]*$", 1).alias("size"))
    own = cells.join(F.broadcast(first), "file").withColumn("text", F.array_join("p", " "))
    own = own.where(F.col("text") != F.regexp_replace("size", "[ \t]+", " "))
    v = F.when(F.col("pattern"), 1.0).otherwise(F.try_element_at("p", F.lit(3)).cast("double"))
    e = own.select((F.col("p")[0].cast("bigint") - 1).alias("i"), (F.col("p")[1].cast("bigint") - 1).alias("j"), v.alias("v"), "symmetric")
    return e.select("i", "j", "v").union(e.where("symmetric AND i <> j").select("j", "i", "v"))


def read_wav(spark: SparkSession, path: str) -> DataFrame:
    """(path, rate, channels, i, values array<double>): PCM samples of WAV files of 8, 16 or 32 bits, scaled to -1 to 1."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, raw in zip(pdf["path"], pdf["content"]):
                at, fmt, data = 12, None, b""
                while at + 8 <= len(raw):
                    tag, size = raw[at : at + 4], struct.unpack("<I", raw[at + 4 : at + 8])[0]
                    if tag == b"fmt ":
                        fmt = struct.unpack("<HHIIHH", raw[at + 8 : at + 24])
                    elif tag == b"data":
                        data = raw[at + 8 : at + 8 + size]
                    at += 8 + size + size % 2
                _, channels, rate, _, _, bits = fmt
                x = (np.frombuffer(data, np.uint8).astype(float) - 128) / 128 if bits == 8 else np.frombuffer(data, f"<i{bits // 8}") / float(1 << (bits - 1))
                x = x.reshape(-1, channels)
                yield pd.DataFrame({"path": name, "rate": rate, "channels": channels, "i": np.arange(len(x)), "values": list(x)})

    return _files(spark, path).mapInPandas(run, "path string, rate int, channels int, i bigint, values array<double>")


def arff_attributes(lines: DataFrame) -> list[tuple[str, str]]:
    """(name, type) of every attribute of ARFF lines (line)."""
    out = []
    for r in lines.where(F.lower("line").startswith("@attribute")).collect():
        _, name, kind = r["line"].split(None, 2)
        out.append((name.strip("'\""), "double" if kind.strip().lower() in ("numeric", "real", "integer") else "string"))
    return out


def read_arff(spark: SparkSession, path: str) -> DataFrame:
    """An ARFF file as a table: numeric attributes are doubles, all others strings, '?' is null. Only the header reaches the driver."""
    lines = spark.read.text(path).select(F.trim("value").alias("line")).where("line <> '' AND NOT startswith(line, '%')")
    row = F.split("line", ",")
    cells = [F.when(F.trim(row[i]) != "?", F.trim(row[i])).cast(k).alias(n) for i, (n, k) in enumerate(arff_attributes(lines))]
    return lines.where(~F.col("line").startswith("@")).select(*cells)


def read_delta_log(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of a Delta-style table (JSON log of add and remove actions over Parquet files) at a version, without its partition columns' folders."""
    log = spark.read.json(f"{path}/_delta_log/*.json").withColumn("v", F.regexp_extract(F.input_file_name(), r"(\d+)\.json", 1).cast("bigint"))
    if version is not None:
        log = log.where(F.col("v") <= version)
    adds = log.where("add IS NOT NULL").select(F.col("add.path").alias("p"), "v", F.lit(1).alias("live"))
    gone = log.where("remove IS NOT NULL").select(F.col("remove.path").alias("p"), "v", F.lit(0).alias("live")) if "remove" in log.columns else adds.limit(0)
    last = adds.union(gone).groupBy("p").agg(F.max(F.struct("v", "live")).alias("s")).where("s.live = 1")
    files = [f"{path}/{r['p']}" for r in last.select("p").collect()]  # file names of one version of one table
    return spark.read.parquet(*files)


def write_delta_log(df: DataFrame, path: str, version: int) -> None:
    """Appends df as a version: Parquet files, then one JSON commit that names them."""
    spark = df.sparkSession
    part = f"v{version:020d}"
    df.write.mode("errorifexists").parquet(f"{path}/{part}")
    files = spark.read.parquet(f"{path}/{part}").select(F.input_file_name().alias("f")).distinct().collect()
    actions = [{"commitInfo": {"operation": "WRITE", "version": version}}, {"metaData": {"schemaString": df.schema.json()}}]
    actions += [{"add": {"path": f"{part}/{r['f'].rsplit('/', 1)[1]}", "dataChange": True}} for r in files]
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_delta_log/{version:020d}.json")
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(hadoop, False)
    out.write(bytearray("\n".join(map(json.dumps, actions)).encode()))
    out.close()


def run_length(df: DataFrame, value: str, order_by: list[str]) -> DataFrame:
    """(run, value, length): encoding of a column in order."""
    from helioscope.operators.windows import runs

    return runs(df, value, order_by).select("run", "value", "length")


def run_length_decode(encoded: DataFrame) -> DataFrame:
    """(i, value): the column again, numbered from zero by run and place."""
    from helioscope.operators.prefix import numbered

    rows = encoded.select("run", "value", F.explode(F.sequence(F.lit(1), F.col("length").cast("int"))).alias("k"))
    return numbered(rows, [F.col("run"), F.col("k")], "i").select("i", "value")


def dictionary(df: DataFrame, value: str) -> tuple[DataFrame, DataFrame]:
    """(df with code, table of (code, value)): codes by falling count, ties by value."""
    from helioscope.operators.prefix import numbered

    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
    codes = numbered(counts, [-F.col("_n"), F.col(value)], "code").select(value, "code")
    return df.join(codes, value, "left"), codes


def delta_encode(df: DataFrame, value: str, order_by: list[str], by: list[str] = ()) -> DataFrame:
    """First value and then differences, exact for integers."""
    from pyspark.sql import Window

    w = Window.partitionBy(*by).orderBy(*order_by)
    return df.withColumn("delta", F.col(value) - F.coalesce(F.lag(value).over(w), F.lit(0)))


def delta_decode(df: DataFrame, order_by: list[str], by: list[str] = ()) -> DataFrame:
    from pyspark.sql import Window

    return df.withColumn("value", F.sum("delta").over(Window.partitionBy(*by).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, 0)))
