"""Event-time windows, watermarks and late data. The window functions take batch and streaming tables alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def event_time(df: DataFrame, ts: str, delay: str | None = None) -> DataFrame:
    """ts as a timestamp with time zone (the session's), under a watermark if `delay` is given."""
    out = df.withColumn(ts, F.col(ts).cast("timestamp"))
    return out.withWatermark(ts, delay) if delay else out


def tumbling(df: DataFrame, ts: str, size: str, by: list[str], **aggs: Column) -> DataFrame:
    """Aggregates by window of `size` and key: start, keys, aggregates."""
    return df.groupBy(F.window(ts, size), *by).agg(*[v.alias(k) for k, v in aggs.items()]).select(F.col("window.start").alias("start"), *by, *aggs)


def sliding(df: DataFrame, ts: str, size: str, step: str, by: list[str], **aggs: Column) -> DataFrame:
    return df.groupBy(F.window(ts, size, step), *by).agg(*[v.alias(k) for k, v in aggs.items()]).select(F.col("window.start").alias("start"), *by, *aggs)


def session(df: DataFrame, ts: str, gap: str, by: list[str], **aggs: Column) -> DataFrame:
    """Sessions end when the next row is more than `gap` later; start, end of the last row plus gap, keys, aggregates."""
    return df.groupBy(F.session_window(ts, gap), *by).agg(*[v.alias(k) for k, v in aggs.items()]).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *by, *aggs)


def anchored_tumbling(series: Column, size: float) -> Column:
    """Windows that start at data: the first at the first record, the next at the first record at or after its end. series: sorted array<struct<t:double,v:double>>; gives array<struct<start,n,total>>."""
    kind = "array<struct<start:double,n:int,total:double>>"

    def one(x: Column) -> Column:
        return F.struct(x["t"].alias("start"), F.lit(1).alias("n"), x["v"].alias("total"))

    def step(s: Column, x: Column) -> Column:
        last = F.element_at(s, -1)
        grown = F.struct(last["start"].alias("start"), (last["n"] + 1).alias("n"), (last["total"] + x["v"]).alias("total"))
        fresh = (F.size(s) == 0) | (x["t"] >= last["start"] + size)
        return F.when(fresh, F.concat(s, F.array(one(x)))).otherwise(F.concat(F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0))), F.array(grown))).cast(kind)

    return F.aggregate(series, F.array().cast(kind), step)


def watermark_audit(df: DataFrame, ts: str, arrival: str, delay: float, by: list[str] = ()) -> DataFrame:
    """Adds watermark (greatest time before this row in arrival order, less `delay` seconds) and late (time at or before it)."""
    w = Window.partitionBy(*by).orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1)
    mark = F.max(F.col(ts).cast("double")).over(w) - delay
    return df.withColumn("watermark", mark).withColumn("late", F.coalesce(F.col(ts).cast("double") <= F.col("watermark"), F.lit(False)))


def late_policy(df: DataFrame, ts: str, policy: str, grace: float = 0.0) -> DataFrame:
    """Rows of a watermark_audit that a policy processes: drop keeps times at or after the watermark, allow those within `grace` seconds before it, side keeps all and marks them."""
    t = F.col(ts).cast("double")
    on_time = F.coalesce(t >= F.col("watermark"), F.lit(True))
    if policy == "drop":
        return df.where(on_time)
    if policy == "allow":
        return df.where(F.coalesce(t >= F.col("watermark") - grace, F.lit(True)))
    if policy == "side":
        return df.withColumn("side", ~on_time)
    raise ValueError(f"no policy {policy}")


def interval_stream_join(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, within: str, delay: str) -> DataFrame:
    """Stream-stream join within an interval; watermarks on both sides bound the state."""
    l, r = left.withWatermark(left_ts, delay), right.withWatermark(right_ts, delay)
    span = F.expr(f"interval {within}")
    return l.join(r, (l[key] == r[key]) & (F.col(right_ts) >= F.col(left_ts) - span) & (F.col(right_ts) <= F.col(left_ts) + span))


def replay(df: DataFrame, path: str, files: int = 4):
    """A streaming table of df's rows, by way of Parquet files at `path`."""
    df.repartition(files).write.mode("overwrite").parquet(path)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def drain(stream: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """All that a stream has now, through a memory sink."""
    writer = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    query = (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
    query.awaitTermination(300)
    return stream.sparkSession.table(name)
