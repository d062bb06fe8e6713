"""Event-time windows, watermarks, stream joins and sketches over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helioscope.functions import aggregates as A
from helioscope.operators import joins, sketches
from helioscope.operators import windows as W
from helioscope.plans.registry import query, rounded
from helioscope.session import load
from helioscope.streaming import state
from helioscope.streaming import windows as S


def micros(c):
    return F.unix_micros(c.cast("timestamp"))


@query("""SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start_us, event_type, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std,
    round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS q95 FROM events GROUP BY ALL""")
def tumbling_agg(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    x = S.tumbling(load(spark, d, "events"), "ts", "1 hour", ["event_type"], n=F.count(F.lit(1)), mean=F.avg(v), std=F.stddev_samp(v), median=A.median(v), q95=A.quantile(v, 0.95))
    return x.select(micros(F.col("start")).alias("start_us"), "event_type", "n", *rounded(**{c: F.col(c) for c in ("mean", "std", "median", "q95")}))


@query("""WITH w AS (SELECT unnest(generate_series(time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 45 MINUTE, time_bucket(INTERVAL 15 MINUTE, ts), INTERVAL 15 MINUTE)) AS s, * FROM events)
    SELECT epoch_us(s) AS start_us, event_type, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY ALL""")
def sliding_agg(spark: SparkSession, d: str) -> DataFrame:
    x = S.sliding(load(spark, d, "events"), "ts", "1 hour", "15 minutes", ["event_type"], n=F.count(F.lit(1)), total=F.sum("value"))
    return x.select(micros(F.col("start")).alias("start_us"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH m AS (SELECT *, CASE WHEN ts - lag(ts) OVER w > INTERVAL 2 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM m)
    SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts) + INTERVAL 2 HOUR) AS end_us, count(*) AS n, round(sum(value), 4) AS total FROM g GROUP BY user_id, s""")
def session_windows(spark: SparkSession, d: str) -> DataFrame:
    x = S.session(load(spark, d, "events"), "ts", "2 hours", ["user_id"], n=F.count(F.lit(1)), total=F.sum("value"))
    return x.select("user_id", micros(F.col("start")).alias("start_us"), micros(F.col("end")).alias("end_us"), "n", F.round("total", 4).alias("total"))


@query("""WITH m AS (SELECT *, CASE WHEN ts - lag(ts) OVER w > INTERVAL 2 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts))
    SELECT event_id, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS BIGINT) AS session FROM m""")
def session_numbers(spark: SparkSession, d: str) -> DataFrame:
    x = load(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return W.sessions(x, "ts", 7200, ["user_id"]).select("event_id", "session")


@query()
def anchored_windows(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events").select("user_id", F.struct((micros(F.col("ts")) / 1e6).alias("t"), F.col("value").alias("v")).alias("x"))
    g = e.groupBy("user_id").agg(F.array_sort(F.collect_list("x")).alias("series"))
    return g.select("user_id", F.explode(S.anchored_tumbling(F.col("series"), 86_400.0)).alias("w")).select("user_id", "w.start", "w.n", F.round("w.total", 4).alias("total"))


ARRIVALS = "SELECT *, (event_id * 7919) % 1000003 AS arrival, epoch_us(ts) / 1e6 AS t FROM events"


def arrivals(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").withColumns({"arrival": (F.col("event_id") * 7919) % 1000003, "t": micros(F.col("ts")) / 1e6})


@query(f"""WITH a AS ({ARRIVALS}), w AS (SELECT user_id, t, max(t) OVER (PARTITION BY user_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 3600 AS mark FROM a)
    SELECT user_id, count(*) AS n, sum(CASE WHEN t <= mark THEN 1 ELSE 0 END)::BIGINT AS late, sum(CASE WHEN mark IS NULL OR t >= mark THEN 1 ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN mark IS NULL OR t >= mark - 86400 THEN 1 ELSE 0 END)::BIGINT AS within_grace FROM w GROUP BY ALL""")
def watermark_late_events(spark: SparkSession, d: str) -> DataFrame:
    x = S.watermark_audit(arrivals(spark, d), "t", "arrival", 3600.0, ["user_id"])
    t = F.col("t")
    keep = lambda grace: F.sum(F.when(F.col("watermark").isNull() | (t >= F.col("watermark") - grace), 1).otherwise(0))
    return x.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("late").cast("int")).alias("late"), keep(0.0).alias("kept"), keep(86400.0).alias("within_grace"))


@query(f"""WITH a AS ({ARRIVALS}) SELECT l.event_id AS l_id, r.event_id AS r_id FROM a l JOIN a r ON l.user_id = r.user_id AND l.event_type = 'click' AND r.event_type = 'purchase' AND l.arrival < r.arrival""")
def hash_join_stream(spark: SparkSession, d: str) -> DataFrame:
    a = arrivals(spark, d)
    l = a.where("event_type = 'click'").select("user_id", F.col("event_id").alias("l_id"), F.col("arrival").alias("la"))
    r = a.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("r_id"), F.col("arrival").alias("ra"))
    return joins.hash_join(l, r, ["user_id"], ("la", "ra")).select("l_id", "r_id")


@query(f"""WITH a AS ({ARRIVALS}) SELECT l.event_id AS l_id, r.event_id AS r_id FROM a l JOIN a r ON l.user_id = r.user_id AND l.event_type = 'click' AND r.event_type = 'purchase' AND abs(l.t - r.t) <= 3600""")
def interval_join(spark: SparkSession, d: str) -> DataFrame:
    a = arrivals(spark, d)
    l = a.where("event_type = 'click'").select("user_id", F.col("event_id").alias("l_id"), F.col("t").alias("lt"))
    r = a.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("r_id"), F.col("t").alias("rt"))
    return joins.interval_join(l, r, ["user_id"], "lt", "rt", 3600.0).select("l_id", "r_id")


@query("""WITH l AS (SELECT * FROM events WHERE event_type = 'click'), r AS (SELECT user_id, ts, max(value) AS v FROM events WHERE event_type = 'purchase' GROUP BY ALL)
    SELECT l.event_id, r.v AS v FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.ts""")
def asof_join(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events")
    l = e.where("event_type = 'click'").select("event_id", "user_id", "ts")
    r = e.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("v")).withColumnRenamed("ts", "rts")
    return joins.asof_join(l, r, ["user_id"], "ts", "rts", "v").select("event_id", "v")


@query("""SELECT o_orderkey, low FROM orders JOIN (SELECT unnest(range(0, 600000, 50000)) AS low) r ON o_totalprice >= low AND o_totalprice < low + 50000""")
def range_join(spark: SparkSession, d: str) -> DataFrame:
    r = spark.range(0, 600000, 50000).select(F.col("id").alias("low"), (F.col("id") + 50000).alias("high"))
    return joins.range_join(load(spark, d, "orders"), r, "o_totalprice", "low", "high", 50000.0).select("o_orderkey", "low")


@query("""SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY ALL""")
def distinct_users(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("users"))


@query()
def hll_distinct_users(spark: SparkSession, d: str) -> DataFrame:
    """By day first, then merged: sketches of parts give the sketch of the whole."""
    daily = load(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(sketches.hll(F.col("user_id")).alias("s"))
    return daily.groupBy("event_type").agg(sketches.hll_merge(F.col("s")).alias("users"))


@query()
def sketch_quantiles(spark: SparkSession, d: str) -> DataFrame:
    daily = load(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(sketches.kll(F.col("value")).alias("s"))
    return daily.groupBy("event_type").agg(sketches.kll_merge(F.col("s")).alias("s")).select("event_type", sketches.kll_quantile(F.col("s"), 0.5).alias("median"), sketches.kll_quantile(F.col("s"), 0.95).alias("q95"))


@query()
def tdigest_quantiles(spark: SparkSession, d: str) -> DataFrame:
    return sketches.tdigest_quantiles(load(spark, d, "events"), "value", ["event_type"], [0.05, 0.5, 0.95])


@query()
def count_min_parts(spark: SparkSession, d: str) -> DataFrame:
    s = sketches.count_min(load(spark, d, "lineitem"), "l_partkey", 4, 2048)
    return sketches.count_min_query(s, load(spark, d, "part").select(F.col("p_partkey").alias("key")), "key", 4, 2048)


@query("""SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY ALL ORDER BY n DESC, l_partkey LIMIT 20""")
def topk_heavy_hitters(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "l_partkey").limit(20)


@query("""SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)""")
def bloom_semi_join(spark: SparkSession, d: str) -> DataFrame:
    """A Bloom filter of fixed size drops most customers without orders before the exact semi join."""
    o = load(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return sketches.bloom_prefilter(load(spark, d, "customer").select("c_custkey"), o, "c_custkey", 1 << 20, 4).join(o, "c_custkey", "left_semi")


@query()
def reservoir_sample(spark: SparkSession, d: str) -> DataFrame:
    return sketches.reservoir(load(spark, d, "events"), "event_id", 100, ["event_type"], 7)


@query("""WITH RECURSIVE n AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id, value) AS i FROM events WHERE value IS NOT NULL AND user_id IS NOT NULL),
    r AS (SELECT user_id, i, value AS mean, value AS ewma, 0::DOUBLE AS spread, 0::DOUBLE AS up, 0::DOUBLE AS down, 0 AS changes FROM n WHERE i = 1
        UNION ALL SELECT user_id, i, mean, ewma, 0.2 * power(value - ewma, 2) + 0.8 * spread, CASE WHEN fire THEN 0 ELSE up END, CASE WHEN fire THEN 0 ELSE down END, changes + fire::INT
        FROM (SELECT *, up > 100 OR down > 100 AS fire FROM (SELECT *, greatest(0, up0 + value - mean - 5) AS up, greatest(0, down0 - value + mean - 5) AS down
        FROM (SELECT n.user_id, n.i, n.value, r.mean + (n.value - r.mean) / n.i AS mean, 0.2 * n.value + 0.8 * r.ewma AS ewma, r.spread, r.up AS up0, r.down AS down0, r.changes FROM r JOIN n ON n.user_id = r.user_id AND n.i = r.i + 1))))
    SELECT user_id, max(i) AS n, round(max_by(mean, i), 6) AS mean, round(max_by(ewma, i), 6) AS ewma, round(max_by(spread, i), 6) AS ewma_variance, max(changes)::BIGINT AS changes FROM r GROUP BY user_id""")
def stream_changes(spark: SparkSession, d: str) -> DataFrame:
    """The last state of each user and the changes found, from a stream of the events' file."""
    schema = load(spark, d, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{d}/events*.parquet")
    x = state.settled(state.analyzed(events, "value", ["ts", "event_id"], ["user_id"], 0.2, 5.0, 100.0), spark)
    last = [F.round(F.max_by(c, "n"), 6).alias(c) for c in ("mean", "ewma", "ewma_variance")]
    return x.groupBy("user_id").agg(F.max("n").cast("bigint").alias("n"), *last, F.sum("change").cast("bigint").alias("changes"))
