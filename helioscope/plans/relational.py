"""The relational base: joins, grouping sets, ranking, set operations, subqueries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helioscope.operators import quality
from helioscope.plans.registry import query
from helioscope.session import load


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 4) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    x = load(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return x.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 4).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"))


@query("""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def revenue_by_nation(spark: SparkSession, d: str) -> DataFrame:
    n = load(spark, d, "nation").join(load(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    x = load(spark, d, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).join(load(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey")).join(load(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return x.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("""SELECT o_orderkey, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = (SELECT min(c_mktsegment) FROM customer) ORDER BY o_totalprice DESC, o_orderkey LIMIT 10""")
def top_orders(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d, "customer")
    first = F.broadcast(c.agg(F.min("c_mktsegment").alias("c_mktsegment")))
    x = load(spark, d, "orders").join(c.join(first, "c_mktsegment", "left_semi"), F.col("o_custkey") == F.col("c_custkey"))
    return x.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def customers_without_orders(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "customer").join(load(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL")
def orders_per_customer(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "customer").join(load(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))


@query("SELECT s_nationkey, c_nationkey FROM (SELECT DISTINCT s_nationkey FROM supplier) FULL JOIN (SELECT DISTINCT c_nationkey FROM customer) ON s_nationkey = c_nationkey")
def full_join_nations(spark: SparkSession, d: str) -> DataFrame:
    s, c = load(spark, d, "supplier").select("s_nationkey").distinct(), load(spark, d, "customer").select("c_nationkey").distinct()
    return s.join(c, F.col("s_nationkey") == F.col("c_nationkey"), "full")


@query("SELECT o_orderstatus, o_orderpriority, grouping(o_orderstatus)::BIGINT AS g, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube_orders(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.grouping("o_orderstatus").cast("bigint").alias("g"), F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT n_regionkey, n_nationkey, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, n_nationkey)")
def rollup_customers(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "customer").join(F.broadcast(load(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).rollup("n_regionkey", "n_nationkey").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
def grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    x = load(spark, d, "lineitem")
    r, s = F.col("l_returnflag"), F.col("l_linestatus")
    return x.groupingSets([[r], [s], []], r, s).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS rk, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS dr, ntile(4) OVER w AS nt,
    round(percent_rank() OVER w, 6) AS pr, round(cume_dist() OVER w, 6) AS cd, first_value(o_totalprice) OVER w AS fv FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def ranking_windows(spark: SparkSession, d: str) -> DataFrame:
    w, p = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"), Window.partitionBy("o_custkey").orderBy("o_orderpriority")
    big = lambda c: c.cast("bigint")
    return load(spark, d, "orders").select("o_orderkey", big(F.row_number().over(w)).alias("rn"), big(F.rank().over(p)).alias("rk"), big(F.dense_rank().over(p)).alias("dr"), big(F.ntile(4).over(w)).alias("nt"), F.round(F.percent_rank().over(w), 6).alias("pr"), F.round(F.cume_dist().over(w), 6).alias("cd"), F.first("o_totalprice").over(w).alias("fv"))


@query("SELECT p_partkey AS k FROM part UNION SELECT s_suppkey FROM supplier")
def set_union(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "part").select(F.col("p_partkey").alias("k")).union(load(spark, d, "supplier").select("s_suppkey")).distinct()


@query("SELECT l_partkey AS k FROM lineitem INTERSECT SELECT p_partkey FROM part WHERE p_size > 25")
def set_intersect(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "lineitem").select(F.col("l_partkey").alias("k")).intersect(load(spark, d, "part").where("p_size > 25").select("p_partkey"))


@query("SELECT o_custkey AS k FROM orders EXCEPT ALL SELECT c_custkey FROM customer")
def set_except_all(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "orders").select(F.col("o_custkey").alias("k")).exceptAll(load(spark, d, "customer").select("c_custkey"))


@query("""SELECT l_suppkey, round(sum(CASE WHEN l_returnflag = 'A' THEN l_quantity END), 4) AS a, round(sum(CASE WHEN l_returnflag = 'N' THEN l_quantity END), 4) AS n, round(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END), 4) AS r FROM lineitem GROUP BY ALL""")
def pivot_flags(spark: SparkSession, d: str) -> DataFrame:
    x = load(spark, d, "lineitem").groupBy("l_suppkey").pivot("l_returnflag", ["A", "N", "R"]).agg(F.sum("l_quantity"))
    return x.select("l_suppkey", *[F.round(c, 4).alias(c.lower()) for c in "ANR"])


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query("""SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, count(*) AS n, count(*) FILTER (dayofweek(o_orderdate) IN (0, 6)) AS weekend, max(date_diff('day', o_orderdate, TIMESTAMP '2000-01-01')) AS age FROM orders GROUP BY ALL""")
def calendar_counts(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("o_orderdate")
    return load(spark, d, "orders").groupBy(F.year(t).cast("bigint").alias("y"), F.month(t).cast("bigint").alias("m")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.dayofweek(t).isin(1, 7)).alias("weekend"), F.max(F.datediff(F.lit("2000-01-01").cast("date"), t)).cast("bigint").alias("age"))


@query("""SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.2 FROM orders i WHERE i.o_custkey = o.o_custkey)""")
def correlated_above_average(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders")
    m = o.groupBy("o_custkey").agg((F.avg("o_totalprice") * 1.2).alias("m"))
    return o.join(m, "o_custkey").where("o_totalprice > m").select("o_orderkey")


@query("""SELECT 'c_acctbal' AS "column", count(*) AS n, count(*) FILTER (c_acctbal IS NULL) AS nulls, count(DISTINCT c_acctbal) AS distinct_values, count(*) FILTER (c_acctbal < 0) AS below, count(*) FILTER (c_acctbal > 9000) AS above FROM customer
    UNION ALL SELECT 'c_nationkey', count(*), count(*) FILTER (c_nationkey IS NULL), count(DISTINCT c_nationkey), count(*) FILTER (c_nationkey < 1), count(*) FILTER (c_nationkey > 23) FROM customer""")
def quality_report(spark: SparkSession, d: str) -> DataFrame:
    return quality.report(load(spark, d, "customer"), {"c_acctbal": (0, 9000), "c_nationkey": (1, 23)})
