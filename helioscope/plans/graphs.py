"""Graph operators over the customers and suppliers that share orders and nations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helioscope.operators import cluster, graph
from helioscope.plans.registry import query
from helioscope.session import load

EDGES = "SELECT DISTINCT o_custkey AS src, 1000000 + l_suppkey AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey"
BOTH = f"SELECT src, dst FROM ({EDGES}) UNION SELECT dst, src FROM ({EDGES})"


def edges(spark: SparkSession, d: str) -> DataFrame:
    o, l = load(spark, d, "orders"), load(spark, d, "lineitem")
    return o.join(l, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("src"), (1000000 + F.col("l_suppkey")).alias("dst")).distinct()


@query(f"SELECT src AS id, count(*) AS degree FROM ({BOTH}) GROUP BY ALL")
def graph_degree(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees(edges(spark, d))


@query(f"""WITH e AS ({BOTH}), g AS (SELECT src, count(*) AS k FROM e GROUP BY src), c AS (SELECT x.src AS a, y.src AS b, count(*) AS common FROM e x JOIN e y ON x.dst = y.dst AND x.src < y.src GROUP BY ALL)
    SELECT a, b, common, round(common / (ga.k + gb.k - common), 6) AS jaccard FROM c JOIN g ga ON ga.src = a JOIN g gb ON gb.src = b""")
def graph_jaccard(spark: SparkSession, d: str) -> DataFrame:
    """Every pair of nodes that shares a neighbour, over the edges of all orders and line items."""
    o, l = load(spark, d, "orders"), load(spark, d, "lineitem")
    e = o.join(l, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("src"), (1000000 + F.col("l_suppkey")).alias("dst"))
    both = e.select(F.inline(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))))
    return graph.neighbour_similarity(both, 6)


@query(f"""WITH RECURSIVE e AS ({BOTH}), r(id, c) USING KEY (id) AS (SELECT src, min(least(src, dst)) FROM e GROUP BY src UNION SELECT e.src, min(x.c) FROM r x JOIN e ON e.dst = x.id JOIN recurring.r o ON o.id = e.src WHERE x.c < o.c GROUP BY e.src)
    SELECT id, c AS component FROM r""")
def connected_components(spark: SparkSession, d: str) -> DataFrame:
    return graph.connected_components(edges(spark, d))


@query()
def k_core(spark: SparkSession, d: str) -> DataFrame:
    return graph.k_core(edges(spark, d), 3)


def chained(first: str, step: str, rounds: int, last: str) -> str:
    """SQL: table r0 by `first`, each further one from the one before (named in `step` as before), then `last` over the last one (named now)."""
    tables = [f"r0 AS ({first})"] + [f"r{i} AS ({step.replace('before', f'r{i - 1}')})" for i in range(1, rounds + 1)]
    return ", ".join(tables) + " " + last.replace("now", f"r{rounds}")


@query(f"WITH e AS ({BOTH}), " + chained("SELECT DISTINCT src AS id, src AS label FROM e", """SELECT id, label FROM (SELECT src AS id, label, row_number() OVER (PARTITION BY src ORDER BY count(*) DESC, label) AS k FROM e JOIN before ON dst = id GROUP BY src, label) WHERE k = 1""", 3, "SELECT id, label FROM now"))
def label_propagation(spark: SparkSession, d: str) -> DataFrame:
    return graph.label_propagation(edges(spark, d), 3)


@query(f"WITH e AS ({EDGES}), ids AS (SELECT src AS id FROM e UNION SELECT dst FROM e), n AS (SELECT count(*) AS n FROM ids), o AS (SELECT src, count(*) AS o FROM e GROUP BY src), " + chained("SELECT id, 1.0::DOUBLE / n AS rank FROM ids, n", """SELECT ids.id, 0.15 / n + 0.85 * (coalesce(s, 0) + loose / n) AS rank FROM ids CROSS JOIN n CROSS JOIN (SELECT coalesce(sum(rank), 0) AS loose FROM before WHERE id NOT IN (SELECT src FROM o))
    LEFT JOIN (SELECT e.dst AS id, sum(rank / o) AS s FROM e JOIN o ON o.src = e.src JOIN before b ON b.id = e.src GROUP BY e.dst) g ON g.id = ids.id""", 5, "SELECT id, round(rank, 9) AS rank FROM now"))
def pagerank(spark: SparkSession, d: str) -> DataFrame:
    return graph.pagerank(edges(spark, d), 5).withColumn("rank", F.round("rank", 9))


@query(f"""WITH e AS ({EDGES}), l AS (SELECT src AS id, src % 5 AS label FROM ({BOTH}) GROUP BY ALL), m AS (SELECT count(*) AS m FROM e), i AS (SELECT count(*) AS w FROM e JOIN l a ON a.id = src JOIN l b ON b.id = dst WHERE a.label = b.label),
    k AS (SELECT label, count(*) AS k FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) JOIN l USING (id) GROUP BY label) SELECT round(max(w / m) - sum(power(k / (2 * m), 2)), 6) AS modularity FROM k, m, i""")
def modularity(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d)
    l = graph.symmetric(e).select(F.col("src").alias("id")).distinct().withColumn("label", F.col("id") % 5)
    return graph.modularity(e, l).select(F.round("modularity", 6).alias("modularity"))


NATIONS = "SELECT DISTINCT c_nationkey AS src, s_nationkey AS dst FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey"


def nations(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "customer").join(load(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"))
    l = load(spark, d, "lineitem").join(load(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return o.join(l, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).where("src <> dst").distinct()


@query(f"""WITH d AS ({NATIONS}), e AS (SELECT src, dst FROM d UNION SELECT dst, src FROM d) SELECT a.src AS id, count(*) // 2 AS triangles FROM e a JOIN e b ON b.src = a.dst JOIN e c ON c.src = b.dst AND c.dst = a.src GROUP BY ALL""")
def triangles(spark: SparkSession, d: str) -> DataFrame:
    return graph.triangles(nations(spark, d))


@query(f"""WITH d AS ({NATIONS}), e AS (SELECT src, dst FROM d UNION SELECT dst, src FROM d) SELECT round(count(*) / (count(DISTINCT src) * (count(DISTINCT src) - 1)), 6) AS density FROM e""")
def graph_density(spark: SparkSession, d: str) -> DataFrame:
    return graph.density(nations(spark, d)).select(F.round("density", 6).alias("density"))


NEAREST = "SELECT id, centre, dist FROM (SELECT c.id, b.centre, sum(power(c.v - b.v, 2)) AS dist, row_number() OVER (PARTITION BY c.id ORDER BY sum(power(c.v - b.v, 2)), b.centre) AS k FROM c JOIN before b USING (i) GROUP BY c.id, b.centre) WHERE k = 1"


@query("WITH c AS (SELECT vec_id AS id, unnest(range(0, 64)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings), f AS (SELECT vec_id AS id, row_number() OVER (ORDER BY vec_id) - 1 AS centre FROM embeddings), " + chained("SELECT centre, i, v FROM c JOIN f USING (id) WHERE centre < 8", f"""SELECT b.centre, b.i, coalesce(m.v, b.v) AS v FROM before b LEFT JOIN (SELECT a.centre, c.i, avg(c.v) AS v FROM ({NEAREST}) a JOIN c USING (id) GROUP BY ALL) m ON m.centre = b.centre AND m.i = b.i""", 5, f"SELECT id, centre::INTEGER AS centre, round(sqrt(dist), 5) AS distance FROM ({NEAREST.replace('before', 'now')})"))
def kmeans_embeddings(spark: SparkSession, d: str) -> DataFrame:
    x = cluster.kmeans(load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x")), 8, 5)
    return x.select("id", F.col("centre").cast("int").alias("centre"), F.round("distance", 5).alias("distance"))


@query()
def dbscan_suppliers(spark: SparkSession, d: str) -> DataFrame:
    s = load(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_acctbal") / 100).alias("x"), (F.col("s_nationkey") * 4.0).alias("y"))
    return cluster.dbscan(s, 6.0, 3)
