"""Graph operators on edge tables (src, dst[, weight]). Undirected unless said otherwise. Iterations write each round to the checkpoint folder."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, LongType, StructField, StructType

from helioscope.operators import overlaps

#: Blocks of a slot in `neighbour_similarity`, unless there are fewer blocks than tasks can use.
SLOT = 2


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. One machine may name none; a cluster must."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "/tmp/checkpoints/helioscope"
        spark.sparkContext.setCheckpointDir(named)
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def symmetric(edges: DataFrame) -> DataFrame:
    """Both directions of each distinct edge, without loops."""
    e = edges.where("src <> dst").select("src", "dst")
    return e.union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    return symmetric(edges).groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))


def in_out_degrees(edges: DataFrame) -> DataFrame:
    o = edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("out_degree"))
    i = edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("in_degree"))
    return o.join(i, "id", "full").select("id", F.coalesce("out_degree", F.lit(0)).alias("out_degree"), F.coalesce("in_degree", F.lit(0)).alias("in_degree"))


def common_neighbours(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, common, jaccard, adamic_adar) of the given pairs only: neighbours are joined along them, never all pairs."""
    s = symmetric(edges)
    d = s.groupBy("src").agg(F.count(F.lit(1)).alias("deg"))
    na = pairs.join(s.select(F.col("src").alias("a"), F.col("dst").alias("n")), "a")
    both = na.join(s.select(F.col("src").alias("b"), F.col("dst").alias("n")), ["b", "n"]).join(d.select(F.col("src").alias("n"), "deg"), "n")
    c = both.groupBy("a", "b").agg(F.count(F.lit(1)).alias("common"), F.sum(F.when(F.col("deg") > 1, 1 / F.ln("deg")).otherwise(0.0)).alias("adamic_adar"))
    x = pairs.join(c, ["a", "b"], "left").join(d.select(F.col("src").alias("a"), F.col("deg").alias("da")), "a", "left").join(d.select(F.col("src").alias("b"), F.col("deg").alias("db")), "b", "left")
    n = F.coalesce("common", F.lit(0))
    union = F.coalesce("da", F.lit(0)) + F.coalesce("db", F.lit(0)) - n
    return x.select("a", "b", n.alias("common"), F.when(union > 0, n / union).otherwise(1.0).alias("jaccard"), F.coalesce("adamic_adar", F.lit(0.0)).alias("adamic_adar"))


def neighbour_similarity(links: DataFrame, digits: int | None = None) -> DataFrame:
    """(a, b, common, jaccard) of every pair a < b of sources of directed links (src, dst) that share a target; jaccard with so many decimals.

    Links are dealt by ranges of sources into blocks of 1.5 million, packed
    and written to the shared folder. The blocks are dealt once into slots, and a
    task reads two slots (a Cartesian product of partitions, which ships nothing
    more) and counts those of their pairs whose ranges of targets meet. So neither
    the pairs nor copies of blocks lie on disk. The driver holds a number for each
    block. A source's links must fit in a task.
    """
    spark = links.sparkSession
    at = f"{shared_folder(spark)}/similarity-{uuid.uuid4().hex}"
    links.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").write.option("compression", "zstd").parquet(f"{at}/links")
    x = spark.read.parquet(f"{at}/links")
    n = x.count()
    source, target = x.schema["src"].dataType, x.schema["dst"].dataType
    blocks = StructType([StructField("first", source), StructField("low", target), StructField("high", target), StructField("links", LongType()), StructField("block", BinaryType())])
    form = to_arrow_schema(blocks)
    m = max(-(-n // overlaps.BLOCK), min(8, n // 16384), 1)
    x.repartitionByRange(m, "src").mapInArrow(lambda it: overlaps.pack(it, form), blocks).write.parquet(f"{at}/blocks")
    old = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/links")
    old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
    x = spark.read.parquet(f"{at}/blocks")
    known = sorted(r["first"] for r in x.select("first").collect())
    number = spark.createDataFrame(list(zip(known, range(len(known)))), StructType([StructField("first", source), StructField("i", IntegerType())]))
    # a task gets four pairs of blocks at most, as all of them may be in one Arrow batch
    p = max(-(-len(known) // SLOT), min(len(known), 3 * spark.sparkContext.defaultParallelism), 1)
    x = x.join(F.broadcast(number), "first").select("i", "low", "high", "block").repartitionById(p, F.col("i") % p)
    one, other = x.alias("one"), x.alias("other").hint("shuffle_replicate_nl")
    meet = (F.col("one.i") <= F.col("other.i")) & (F.col("one.low") <= F.col("other.high")) & (F.col("other.low") <= F.col("one.high"))
    y = one.join(other, meet).select(F.col("one.block").alias("one"), F.when(F.col("one.i") < F.col("other.i"), F.col("other.block")).alias("other"))
    out = StructType([StructField("a", source), StructField("b", source), StructField("common", LongType()), StructField("jaccard", DoubleType())])
    arrow = to_arrow_schema(out)
    return y.mapInArrow(lambda it: overlaps.pairs(it, arrow, digits), out)


def triangles(edges: DataFrame) -> DataFrame:
    """(id, triangles): edges point from lower to higher degree, so no node's wedges exceed the root of the number of edges."""
    d = degrees(edges)
    e = symmetric(edges).where("src < dst")
    e = e.join(d.select(F.col("id").alias("src"), F.col("degree").alias("ds")), "src").join(d.select(F.col("id").alias("dst"), F.col("degree").alias("dd")), "dst")
    up = (F.col("ds") < F.col("dd")) | ((F.col("ds") == F.col("dd")) & (F.col("src") < F.col("dst")))
    o = e.select(F.when(up, F.col("src")).otherwise(F.col("dst")).alias("x"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("y"))
    t = o.join(o.select("x", F.col("y").alias("z")), "x").where("y <> z").join(o.select(F.col("x").alias("y"), F.col("y").alias("z")), ["y", "z"])
    return t.select(F.explode(F.array("x", "y", "z")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("triangles"))


def clustering_coefficient(edges: DataFrame) -> DataFrame:
    d, t = degrees(edges), triangles(edges)
    pairs = F.col("degree") * (F.col("degree") - 1) / 2
    return d.join(t, "id", "left").select("id", F.when(pairs > 0, F.coalesce("triangles", F.lit(0)) / pairs).otherwise(0.0).alias("clustering"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component): the least id reachable. Each round takes the least label of a node's neighbours and jumps to that label's label."""
    s = cut(symmetric(edges))
    labels = cut(s.groupBy(F.col("src").alias("id")).agg(F.least(F.first("src"), F.min("dst")).alias("component")))
    while True:
        near = s.join(labels, s["dst"] == labels["id"]).groupBy("src").agg(F.min("component").alias("c"))
        new = labels.join(near, labels["id"] == near["src"], "left").select("id", F.least("component", F.coalesce("c", "component")).alias("component"))
        jump = new.select(F.col("id").alias("component"), F.col("component").alias("further"))
        new = cut(new.join(jump, "component", "left").select("id", F.least("component", F.coalesce("further", "component")).alias("component")))
        moved = new.join(labels.select("id", F.col("component").alias("old")), "id").where("component <> old").limit(1).count()
        labels = new
        if not moved:
            return labels


def label_propagation(edges: DataFrame, rounds: int) -> DataFrame:
    """(id, label) after synchronous rounds: the most frequent label of the neighbours, ties to the least."""
    s = cut(symmetric(edges))
    labels = s.select(F.col("src").alias("id")).distinct().withColumn("label", F.col("id"))
    for _ in range(rounds):
        votes = s.join(labels, s["dst"] == labels["id"]).groupBy("src", "label").agg(F.count(F.lit(1)).alias("n"))
        best = votes.groupBy(F.col("src").alias("id")).agg(F.min(F.struct((-F.col("n")).alias("m"), "label")).alias("b"))
        labels = cut(best.select("id", F.col("b.label").alias("label")))
    return labels


def k_core(edges: DataFrame, k: int) -> DataFrame:
    """Edges of the k-core, in both directions: nodes of degree under k go until none is left."""
    s = cut(symmetric(edges))
    while True:
        keep = s.groupBy("src").agg(F.count(F.lit(1)).alias("d")).where(F.col("d") >= k).select(F.col("src").alias("id"))
        left = cut(s.join(keep.withColumnRenamed("id", "src"), "src", "left_semi").join(keep.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst"))
        if left.count() == s.count():
            return left
        s = left


def pagerank(edges: DataFrame, rounds: int, damping: float = 0.85) -> DataFrame:
    """(id, rank) of a directed graph after `rounds` rounds; the rank of nodes without out-edges goes to all."""
    e = cut(edges.select("src", "dst").distinct())
    ids = cut(e.select(F.col("src").alias("id")).union(e.select(F.col("dst").alias("id"))).distinct())
    n = ids.count()
    out = cut(e.groupBy("src").agg(F.count(F.lit(1)).alias("o")))
    rank = ids.withColumn("rank", F.lit(1.0 / n))
    for _ in range(rounds):
        share = rank.join(out, rank["id"] == out["src"], "left")
        loose = share.where("o IS NULL").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
        gave = e.join(share.where("o IS NOT NULL").select("src", (F.col("rank") / F.col("o")).alias("s")), "src").groupBy(F.col("dst").alias("id")).agg(F.sum("s").alias("s"))
        rank = cut(ids.join(gave, "id", "left").select("id", ((1 - damping) / n + damping * (F.coalesce("s", F.lit(0.0)) + loose / n)).alias("rank")))
    return rank


def shortest_paths(edges: DataFrame, source, rounds: int) -> DataFrame:
    """(id, distance) over weighted directed edges from one source by at most `rounds` relaxations."""
    best = edges.sparkSession.createDataFrame([(source, 0.0)], f"id {edges.schema['src'].dataType.simpleString()}, distance double")
    for _ in range(rounds):
        step = edges.join(best, edges["src"] == best["id"]).select(F.col("dst").alias("id"), (F.col("distance") + F.col("weight")).alias("distance"))
        best = cut(best.union(step).groupBy("id").agg(F.min("distance").alias("distance")))
    return best


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Newman's modularity of labels (id, label); weights of one if there are none."""
    w = F.col("weight") if "weight" in edges.columns else F.lit(1.0)
    e = edges.select("src", "dst", w.alias("w"))
    m = e.agg(F.sum("w").alias("m"))
    a = e.join(labels.select(F.col("id").alias("src"), F.col("label").alias("ls")), "src").join(labels.select(F.col("id").alias("dst"), F.col("label").alias("ld")), "dst")
    inside = a.agg(F.coalesce(F.sum(F.when(F.col("ls") == F.col("ld"), F.col("w"))), F.lit(0.0)).alias("inside"))
    ends = a.select(F.col("ls").alias("label"), "w").union(a.select(F.col("ld").alias("label"), "w")).groupBy("label").agg(F.sum("w").alias("k"))
    return ends.crossJoin(m).agg(F.sum(F.pow(F.col("k") / (2 * F.col("m")), 2)).alias("e"), F.max("m").alias("m")).crossJoin(inside).select((F.col("inside") / F.col("m") - F.col("e")).alias("modularity"))


def density(edges: DataFrame) -> DataFrame:
    s = symmetric(edges)
    n = F.count_distinct("src")
    return s.agg((F.count(F.lit(1)) / (n * (n - 1))).alias("density"))


def earliest_arrival(links: DataFrame, source, start: float, rounds: int) -> DataFrame:
    """(id, arrival) over temporal links (src, dst, depart, arrive): a link is taken if its departure isn't before the arrival at src."""
    best = links.sparkSession.createDataFrame([(source, float(start))], f"id {links.schema['src'].dataType.simpleString()}, arrival double")
    for _ in range(rounds):
        step = links.join(best, links["src"] == best["id"]).where("depart >= arrival").select(F.col("dst").alias("id"), F.col("arrive").cast("double").alias("arrival"))
        best = cut(best.union(step).groupBy("id").agg(F.min("arrival").alias("arrival")))
    return best


def link_stream(links: DataFrame) -> DataFrame:
    """(a, b, contacts, duration, mean_gap) of undirected contacts (src, dst, start, end): gaps are from an end to the next start, where positive."""
    from pyspark.sql import Window

    p = links.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "start", "end")
    gap = F.lead("start").over(Window.partitionBy("a", "b").orderBy("start", "end")) - F.col("end")
    p = p.withColumn("gap", F.when(gap > 0, gap))
    return p.groupBy("a", "b").agg(F.count(F.lit(1)).alias("contacts"), F.sum(F.col("end") - F.col("start")).alias("duration"), F.avg("gap").alias("mean_gap"))


def random_walks(edges: DataFrame, walks: int, length: int, seed: int) -> DataFrame:
    """(walk, start, path): uniform walks from every node. The next node is the neighbour whose hash with walk and step is least, so it doesn't depend on the partitioning."""
    s = cut(symmetric(edges))
    w = s.select(F.col("src").alias("start")).distinct().withColumn("walk", F.explode(F.sequence(F.lit(1), F.lit(walks)))).select("walk", "start", F.array("start").alias("path"), F.col("start").alias("at"))
    for step in range(length - 1):
        pick = F.xxhash64(F.lit(seed), F.lit(step), "walk", "start", "dst")
        nxt = w.join(s, w["at"] == s["src"]).groupBy("walk", "start").agg(F.min(F.struct(pick.alias("h"), "dst")).alias("n"), F.first("path").alias("path"))
        w = cut(nxt.select("walk", "start", F.concat("path", F.array("n.dst")).alias("path"), F.col("n.dst").alias("at")))
    return w.select("walk", "start", "path")


def hits(edges: DataFrame, rounds: int) -> DataFrame:
    """(id, hub, authority), each of sum one, after `rounds` rounds."""
    e = cut(edges.select("src", "dst").distinct())
    ids = cut(e.select(F.col("src").alias("id")).union(e.select(F.col("dst").alias("id"))).distinct())
    hub = ids.withColumn("hub", F.lit(1.0))
    for _ in range(rounds):
        a = e.join(hub, e["src"] == hub["id"]).groupBy(F.col("dst").alias("id")).agg(F.sum("hub").alias("x"))
        auth = cut(a.crossJoin(F.broadcast(a.agg(F.sum("x").alias("t")))).select("id", (F.col("x") / F.col("t")).alias("authority")))
        h = e.join(auth, e["dst"] == auth["id"]).groupBy(F.col("src").alias("id")).agg(F.sum("authority").alias("x"))
        hub = cut(h.crossJoin(F.broadcast(h.agg(F.sum("x").alias("t")))).select("id", (F.col("x") / F.col("t")).alias("hub")))
    return ids.join(hub, "id", "left").join(auth, "id", "left").select("id", F.coalesce("hub", F.lit(0.0)).alias("hub"), F.coalesce("authority", F.lit(0.0)).alias("authority"))


def bfs(edges: DataFrame, source, rounds: int) -> DataFrame:
    """(id, depth) of nodes within `rounds` steps of the source."""
    s = cut(symmetric(edges))
    seen = edges.sparkSession.createDataFrame([(source, 0)], f"id {edges.schema['src'].dataType.simpleString()}, depth int")
    for d in range(1, rounds + 1):
        edge = seen.where(F.col("depth") == d - 1)
        new = s.join(edge, s["src"] == edge["id"], "left_semi").select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti").withColumn("depth", F.lit(d))
        seen = cut(seen.union(new))
    return seen
