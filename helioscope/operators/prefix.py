"""Running sums over a whole table without one task for all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helioscope.operators.graph import cut


def running(df: DataFrame, value: str, columns: list[str], descending: bool = False) -> DataFrame:
    """df with run_c, the sum of c up to and with this row in the order of `value`, and total_c, for each of `columns`.

    Rows are cut into ranges of `value`, checkpointed so that the ranges stay
    as they are; each range sums by itself, and starts from the sums of the
    ranges before it, which are one row a range. `value` should be distinct.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = F.desc(value) if descending else F.asc(value)
    parts = cut(df.repartitionByRange(n, order).withColumn("_part", F.spark_partition_id()))
    sums = parts.groupBy("_part").agg(*[F.sum(c).alias(f"_s_{c}") for c in columns])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    starts = sums.select("_part", *[F.coalesce(F.sum(f"_s_{c}").over(before), F.lit(0)).alias(f"_b_{c}") for c in columns], *[F.sum(f"_s_{c}").over(whole).alias(f"total_{c}") for c in columns])
    own = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = parts.join(starts, "_part").withColumns({f"run_{c}": F.col(f"_b_{c}") + F.sum(c).over(own) for c in columns})
    return out.drop("_part", *[f"_b_{c}" for c in columns])


def quantiles(df: DataFrame, value: str, qs: dict[str, float], by: list[str] = ()) -> DataFrame:
    """(by, a column for each of qs): exact quantiles, linear between the neighbours at q * (n - 1); nulls are left out.

    Values are counted, and the counts summed over ranges of (by, value), so no
    task holds a group's values; then two neighbours are picked by their places.
    """
    keys = [F.col(c).alias(f"_g{i}") for i, c in enumerate(by)]
    names = [f"_g{i}" for i in range(len(by))]
    c = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    r = running(c.withColumn("_key", F.struct(*names, "_v")), "_key", ["_n"])
    g = r.groupBy(*(F.col(k).alias(f"_h{k}") for k in names)).agg(F.min(F.col("run__n") - F.col("_n")).alias("_start"), F.sum("_n").alias("_all"))
    same = F.lit(True)
    for k in names:
        same = same & F.col(k).eqNullSafe(F.col(f"_h{k}"))
    x = r.join(g, same).select(*names, "_v", "_all", (F.col("run__n") - F.col("_n") - F.col("_start")).alias("_lo"), (F.col("run__n") - F.col("_start")).alias("_hi"))

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("_lo") <= place) & (place < F.col("_hi")), F.col("_v")))

    out = []
    for name, q in qs.items():
        t = q * (F.col("_all") - 1)
        low, high = at(F.floor(t)), at(F.ceil(t))
        out.append((low + (high - low) * (F.max(t) - F.max(F.floor(t)))).alias(name))
    found = x.groupBy(*names).agg(*out)
    return found.select(*(F.col(k).alias(b) for k, b in zip(names, by)), *qs)


def lagged(df: DataFrame, columns: list[str], order: str, prefix: str = "last_") -> DataFrame:
    """df with the columns of the row before, in the order of `order` (distinct) over the whole table: ranges, and one row carried from range to range."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = cut(df.repartitionByRange(n, order).withColumn("_part", F.spark_partition_id()))
    last = parts.groupBy("_part").agg(F.max_by(F.struct(*columns), F.col(order)).alias("_l"))
    carried = last.select("_part", F.lag("_l").over(Window.orderBy("_part")).alias("_c"))
    own = Window.partitionBy("_part").orderBy(order)
    first = F.row_number().over(own) == 1
    x = parts.join(carried, "_part").withColumns({f"{prefix}{c}": F.when(first, F.col("_c")[c]).otherwise(F.lag(c).over(own)) for c in columns})
    return x.drop("_part", "_c")


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with its row number from zero, in an order of distinct keys."""
    x = df.withColumns({"_key": F.struct(*[o.alias(f"k{i}") for i, o in enumerate(order)]), "_one": F.lit(1)})
    x = running(x, "_key", ["_one"])
    return x.withColumn(name, (F.col("run__one") - 1).cast("bigint")).drop("_key", "_one", "run__one", "total__one")
