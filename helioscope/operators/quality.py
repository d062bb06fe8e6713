"""Schema validation and data-quality reports, each one aggregate over the table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from helioscope.operators.prefix import quantiles


def report(df: DataFrame, ranges: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """(column, n, nulls, distinct_values, below, above) of the columns, with their allowed ranges, from one pass."""
    cells = []
    for c, (low, high) in ranges.items():
        x = F.col(c)
        below = F.count_if(x < low) if low is not None else F.lit(0).cast("bigint")
        above = F.count_if(x > high) if high is not None else F.lit(0).cast("bigint")
        cells.append(F.struct(F.lit(c).alias("column"), F.count(F.lit(1)).alias("n"), F.count_if(x.isNull()).alias("nulls"), F.count_distinct(x).alias("distinct_values"), below.alias("below"), above.alias("above")))
    return df.agg(F.array(*cells).alias("r")).select(F.inline("r"))


def violations(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """(rule, violations): rows where a rule's SQL condition is false or null."""
    cells = [F.struct(F.lit(k).alias("rule"), F.count_if(~F.coalesce(F.expr(v), F.lit(False))).alias("violations")) for k, v in rules.items()]
    return df.agg(F.array(*cells).alias("r")).select(F.inline("r"))


def schema_errors(found: StructType, wanted: StructType) -> list[str]:
    """What found lacks of wanted: missing columns, other types (unless they widen), nulls where none are allowed."""
    wider = {("int", "bigint"), ("smallint", "int"), ("smallint", "bigint"), ("float", "double"), ("int", "double"), ("date", "timestamp")}
    own = {f.name: f for f in found}
    out = []
    for f in wanted:
        if f.name not in own:
            out.append(f"missing: {f.name}")
            continue
        a, b = own[f.name].dataType.simpleString(), f.dataType.simpleString()
        if a != b and (a, b) not in wider:
            out.append(f"type of {f.name}: {a} instead of {b}")
        if own[f.name].nullable and not f.nullable:
            out.append(f"nullable: {f.name}")
    return out


def outliers(df: DataFrame, value: str, by: list[str], whisker: float = 1.5) -> DataFrame:
    """Rows beyond the box-plot fences of their group."""
    q = quantiles(df, value, {"_q1": 0.25, "_q3": 0.75}, by)
    span = (F.col("_q3") - F.col("_q1")) * whisker
    return df.join(q, by).where((F.col(value) < F.col("_q1") - span) | (F.col(value) > F.col("_q3") + span)).drop("_q1", "_q3")
