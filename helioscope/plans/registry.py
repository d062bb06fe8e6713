"""Queries over the driver tables by name, with the SQL that gives the same rows.

Each query runs one operator of the library over its whole tables. Floating
results are rounded on both sides, so that the order of summation can't show.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def rounded(**columns: Column) -> list[Column]:
    from pyspark.sql import functions as F

    return [F.round(c, 6).alias(name) for name, c in columns.items()]


from helioscope.plans import evaluation, graphs, hypotheses, more, relational, shapes, signals, statistics, streams, structures, texts  # noqa: E402, F401
