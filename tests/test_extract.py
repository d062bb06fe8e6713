"""Entities and expressions of time against Python's regular expressions."""

import re

from pyspark.sql import functions as F

from helioscope.functions import extract

TEXTS = [
    None,
    "",
    "nothing here",
    "Yesterday 12:30 - 13:45, then 3 days later: next Friday; Christmas and NEW YEAR, last week",
    "mail a.b@c.org or x@y.co.uk, see https://www.a-b.org/x?y=1#z and http://q.io on 2024-05-06 or 5 March 2021 or 12/31/99",
    "pay $ 1,200.50 or 30 euros, 12%x of it; call +1 (555) 123-4567 at 9:05 pm",
    "été 5 jours, 7 weeks — summer",
    "2 days " * 3000,
]


def found(text, patterns, prefix=""):
    return [(prefix + k, m.group(), m.start(), m.end()) for k, p in patterns.items() for m in re.finditer(p, text or "")]


def test_matches_and_their_places(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, text string")
    rows = df.select("i", extract.entities(F.col("text")).alias("e"), extract.temporal(F.col("text")).alias("t")).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        assert [tuple(x) for x in r["e"]] == found(TEXTS[r["i"]], extract.ENTITIES)
        assert [tuple(x) for x in r["t"]] == found(TEXTS[r["i"]], extract.TEMPORAL, "temporal_")
    assert df.limit(0).select(extract.entities(F.col("text"))).count() == 0
