"""Entities and expressions of time in texts, by patterns, with their places."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns that define each kind.
ENTITIES = {
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "url": r"https?://(?:www\.)?[-a-zA-Z0-9@:%._\+~#=]{1,256}\.[a-zA-Z0-9()]{1,6}\b(?:[-a-zA-Z0-9()@:%_\+.~#?&/=]*)",
    "phone": r"(?:\+?1[-.\s]?)?\(?([0-9]{3})\)?[-.\s]?([0-9]{3})[-.\s]?([0-9]{4})",
    "date": r"\b(?:(?:0?[1-9]|1[0-2])[/-](?:0?[1-9]|[12][0-9]|3[01])[/-](?:19|20)?\d{2})|(?:(?:19|20)\d{2}[/-](?:0?[1-9]|1[0-2])[/-](?:0?[1-9]|[12][0-9]|3[01]))"
    r"|(?:(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},?\s+\d{4})|(?:\d{1,2}\s+(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{4})\b",
    "time": r"\b(?:[01]?[0-9]|2[0-3]):[0-5][0-9](?::[0-5][0-9])?(?:\s*[aApP][mM])?\b",
    "money": r"[$€£¥]\s*\d+(?:,\d{3})*(?:\.\d{1,2})?|\d+(?:,\d{3})*(?:\.\d{1,2})?\s*(?:dollars?|euros?|pounds?|yen)",
    "percentage": r"\b\d+(?:\.\d+)?%\b",
}
TEMPORAL = {
    "relative_date": r"(?i)\b(?:yesterday|today|tomorrow|last|next|this)\s+(?:week|month|year|monday|tuesday|wednesday|thursday|friday|saturday|sunday)\b",
    "time_range": r"(?i)\b(?:[01]?[0-9]|2[0-3]):[0-5][0-9]\s*-\s*(?:[01]?[0-9]|2[0-3]):[0-5][0-9]\b",
    "duration": r"(?i)\b(?:\d+)\s+(?:seconds?|minutes?|hours?|days?|weeks?|months?|years?)\b",
    "seasonal": r"(?i)\b(?:spring|summer|fall|autumn|winter|christmas|thanksgiving|easter|halloween|new year)\b",
}


def matches(text: Column, pattern: str, kind: str) -> Column:
    """array<struct<kind, text, first, last>> of what a pattern finds, left to right without overlaps; first is the place of the first character from zero, last that of the one behind. Null texts have none.

    Word edges, digits and white space are those of Unicode. The places are
    sums over the pieces between the finds, so the pattern must not match an
    empty string.
    """
    regex = F.lit("(?U)" + pattern)
    whole = F.coalesce(text, F.lit(""))
    found, between = F.regexp_extract_all(whole, regex, F.lit(0)), F.split(whole, "(?U)" + pattern, -1)
    empty = F.array().cast("array<struct<kind:string,text:string,first:int,last:int>>")

    def put(own: Column, pair: Column) -> Column:
        first = own["at"] + F.length(pair["gap"])
        last = first + F.length(pair["hit"])
        return F.struct(F.array_append(own["out"], F.struct(F.lit(kind).alias("kind"), pair["hit"].alias("text"), first.alias("first"), last.alias("last"))).alias("out"), last.alias("at"))

    pairs = F.zip_with(found, F.slice(between, 1, F.size(found)), lambda hit, gap: F.struct(hit.alias("hit"), gap.alias("gap")))
    fold = F.aggregate(pairs, F.struct(empty.alias("out"), F.lit(0).alias("at")), put, lambda own: own["out"])
    return F.when(F.size(found) > 0, fold).otherwise(empty)


def entities(text: Column) -> Column:
    """All kinds of ENTITIES, one after the other; finds of different kinds may overlap."""
    return F.concat(*(matches(text, p, k) for k, p in ENTITIES.items()))


def temporal(text: Column) -> Column:
    """All kinds of TEMPORAL, one after the other."""
    return F.concat(*(matches(text, p, f"temporal_{k}") for k, p in TEMPORAL.items()))
