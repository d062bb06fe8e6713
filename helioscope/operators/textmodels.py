"""Text operators beyond expressions: Arrow-batched where a recurrence over characters is needed, columns elsewhere."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType

from helioscope.functions import text as T
from helioscope.operators.prefix import numbered

#: Strings of a lower-cased text that tell its domain. The first domain in this order counts.
DOMAINS = {
    "legal": ["whereas", "liability", "contract"],
    "medical": ["patient", "diagnosis", "medication"],
    "financial": ["revenue", "profit", "investment"],
    "patent": ["claim", "invention", "patent"],
    "news": ["breaking", "according to", "officials"],
    "social_media": ["#", "@"],
}
#: The domain of all other texts (a fixed value).
DOMAIN_ELSE = "scientific"


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


@F.pandas_udf(StringType())
def without_diacritics(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.combining(c)))


def _osa(a: str, b: str) -> int:
    """Edits with transpositions of neighbours."""
    before, last, now = None, list(range(len(b) + 1)), None
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            v = min(last[j] + 1, now[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before[j - 2] + 1)
            now.append(v)
        before, last = last, now
    return last[-1]


@F.pandas_udf(IntegerType())
def transposition_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else _osa(x, y) for x, y in zip(a, b)], dtype="Int32")


def _lcs(a: list[str], b: list[str]) -> int:
    row = np.zeros(len(b) + 1, np.int64)
    codes = {w: i for i, w in enumerate(b)}
    y = np.array([codes[w] for w in b])
    for w in a:
        hit = np.zeros(len(b), bool) if w not in codes else y == codes[w]
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], np.where(hit, row[:-1] + 1, 0)))
    return int(row[-1])


@F.pandas_udf(IntegerType())
def lcs_length(a: pd.Series, b: pd.Series) -> pd.Series:
    """Longest common subsequence of two arrays of words."""
    return pd.Series([None if x is None or y is None else _lcs(list(x), list(y)) for x, y in zip(a, b)], dtype="Int32")


def rouge(hits: Column, candidate: Column, reference: Column) -> Column:
    """struct<precision,recall,f1>; two empty sides score one."""
    both = (candidate == 0) & (reference == 0)
    p, r = F.when(both, 1.0).otherwise(F.coalesce(F.try_divide(hits, candidate), F.lit(0.0))), F.when(both, 1.0).otherwise(F.coalesce(F.try_divide(hits, reference), F.lit(0.0)))
    return F.struct(p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"))


def rouge_n(candidate: Column, reference: Column, n: int) -> Column:
    """Clipped n-gram overlap of two arrays of words."""
    a, b = T.ngrams(candidate, n), T.ngrams(reference, n)
    count = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    hits = F.aggregate(F.array_distinct(a), F.lit(0), lambda s, g: s + F.least(count(a, g), count(b, g)))
    return rouge(hits, F.size(a), F.size(b))


def rouge_l(candidate: Column, reference: Column) -> Column:
    return rouge(lcs_length(candidate, reference), F.size(candidate), F.size(reference))


def domain(text: Column) -> Column:
    low, out = F.lower(text), None
    for name, keys in DOMAINS.items():
        hit = F.lit(False)
        for k in keys:
            hit = hit | low.contains(k)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(DOMAIN_ELSE)


def char_cosine(a: Column, b: Column) -> Column:
    """Cosine of character counts; one empty side gives zero, two give one."""
    chars = lambda s: F.filter(F.split(s, ""), lambda c: c != "")
    x, y = chars(a), chars(b)
    count = lambda xs, c: F.size(F.filter(xs, lambda d: d == c)).cast("double")
    dot = lambda p, q: F.aggregate(F.array_distinct(p), F.lit(0.0), lambda s, c: s + count(p, c) * count(q, c))
    n = F.sqrt(dot(x, x) * dot(y, y))
    return F.when((F.size(x) == 0) & (F.size(y) == 0), 1.0).when(n > 0, dot(x, y) / n).otherwise(0.0)


def occurrences(text: Column, pattern: str) -> Column:
    """Zero-based starts of all matches of a literal, overlapping ones too."""
    last = F.length(text) - len(pattern)
    return F.when(last >= 0, F.filter(F.sequence(F.lit(0), last), lambda i: F.substring(text, i + 1, F.lit(len(pattern))) == pattern)).otherwise(F.array().cast("array<int>")) if pattern else F.array().cast("array<int>")


def kmers(df: DataFrame, sequence: str, k: int, by: list[str]) -> DataFrame:
    """(by, kmer, n, share)."""
    g = df.select(*by, F.explode(T.char_ngrams(F.col(sequence), k)).alias("kmer")).groupBy(*by, "kmer").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))


def vocabulary(df: DataFrame, tokens: str, least: int = 1, most: int | None = None) -> DataFrame:
    """(token, n, index): by falling count, ties by token."""
    c = df.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    v = numbered(c, [-F.col("n"), F.col("token")], "index").withColumn("index", F.col("index").cast("int"))
    return v.where(F.col("index") < most) if most is not None else v


def viterbi(df: DataFrame, tokens: str, start: dict[str, float], move: dict[tuple[str, str], float], emit: dict[tuple[str, str], float], floor: float = 1e-12) -> DataFrame:
    """Adds tags: the most likely path of a hidden Markov model for each row's array of tokens."""
    states = list(start)
    s = np.log([start[x] for x in states])
    m = np.log([[move.get((a, b), floor) for b in states] for a in states])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            tags = []
            for words in pdf[tokens]:
                if words is None or not len(words):
                    tags.append([])
                    continue
                e = np.log([[emit.get((x, w), floor) for x in states] for w in words])
                score, back = s + e[0], []
                for row in e[1:]:
                    via = score[:, None] + m
                    back.append(via.argmax(0))
                    score = via.max(0) + row
                path = [int(score.argmax())]
                for b in reversed(back):
                    path.append(int(b[path[-1]]))
                tags.append([states[i] for i in reversed(path)])
            yield pdf.assign(tags=tags)

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInPandas(run, f"{kind}, tags array<string>")


def parse_logs(df: DataFrame, line: str) -> DataFrame:
    """(ts, level, logger, message, fields map) of lines "time LEVEL logger: message key=value ..."; lines of another form have nulls."""
    p = r"^(\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(?:\.\d+)?Z?)\s+(TRACE|DEBUG|INFO|WARN|ERROR|FATAL)\s+([^:\s]+):\s*(.*)$"
    part = lambda i: F.nullif(F.regexp_extract(line, p, i), F.lit(""))
    pairs = F.regexp_extract_all(F.col(line), F.lit(r"(\w+)=(\S+)"), F.lit(0))
    fields = F.map_from_entries(F.transform(pairs, lambda s: F.struct(F.split_part(s, F.lit("="), F.lit(1)), F.split_part(s, F.lit("="), F.lit(2)))))
    return df.select(F.try_to_timestamp(part(1)).alias("ts"), part(2).alias("level"), part(3).alias("logger"), part(4).alias("message"), fields.alias("fields"))
