"""Text functions on string and array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = "[A-Za-z]+"


def words(text: Column) -> Column:
    """Lower-case ASCII words."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))


def ngrams(tokens: Column, n: int) -> Column:
    """Runs of n tokens, joined by a space; empty if there are fewer."""
    last = F.greatest(F.size(tokens) - (n - 1), F.lit(0))
    out = F.slice(tokens, F.lit(1), last)
    for k in range(2, n + 1):  # shifted copies side by side
        out = F.zip_with(out, F.slice(tokens, F.lit(k), last), lambda x, y: F.concat(x, F.lit(" "), y))
    return out


def neighbours(tokens: Column) -> Column:
    """array<struct<a,b>> of each token and the next one."""
    last = F.greatest(F.size(tokens) - 1, F.lit(0))
    return F.zip_with(F.slice(tokens, F.lit(1), last), F.slice(tokens, F.lit(2), last), lambda x, y: F.struct(x.alias("a"), y.alias("b")))


def char_ngrams(text: Column, n: int) -> Column:
    last = F.length(text) - (n - 1)
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def skipgrams(tokens: Column, skip: int) -> Column:
    """Pairs of tokens with up to `skip` tokens between them."""
    n = F.size(tokens)
    pairs = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(skip + 1)), lambda d: F.when(n - d > 0, F.transform(F.sequence(F.lit(1), n - d), lambda i: F.concat_ws(" ", F.element_at(tokens, i), F.element_at(tokens, i + d)))).otherwise(F.array().cast("array<string>"))))
    return F.when(n > 1, pairs).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; two empty ones have similarity zero."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def dice(a: Column, b: Column) -> Column:
    total = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b))
    return F.when(total > 0, 2 * F.size(F.array_intersect(a, b)) / total).otherwise(0.0)


def overlap(a: Column, b: Column) -> Column:
    least = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(0.0)


def normalized_levenshtein(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest > 0, 1 - F.levenshtein(a, b) / longest).otherwise(1.0)


def clean(text: Column) -> Column:
    """Without tags, addresses and doubled white space."""
    out = F.regexp_replace(text, "<[^>]*>", " ")
    out = F.regexp_replace(out, "https?://[^ \\t\\n]+|[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+", " ")
    return F.trim(F.regexp_replace(out, "[ \\t\\n\\r]+", " "))


def count_matches(text: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def sentences(text: Column) -> Column:
    """Parts that end in a full stop, a question or an exclamation mark."""
    return F.filter(F.transform(F.split(text, "[.!?]+"), lambda s: F.trim(s)), lambda s: s != "")


def title_case(text: Column) -> Column:
    return F.initcap(text)


def syllables(word: Column) -> Column:
    """Vowel groups, one at least."""
    return F.greatest(count_matches(F.lower(word), "[aeiouy]+"), F.lit(1))
