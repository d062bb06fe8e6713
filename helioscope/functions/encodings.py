"""Integer encodings, sequence statistics and string tests as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def zigzag(x: Column) -> Column:
    """Signed to unsigned: 0, -1, 1, -2 become 0, 1, 2, 3."""
    x = x.cast("bigint")
    return F.shiftleft(x, 1).bitwiseXOR(F.shiftright(x, 63))


def unzigzag(z: Column) -> Column:
    return F.shiftrightunsigned(z, 1).bitwiseXOR(-(z.bitwiseAND(F.lit(1).cast("bigint"))))


def varint(x: Column) -> Column:
    """Binary: seven bits a byte, the lowest first, the high bit set on all but the last."""
    n = varint_length(x)
    parts = []
    for i in range(10):
        part = F.shiftrightunsigned(x, 7 * i).bitwiseAND(F.lit(127).cast("bigint")) + F.when(n > i + 1, 128).otherwise(0)
        parts.append(F.when(n > i, F.lpad(F.hex(part), 2, "0")).otherwise(""))
    return F.unhex(F.concat(*parts))


def varint_length(x: Column) -> Column:
    out = F.lit(1)
    for i in range(1, 10):
        out = out + F.when(F.shiftrightunsigned(x, 7 * i) != 0, 1).otherwise(0)
    return out


def unvarint(b: Column) -> Column:
    h = F.hex(b)
    digits = F.transform(F.sequence(F.lit(0), F.length(b) - 1), lambda i: F.conv(F.substring(h, 2 * i + 1, F.lit(2)), 16, 10).cast("bigint").bitwiseAND(F.lit(127).cast("bigint")))
    return F.aggregate(F.reverse(digits), F.lit(0).cast("bigint"), lambda s, d: F.shiftleft(s, 7).bitwiseOR(d))


def hamming(a: Column, b: Column) -> Column:
    """Places of two strings of one length that differ; null for other lengths."""
    chars = lambda s: F.filter(F.split(s, ""), lambda c: c != "")
    pairs = F.zip_with(chars(a), chars(b), lambda x, y: F.when(x != y, 1).otherwise(0))
    return F.when(F.length(a) == F.length(b), F.aggregate(pairs, F.lit(0), lambda s, v: s + v))


def jukes_cantor(p: Column) -> Column:
    """Substitutions a site of a share p of differing sites; null from 3/4 on."""
    return F.when(p < 0.75, -0.75 * F.ln(1 - 4 * p / 3))


def codons(sequence: Column) -> Column:
    """Triples from the first letter on; a rest is left out."""
    n = F.floor(F.length(sequence) / 3).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.upper(F.substring(sequence, 3 * i + 1, F.lit(3))))).otherwise(F.array().cast("array<string>"))


def whitespace_positions(text: Column) -> Column:
    """Zero-based places of white space."""
    return F.when(F.length(text) > 0, F.filter(F.sequence(F.lit(0), F.length(text) - 1), lambda i: F.substring(text, i + 1, F.lit(1)).rlike("^[ \\t\\n\\r]$"))).otherwise(F.array().cast("array<int>"))


def within_length(a: Column, b: Column, most: int) -> Column:
    return F.abs(F.length(a) - F.length(b)) <= most


def alphanumeric(text: Column) -> Column:
    return text.rlike("^[A-Za-z0-9]+$")


def find_all(text: Column, patterns: list[str]) -> dict[str, Column]:
    """How often each literal stands in the text, side by side."""
    return {p: (F.length(text) - F.length(F.replace(text, F.lit(p), F.lit("")))) / len(p) for p in patterns}
