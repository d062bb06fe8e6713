"""Packing token sequences by cutting-stock column generation.

Every document becomes ids and an end id. Whole runs of `capacity` ids are
sequences of their own; what remains is an item whose length is rounded up to
a multiple of `width`. The histogram of these lengths (at most capacity /
width numbers, whatever the input) is the demand of a cutting-stock problem:
a revised simplex solves the linear program over patterns, and a knapsack
dynamic program prices the next pattern. The pattern counts are rounded down,
the few items left over are packed by best fit, and the documents, ranked
within their length, are dealt to the patterns' places. Ranks come from counts
by input partition and length, so no length, however common, meets in a task.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import SPACE, ByteBPE
from .common import slices, texts_of, written

CAPACITY = 4096
WIDTH = 8
END = 2
CACHE = 800_000
CHUNK = re.compile(f"[^{SPACE}]+")
BEYOND = re.compile("[^\x00-\xff]").search
#: Lower-case letters and digits of Latin-1 by their Unicode categories.
LETTER, DIGIT = ("".join(chr(c) for c in range(256) if unicodedata.category(chr(c))[0] == k and chr(c).lower() == chr(c)) for k in "LN")
#: The pre-tokeniser's pattern for lower-case Latin-1 text.
PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{DIGIT}]|[^{SPACE}{LETTER}{DIGIT}]+").findall


class WordIds:
    """Ids as the tokenizers library gives them.

    Texts of Latin-1 characters, which its normaliser only lower-cases, are cut
    by the vocabulary's pattern, and the segment tree of `bpe` encodes each
    distinct piece once; other texts go through the library, once for each
    distinct run without white space, as this vocabulary's tokens cross none.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = ByteBPE(path)
        self.cache: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _plain(self, texts: list[str]) -> list[bytes]:
        cut = [PIECES(t.lower()) for t in texts]
        seen, words = set().union(*cut), self.words
        if len(words) + len(seen) > CACHE:
            words.clear()
        words.update(self.model.learn(list(seen.difference(words))))
        get = words.__getitem__
        return [b"".join(map(get, c)) for c in cut]

    def _other(self, texts: list[str]) -> list[bytes]:
        cut = [CHUNK.findall(t) for t in texts]
        seen, cache = set().union(*cut), self.cache
        if len(cache) + len(seen) > CACHE:
            cache.clear()
        fresh = list(seen.difference(cache))
        for a in range(0, len(fresh), 20_000):
            part = fresh[a : a + 20_000]
            for c, e in zip(part, self.tokenizer.encode_batch(part, add_special_tokens=False)):
                cache[c] = np.array(e.ids, "<u4").tobytes()
        get = cache.__getitem__
        return [b"".join(map(get, c)) for c in cut]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian uint32."""
        plain = [(t.isascii() or BEYOND(t) is None) and "<|" not in t for t in texts]
        a, b = (iter(f([t for t, p in zip(texts, plain) if p == want])) for f, want in ((self._plain, True), (self._other, False)))
        return [next(a if p else b) for p in plain]


@lru_cache(maxsize=2)
def tokens(path: str) -> WordIds:
    return WordIds(path)


def knapsack(value: np.ndarray, size: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of items within the capacity: its value and counts. Sizes are distinct and rising."""
    best = np.zeros(capacity + 1)
    took = np.full(capacity + 1, -1)
    upto = np.searchsorted(size, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        k = upto[c]
        if k:
            got = best[c - size[:k]] + value[:k]
            i = int(got.argmax())
            if got[i] > best[c] + 1e-12:
                best[c], took[c] = got[i], i
    counts, c = np.zeros(len(size), np.int64), capacity
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            counts[took[c]] += 1
            c -= int(size[took[c]])
    return float(best[capacity]), counts


def column_generation(size: np.ndarray, demand: np.ndarray, capacity: int, most: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (rows) and how often each is used, in the linear program's optimum: least patterns that meet the demand."""
    n = len(size)
    columns = [np.where(np.arange(n) == i, capacity // size[i], 0) for i in range(n)]
    basis = np.array(columns, np.float64).T
    inverse = np.diag(1 / np.diag(basis))
    x = inverse @ demand
    for _ in range(most):
        gain, pattern = knapsack(inverse.sum(0), size, capacity)  # all costs are one
        if gain <= 1 + 1e-7:
            break
        way = inverse @ pattern
        ok = way > 1e-9
        ratio = np.where(ok, x / np.where(ok, way, 1), np.inf)
        out = int(ratio.argmin())
        step = ratio[out]
        x = np.maximum(x - step * way, 0)
        x[out] = step
        row = inverse[out] / way[out]
        inverse -= np.outer(way, row)
        inverse[out] = row
        columns[out] = pattern
    return np.array(columns), x


def best_fit(left: np.ndarray, size: np.ndarray, capacity: int) -> list[np.ndarray]:
    """Patterns for the items left over, the longest first, each into the fullest pattern that has room."""
    open_by: list[list[np.ndarray]] = [[] for _ in range(capacity + 1)]  # by room
    out: list[np.ndarray] = []
    for i in np.argsort(-size, kind="stable").tolist():
        s = int(size[i])
        for _ in range(int(left[i])):
            room = next((r for r in range(s, capacity + 1) if open_by[r]), None)
            if room is None:
                p, room = np.zeros(len(size), np.int64), capacity
                out.append(p)
            else:
                p = open_by[room].pop()
            p[i] += 1
            open_by[room - s].append(p)
    return out


def solve(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(items of each size in a pattern, uses of the pattern) that hold the whole histogram {size: count}."""
    if not histogram:
        return []
    size = np.array(sorted(histogram))
    demand = np.array([histogram[s] for s in size.tolist()], np.int64)
    patterns, x = column_generation(size, demand.astype(np.float64), capacity)
    uses = np.floor(x + 1e-9).astype(np.int64)
    left = demand - uses @ patterns
    while (left < 0).any():  # float error only
        uses[np.flatnonzero(uses)[0]] -= 1
        left = demand - uses @ patterns
    total = Counter({tuple(p): int(u) for p, u in zip(patterns.tolist(), uses.tolist()) if u})
    total.update(tuple(p.tolist()) for p in best_fit(left, size, capacity))
    return [({int(size[i]): c for i, c in enumerate(p) if c}, u) for p, u in total.items()]


def places(solution: list[tuple[dict[int, int], int]], whole: int) -> dict[str, np.ndarray]:
    """Runs of ranks: from rank lo on, items of this size go `each` to a sequence, from sequence `first` on, from slot `slot` on. Size 0: whole sequences."""
    runs = [(0, 0, 1, 0, 0)] if whole else []
    rank: Counter[int] = Counter()
    first = whole
    for pattern, uses in solution:
        slot = 0
        for s, c in sorted(pattern.items(), reverse=True):
            runs.append((s, rank[s], c, first, slot))
            rank[s] += c * uses
            slot += c
        first += uses
    runs.sort()
    return dict(zip(("size", "lo", "each", "first", "slot"), np.array(runs, np.int64).reshape(-1, 5).T))


def pieces_of(docs: DataFrame, tokenizer_path: str, capacity: int, width: int, end: int, keep_ids: bool, id_col: str, text_col: str) -> DataFrame:
    """A row for each piece, its size class, and its number within the input partition and class."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "size", "part", "nth"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, part, counts = tokens(tokenizer_path), TaskContext.get().partitionId(), Counter()
        tail = np.uint32(end).astype("<u4").tobytes()
        for batch in slices(batches):
            rows, kept = [], []
            for doc, ids in zip(batch.column(0).to_pylist(), model.encode(batch.column(1).to_pylist())):
                ids += tail
                n = len(ids) // 4
                for a in range(0, n, capacity):
                    own = ids[4 * a : 4 * (a + capacity)]
                    m = len(own) // 4
                    s = 0 if m == capacity else -(-m // width)
                    rows.append((doc, a, m, zlib.crc32(own), n, s, part, counts[s]))
                    counts[s] += 1
                    if keep_ids:
                        kept.append(np.frombuffer(own, "<u4").astype(np.int32))
            columns = [pa.array(c, pa.int64()) for c in zip(*rows)]
            if keep_ids:
                columns.append(pa.array(kept, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names + ["ids"] * keep_ids)

    schema = ", ".join(f"{n} bigint" for n in names) + ", ids array<int>" * keep_ids
    return texts_of(docs, id_col, text_col).mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, width: int = WIDTH, end: int = END, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]): a row for each piece.

    Each id of a document, and `end` behind them, lies in one piece. A null or
    empty text is the end id alone. Rows with the same or a null doc_id are
    packed as documents of their own. An empty table gives no rows. The driver
    gets the histogram of lengths only.
    """
    pieces = written(pieces_of(docs, tokenizer_path, capacity, width, end, keep_ids, id_col, text_col), "packing")
    counts = pieces.groupBy("part", "size").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["size"]: r["n"] for r in counts.groupBy("size").agg(F.sum("n").alias("n")).collect()}
    whole = histogram.pop(0, 0)
    plan = places(solve(histogram, capacity // width), whole)
    before = Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", "size", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = pieces.join(offsets, ["part", "size"]).withColumn("rank", F.col("before") + F.col("nth"))
    keep = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * keep_ids]
    bits = np.int64(1 << 40)
    starts = plan["size"] * bits + plan["lo"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("size", "rank"))
            run = np.searchsorted(starts, size * bits + rank, "right") - 1
            past, each = rank - plan["lo"][run], plan["each"][run]
            own = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*own, pa.array(plan["first"][run] + past // each), pa.array(plan["slot"][run] + past % each)], [*keep, "sequence_id", "slot"])

    schema = ", ".join(f"{c} bigint" for c in keep if c != "ids") + ", ids array<int>" * keep_ids + ", sequence_id bigint, slot bigint"
    dealt = ranked.mapInArrow(deal, schema)
    ahead = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return dealt.select(*keep[:5], "sequence_id", F.coalesce(F.sum("length").over(ahead), F.lit(0)).alias("offset"), *keep[5:])
