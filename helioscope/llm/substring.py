"""Repeated word passages by prefix-partitioned suffix trees.

A window is `window` consecutive words of one document. `repeats` partitions
the suffixes: a group has those with one k-word prefix at their anchor, and
where that prefix is too common, those of one whole window. Each group's tree is
built top-down, level by level: the suffixes below a node are divided by their
next words, and a node that is left with one document is a leaf and is dropped.
Internal nodes at depth `window` are the repeated windows; extended to the
right and left along a document they are its maximal repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, slices
from .repeats import CROWD, U, Units, covered, keyed, ragged, repeated

WINDOW = 13
PREFIX = 5
CACHE = 400_000
#: Stands for a null doc_id inside: greater than every other.
LAST = 2**63 - 1


class Words(Units):
    content = U

    def __init__(self, window: int = WINDOW, k: int = PREFIX, crowd: int = CROWD):
        self.window, self.k, self.crowd = window, min(k, window), crowd
        self.cache: dict[bytes, int] = {}

    def __getstate__(self):
        return {"window": self.window, "k": self.k, "crowd": self.crowd, "cache": {}}

    def cut(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        own = [t.encode().split() for t in texts]  # bytes.split() parts at space and tab to carriage return
        words, cache = [w for o in own for w in o], self.cache
        if len(cache) > CACHE:
            cache.clear()
        digest = xxhash.xxh64_intdigest
        cache.update((w, digest(w)) for w in set(words).difference(cache))
        return np.fromiter(map(cache.__getitem__, words), U, len(words)), np.fromiter(map(len, own), np.int64, len(own))

    def _hash(self, units: np.ndarray, n: int, seed: int) -> np.ndarray:
        """A hash of units[i : i + n] at each i; the last places repeat the end."""
        padded = np.append(units, np.zeros(n - 1, units.dtype)).astype(U)
        h = np.full(len(units), seed, U)
        for j in range(n):
            h = (h ^ padded[j : j + len(units)]) * U(0x9E3779B97F4A7C15)
            h ^= h >> U(29)
        return h

    def grams(self, units: np.ndarray) -> np.ndarray:
        return mix64(self._hash(units, self.k, 1))

    def shipped(self, units: np.ndarray) -> np.ndarray:
        return units

    def digests(self, content: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        words = mix64(content + U(1))
        return mix64(self._hash(words, self.window, 2))[starts], mix64(self._hash(words, self.window, 3))[starts]


def tree_levels(content: np.ndarray, starts: np.ndarray, doc: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes at `starts` that lie below an internal node at `depth` with two documents or more, and the least document of each one's node.

    One level takes two words: a node's suffixes are ordered by (node, a mix of
    the next two words), and only nodes with two documents grow further. Where
    a node ends is told by the 64-bit words themselves.
    """
    alive, node, at = np.arange(len(starts)), np.zeros(len(starts), U), 0
    while len(alive) and at < depth:
        step = min(2, depth - at)
        nxt = content[starts[alive] + at]
        then = content[starts[alive] + at + step - 1]
        order = np.lexsort((mix64(nxt) + then * U(0x9E3779B97F4A7C15), node))
        node, nxt, then, alive = node[order], nxt[order], then[order], alive[order]
        first = np.flatnonzero(np.append(True, (node[1:] != node[:-1]) | (nxt[1:] != nxt[:-1]) | (then[1:] != then[:-1])))
        size = np.diff(np.append(first, len(alive)))
        low, high = np.minimum.reduceat(doc[alive], first), np.maximum.reduceat(doc[alive], first)
        grows = low < high
        keep = np.repeat(grows, size)
        alive, node = alive[keep], np.repeat(np.arange(int(grows.sum()), dtype=U), size[grows])
        least = np.repeat(low[grows], size[grows])
        at += step
    return alive, (least if len(alive) else np.zeros(0, np.int64))


def resolver(window: int):
    def resolve(x: dict[str, np.ndarray]) -> np.ndarray:
        """A flag for each window of these runs: another run has it in a document with a smaller id."""
        starts = ragged(x["at"], x["windows"])
        doc = np.repeat(x["doc"], x["windows"])
        flags = np.zeros(len(starts), bool)
        alive, least = tree_levels(x["content"], starts, doc, window)
        flags[alive] = doc[alive] > least
        return flags

    return resolve


def dedup(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, kept string, n_words, n_removed, removed array<struct<first:bigint,last:bigint>>) of each row.

    A word goes if a window that covers it also starts in a document with a
    smaller doc_id, judged on the input. kept joins the other words by one
    space; removed has the ranges of removed words. Rows that repeat a doc_id
    are one document in this: neither removes from the other. A null doc_id
    counts as greater than all others. Null and empty texts have no words.
    carry: columns of docs that come along.
    """
    units = Words(window, crowd=crowd)
    base = keyed(docs.withColumn(id_col, F.coalesce(F.col(id_col).cast("bigint"), F.lit(LAST))), id_col, text_col, carry)
    spans = repeated(base.select("doc_id", "text", "row"), units, False, resolver(window), resolver(window), True)
    carried = [f"carried_{i}" for i in range(len(carry))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
        for batch in slices(batches):
            kept, sizes, gone, where = [], [], [], []
            for text, blobs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = text.encode().split()
                sizes.append(len(words))
                if not blobs:
                    kept.append(b" ".join(words).decode())
                    gone.append(0)
                    where.append([])
                    continue
                off = covered(blobs, len(words), window)
                edges = np.flatnonzero(np.diff(np.concatenate([[0], off.view(np.int8), [0]]))).reshape(-1, 2)
                kept.append(b" ".join([w for w, x in zip(words, off.tolist()) if not x]).decode())
                gone.append(int(off.sum()))
                where.append([{"first": a, "last": b - 1} for a, b in edges.tolist()])
            ids = batch.column(0)
            ids = pa.array([None if i == LAST else i for i in ids.to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array(kept, pa.string()), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(where, ranges), *batch.columns[3:]], ["doc_id", "kept", "n_words", "n_removed", "removed", *carried])

    joined = base.join(spans, "row", "left").select("doc_id", "text", "spans", *carried)
    schema = "doc_id bigint, kept string, n_words bigint, n_removed bigint, removed array<struct<first:bigint,last:bigint>>"
    schema += "".join(f", {f.name} {f.dataType.simpleString()}" for f in base.select(*carried).schema) if carried else ""
    out = joined.mapInArrow(run, schema)
    return out.select("doc_id", "kept", "n_words", "n_removed", "removed", *(F.col(a).alias(b) for a, b in zip(carried, carry)))


def digests(found: DataFrame) -> DataFrame:
    """The columns of the query op5."""
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
