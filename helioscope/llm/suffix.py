"""Repeated byte strings by two-stage suffix sorting.

`repeats` brings the runs of windows that share an anchor to a bucket. There
the distinct runs of anchors with several are joined to texts of bounded size
and their suffixes are sorted in two stages: only suffixes smaller than their
successors are sorted directly; all others are induced by scanning the buckets
of first bytes in rising order, each sorted bucket handing its members'
predecessors to the buckets of their first bytes. Common prefixes of adjacent
suffixes then tell the windows that stand more than once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, slices
from .repeats import U, Units, covered, keyed, ragged, repeated, twins

WINDOW = 400
GRAM = 96
CROWD = 20_000
#: Bytes of distinct runs that are sorted together, whole groups of an anchor.
TEXT = 1 << 18
#: Bytes of sort keys that are held at once.
KEYS = 64 << 20
#: Never a byte of UTF-8, so it parts runs.
PART = 0xFF


def _pair(a: np.ndarray, b: np.ndarray, seed: int) -> np.ndarray:
    h = (a * U(0x9E3779B97F4A7C15) + U(seed)) ^ (b * U(0xC2B2AE3D27D4EB4F))
    h ^= h >> U(32)
    return h * U(0x165667B19E3779F9)


def _doubled(data: np.ndarray, seed: int) -> Iterator[tuple[int, np.ndarray]]:
    """(length, hashes of that many bytes at each place) for 8, 16, 32 ... bytes; places past the end read zeros."""
    padded = np.append(data, np.zeros(7, data.dtype)).astype(U)
    h = padded[: len(data)].copy()
    for j in range(1, 8):
        h = h << U(8) | padded[j : j + len(data)]
    n = 8
    while True:
        yield n, h
        far = np.append(h[n:], np.zeros(min(n, len(h)), U))[: len(h)]
        h = _pair(h, far, seed + n)
        n *= 2


class Bytes(Units):
    content = np.uint8
    slice_bytes = 1 << 20  # hashes of every place take 8 bytes each, several times over

    def __init__(self, window: int = WINDOW, k: int = GRAM, crowd: int = CROWD):
        self.window, self.k, self.crowd = window, min(k, window), crowd

    def cut(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        own = [t.encode() for t in texts]
        return np.frombuffer(b"".join(own), np.uint8), np.fromiter(map(len, own), np.int64, len(own))

    def _hash(self, data: np.ndarray, n: int, seed: int) -> np.ndarray:
        """Hashes of n bytes at each place, put together from powers of two of at least eight, the last overlapping, or byte by byte."""
        if n < 8:
            out = np.zeros(len(data), U)
            for j in range(n):
                out = out << U(8) | np.append(data[j:], np.zeros(j, data.dtype)).astype(U)
            return out + U(seed)
        out, at = None, 0
        parts = []
        for size, h in _doubled(data, seed):
            if size > n:
                break
            parts.append((size, h))
        for size, h in reversed(parts):
            while at + size <= n:
                own = np.append(h[at:], np.zeros(min(at, len(h)), U))[: len(h)]
                out = own if out is None else _pair(out, own, seed + at)
                at += size
        if at < n:
            own = np.append(parts[0][1][n - 8 :], np.zeros(min(n - 8, len(data)), U))[: len(data)]
            out = _pair(out, own, seed + at)
        return out

    def grams(self, units: np.ndarray) -> np.ndarray:
        return mix64(self._hash(units, self.k, 1))

    def shipped(self, units: np.ndarray) -> np.ndarray:
        return units

    def digests(self, content: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return mix64(self._hash(content, self.window, 2))[starts], mix64(self._hash(content, self.window, 3))[starts]


def rising(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than its successor; the last one counts as smaller."""
    n = len(t)
    change = np.flatnonzero(t[1:] != t[:-1])  # the sign of a run of equal bytes is that of the step behind it
    up = np.ones(n, bool)
    if len(change):
        at = np.searchsorted(change, np.arange(n))
        inside = at < len(change)
        step = t[change] < t[np.minimum(change + 1, n - 1)]
        up[inside] = step[at[inside]]
    return up


def direct_sort(text: bytes, at: np.ndarray, depth: int) -> np.ndarray:
    """These suffixes in the order of their first `depth` bytes. Where that many copies would be large, by the first 32, and by all where those are equal."""
    own = at.tolist()
    if len(own) * depth <= KEYS:
        keys = [text[i : i + depth] for i in own]
        return at[np.array(sorted(range(len(own)), key=keys.__getitem__), np.int64)]
    keys = [text[i : i + 32] for i in own]
    order = sorted(range(len(own)), key=keys.__getitem__)
    same = np.fromiter((keys[a] == keys[b] for a, b in zip(order, order[1:])), bool, len(order) - 1)
    out = at[np.array(order, np.int64)]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]]).view(np.int8)))
    for a, b in edges.reshape(-1, 2).tolist():
        tied = out[a : b + 1].tolist()
        tied.sort(key=lambda i: text[i + 32 : i + depth])
        out[a : b + 1] = tied
    return out


def two_stage_sort(text: bytes, depth: int) -> np.ndarray:
    """Suffixes of the text in the order of their first `depth` bytes at least."""
    t = np.frombuffer(text, np.uint8)
    up = rising(t)
    direct = direct_sort(text, np.flatnonzero(up), depth)
    heads = t[direct]
    cuts = np.searchsorted(heads, np.arange(257))
    pending: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    for c in range(256):
        layer = np.concatenate(pending[c]) if pending[c] else direct[:0]
        bucket = []
        while len(layer):  # bytes before these that are equal to c: one more c in front
            bucket.append(layer)
            before = layer[layer > 0] - 1
            layer = before[t[before] == c]
        own = np.concatenate([*bucket, direct[cuts[c] : cuts[c + 1]]])
        if not len(own):
            continue
        out.append(own)
        before = own[own > 0] - 1
        head = t[before]
        before, head = before[head > c], head[head > c]
        order = np.argsort(head, kind="stable")
        before, head = before[order], head[order]
        first = np.flatnonzero(np.append(True, head[1:] != head[:-1])) if len(head) else []
        for a, b in zip(first, [*first[1:], len(head)]):
            pending[int(head[a])].append(before[a:b])
    return np.concatenate(out) if out else direct


def repeated_starts(runs: list[bytes], window: int) -> list[np.ndarray]:
    """Of each run, which of its windows also start elsewhere in these runs."""
    text = bytes([PART]).join(runs) + bytes([PART])
    ends = np.cumsum([len(r) + 1 for r in runs])
    starts = ends - [len(r) + 1 for r in runs]
    order = two_stage_sort(text, window)
    run = np.searchsorted(ends, order, "right")
    own = order[order + window < ends[run]]  # `window` bytes are left in the run
    flags = np.zeros(len(text), bool)
    mine = own.tolist()
    same = np.fromiter((text[a : a + window] == text[b : b + window] for a, b in zip(mine, mine[1:])), bool, max(len(mine) - 1, 0))
    flags[own[:-1][same]] = True
    flags[own[1:][same]] = True
    return [flags[a : a + len(r) - window + 1] for a, r in zip(starts.tolist(), runs)]


def copies(x: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each run the first of its content, and whether it has a copy."""
    n = len(x["anchor"])
    lead = twins(x)
    many = np.zeros(n, bool)
    copy = lead != np.arange(n)
    many[copy] = True
    many[lead[copy]] = True
    return lead, many


def local(x: dict[str, np.ndarray]) -> np.ndarray:
    """A flag for each window of a task's own runs: its run has a copy. What else repeats is left to the buckets."""
    return np.repeat(copies(x)[1], x["windows"])


def resolver(window: int):
    def resolve(x: dict[str, np.ndarray]) -> np.ndarray:
        """A flag for each window of these runs: it stands in another run, or in this one once more."""
        n = len(x["anchor"])
        lead, many = copies(x)
        copy = lead != np.arange(n)
        lens = x["windows"] + (window - 1)
        flags = [np.full(w, m) for w, m in zip(x["windows"].tolist(), many.tolist())]
        order = np.flatnonzero(~copy)
        order = order[np.argsort(x["anchor"][order], kind="stable")]
        anchors = x["anchor"][order]
        first = np.flatnonzero(np.append(True, anchors[1:] != anchors[:-1])) if len(order) else []
        batch: list[int] = []
        held = 0

        def settle() -> None:
            runs = [x["content"][x["at"][i] : x["at"][i] + lens[i]].tobytes() for i in batch]
            for i, got in zip(batch, repeated_starts(runs, window)):
                flags[i] = flags[i] | got

        for a, b in zip(first, [*first[1:], len(order)]):
            group = order[a:b]
            if b - a < 2 or many[group].all():
                continue
            batch += group.tolist()
            held += int(lens[group].sum())
            if held > TEXT:
                settle()
                batch, held = [], 0
        if batch:
            settle()
        for i in np.flatnonzero(copy).tolist():
            flags[i] = flags[lead[i]]
        return np.concatenate(flags) if flags else np.zeros(0, bool)

    return resolve


def dedup(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD) -> DataFrame:
    """(doc_id, kept binary, n_bytes, n_removed, removed array<struct<first:bigint,last:bigint>>) of each row.

    A byte goes if a string of `window` bytes that covers it starts anywhere
    else too, the same row included, judged on the input. Rows are places of
    their own: a row that repeats another loses all its windows, as the other
    does. Null and empty texts have no bytes; null ids are kept.
    """
    base = keyed(docs, id_col, text_col)
    spans = repeated(base, Bytes(window, crowd=crowd), True, local, resolver(window), False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
        for batch in slices(batches):
            kept, sizes, gone, where = [], [], [], []
            for text, blobs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                raw = text.encode()
                sizes.append(len(raw))
                if not blobs:
                    kept.append(raw)
                    gone.append(0)
                    where.append([])
                    continue
                off = covered(blobs, len(raw), window)
                edges = np.flatnonzero(np.diff(np.concatenate([[0], off.view(np.int8), [0]]))).reshape(-1, 2)
                kept.append(np.frombuffer(raw, np.uint8)[~off].tobytes())
                gone.append(int(off.sum()))
                where.append([{"first": a, "last": b - 1} for a, b in edges.tolist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary()), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(where, ranges)], ["doc_id", "kept", "n_bytes", "n_removed", "removed"])

    joined = base.join(spans, "row", "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(run, "doc_id bigint, kept binary, n_bytes bigint, n_removed bigint, removed array<struct<first:bigint,last:bigint>>")


def digests(found: DataFrame) -> DataFrame:
    """The columns of the query op8."""
    return found.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
