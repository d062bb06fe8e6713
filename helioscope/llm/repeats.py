"""Where documents share windows of a fixed length: what op5 and op8 have in common.

Windows are never shipped whole. Each window of `window` units has an anchor,
the k-gram of least hash in it; equal windows have equal anchors at the same
place. Consecutive windows with one anchor are a run.

1. Every task sends its anchors' hashes, deduplicated, to buckets by hash; a
   bucket tells each row which of its anchors stand elsewhere too (`notes`).
2. Rows with such anchors send the runs of these to buckets by anchor, a group
   of suffixes with that prefix. A task settles its own runs first and sends one
   for each content, so a passage that very many documents share weighs
   one run a task. Anchors with more than `crowd` runs, of whatever contents,
   send their windows as 128-bit digests instead, which are dealt by digest.
3. A bucket resolves its runs (`resolve`, given by the operator), and tells each
   row which of its windows are repeated.

Rows are known by a hash of doc_id and text. Only hashes in step 1 are short
(48 bits): a false match there costs a run sent in vain, and no result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, slices, spread, written

U = np.uint64
CROWD = 20_000
FLUSH = 2_000_000
LOW48 = U((1 << 48) - 1)
HOT = U(1 << 63)


class Units:
    """How a text is cut: its units, hashes of k-grams, and what a run ships."""

    window: int
    k: int
    content: type
    crowd: int = CROWD
    slice_bytes: int = 4 << 20

    def cut(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Units of all texts, one text behind the other, and how many each has."""
        raise NotImplementedError

    def grams(self, units: np.ndarray) -> np.ndarray:
        """A 64-bit hash of the k-gram at each position (any value where it would pass the end)."""
        raise NotImplementedError

    def shipped(self, units: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def digests(self, content: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit hashes of the windows of `content` at `starts`."""
        raise NotImplementedError


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of x[i : i + width] at each i, by doubling."""
    m, have = x, 1
    while 2 * have <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    return np.minimum(m[: len(m) - (width - have)], m[width - have :]) if have < width else m


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    ends = np.cumsum(lens)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lens - starts, lens)


def gather(content: np.ndarray, starts: np.ndarray, lens: np.ndarray, piece: int = 1 << 20) -> np.ndarray:
    """Runs of content one behind the other, copied a piece at a time: indices take eight times the room of bytes."""
    ends = np.cumsum(lens)
    out = np.empty(ends[-1] if len(ends) else 0, content.dtype)
    i = 0
    while i < len(lens):
        first = ends[i] - lens[i]
        j = max(i + 1, int(np.searchsorted(ends, first + piece, "right")))
        out[first : ends[j - 1]] = content[ragged(starts[i:j], lens[i:j])]
        i = j
    return out


def runs_of(u: Units, units: np.ndarray, lens: np.ndarray) -> dict[str, np.ndarray]:
    """Runs of a slice: doc (index), start (first window, in the slice), windows, and the anchor's hash."""
    none = np.zeros(0, np.int64)
    if len(units) < u.window:
        return {"doc": none, "start": none, "windows": none, "anchor": none.astype(U)}
    h = u.grams(units)
    n = len(units) - u.window + 1
    packed = (h & U(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=U)
    least = (sliding_min(packed[: n + u.window - u.k], u.window - u.k + 1)[:n] & U(0xFFFFFFFF)).astype(np.int64)
    per = np.maximum(lens - u.window + 1, 0)
    at = ragged(np.cumsum(lens) - lens, per)  # starts of windows that lie in one text
    doc = np.repeat(np.arange(len(lens)), per)
    if not len(at):
        return {"doc": none, "start": none, "windows": none, "anchor": none.astype(U)}
    anchor = least[at]
    first = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])))
    return {"doc": doc[first], "start": at[first], "windows": np.diff(np.append(first, len(at))), "anchor": mix64(h[anchor[first]])}


def keyed(docs: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text, row, carried_0, ...): row is a hash of both."""
    doc, text = F.col(id_col).cast("bigint"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(doc.alias("doc_id"), text.alias("text"), F.xxhash64(doc, text).alias("row"), *(F.col(c).alias(f"carried_{i}") for i, c in enumerate(carry)))


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Rows of each bucket of a partition that is sorted by it (the first column)."""
    at, held = None, []
    for batch in batches:
        bucket = batch.column(0).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if at is not None and bucket[a] != at:
                yield at, held
                held = []
            at = int(bucket[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield at, held


def _joined(held: list[pa.RecordBatch], column: int, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(x for b in held for x in b.column(column).to_pylist() if x is not None), dtype)


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order that sorts keys, where each group starts in it, and the size of each."""
    order = np.argsort(keys, kind="stable")
    own = keys[order]
    first = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, np.int64)
    return order, first, np.diff(np.append(first, len(own)))


def _parcels(rows: np.ndarray, values: np.ndarray, buckets: int) -> list[tuple[int, bytes, bytes, bytes]]:
    """Values of rows as parcels, one for each bucket of rows: rows, how many values each has, values."""
    bucket = (mix64(rows) % U(buckets)).astype(np.int64)
    order = np.lexsort((rows, bucket))
    rows, values, bucket = rows[order], values[order], bucket[order]
    edges = np.searchsorted(bucket, np.arange(buckets + 1)).tolist()
    out = []
    for i, (a, b) in enumerate(zip(edges, edges[1:])):
        if b > a:
            _, first, size = _groups(rows[a:b])
            out.append((i, rows[a:b][first].tobytes(), size.astype(np.uint32).tobytes(), np.ascontiguousarray(values[a:b]).tobytes()))
    return out


PARCEL = "bucket int, rows binary, sizes binary, values binary"


def _unpacked(parcels: DataFrame, width: int, name: str) -> DataFrame:
    """(row, name): all values of a row, each `width` bytes, as one blob."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in _by_bucket(batches):
            rows, sizes = _joined(held, 1, U), _joined(held, 2, np.uint32)
            values = _joined(held, 3, np.dtype(("V", width)))
            order, first, _ = _groups(np.repeat(rows, sizes))
            flat = values[order].tobytes()
            own = np.repeat(rows, sizes)[order][first]
            cuts = (width * np.append(first, len(order))).tolist()
            for a in range(0, len(own), 5000):
                blobs = [flat[x:y] for x, y in zip(cuts[a : a + 5000], cuts[a + 1 : a + 5001])]
                yield pa.RecordBatch.from_arrays([pa.array(own[a : a + 5000].view(np.int64)), pa.array(blobs, pa.binary())], ["row", name])

    n = spread(parcels.sparkSession)
    return parcels.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(run, f"row bigint, {name} binary")


def notes(docs: DataFrame, u: Units, same_row: bool) -> DataFrame:
    """(row, notes): 48-bit hashes of a row's anchors that stand elsewhere too, HOT set on crowded ones.

    same_row: whether a second place in the same row counts.
    """
    buckets = spread(docs.sparkSession)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["bucket", "passed", "rows", "sizes", "hashes", "counts"]
        types = [pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
        rows, hashes, held = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            r, h = np.concatenate(rows), np.concatenate(hashes)
            if not same_row:  # each anchor once a row
                order = np.lexsort((r, h))
                r, h = r[order], h[order]
                keep = np.append(True, (r[1:] != r[:-1]) | (h[1:] != h[:-1])) if len(r) else np.zeros(0, bool)
                r, h = r[keep], h[keep]
            order, first, size = _groups(h)
            r, h = r[order], h[order]
            many = np.repeat(size > 1, size)
            out = [(i, True, *own, None) for i, *own in _parcels(r[many], h[many], buckets)]  # known to repeat: these go to no bucket of hashes
            r, h, n = r[first], h[first], size.astype(np.uint32)
            bucket = (mix64(h) % U(buckets)).astype(np.int32)
            order = np.lexsort((r, bucket))
            r, h, n, bucket = r[order], h[order], n[order], bucket[order]
            cuts = np.flatnonzero(np.append(True, np.diff(bucket) != 0)) if len(bucket) else []
            for a, b in zip(cuts, [*cuts[1:], len(bucket)]):
                _, starts, counts = _groups(r[a:b])
                big = n[a:b] if (n[a:b] > 1).any() else n[:0]
                out.append((int(bucket[a]), False, r[a:b][starts].tobytes(), counts.astype(np.uint32).tobytes(), h[a:b].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes(), big.tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

        for batch in slices(batches, "text", u.slice_bytes):
            units, lens = u.cut(batch.column(1).to_pylist())
            got = runs_of(u, units, lens)
            row = batch.column(2).to_numpy().view(U)
            rows.append(row[got["doc"]])
            hashes.append(got["anchor"] & LOW48)
            held += len(got["doc"])
            if held > FLUSH:
                yield from flush()
                rows, hashes, held = [], [], 0
        if held:
            yield from flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in _by_bucket(batches):
            own = [x for b in held for x in zip(*(b.column(i).to_pylist() for i in range(6))) if x[1]]
            yield parcels([(x[0], *x[2:5]) for x in own], True)
            rows, hashes, counts = [], [], []
            for b in held:
                for passed, r, c, h, n in zip(*(b.column(i).to_pylist() for i in range(1, 6))):
                    if passed:
                        continue
                    rows.append(np.repeat(np.frombuffer(r, U), np.frombuffer(c, np.uint32)))
                    wide = np.zeros((len(h) // 6, 8), np.uint8)
                    wide[:, :6] = np.frombuffer(h, np.uint8).reshape(-1, 6)
                    hashes.append(wide.view("<u8").ravel())
                    counts.append(np.frombuffer(n, np.uint32) if n else np.ones(len(wide), np.uint32))
            if not rows:
                continue
            r, h, n = np.concatenate(rows), np.concatenate(hashes), np.concatenate(counts)
            order, first, size = _groups(h)
            r, h, n = r[order], h[order], n[order]
            sums = np.add.reduceat(n.astype(np.int64), first)
            total = np.repeat(sums, size)
            tell = (total > 1) & (n == 1)  # rows behind larger counts know already
            yield parcels(_parcels(r[tell], np.where(total[tell] > u.crowd, h[tell] | HOT, h[tell]), buckets), False)
            crowded = h[first][sums > u.crowd]
            if len(crowded):
                yield parcels([(-1, b"", b"", crowded.tobytes())], False)

    def parcels(rows: list[tuple], passed: bool) -> pa.RecordBatch:
        columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.binary(), pa.binary()))]
        return pa.RecordBatch.from_arrays([*columns, pa.array([passed] * len(rows), pa.bool_())], ["bucket", "rows", "sizes", "values", "passed"])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r, n, v in zip(*(b.column(i).to_pylist() for i in range(1, 4))):
                rows = np.repeat(np.frombuffer(r, np.int64), np.frombuffer(n, np.uint32)) if r else np.zeros(len(v) // 8, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(np.frombuffer(v, np.int64))], ["row", "hash"])

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = _parcels(b.column(0).to_numpy().view(U), b.column(1).to_numpy().view(U) | HOT, buckets)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in own], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["bucket", "rows", "sizes", "values"])

    sent = docs.select("doc_id", "text", "row").mapInArrow(send, "bucket int, passed boolean, rows binary, sizes binary, hashes binary, counts binary")
    told = written(sent.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(meet, PARCEL + ", passed boolean"), "repeats")
    out = told.where("bucket >= 0").select("bucket", "rows", "sizes", "values")
    crowded = told.where("bucket < 0")
    if not crowded.isEmpty():  # rows that passed their anchors on learn which of these are crowded
        hashes = crowded.mapInArrow(pairs, "row bigint, hash bigint").select("hash").distinct()
        found = told.where("passed").mapInArrow(pairs, "row bigint, hash bigint").join(hashes, "hash").select("row", "hash")
        out = out.union(found.mapInArrow(marked, PARCEL))
    return _unpacked(out, 8, "notes")


RUN_COLUMNS = "bucket int, anchors binary, rows binary, docs binary, starts binary, windows binary, contents binary, hot binary, parcel binary, sizes binary, spans binary"

#: Given runs (anchor, row, doc, windows, content, where each run's content starts), which windows are repeated: a flag for each window, run by run, and which of them need go no further.
Resolve = Callable[[dict[str, np.ndarray]], np.ndarray]

HOT_ROW = np.dtype([("a", U), ("b", U), ("row", U), ("doc", np.int64), ("start", np.int64)])


def repeated(docs: DataFrame, u: Units, same_row: bool, local: Resolve, resolve: Resolve, first_stays: bool) -> DataFrame:
    """(row, spans): blob of (first, last) starts of windows, as int64 pairs, that are repeated.

    first_stays: of equal windows those of the least doc_id are kept (they are
    not told); else all of them are told. local: what a task tells of its own
    runs, all or some of what `resolve` would. docs: (doc_id, text, row), where
    null ids have been given a number.
    """
    buckets = spread(docs.sparkSession)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in RUN_COLUMNS.split(", ")]
        types = [pa.int32(), *[pa.binary()] * 10]
        held: list[dict[str, np.ndarray]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            runs = merged(held)
            settled = local(runs)  # what this task can tell by itself
            out = [(i, *[None] * 7, *own) for i, *own in _spans(runs, settled, buckets)]
            go = open_runs(runs, settled, first_stays)
            if len(go["anchor"]):
                bucket = (mix64(go["anchor"]) % U(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                lens = go["windows"] + (u.window - 1)
                content = gather(go["content"], go["at"][order], lens[order])
                ends = np.cumsum(lens[order])
                own = bucket[order]
                cuts = np.flatnonzero(np.append(True, np.diff(own) != 0)).tolist()
                for a, b in zip(cuts, [*cuts[1:], len(own)]):
                    i = order[a:b]
                    part = content[(ends[a - 1] if a else 0) : ends[b - 1]]
                    out.append((int(own[a]), go["anchor"][i].tobytes(), go["row"][i].tobytes(), go["doc"][i].tobytes(), go["start"][i].astype(np.uint32).tobytes(), go["windows"][i].astype(np.uint32).tobytes(), part.tobytes(), *[None] * 4))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

        def hot_rows(x: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
            at = ragged(x["at"], x["windows"])
            rows = np.zeros(len(at), HOT_ROW)
            rows["a"], rows["b"] = u.digests(x["content"], at)
            for c in ("row", "doc"):
                rows[c] = np.repeat(x[c], x["windows"])
            rows["start"] = ragged(x["start"], x["windows"])
            flags, stay = _resolve_hot(rows, same_row, first_stays)
            out = [(i, *[None] * 7, *own) for i, *own in _spans_of(rows["row"][flags], rows["start"][flags], buckets)]
            rows = rows[stay]
            bucket = (rows["a"] % U(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.append(True, np.diff(bucket[order]) != 0)).tolist() if len(order) else []
            out += [(int(bucket[order[a]]), *[None] * 6, rows[order[a:b]].tobytes(), *[None] * 3) for a, b in zip(cuts, [*cuts[1:], len(order)])]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

        for batch in slices(batches, "text", u.slice_bytes):
            units, lens = u.cut(batch.column(1).to_pylist())
            got = runs_of(u, units, lens)
            row, doc = batch.column(2).to_numpy().view(U), batch.column(0).fill_null(0).to_numpy()
            told = [np.frombuffer(x, U) for x in batch.column(3).to_pylist()]
            many = np.fromiter(map(len, told), np.int64, len(told))
            flat = np.concatenate(told) if told else np.zeros(0, U)
            # a row's own notes: hashes are mixed with the row's place in the slice, so that one sorted list serves all rows
            place = mix64(np.arange(1, len(lens) + 1, dtype=U))
            wanted = (flat & LOW48) ^ np.repeat(place, many)
            order = np.argsort(wanted)
            mine = (got["anchor"] & LOW48) ^ place[got["doc"]]
            at = np.minimum(np.searchsorted(wanted[order], mine), max(len(wanted) - 1, 0))
            hit = wanted[order][at] == mine if len(wanted) else np.zeros(len(mine), bool)
            hot = hit & np.isin(mine, wanted[(flat & HOT) != 0])
            begin = np.cumsum(lens) - lens
            shipped = u.shipped(units)
            for some, is_hot in ((hit & ~hot, False), (hot, True)):
                i = np.flatnonzero(some)
                if not len(i):
                    continue
                span = got["windows"][i] + u.window - 1
                x = {
                    "anchor": got["anchor"][i], "row": row[got["doc"][i]], "doc": doc[got["doc"][i]], "start": got["start"][i] - begin[got["doc"][i]],
                    "windows": got["windows"][i], "content": gather(shipped, got["start"][i], span), "at": np.cumsum(span) - span,
                }
                if is_hot:
                    yield from hot_rows(x)
                else:
                    held.append(x)
                    size += x["content"].nbytes + 40 * len(i)
            if size > 16 << 20:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    def merged(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
        out = {c: np.concatenate([p[c] for p in parts]) for c in ("anchor", "row", "doc", "start", "windows", "content")}
        lens = out["windows"] + (u.window - 1)
        return out | {"at": np.cumsum(lens) - lens}

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in _by_bucket(batches):
            out = [(x[0], *x[1:]) for b in held for x in zip(*(b.column(i).to_pylist() for i in (0, 8, 9, 10))) if x[1] is not None]
            rows = _joined(held, 7, HOT_ROW)
            if len(rows):
                flags, _ = _resolve_hot(rows, same_row, first_stays)
                out += _spans_of(rows["row"][flags], rows["start"][flags], buckets)
            x = {"anchor": _joined(held, 1, U), "row": _joined(held, 2, U), "doc": _joined(held, 3, np.int64), "start": _joined(held, 4, np.uint32).astype(np.int64), "windows": _joined(held, 5, np.uint32).astype(np.int64), "content": _joined(held, 6, u.content)}
            if len(x["anchor"]):
                lens = x["windows"] + (u.window - 1)
                x["at"] = np.cumsum(lens) - lens
                out += _spans(x, resolve(x), buckets)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["bucket", "rows", "sizes", "values"])

    told = docs.join(notes(docs, u, same_row), "row").select("doc_id", "text", "row", "notes")
    sent = told.mapInArrow(send, RUN_COLUMNS)
    found = sent.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(meet, PARCEL)
    return _unpacked(found, 16, "spans")


def open_runs(x: dict[str, np.ndarray], settled: np.ndarray, first_stays: bool) -> dict[str, np.ndarray]:
    """The runs that go on to the buckets.

    With first_stays, windows that are settled (another document of the task
    has them, with a smaller id) go no further: that document's stand for them.
    Without it a run goes on, unless a run before it has the same content.
    """
    if first_stays:
        doc = np.repeat(np.arange(len(x["anchor"])), x["windows"])
        place = ragged(np.zeros(len(x["anchor"]), np.int64), x["windows"])
        keep = np.flatnonzero(~settled)
        first = np.flatnonzero(np.append(True, (doc[keep][1:] != doc[keep][:-1]) | (place[keep][1:] != place[keep][:-1] + 1))) if len(keep) else keep
        run, off = doc[keep[first]], place[keep[first]]
        return {c: x[c][run] for c in ("anchor", "row", "doc")} | {"start": x["start"][run] + off, "windows": np.diff(np.append(first, len(keep))), "at": x["at"][run] + off, "content": x["content"]}
    keep = twins(x) == np.arange(len(x["anchor"]))
    return {c: v[keep] if c != "content" else v for c, v in x.items()}


def content_hashes(x: dict[str, np.ndarray], piece: int = 1 << 20) -> np.ndarray:
    """A 64-bit hash of each run's anchor and content, some runs at a time."""
    ends = np.append(x["at"][1:], len(x["content"]))
    lens = ends - x["at"]
    out = np.zeros(len(lens), U)
    i = 0
    while i < len(lens):
        j = max(i + 1, int(np.searchsorted(ends, x["at"][i] + piece, "right")))
        place = ragged(np.zeros(j - i, np.int64), lens[i:j]).astype(U)
        mixed = mix64(x["content"][x["at"][i] : ends[j - 1]].astype(U) + (place << U(32)) * U(0x9E3779B97F4A7C15))
        out[i:j] = np.add.reduceat(mixed, x["at"][i:j] - x["at"][i])
        i = j
    return mix64(out ^ x["anchor"] ^ (lens.astype(U) << U(40)))


def twins(x: dict[str, np.ndarray], piece: int = 1 << 20) -> np.ndarray:
    """For each run the first one with the same anchor and content (compared in full), or itself. x["at"] rises without gaps."""
    order, first, size = _groups(content_hashes(x))
    out = np.arange(len(order))
    if not len(order):
        return out
    lead = np.repeat(order[first], size)
    cand = np.flatnonzero(lead != order)
    a, b = order[cand], lead[cand]
    lens = np.append(x["at"][1:], len(x["content"])) - x["at"]
    same = (lens[a] == lens[b]) & (x["anchor"][a] == x["anchor"][b])
    a, b = a[same], b[same]
    ends = np.cumsum(lens[a])
    i = 0
    while i < len(a):
        begin = ends[i] - lens[a[i]]
        j = max(i + 1, int(np.searchsorted(ends, begin + piece, "right")))
        p, q = a[i:j], b[i:j]
        equal = x["content"][ragged(x["at"][p], lens[p])] == x["content"][ragged(x["at"][q], lens[q])]
        fine = np.logical_and.reduceat(equal, ends[i:j] - lens[p] - begin)
        out[p[fine]] = q[fine]
        i = j
    return out


def _resolve_hot(rows: np.ndarray, same_row: bool, first_stays: bool) -> tuple[np.ndarray, np.ndarray]:
    """Which windows are told, and which must go on: of each digest, one or two that stand for all."""
    order = np.lexsort((rows["start"], rows["row"], rows["doc"], rows["b"], rows["a"]))
    own = rows[order]
    new = np.append(True, (own["a"][1:] != own["a"][:-1]) | (own["b"][1:] != own["b"][:-1]))
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(own)))
    flags, stay = np.zeros(len(rows), bool), np.zeros(len(rows), bool)
    if first_stays:
        flags[order] = own["doc"] > np.repeat(own["doc"][first], size)
        stay[order] = ~flags[order]
    else:
        flags[order] = np.repeat(size > 1, size)
        stay[order] = new  # of several equal ones the first is told already, and tells others
    return flags, stay


def _spans(x: dict[str, np.ndarray], flags: np.ndarray, buckets: int) -> list[tuple[int, bytes, bytes, bytes]]:
    return _spans_of(np.repeat(x["row"], x["windows"])[flags], ragged(x["start"], x["windows"])[flags], buckets)


def _spans_of(row: np.ndarray, start: np.ndarray, buckets: int) -> list[tuple[int, bytes, bytes, bytes]]:
    """Parcels of (first, last) window starts."""
    if not len(row):
        return []
    order = np.lexsort((start, row))
    row, start = row[order], start[order]
    first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (start[1:] > start[:-1] + 1)))
    last = np.append(first[1:], len(row)) - 1
    return _parcels(row[first], np.stack([start[first], start[last]], 1).astype(np.int64), buckets)


def covered(spans: bytes | None, n: int, window: int) -> np.ndarray:
    """Which of n units lie in a window of these spans."""
    out = np.zeros(n + 1, np.int64)
    if spans:
        own = np.frombuffer(spans, np.int64).reshape(-1, 2)
        np.add.at(out, own[:, 0], 1)
        np.add.at(out, own[:, 1] + window, -1)
    return np.cumsum(out)[:n] > 0
