"""WARC archives of pages, and their capture index by an external merge.

Each writing task fills archive files in the shared folder, one gzip member a
record, and leaves a run for each file: its index entries, sorted by URL key,
time and page. The runs are the sorted pieces of an external sort: they are cut
by ranges of (URL key, time, page), and each range's slices of all runs go
through a k-way loser tree, so the index is globally ordered by partition. A
URL key with very many captures is cut by time and page as well. A repeated
task writes files under new names; only entries of finished tasks count.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta
from itertools import groupby
from operator import itemgetter
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, spread, written

ROTATE = 64 << 20
LEVEL = 4
EPOCH = datetime(2024, 1, 1, tzinfo=UTC)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ENTRY = "run string, nth bigint, url_key string, ts string, page_id bigint, file string, offset bigint, length bigint"
NAMES = [c.split()[0] for c in ENTRY.split(", ")]


class LoserTree:
    """Merges k sorted lists of (key, value): inner nodes hold the losers of their matches, and the winner is replayed on its path alone."""

    def __init__(self, runs: list[list]):
        self.runs, self.k = [iter(r) for r in runs], len(runs)
        self.heads = [next(r, None) for r in self.runs]
        self.losers = [-1] * max(self.k, 1)
        for i in range(self.k):
            self._replay(i)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x[0], a) < (y[0], b)

    def _replay(self, i: int) -> None:
        node, winner = (i + self.k) >> 1, i
        while node:
            if self.losers[node] < 0:  # first match at this node: wait for the other side
                self.losers[node] = winner
                return
            if self._beats(self.losers[node], winner):
                self.losers[node], winner = winner, self.losers[node]
            node >>= 1
        self.losers[0] = winner

    def __iter__(self):
        while self.k and self.heads[self.losers[0]] is not None:
            i = self.losers[0]
            yield self.heads[i]
            self.heads[i] = next(self.runs[i], None)
            self._replay(i)


def url_key(url: str | None) -> str:
    """Host labels from the right, then path and query, in lower case: keys of one site stand together."""
    parts = urlsplit_or_none(url or "")
    if parts is None or not parts.netloc:
        return (url or "").lower()
    host = parts.netloc.rpartition("@")[2].lower()
    host = re.sub(r":(80|443)$", "", host).removeprefix("www.")
    name, _, port = host.partition(":")
    return ",".join(reversed(name.split("."))) + (f":{port}" if port else "") + ")" + (parts.path or "/").lower() + (f"?{parts.query.lower()}" if parts.query else "")


def urlsplit_or_none(url: str):
    try:
        return urlsplit(url)
    except ValueError:
        return None


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, ident: str, date: str, url: str, payload: bytes, refers_to: str | None = None) -> bytes:
    """One WARC record. A revisit keeps the HTTP headers, with the full payload's length, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = [f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:page:{ident}>\r\nWARC-Date: {date}\r\nWARC-Target-URI: {url}"]
    if kind == "revisit":
        head.append(f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: <urn:page:{refers_to}>")
    head.append(f"WARC-Payload-Digest: sha1:{payload_digest(payload)}\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n")
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Headers, HTTP headers and payload of a record; the digest of a response is verified."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != length or payload_digest(payload) != digest):
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} fails its digest")
    return {"fields": fields, "payload": payload, "payload_bytes": length, "payload_digest": digest}


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def with_roles(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, html, refers_to): of rows with equal payloads of at least least_bytes, all but that with the largest page_id refer to it.

    The largest page_id of a payload is a partial aggregate by digest; joining
    it to the pages spreads a payload that very many pages share by an adaptive
    skew join. Rows that repeat the largest page_id are responses as well; null
    page_ids refer to the largest, if there is one.
    """
    base = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    keyed = base.withColumn("sha", F.sha1(F.encode("html", "UTF-8")))
    best = base.where(F.octet_length("html") >= least_bytes).groupBy(F.sha1(F.encode("html", "UTF-8")).alias("sha")).agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("n")).where("n > 1").select("sha", "top")
    return keyed.join(best, "sha", "left").select("page_id", "url", "html", F.when(~F.col("top").eqNullSafe(F.col("page_id")), F.col("top")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, rotate: int = ROTATE) -> DataFrame:
    """Writes the archive files and returns the runs of index entries (run, nth, url_key, ts, page_id, file, offset, length), written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = filesystem(folder)
        store.create_dir(root, recursive=True)
        context = TaskContext.get()
        stem, files, out, size, entries = f"{context.partitionId():06d}-{context.taskAttemptId()}", 0, None, 0, []

        def closed() -> pa.RecordBatch:
            name = entries[0][3]
            entries.sort(key=lambda e: (e[0], e[1], e[2] is None, e[2] or 0, e[4]))
            rows = [(name, i, *e) for i, e in enumerate(entries)]
            types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], NAMES)

        for batch in batches:
            for page, url, html, refers in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    name = f"{stem}-{files:04d}.warc.gz"
                    out, size, files, entries = store.open_output_stream(f"{root}/{name}", compression=None), 0, files + 1, []
                date = (EPOCH + timedelta(seconds=(page or 0) % (1 << 31))).strftime("%Y-%m-%dT%H:%M:%SZ")
                target = quote(url or "", safe="!#$%&'()*+,/:;=?@[]~")
                squeeze = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                member = squeeze.compress(record("response" if refers is None else "revisit", "null" if page is None else str(page), date, target, html.encode(), None if refers is None else str(refers))) + squeeze.flush()
                out.write(member)
                entries.append((url_key(url), date, page, name, size, len(member)))
                size += len(member)
                if size >= rotate:
                    out.close()
                    out = None
                    yield closed()
        if out is not None:
            out.close()
            yield closed()

    return written(pages.select("page_id", "url", "html", "refers_to").mapInArrow(run, ENTRY), "warc-runs")


def merge_runs(runs: DataFrame) -> DataFrame:
    """All entries in global order of (url_key, ts, page_id), null page_ids last: partitions are ranges, each merged by a loser tree over its slices of the runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))]
        slices_ = [[((r[2], r[3], r[4] is None, r[4] or 0, r[5], r[6]), r) for r in own] for _, own in groupby(rows, itemgetter(0))]
        merged = [r for _, r in LoserTree(slices_)]
        for a in range(0, len(merged), 10_000):
            cols = zip(*merged[a : a + 10_000])
            types = [f.type for f in schema]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], NAMES)

    schema = pa.schema([("run", pa.string()), ("nth", pa.int64()), ("url_key", pa.string()), ("ts", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
    n = spread(runs.sparkSession)
    ranges = runs.select(*NAMES).repartitionByRange(n, "url_key", "ts", F.col("page_id").asc_nulls_last(), "file", "offset")
    return ranges.sortWithinPartitions("run", "nth").mapInArrow(run, ENTRY)


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """(page_id, url_key, ts, record_type, payload_bytes, payload_digest, refers_to, payload) of each entry, read from its file at its offset. Each file goes to one task; files are at most about ROTATE bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = filesystem(folder)
        at, source = None, None
        for batch in batches:
            rows = []
            for key, ts, file, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                if file != at:
                    if source is not None:
                        source.close()
                    at, source = file, store.open_input_file(f"{root}/{file}")
                raw = zlib.decompress(source.read_at(length, offset), 31)
                got = parse(raw)
                ident, refers = (got["fields"].get(h, "<urn:page:null>")[10:-1] for h in ("WARC-Record-ID", "WARC-Refers-To"))
                rows.append((None if ident == "null" else int(ident), key, ts, got["fields"]["WARC-Type"], got["payload_bytes"], got["payload_digest"], None if refers == "null" else int(refers), got["payload"]))
                if len(rows) == 500:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
        if source is not None:
            source.close()

    names = ["page_id", "url_key", "ts", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    schema = "page_id bigint, url_key string, ts string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, payload binary"
    n = spread(index.sparkSession)
    return index.select("url_key", "ts", "file", "offset", "length").repartition(n, "file").sortWithinPartitions("file", "offset").mapInArrow(run, schema)


def archive(pages: DataFrame, least_bytes: int = 0) -> tuple[DataFrame, str]:
    """The merged index of archives of these pages, and their folder (under the shared one).

    A null url is the empty one, a null html the empty payload; an empty table
    makes no files and an empty index; every row makes one record.
    """
    folder = fresh_path(pages.sparkSession, "warc")
    return merge_runs(write_archives(with_roles(pages, least_bytes), folder)), folder
