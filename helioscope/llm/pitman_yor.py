"""Language-model scores by a hierarchical Pitman-Yor model.

A context's restaurant serves the words that follow it; its tables are the
customers of one parent restaurant over all words, whose base is uniform over
the training vocabulary and one unknown word. Every word is a context of its
own, so the restaurants grow with the corpus.

Counts and seats stay distributed. Pairs (context, word) are dealt to buckets:
those of two frequent words by the pair, those of a rare context and a frequent
word by the context, those of a rare word by the word. So a bucket has all of a
pair's customers, and all of a rare word's. Frequent words (OWN of them) are
known to all tasks as arrays of that fixed size, summed once a sweep. What a
rare context has in several buckets is summed at its home, the bucket of its
hash, which tells the sum to every bucket that has the context (`Homes`).
Gibbs sweeps seat every pair's customers again, given the tables of all others
from the sweep before. After `burn` sweeps, `samples` sweeps give predictive
probabilities whose average scores every document's words. Seats are drawn with
seeds by bucket and sweep, so a repeated task draws the same.

Words are known by 64-bit hashes.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, mix64, slices, spread, texts_of, word_hashes, written
from .repeats import U, _by_bucket, _groups, _joined
from .toxicity import fold

OWN = 61_440
#: Stands for a word or context that isn't frequent.
RARE = 0xFFFF
#: The end of a text is a token of its own; words are never empty.
ENDING = U(0x9E3779B97F4A7C15)
FLUSH = 500_000
#: Tokens that a bucket holds, about, as long as Spark allows for that many buckets.
BUCKET_TOKENS = 1_000_000
MOST_BUCKETS = 100_000
THETA = 1.0


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' words, each text closed by its end, and how many each text has."""
    words, lens = word_hashes(texts)
    out = np.empty(len(words) + len(lens), U)
    ends = np.cumsum(lens + 1) - 1
    inner = np.ones(len(out), bool)
    inner[ends] = False
    out[inner], out[ends] = words, ENDING
    return out, lens + 1


def marked(docs: DataFrame, parts: int, held: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, train): null ids are in no fold, so they train."""
    return texts_of(docs, id_col, text_col).withColumn("train", F.coalesce(fold(F.col("doc_id"), parts) != held, F.lit(True)))


def vocabulary(docs: DataFrame, own: int = OWN) -> dict:
    """tokens: N; types: V; hashes, counts: the `own` most frequent words of the training rows, by falling count."""
    buckets = spread(docs.sparkSession)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts, held = [], [], 0

        def flush() -> pa.RecordBatch:
            h, at = np.unique(np.concatenate(hashes), return_inverse=True)
            n = np.bincount(at, np.concatenate(counts), len(h)).astype(np.uint32)
            bucket = (mix64(h) % U(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
            out = [(i, h[order[a:b]].tobytes(), n[order[a:b]].tobytes()) for i, (a, b) in enumerate(zip(edges, edges[1:])) if b > a]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.binary(), pa.binary()))], ["bucket", "hashes", "counts"])

        for batch in slices(batches):
            h, n = np.unique(tokens_of(batch.column(0))[0], return_counts=True)
            hashes.append(h)
            counts.append(n)
            held += len(h)
            if held > FLUSH:
                yield flush()
                hashes, counts, held = [], [], 0
        if held:
            yield flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = types = 0
        best: list[tuple[int, int]] = []
        for _, held in _by_bucket(batches):
            h, at = np.unique(_joined(held, 1, U), return_inverse=True)
            n = np.bincount(at, _joined(held, 2, np.uint32), len(h)).astype(np.int64)
            tokens, types = tokens + int(n.sum()), types + len(h)
            top = np.lexsort((h, -n))[:own]
            best = heapq.nsmallest(own, [*best, *zip((-n[top]).tolist(), h[top].tolist())])
        if types:
            hashes, counts = np.array([b[1] for b in best], U), np.array([-b[0] for b in best], np.int64)
            n = len(best)
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(counts), pa.array([tokens] + [0] * (n - 1), pa.int64()), pa.array([types] + [0] * (n - 1), pa.int64())], ["hash", "n", "tokens", "types"])

    sent = docs.where("train").select("text").mapInArrow(send, "bucket int, hashes binary, counts binary")
    rows = written(sent.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(meet, "hash bigint, n bigint, tokens bigint, types bigint"), "lm-words")
    total = rows.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first()
    # words under the power of two that `own` words reach need not be sorted: fewer than that many words a partition come to the driver
    least, many = 1, 0
    for r in sorted(rows.groupBy(F.floor(F.log2("n")).alias("power")).agg(F.count(F.lit(1)).alias("words")).collect(), reverse=True):
        least, many = 1 << r["power"], many + r["words"]
        if many >= own:
            break
    top = rows.where(F.col("n") >= least).orderBy(F.desc("n"), "hash").limit(own).select("hash", "n").toPandas()
    hashes = top["hash"].to_numpy(np.int64).view(U)
    order = np.argsort(hashes)
    return {"tokens": int(total[0]), "types": int(total[1]), "hashes": hashes[order], "counts": top["n"].to_numpy(np.int64)[order]}


#: kind 0: pairs of documents; kind 1: documents. Counts of base_score's frequent words are summed by the sender.
SENT = "bucket int, kind int, docs binary, lens binary, contexts binary, words binary, rare binary, rare_contexts binary"
DOC = np.dtype([("row", U), ("id", np.int64), ("null", np.int8), ("train", np.int8), ("n", np.int64), ("known", np.int64), ("base", np.float64)])
PART = np.dtype([("known", np.uint32), ("score", np.float32), ("base", np.float64)])
LONG = 65_535


def _packed(rows: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and how many tokens each has as 16-bit numbers; larger ones take several entries."""
    parts = np.maximum(-(-many // LONG), 1)
    lens = np.full(int(parts.sum()), LONG, np.int64)
    lens[np.cumsum(parts) - 1] = many - (parts - 1) * LONG
    return np.repeat(rows, parts), lens.astype(np.uint16)


def _deltas(x: np.ndarray) -> bytes:
    """Differences of neighbours (modulo 2^64), which compress where rows rise slowly."""
    return np.diff(x, prepend=U(0)).tobytes()


def _undeltas(x: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(x, U), dtype=U)


def dealt(docs: DataFrame, words: dict, buckets: int) -> DataFrame:
    """A table with one row for each bucket's pairs, and rows for documents, kept by bucket so that joins on it leave it where it is."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast({k: words[k] for k in ("hashes", "counts")})
    names = [c.split()[0] for c in SENT.split(", ")]
    types = [pa.int32(), pa.int32(), *[pa.binary()] * 6]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        frequent, counts = shared.value["hashes"], shared.value["counts"]
        logs = np.log10(counts + 1.0)
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            row, train, ctx, ctx_hash, word, word_hash = (np.concatenate(c) for c in zip(*held))
            own = word != RARE
            pair = (word.astype(U) * U(0x9E3779B97F4A7C15)) ^ mix64(ctx)
            bucket = (mix64(np.where(own, np.where(ctx != RARE, pair, ctx_hash), word_hash)) % U(buckets)).astype(np.int64)
            order = np.argsort(bucket << 41 | (~own).astype(np.int64) << 40 | (row - row[0]).astype(np.int64), kind="stable")
            row, train, ctx, ctx_hash, word, word_hash, own, bucket = (c[order] for c in (row, train, ctx, ctx_hash, word, word_hash, own, bucket))
            edges = np.searchsorted(bucket, np.arange(buckets + 1))
            out = []
            for i, (a, b) in enumerate(zip(edges, edges[1:])):
                if b == a:
                    continue
                m = a + int(own[a:b].sum())  # frequent words first, then rare ones
                blobs = []
                for x, y in ((a, m), (m, b)):
                    _, first, many = _groups(row[x:y])
                    blobs.append(_packed(row[x:y][first] << U(1) | train[x:y][first].astype(U), many))
                rows = np.concatenate([blobs[0][0], blobs[1][0]])
                head = np.array([len(blobs[0][0])], np.uint32).tobytes()
                out.append((i, 0, _deltas(rows), head + blobs[0][1].tobytes() + blobs[1][1].tobytes(), ctx[a:b].tobytes(), word[a:m].tobytes(), word_hash[m:b].tobytes(), ctx_hash[a:b][ctx[a:b] == RARE].tobytes()))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

        for batch in slices(batches):
            h, lens = tokens_of(batch.column(1))
            at = np.minimum(np.searchsorted(frequent, h), max(len(frequent) - 1, 0))
            own = frequent[at] == h if len(frequent) else np.zeros(len(h), bool)
            word = np.where(own, at, RARE).astype(np.uint16)
            first = np.cumsum(lens) - lens
            before = np.arange(-1, len(h) - 1)
            before[first] = first + lens - 1  # a text follows an end
            n = len(lens)
            row = (U(part) << U(40)) + np.arange(number, number + n, dtype=U)
            number += n
            train = np.array(batch.column(2).to_pylist(), bool)
            d = np.zeros(n, DOC)
            d["row"], d["train"], d["n"] = row, train, lens
            d["id"], d["null"] = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False), batch.column(0).is_null().to_numpy(zero_copy_only=False)
            which = np.repeat(np.arange(n), lens)
            d["known"] = np.bincount(which[own], minlength=n)
            d["base"] = np.bincount(which[own], logs[at[own]], n) if own.any() else 0
            none = pa.nulls(1, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([int(row[0] % U(buckets))], pa.int32()), pa.array([1], pa.int32()), pa.array([d.tobytes()], pa.binary()), *[none] * 5], names)
            held.append((np.repeat(row, lens), np.repeat(train, lens).astype(np.uint8), word[before], h[before], word, h))
            size += len(h)
            if size > FLUSH:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each bucket's pairs."""
        for bucket, held in _by_bucket(batches):
            docs_, pairs = [], []
            for b in held:
                kind = b.column(1).to_numpy(zero_copy_only=False)
                for i in range(b.num_rows):
                    (docs_ if kind[i] else pairs).append([b.column(c)[i].as_buffer() for c in range(2, 8)])
            for p in docs_:
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([1], pa.int32()), pa.array([p[0].to_pybytes()], pa.binary()), *[pa.nulls(1, pa.binary())] * 5], names)
            if not pairs:
                continue
            front, back = [[], [], [], []], [[], [], [], []]  # rows, counts, contexts and rare contexts of frequent and of rare words
            for rows, lens, ctx, word, _, rare in pairs:
                lens, m = np.frombuffer(lens, np.uint8), len(word) // 2
                n = int(lens[:4].copy().view(np.uint32)[0])
                rows, lens, ctx, rare = _undeltas(rows), lens[4:].copy().view(np.uint16), np.frombuffer(ctx, np.uint16), np.frombuffer(rare, U)
                k = int((ctx[:m] == RARE).sum())
                for out, x in ((front, (rows[:n], lens[:n], ctx[:m], rare[:k])), (back, (rows[n:], lens[n:], ctx[m:], rare[k:]))):
                    for o, v in zip(out, x):
                        o.append(v)
            rows, lens, ctx, rare = (np.concatenate([*f, *b]) for f, b in zip(front, back))
            blobs = (_deltas(rows), lens.tobytes(), ctx.tobytes(), b"".join(p[3] for p in pairs), b"".join(p[4] for p in pairs), rare.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([0], pa.int32()), *(pa.array([x], pa.binary()) for x in blobs)], names)

    sent = docs.mapInArrow(send, SENT)
    name = f"lm_pairs_{uuid.uuid4().hex}"
    own = sent.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(gather, SENT)
    own.write.bucketBy(buckets, "bucket").option("compression", "zstd").option("path", fresh_path(spark, "lm-pairs")).saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the entry of the catalogue only: the files are in the shared folder
    return table


class Bucket:
    """A bucket's pairs: counts of training customers, and which pair each token is. Contexts and words are numbered from OWN where they are rare."""

    def __init__(self, rows: bytes, lens: bytes, contexts: bytes, words: bytes, rare: bytes, rare_contexts: bytes):
        self.entries, self.lens = _undeltas(rows), np.frombuffer(lens, np.uint16)
        word, short = np.frombuffer(words, np.uint16), np.frombuffer(contexts, np.uint16)
        self.rare_words, local = np.unique(np.frombuffer(rare, U), return_inverse=True)
        train = np.repeat((self.entries & U(1)).astype(bool), self.lens)
        key = np.concatenate([word.astype(np.int64), OWN + local]) << 32
        del local
        self.rare_contexts, local = np.unique(np.frombuffer(rare_contexts, U), return_inverse=True)
        context = short.astype(np.int64)
        context[short == RARE] = OWN + local
        key |= context
        del local, context
        self.keys, pair = np.unique(key, return_inverse=True)
        self.pair = pair.astype(np.int32)
        del key, pair
        self.count = np.bincount(self.pair[train], minlength=len(self.keys)).astype(np.int64)
        self.context, self.word = self.keys & 0xFFFFFFFF, self.keys >> 32
        self.contexts = OWN + len(self.rare_contexts)
        self.rare = self.word >= OWN
        self.local = self.word[self.rare] - OWN
        self.seen = np.bincount(self.local, self.count[self.rare], len(self.rare_words)).astype(np.int64)

    def by_context(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums of a value of each pair by frequent context and by rare context."""
        out = np.bincount(self.context, values, self.contexts)
        return out[:OWN], out[OWN:]


def seat(rng: np.random.Generator, count: np.ndarray, d: np.ndarray | float, fresh: np.ndarray) -> np.ndarray:
    """Tables that `count` customers of a dish take when each joins one with weight (customers - d * tables) or opens one with weight `fresh`.

    The first opens a table. Customers are seated one after another up to 32,
    then in groups of an eighth of those seated, with the chances at the start
    of the group.
    """
    tables = np.minimum(count, 1).astype(np.int64)
    d = np.broadcast_to(d, count.shape)
    live, sat = np.flatnonzero(count > 1), 1
    while len(live):
        group = np.minimum(max(1, sat // 8) if sat >= 32 else 1, count[live] - sat)
        t = tables[live]
        new = fresh[live] / np.maximum(sat - d[live] * t + fresh[live], 1e-300)
        tables[live] += rng.binomial(group, np.clip(new, 0, 1))
        sat += max(1, sat // 8) if sat >= 32 else 1
        live = live[count[live] > sat]
    return tables


def parent(tables: np.ndarray, own: np.ndarray, g: dict) -> np.ndarray:
    """Predictive probability of words with these customers and tables in the parent restaurant."""
    return (np.maximum(tables - g["d1"] * own, 0) + (THETA + g["d1"] * g["roots"]) * g["base"]) / (THETA + g["customers"])


def sweep(b: Bucket, g: dict, tables_of: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One seating of a bucket: tables of each pair, and each rare word's customers and tables in the parent. tables_of: tables of the bucket's contexts, frequent ones first."""
    rng = np.random.default_rng(seed)
    tables = np.minimum(b.count, 1)
    up = np.bincount(b.local, tables[b.rare], len(b.rare_words)).astype(np.int64)
    own = np.minimum(up, 1)
    many = np.flatnonzero(b.count > 1)
    for _ in range(2):  # a rare word's parent tables and its pairs' tables in turn
        p = np.empty(len(b.keys))
        p[~b.rare] = g["p1"][b.word[~b.rare]]
        p[b.rare] = parent(up, own, g)[b.local]
        tables[many] = seat(rng, b.count[many], g["d"], (THETA + g["d"] * tables_of[b.context[many]]) * p[many])
        up = np.bincount(b.local, tables[b.rare], len(b.rare_words)).astype(np.int64)
        own = seat(rng, up, g["d1"], np.full(len(up), (THETA + g["d1"] * g["roots"]) * g["base"]))
    return tables, up, own


def predictive(b: Bucket, g: dict, served: np.ndarray, tables_of: np.ndarray, seed: int) -> np.ndarray:
    """Probability of each pair's word in its context, by one seating. served, tables_of: customers and tables of the bucket's contexts."""
    t, up, own = sweep(b, g, tables_of, seed)
    low = np.empty(len(b.keys))
    low[~b.rare] = g["p1"][b.word[~b.rare]]
    low[b.rare] = parent(up, own, g)[b.local]
    return (np.maximum(b.count - g["d"] * t, 0) + (THETA + g["d"] * tables_of[b.context]) * low) / (THETA + served[b.context])


CHUNK = 1024
#: kind 0: a chunk (other) of sums by frequent word; kind 1: a bucket's (other) contexts of the home `bucket`: hashes, customers, tables.
ROUND = "kind int, bucket int, other int, a binary, b binary, c binary"
#: What a home tells: kind 0: to itself, which of its contexts a bucket (other) has; kind 1: to a bucket, the customers and tables of its contexts of the home (other).
TOLD = "kind int, bucket int, other int, a binary, b binary"
PAIR_COLUMNS = ["bucket", "docs", "lens", "contexts", "words", "rare", "rare_contexts"]


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names = [c.split()[0] for c in schema.split(", ")]
    types = [pa.int32() if c.endswith(" int") else pa.binary() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)


def opened(batch: pa.RecordBatch, i: int) -> tuple[int, Bucket, list]:
    """A row's bucket, its pairs, and what homes told it."""
    own = Bucket(*(batch.column(c)[i].as_buffer() for c in range(1, 7)))
    return batch.column(0)[i].as_py(), own, (batch.column(7)[i].as_py() or []) if batch.num_columns > 7 else []


def told(b: Bucket, blobs: list, part: int, buckets: int) -> np.ndarray:
    """Values of a bucket's rare contexts, of one part of what their homes told."""
    out = np.zeros(len(b.rare_contexts), np.float64)
    order = np.argsort(mix64(b.rare_contexts) % U(buckets), kind="stable")
    out[order] = np.frombuffer(b"".join(x["v"] for x in blobs if x["part"] == part), np.uint32)
    return out


def messages(b: Bucket, bucket: int, customers: np.ndarray, tables: np.ndarray, buckets: int, first: bool) -> list[tuple]:
    """A row for each home of the bucket's rare contexts. Only the first round has hashes and customers."""
    home = (mix64(b.rare_contexts) % U(buckets)).astype(np.int64)
    order = np.argsort(home, kind="stable")
    cuts = np.flatnonzero(np.append(True, np.diff(home[order]) != 0)).tolist() if len(order) else []
    out = []
    for x, y in zip(cuts, [*cuts[1:], len(order)]):
        i = order[x:y]
        own = (b.rare_contexts[i].tobytes(), customers[i].astype(np.uint32).tobytes()) if first else (None, None)
        out.append((1, int(home[i[0]]), bucket, *own, tables[i].astype(np.uint32).tobytes()))
    return out


class Homes:
    """Sums of rare contexts over the buckets that have them."""

    def __init__(self, buckets: int):
        self.buckets, self.layout = buckets, None

    def add(self, sent: DataFrame) -> DataFrame:
        """(bucket, other, a, b): what homes tell, of the messages of one round."""
        buckets, first = self.buckets, self.layout is None

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for home, held in _by_bucket(batches):
                rows = [r for b in held for r in zip(*(b.column(i).to_pylist() for i in range(1, 6)))]
                if first:
                    senders = [r[1] for r in rows]
                    size = [len(r[2]) // 8 for r in rows]
                    names, inverse = np.unique(np.frombuffer(b"".join(r[2] for r in rows), U), return_inverse=True)
                    places = dict(zip(senders, np.split(inverse, np.cumsum(size)[:-1])))
                    sums = [np.bincount(inverse, np.frombuffer(b"".join(r[i] for r in rows), np.uint32), len(names)) for i in (3, 4)]
                    out = [(0, home, s, p.astype(np.uint32).tobytes(), None) for s, p in places.items()]
                else:
                    places = {r[1]: np.frombuffer(r[2], np.uint32) for r in rows if not r[0]}
                    own = {r[1]: np.frombuffer(r[4], np.uint32) for r in rows if r[0]}
                    total = np.zeros(1 + max(int(p.max()) for p in places.values()))
                    for s, p in places.items():
                        np.add.at(total, p, own[s])
                    sums, out = [total], []
                for s, p in places.items():
                    a = sums[0][p].astype(np.uint32).tobytes() if first else None
                    out.append((1, s, home, a, sums[-1][p].astype(np.uint32).tobytes()))
                yield _rows(out, TOLD)

        sent = sent.where("kind = 1").select("bucket", "kind", "other", "a", "b", "c")
        if not first:
            sent = sent.union(self.layout.select("bucket", F.lit(0).alias("kind"), "other", "a", F.lit(None).cast("binary"), F.lit(None).cast("binary")))
        got = written(sent.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(meet, TOLD), "lm-homes")
        if first:
            self.layout = got.where("kind = 0").select("bucket", "other", "a")
        return got.where("kind = 1").select("bucket", "other", "a", "b")


def with_told(pairs: DataFrame, *parts: tuple[DataFrame, str]) -> DataFrame:
    """pairs with a column `told`: for each bucket what homes told, of each part (what `Homes.add` gave, one of its columns) in turn, in the order of the homes. Hashed by the small side, so the pairs are neither moved nor sorted."""
    rows = None
    for k, (told_, column) in enumerate(parts):
        own = told_.select("bucket", F.lit(k).alias("part"), "other", F.col(column).alias("v"))
        rows = own if rows is None else rows.union(own)
    x = rows.groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("part", "other", "v"))).alias("x"))
    return pairs.join(x.select("bucket", F.transform("x", lambda s: F.struct(s["part"].alias("part"), s["v"].alias("v"))).alias("told")).hint("shuffle_hash"), "bucket", "left")


def _sums(pairs: DataFrame, homes: Homes, each: Callable, size: int) -> tuple[np.ndarray, DataFrame]:
    """Sums over all buckets of the arrays (of `size`) that `each` makes of a bucket, and what homes tell of its rare contexts. Arrays are summed by chunks, so no task holds more than its chunks, and the driver gets one array."""

    buckets, first = homes.buckets, homes.layout is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for i in range(batch.num_rows):
                bucket, b, local = opened(batch, i)
                own, customers, tables = each(b, bucket, local)
                total += own
                yield _rows(messages(b, bucket, customers, tables, buckets, first), ROUND)
        yield _rows([(0, i, 0, total[i * CHUNK : (i + 1) * CHUNK].tobytes(), None, None) for i in range(-(-size // CHUNK))], ROUND)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = np.frombuffer(x, np.float64)
                total[i] = total[i] + x if i in total else x
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["bucket", "sums"])

    n = spread(pairs.sparkSession)
    sent = written(pairs.mapInArrow(run, ROUND), "lm-sweep")
    rows = sent.where("kind = 0").select("bucket", F.col("a").alias("sums")).repartition(n, "bucket").mapInArrow(add, "bucket int, sums binary").collect()
    out = np.zeros(-(-size // CHUNK) * CHUNK)
    for r in rows:
        x = np.frombuffer(r["sums"], np.float64)
        out[r["bucket"] * CHUNK : r["bucket"] * CHUNK + len(x)] = x
    return out[:size], homes.add(sent)


def gibbs(pairs: DataFrame, words: dict, buckets: int, burn: int, samples: int, seed: int) -> tuple[list[dict], DataFrame, list[DataFrame]]:
    """The state that each of the `samples` seatings is drawn from: tables and customers of frequent contexts, the parent's probabilities of frequent words, and its totals; then what homes told of customers, and of tables in each state."""
    extra = 8  # rare words' customers, tables; pairs with one and two customers; rare words with one and two customers
    homes = Homes(buckets)

    def first(b: Bucket, *_) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        out = np.zeros(3 * OWN + extra)
        out[:OWN], customers = b.by_context(b.count)
        out[OWN : 2 * OWN], tables = b.by_context(b.count > 0)
        out[2 * OWN : 3 * OWN] = np.bincount(b.word[~b.rare], b.count[~b.rare] > 0, OWN)
        up = np.bincount(b.local, b.count[b.rare] > 0, len(b.rare_words))
        out[3 * OWN :] = [up.sum(), (up > 0).sum(), (b.count == 1).sum(), (b.count == 2).sum(), (up == 1).sum(), (up == 2).sum(), 0, 0]
        return out, customers, tables

    own_pairs = pairs.where("kind = 0").select(*PAIR_COLUMNS)
    got, rare = _sums(own_pairs, homes, first, 3 * OWN + extra)
    told_ = [rare]
    customers, tables, up, rest = got[:OWN], got[OWN : 2 * OWN], got[2 * OWN : 3 * OWN], got[3 * OWN :]
    ones, twos = rest[4] + (up == 1).sum(), rest[5] + (up == 2).sum()
    d = float(np.clip(rest[2] / max(rest[2] + 2 * rest[3], 1), 0.1, 0.95))
    d1 = float(np.clip(ones / max(ones + 2 * twos, 1), 0.1, 0.95))
    rng = np.random.default_rng(seed)
    base = 1 / (words["types"] + 1)
    roots = float(np.minimum(up, 1).sum() + rest[1])
    states = []
    for s in range(burn + samples):
        if s:
            now = states[-1]

            def again(b: Bucket, bucket: int, local: list, now=now, s=s) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
                t, rare_up, rare_own = sweep(b, now, np.concatenate([now["tables"], told(b, local, 0, buckets)]), sweep_seed(seed, s - 1, bucket))
                out = np.zeros(2 * OWN + 2)
                out[:OWN], own = b.by_context(t)
                out[OWN : 2 * OWN] = np.bincount(b.word[~b.rare], t[~b.rare], OWN)
                out[-2:] = rare_up.sum(), rare_own.sum()
                return out, own, own

            got, rare = _sums(with_told(own_pairs, (rare, "b")), homes, again, 2 * OWN + 2)
            told_.append(rare)
            tables, up, rest = got[:OWN], got[OWN : 2 * OWN], got[-2:]
        total = float(up.sum() + rest[0])
        own = seat(rng, up.astype(np.int64), d1, np.full(OWN, (THETA + d1 * roots) * base))
        roots = float(own.sum() + rest[1])
        g = {"d": d, "d1": d1, "base": base, "roots": roots, "customers": total, "tables": tables, "served": customers}
        g["p1"] = parent(up, own, g)
        states.append(g)
    return states[burn:], told_[0], told_[burn:]


def sweep_seed(seed: int, step: int, bucket: int) -> int:
    return (seed * 1_000_003 + step * 7_919 + bucket) & 0x7FFFFFFF


def score(docs: DataFrame, parts: int = 7, held: int = 2, burn: int = 2, samples: int = 2, seed: int = 7, own: int = OWN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) of each row.

    Rows with crc32(doc_id as text) mod `parts` other than `held` train. Words
    are lower-cased in A-Z. A null or empty text is the end token alone. Rows
    that repeat a doc_id, or have none, are documents of their own; rows
    without an id train. With no training rows every known count is zero.
    own: how many words are kept as arrays, OWN at most; the model is the same
    for every number.
    """
    spark = docs.sparkSession
    base = marked(docs, parts, held, id_col, text_col)
    words = vocabulary(base, own)
    buckets = max(spread(spark), min(words["tokens"] // BUCKET_TOKENS, MOST_BUCKETS))
    pairs = dealt(base, words, buckets)
    found, customers, tables = gibbs(pairs, words, buckets, burn, samples, seed)
    states = spark.sparkContext.broadcast(found)

    def doc_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                rows = np.frombuffer(blob, DOC)
                key = (mix64(rows["row"]) % U(buckets)).astype(np.int32)
                yield parcels([(int(k), rows[key == k].tobytes(), *[None] * 4) for k in np.unique(key)])

    def parcels(blobs: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in blobs], pa.int32()), *(pa.array([x[c] for x in blobs], pa.binary()) for c in range(1, 6))], ["bucket", "docs", "rows", *PART.names])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                bucket, b, local = opened(batch, i)
                served = told(b, local, 0, buckets)
                p = np.zeros(len(b.keys))
                for s, g in enumerate(states.value, burn):  # the seats that the next sweep draws from this state
                    tables = np.concatenate([g["tables"], told(b, local, s - burn + 1, buckets)])
                    p += predictive(b, g, np.concatenate([g["served"], served]), tables, sweep_seed(seed, s, bucket))
                logs = np.log10(p / len(states.value))
                known = np.zeros(len(b.keys), np.int64)
                known[b.rare] = b.seen[b.local]
                flat = np.log10(known + 1.0)
                some = np.flatnonzero(b.lens)  # entries of documents, each with its tokens side by side
                first = np.cumsum(b.lens, dtype=np.int64)[some] - b.lens[some]
                row, at = np.unique(b.entries[some] >> U(1), return_inverse=True)
                rows = np.zeros(len(row), PART)
                rows["score"] = np.bincount(at, np.add.reduceat(logs[b.pair], first), len(row))
                rows["known"] = np.bincount(at, np.add.reduceat((known > 0).astype(np.int64)[b.pair], first), len(row))
                rows["base"] = np.bincount(at, np.add.reduceat(flat[b.pair], first), len(row))
                key = (mix64(row) % U(buckets)).astype(np.int32)
                order = np.argsort(key, kind="stable")
                edges = np.searchsorted(key[order], np.arange(buckets + 1))
                blobs = [(k, None, _deltas(row[order[x:y]]), *(rows[c][order[x:y]].tobytes() for c in PART.names)) for k, (x, y) in enumerate(zip(edges, edges[1:])) if y > x]
                yield parcels(blobs)

    n_train, n_types = words["tokens"], words["types"]

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held_ in _by_bucket(batches):
            d = _joined(held_, 1, DOC)
            d = d[np.argsort(d["row"])]
            at = np.searchsorted(d["row"], np.concatenate([np.zeros(0, U), *(_undeltas(x) for b in held_ for x in b.column(2).to_pylist() if x is not None)]))
            p = {c: _joined(held_, 3 + i, PART[c]) for i, c in enumerate(PART.names)}
            known = d["known"] + np.bincount(at, p["known"], len(d)).astype(np.int64)
            base_sum = d["base"] + np.bincount(at, p["base"], len(d))
            own = np.bincount(at, p["score"], len(d))
            flat = base_sum - d["n"] * np.log10(n_train + 1 * (n_types + 1))
            ids = pa.array(d["id"].copy(), mask=d["null"].astype(bool))
            cols = [ids, pa.array(d["train"] == 0), pa.array(d["n"].copy()), pa.array(known), pa.array(np.full(len(d), n_train, np.int64)), pa.array(flat), pa.array(own), pa.array(10 ** (-own / d["n"]))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    parcel = "bucket int, docs binary, rows binary, known binary, score binary, base binary"
    judged = with_told(pairs.where("kind = 0").select(*PAIR_COLUMNS), (customers, "a"), *((t, "b") for t in tables))
    sent = judged.mapInArrow(judge, parcel).union(pairs.where("kind = 1").select("docs").mapInArrow(doc_rows, parcel))
    schema = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, perplexity double"
    return sent.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(total, schema)
