"""Exact top-k by inner product with a KD-tree per shard.

Shards are parts of space, the leaves of median splits of a bounded sample; a
leaf with more than its share, such as copies of one vector, is dealt to several
shards by id, so none is crowded. A shard's tree splits at the median of the
widest side and keeps tight bounding boxes. For a query q the bound of a box is
the sum of max(q_i * low_i, q_i * high_i): no vector inside scores more. The
traversal opens the box of highest bound first and ends when it can't beat the
kth score. A query first searches the shard of highest bound; the kth score
found there goes with it to those shards only whose whole box allows as much.
Each shard returns k rows a query at most.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mix64, spread, written

SHARD = 20_000
LEAF = 64
BLOCK = 512


class KDTree:
    """Median splits with tight boxes over integer vectors; scores are exact."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF):
        order = np.argsort(ids, kind="stable")
        self.ids, vectors = ids[order], vectors[order]
        most = int(np.abs(vectors.astype(np.float64)).max(initial=0)) + 1
        self.exact_float = most * most * max(1, vectors.shape[1]) < 2**53
        self.lows, self.highs, self.kids, self.spans = [], [], [], []
        self.perm = np.arange(len(vectors))
        self.vectors = vectors.astype(np.float64) if self.exact_float else vectors
        if len(vectors):
            self._grow(0, len(vectors), leaf)
            self.ids, self.vectors = self.ids[self.perm], self.vectors[self.perm]
            self.low, self.high = np.array(self.lows), np.array(self.highs)

    def _grow(self, a: int, b: int, leaf: int) -> int:
        own = self.vectors[self.perm[a:b]]
        low, high = own.min(0), own.max(0)
        node = len(self.kids)
        self.lows.append(low)
        self.highs.append(high)
        self.kids.append(())
        self.spans.append((a, b))
        side = (high - low).argmax() if own.shape[1] else 0
        if b - a > leaf and own.shape[1] and high[side] > low[side]:
            mid = (a + b) // 2
            self.perm[a:b] = self.perm[a:b][np.argpartition(own[:, side], mid - a)]
            self.kids[node] = (self._grow(a, mid, leaf), self._grow(mid, b, leaf))
        return node

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Highest possible score in each node's box, for each query."""
        q = queries.astype(self.vectors.dtype)
        return np.maximum(q, 0) @ self.high.T + np.minimum(q, 0) @ self.low.T

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, kth: np.ndarray) -> list[tuple[int, int, int]]:
        """(query, vector, score) of the k best of each query that score kth at least; ties go to smaller ids."""
        out: list[tuple[int, int, int]] = []
        if not len(self.ids):
            return out
        bounds = self.bounds(queries)
        for q, own, bound, least in zip(query_ids.tolist(), queries.astype(self.vectors.dtype), bounds, kth.tolist()):
            heap, best = [(-bound[0], 0)], []  # best: (score, -id), the worst first
            while heap and -heap[0][0] >= least:
                _, node = heapq.heappop(heap)
                if self.kids[node]:
                    for kid in self.kids[node]:
                        if bound[kid] >= least:
                            heapq.heappush(heap, (-bound[kid], kid))
                    continue
                a, b = self.spans[node]
                scores = self.vectors[a:b] @ own
                for i in np.flatnonzero(scores >= least).tolist():
                    row = (int(scores[i]), -int(self.ids[a + i]))
                    if -row[1] == q:
                        continue
                    if len(best) < k:
                        heapq.heappush(best, row)
                    elif row > best[0]:
                        heapq.heapreplace(best, row)
                    if len(best) == k:
                        least = max(least, best[0][0])
            out += [(q, -i, s) for s, i in best]
        return out


def _rows(batch: pa.RecordBatch) -> np.ndarray:
    col = batch.column(batch.schema.get_field_index("v"))
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(col), -1 if len(flat) else 0)


def _search(dealt: DataFrame, k: int) -> DataFrame:
    """Rows (dim, shard, kind, vec_id, v, kth): kind 0 builds a shard's tree, kind 1 asks it."""
    lowest = -(2**63)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, vectors, tree = None, [], [], None
        for batch in batches:
            head = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)], 1)
            cuts = [0, *(np.flatnonzero((np.diff(head, axis=0) != 0).any(1)) + 1).tolist(), len(head)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if at != (key := tuple(head[a, :2].tolist())):
                    at, ids, vectors, tree = key, [], [], None
                own, v = part.column(3).to_numpy(zero_copy_only=False), _rows(part)
                if head[a, 2] == 0:
                    ids.append(own)
                    vectors.append(v)
                    continue
                if not ids:
                    continue
                tree = tree or KDTree(np.concatenate(ids), np.concatenate(vectors))
                kth = part.column(5).fill_null(lowest).to_numpy(zero_copy_only=False)
                for i in range(0, len(own), BLOCK):
                    found = tree.search(own[i : i + BLOCK], v[i : i + BLOCK], k, kth[i : i + BLOCK])
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["query_id", "vec_id", "score"])

    n = spread(dealt.sparkSession)
    return dealt.repartition(n, "dim", "shard").sortWithinPartitions("dim", "shard", "kind").mapInArrow(run, "query_id bigint, vec_id bigint, score bigint")


def integer_vectors(table: DataFrame, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v array<bigint>) with components floor(scale * x); repeated rows once. Null ids, null vectors and vectors with a null, infinite or NaN component take no part."""
    x = F.col("x").cast("array<double>")
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    rows = table.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).alias("x")).where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & fine)
    return rows.select("vec_id", F.transform(x, lambda e: F.floor(e * scale)).alias("v")).distinct()


#: Shards at most, so that their boxes, which all tasks know, have a bound; and rows of the sample that the splits are made from.
MOST_SHARDS = 4096
SAMPLE = 20_000


def splits(sample: np.ndarray, leaves: int) -> tuple[list[tuple[int, int, int, int]], list[int]]:
    """Median splits of a sample into that many leaves at most: nodes (axis, cut, left, right), leaves as -1 - number, the first one the root; and how many rows of the sample each leaf has."""
    nodes: list[tuple[int, int, int, int]] = []
    sizes: list[int] = []

    def grow(x: np.ndarray, n: int) -> int:
        axis = int(np.argmax(x.max(0) - x.min(0))) if len(x) and x.shape[1] else 0
        own = np.sort(x[:, axis]) if len(x) and x.shape[1] else np.zeros(0)
        cut = own[max(len(own) * (n // 2) // n, 1)] if n > 1 and len(own) > 1 else None
        if cut is not None and cut == own[0]:  # many rows tie at the lowest value: the next one parts them
            above = own[own > cut]
            cut = above[0] if len(above) else None
        if cut is None:
            sizes.append(len(x))
            return -len(sizes)
        at = len(nodes)
        nodes.append((axis, int(cut), 0, 0))
        low = x[:, axis] < cut
        nodes[at] = (axis, int(cut), grow(x[low], n // 2), grow(x[~low], n - n // 2))
        return at

    grow(sample, max(leaves, 1))
    return nodes, sizes


def leaves_of(nodes: list[tuple[int, int, int, int]], v: np.ndarray) -> np.ndarray:
    """The leaf of each vector."""
    out = np.zeros(len(v), np.int64)
    todo = [(0 if nodes else -1, np.arange(len(v)))]
    while todo:
        node, rows = todo.pop()
        if node < 0:
            out[rows] = -1 - node
        elif len(rows):
            axis, cut, left, right = nodes[node]
            low = v[rows, axis] < cut
            todo += [(left, rows[low]), (right, rows[~low])]
    return out


def sharded(vectors: DataFrame, shards: int) -> DataFrame:
    """(dim, shard, vec_id, v), written: shards are the leaves of median splits of a sample of SAMPLE rows, by dimension.

    A leaf with more than its share of the sample (copies of a vector can't be
    split) is dealt to several shards by id. Dimensions that the sample lacks
    have one shard.
    """
    sample: dict[int, list] = {}
    for r in vectors.orderBy(F.xxhash64("vec_id", "v")).limit(SAMPLE).collect():
        sample.setdefault(len(r["v"]), []).append(r["v"])
    total = max(sum(map(len, sample.values())), 1)
    plans, first = {}, 1  # shard 0: dimensions that the sample lacks
    for dim, rows in sorted(sample.items()):
        nodes, sizes = splits(np.array(rows, np.int64).reshape(len(rows), dim), max(1, round(shards * len(rows) / total)))
        salts = np.maximum(1, np.round(np.array(sizes) * shards / total).astype(np.int64))
        plans[dim] = nodes, salts, first + np.cumsum(salts) - salts
        first += int(salts.sum())
    plans = vectors.sparkSession.sparkContext.broadcast(plans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, dims = batch.column(0).to_numpy(zero_copy_only=False), np.asarray(pc.list_value_length(batch.column(1)))
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                own = ids[dims == dim]
                shard = np.zeros(len(own), np.int64)
                if dim in plans.value:
                    nodes, salts, begin = plans.value[dim]
                    leaf = leaves_of(nodes, _rows(part))
                    shard = begin[leaf] + (mix64(own.astype(np.uint64)) % salts[leaf].astype(np.uint64)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), dim, np.int32)), pa.array(shard), part.column(0), part.column(1)], ["dim", "shard", "vec_id", "v"])

    return written(vectors.select("vec_id", "v").mapInArrow(run, "dim int, shard bigint, vec_id bigint, v array<bigint>"), "knn-shards")


def boxes(base: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By dimension: shards, and the least and greatest value of each axis in them: a row a shard, MOST_SHARDS and one more a dimension at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            key = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2)], 1)
            for dim, shard in np.unique(key, axis=0).tolist():
                v = _rows(batch.filter(pa.array((key == (dim, shard)).all(1))))
                low, high = v.min(0), v.max(0)
                old = held.get((dim, shard), (low, high))
                held[dim, shard] = np.minimum(old[0], low), np.maximum(old[1], high)
        keys = list(held)
        kind = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int64()), pa.array([held[k][0] for k in keys], kind), pa.array([held[k][1] for k in keys], kind)], ["dim", "shard", "low", "high"])

    axes = base.select("dim", "shard", "v").mapInArrow(run, "dim int, shard bigint, low array<bigint>, high array<bigint>")
    axes = axes.select("dim", "shard", F.posexplode_outer(F.arrays_zip("low", "high")).alias("i", "b")).groupBy("dim", "shard", "i").agg(F.min("b.low").alias("low"), F.max("b.high").alias("high"))
    rows = axes.groupBy("dim", "shard").agg(F.array_sort(F.collect_list(F.struct("i", "low", "high"))).alias("b")).collect()
    out: dict[int, tuple[list, list, list]] = {}
    for r in rows:
        own = out.setdefault(r["dim"], ([], [], []))
        own[0].append(r["shard"])
        own[1].append([b["low"] for b in r["b"] if b["i"] is not None])
        own[2].append([b["high"] for b in r["b"] if b["i"] is not None])
    return {dim: tuple(np.array(x, np.int64) for x in own) for dim, own in out.items()}


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, shard: int = SHARD) -> DataFrame:
    """(query_id, rank int, vec_id, score): for each query row the k vectors of other ids and its dimension with the highest inner products.

    vectors, queries: (vec_id, v). Shards are parts of space. A query goes to
    the shard whose box allows the highest score, and then to those others
    whose boxes allow its kth score so far. Fewer than k others give all.
    Scores must fit in 64 bits. Empty tables give no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.count()
    shards = min(max(spread(spark), -(-rows // shard)), MOST_SHARDS)
    base = sharded(vectors, shards)
    known = spark.sparkContext.broadcast(boxes(base))

    def routed(first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                dims = np.asarray(pc.list_value_length(batch.column(1)))
                for dim in np.unique(dims).tolist():
                    if dim not in known.value:
                        continue
                    names, low, high = known.value[dim]
                    part = batch.filter(pa.array(dims == dim))
                    for a in range(0, part.num_rows, BLOCK):
                        some = part.slice(a, BLOCK)
                        q = _rows(some)
                        bound = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
                        best = names[bound.argmax(1)] if bound.shape[1] else names[:0]
                        if first:
                            to = best[:, None].tolist()
                        else:
                            kth = some.column(2).fill_null(-(2**63)).to_numpy(zero_copy_only=False)
                            to = [names[(b >= t) & (names != own)].tolist() for b, t, own in zip(bound, kth, best)]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(some.num_rows, dim, np.int32)), some.column(0), some.column(1), some.column(2), pa.array(to, pa.list_(pa.int64()))], ["dim", "vec_id", "v", "kth", "to"])

        return run

    def sent(asked: DataFrame, first: bool) -> DataFrame:
        found = asked.select("vec_id", "v", "kth").mapInArrow(routed(first), "dim int, vec_id bigint, v array<bigint>, kth bigint, to array<bigint>")
        return found.select("dim", F.explode("to").alias("shard"), F.lit(1).alias("kind"), "vec_id", "v", "kth")

    trees = base.select("dim", "shard", F.lit(0).alias("kind"), "vec_id", "v", F.lit(None).cast("bigint").alias("kth"))
    asked = queries.select("vec_id", "v")
    home = written(_search(trees.union(sent(asked.withColumn("kth", F.lit(None).cast("bigint")), True)), k), "knn-home")
    kth = home.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low")).where(F.col("n") >= k).select(F.col("query_id").alias("vec_id"), F.col("low").alias("kth"))
    away = _search(trees.union(sent(asked.join(kth, "vec_id", "left"), False)), k)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return home.union(away).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
