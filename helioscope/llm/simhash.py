"""SimHash near-duplicates by pivot distance tables.

A fingerprint's row of the table holds its Hamming distances to many reference
fingerprints (pivots). By the triangle inequality two fingerprints within
`max_bits` differ by at most that in every coordinate, so a pair whose maximum
coordinate difference is larger is discarded, and survivors are verified. So
that no pair of all fingerprints is formed, the rows are dealt by keys: with
max_bits = 3 and five blocks, close fingerprints agree in two blocks at least.
A key with more than `crowd` fingerprints is split by the blocks of its
remaining bits, again and again: with four such blocks close fingerprints
agree in one. So no key ever holds more than min(crowd, 2^(bits left))
fingerprints in the end. Each task emits a spanning forest of the links that
it verified, never the pairs of a group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, slices, spread, texts_of, written
from .components import components, forest

BITS = 64
PIVOTS = 32
CROWD = 4096
UPPER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shingle_hashes(text: str, words: int, seed: int = 42) -> list[int]:
    """XXH64 of each run of `words` words (lower-cased A-Z, joined by one space), repeats included; fewer words are one run."""
    own = text.encode().translate(UPPER).split()  # bytes.split() parts at space and tab to carriage return
    if not own:
        return []
    whole = b" ".join(own)
    if len(own) <= words:
        return [xxhash.xxh64_intdigest(whole, seed)]
    starts = [0, *accumulate(len(w) + 1 for w in own)]
    digest = xxhash.xxh64_intdigest
    return [digest(whole[a : b - 1], seed) for a, b in zip(starts, starts[words:])]


def fingerprint(hashes: list[int] | np.ndarray) -> int:
    """Bit b is set if it is set in over half of the hashes; zero for none."""
    if len(hashes) == 0:
        return 0
    rows = np.asarray(hashes, np.uint64).view(np.uint8).reshape(-1, 8)
    ones = np.unpackbits(rows, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp bigint) of each row: a narrow map. Null and empty texts have fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = np.array([fingerprint(shingle_hashes(t, words)) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return texts_of(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, fp bigint")


def _blocks(low: int, high: int, parts: int) -> list[tuple[int, int]]:
    """Bits low to high - 1 cut into `parts` ranges."""
    cuts = [low + (high - low) * i // parts for i in range(parts + 1)]
    return list(zip(cuts, cuts[1:]))


def _mask(ranges: list[tuple[int, int]]) -> int:
    return sum((1 << b) - (1 << a) for a, b in ranges)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def pivot_table(fps: np.ndarray, pivots: int = PIVOTS) -> np.ndarray:
    """Hamming distances of each fingerprint to the reference fingerprints, which are the same everywhere."""
    refs = mix64(np.arange(1, pivots + 1, dtype=np.uint64))
    return np.stack([np.bitwise_count(fps ^ r) for r in refs], 1).astype(np.int8)


def close_pairs(keys: np.ndarray, fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of pairs of one key within max_bits. keys are sorted."""
    table = pivot_table(fps)
    us, vs, held = [], [], 0
    at, d = np.arange(len(keys)), 1
    while True:
        at = at[at + d < len(keys)]
        at = at[keys[at] == keys[at + d]]  # rows that have a d-th next row have a (d - 1)-th
        if not len(at):
            break
        i = at
        for a in range(0, table.shape[1], 8):
            i = i[np.abs(table[i, a : a + 8] - table[i + d, a : a + 8]).max(1) <= max_bits] if len(i) else i
        i = i[np.bitwise_count(fps[i] ^ fps[i + d]) <= max_bits]
        us.append(fps[i])
        vs.append(fps[i + d])
        held += len(i)
        if held > 1_000_000:
            u, v = forest(np.concatenate(us), np.concatenate(vs))
            us, vs, held = [u], [v], 0
        d += 1
    if not us:
        return fps[:0], fps[:0]
    return forest(np.concatenate(us), np.concatenate(vs))


def _edges_within(keyed: DataFrame, max_bits: int) -> DataFrame:
    """Edges (u, v) among rows (key, fp) of equal keys, none with more than CROWD rows. A task goes through its rows key by key, in bounded runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def links(keys, fps):
            u, v = close_pairs(keys, fps, max_bits)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

        for batch in batches:
            keys = np.concatenate([keys, batch.column(0).to_numpy(zero_copy_only=False)])
            fps = np.concatenate([fps, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
            if len(keys) > 200_000:
                cut = int(np.searchsorted(keys, keys[-1]))  # the last key may go on
                yield links(keys[:cut], fps[:cut])
                keys, fps = keys[cut:], fps[cut:]
        yield links(keys, fps)

    n = spread(keyed.sparkSession)
    return keyed.repartition(n, "key").sortWithinPartitions("key", "fp").mapInArrow(run, "u bigint, v bigint")


def links(fps: DataFrame, max_bits: int = 3, crowd: int = CROWD) -> DataFrame:
    """Edges (u, v) whose components are those of all pairs of distinct fingerprints within max_bits. fps: distinct (fp)."""
    first = _blocks(0, BITS, max_bits + 2)
    choices = [_mask(list(pair)) for pair in combinations(first, 2)]
    keyed = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(_signed(m)).alias("mask"), F.lit(_signed(m)).bitwiseAND(F.col("fp")).alias("part")) for m in choices])).alias("k"))
    keyed = keyed.select("fp", F.col("k.mask").alias("mask"), F.xxhash64("k.mask", "k.part").alias("key"))
    out = None
    while True:
        keyed = written(keyed, "simhash-keys")
        many = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).withColumn("crowded", F.col("n") > crowd)
        marked = written(keyed.join(many.select("key", "crowded"), "key"), "simhash-marked")
        found = _edges_within(marked.where("not crowded").select("key", "fp"), max_bits)
        out = found if out is None else out.union(found)
        rest = marked.where("crowded")
        masks = [r["mask"] for r in rest.select("mask").distinct().collect()]  # at most one for each choice of blocks
        if not masks:
            return out
        finer = {}
        for m in masks:
            free = [b for b in range(BITS) if not (m >> b) & 1]
            cuts = _blocks(0, len(free), max_bits + 1)
            finer[m] = sorted({_signed((m & (1 << 64) - 1) | sum(1 << free[i] for i in range(a, b))) for a, b in cuts if b > a})
        case = None
        for m, subs in finer.items():
            cell = F.array(*[F.lit(s) for s in subs])
            case = F.when(F.col("mask") == m, cell) if case is None else case.when(F.col("mask") == m, cell)
        keyed = rest.select("fp", "key", F.explode(case).alias("mask")).select("fp", "mask", F.xxhash64("key", "mask", F.col("mask").bitwiseAND(F.col("fp"))).alias("key"))


def near_duplicates(prints: DataFrame, max_bits: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) of rows (doc_id, fp): component_id is the least doc_id reachable over links of at most max_bits.

    Equal fingerprints are one node. A null doc_id never names a component
    unless no other is reachable; repeated rows each give a row.
    """
    prints = written(prints.select("doc_id", "fp"), "simhash")
    reps = written(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-reps")
    roots = components(links(reps.select("fp"), max_bits), "simhash-components").select(F.col("node").alias("fp"), "root")
    tied = reps.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lows = tied.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = tied.join(lows, "root").select("fp", "component_id")
    return prints.join(named, "fp", "left").select("doc_id", "fp", "component_id")


def hex_digits(fp: F.col) -> F.col:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def digests(found: DataFrame) -> DataFrame:
    """The columns of the query op9."""
    return found.select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


WIDE = 4
ROWS, BANDS, SPLITS = 2, 12, 6
LEVELS = 3
#: Standard deviations that the loose filter allows: at 0.8 that is 73 bits, four above the mean of the worst small sets (4 of 5 shingles in common).
LOOSE = 6.0


def expected_bits(similarity: float, bits: int = 64 * WIDE, margin: float = 0.5) -> int:
    """Bits that differ between texts whose shingle sets (of one size) have this Jaccard similarity: the expectation and `margin` standard deviations."""
    p = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    return int(bits * p + margin * np.sqrt(bits * p * (1 - p)))


def shingle_set(text: str, words: int) -> np.ndarray:
    """Distinct hashes of a text's shingles, rising."""
    return np.unique(np.array(shingle_hashes(text, words), np.uint64))


def wide_prints(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row, content binary, fp binary, lows binary): a hash of id and text, a 128-bit digest of the set of shingles, a fingerprint of 64 * WIDE bits, and the least values of the shingles under fixed hash functions. Texts without words have none of the last three."""
    n = ROWS * BANDS + SPLITS * LEVELS
    factors = mix64(np.arange(101, 101 + n, dtype=np.uint64)) | np.uint64(1)
    seeds = mix64(np.arange(1, WIDE + 1, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            contents, fps, lows = [], [], []
            for text in batch.column(1).to_pylist():
                h = shingle_set(text, words)
                if not len(h):
                    for out in (contents, fps, lows):
                        out.append(None)
                    continue
                contents.append(xxhash.xxh3_128_digest(h.tobytes()))
                fps.append(b"".join(np.uint64(fingerprint(mix64(h ^ s))).tobytes() for s in seeds))
                lows.append(np.array([(h * f).min() for f in factors]).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(x, pa.binary()) for x in (contents, fps, lows))], ["doc_id", "row", "content", "fp", "lows"])

    rows = texts_of(docs, id_col, text_col).withColumn("row", F.xxhash64("doc_id", "text"))
    return rows.mapInArrow(run, "doc_id bigint, row bigint, content binary, fp binary, lows binary")


def linked(first: int, order: np.ndarray, near: Callable[[int, np.ndarray], np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """A spanning tree over `first` and what of `order` it reaches: (row, rows linked to it that no row before was). Every row that is reached is compared with all that aren't yet."""
    reached = [first]
    while reached and len(order):
        at = reached.pop()
        hit = near(at, order)
        if hit.any():
            yield at, order[hit]
            reached += order[hit].tolist()
            order = order[~hit]


def families(fps: np.ndarray, max_bits: int) -> list[np.ndarray]:
    """Rows of each component of two or more under fingerprints within max_bits."""
    refs = mix64(np.arange(1, WIDE * PIVOTS + 1, dtype=np.uint64)).reshape(PIVOTS, WIDE)
    table = np.stack([np.bitwise_count(fps ^ r).sum(1) for r in refs], 1).astype(np.int16)

    def near(at: int, rest: np.ndarray) -> np.ndarray:
        hit = np.abs(table[rest] - table[at]).max(1) <= max_bits  # else out of reach, by the triangle inequality
        hit[hit] = np.bitwise_count(fps[rest[hit]] ^ fps[at]).sum(1) <= max_bits
        return hit

    order, out = np.arange(len(fps)), []
    while len(order) > 1:
        own = np.concatenate([order[:1], *(hit for _, hit in linked(int(order[0]), order[1:], near))])
        if len(own) > 1:
            out.append(np.sort(own))
        order = np.setdiff1d(order, own, assume_unique=True)
    return out


def set_links(ids: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of all links between sets whose Jaccard similarity is at least `similarity`: a row that is linked is compared in turn with all rows that aren't yet."""
    near = similarity_of(sets, similarity)
    order, out = np.arange(len(ids)), []
    while len(order) > 1:
        first, order = int(order[0]), order[1:]
        for at, hit in linked(first, order, near):
            out += [(int(ids[at]), int(i)) for i in ids[hit].tolist()]
            order = np.setdiff1d(order, hit, assume_unique=True)
    return out


def similarity_of(sets: list[np.ndarray], similarity: float) -> Callable[[int, np.ndarray], np.ndarray]:
    """A function of a row and other rows: which of these have a Jaccard similarity to it of at least `similarity`, by the sets themselves."""
    sizes = np.array([len(s) for s in sets], np.int64)
    begin = np.cumsum(sizes) - sizes
    names, flat = np.unique(np.concatenate(sets), return_inverse=True)
    flat, mark = flat.astype(np.int32), np.zeros(len(names), bool)
    del names
    parts, wanted = Fraction(str(similarity)).as_integer_ratio()

    def near(at: int, rest: np.ndarray) -> np.ndarray:
        own = flat[begin[at] : begin[at] + sizes[at]]
        mark[own] = True
        hit = wanted * np.minimum(sizes[rest], sizes[at]) >= parts * np.maximum(sizes[rest], sizes[at])
        some = np.flatnonzero(hit)
        for i in range(0, len(some), 512):
            r = rest[some[i : i + 512]]
            ends = np.cumsum(sizes[r])
            common = np.add.reduceat(mark[flat[np.arange(ends[-1]) - np.repeat(ends - sizes[r] - begin[r], sizes[r])]], ends - sizes[r], dtype=np.int64)
            hit[some[i : i + 512]] = wanted * common >= parts * (sizes[r] + sizes[at] - common)
        mark[own] = False
        return hit

    return near


def by_key(batches: Iterator[pa.RecordBatch], close: Callable[[list[tuple]], list[tuple]], types: list, names: list[str]) -> Iterator[pa.RecordBatch]:
    """What `close` makes of each key's rows, of a partition that is sorted by key (the first column)."""
    at, held = None, []
    table = lambda out: pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(types)], names)
    for batch in batches:
        out = []
        for key, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if key != at:
                if len(held) > 1:
                    out += close(held)
                at, held = key, []
            held.append(row)
        yield table(out)
    yield table(close(held) if len(held) > 1 else [])


def similar(docs: DataFrame, words: int = 5, similarity: float = 0.8, crowd: int = CROWD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row, group): groups of documents (row is a hash of id and text) whose sets of shingles have at least this Jaccard similarity.

    Candidates share both values of one of BANDS pairs of least shingle hashes:
    at similarity 0.8 fewer than one pair in 10^5 shares none. A key with more
    than `crowd` different documents is split by SPLITS further least
    values, up to LEVELS times. Within a key wide fingerprints, as a loose
    filter, leave families; families of up to `crowd` documents that
    share members are joined, so a document is shipped once. Only
    members of families have their sets of shingles shipped, by which every
    link is decided. All members are held against each other, but for those
    that are linked already, so a family of n documents makes fewer than n
    edges. A group is a component of all links: its members are near each other
    by chains, not each near the least document.
    Documents with equal sets are one node. Texts without words, and null ids,
    are groups of their own.
    """
    max_bits = expected_bits(similarity, margin=LOOSE)
    prints = written(wide_prints(docs, words, id_col, text_col).where("doc_id IS NOT NULL AND fp IS NOT NULL"), "simhash-wide")
    nodes = prints.groupBy("content", "fp", "lows").agg(F.min(F.struct("doc_id", "row")).alias("m"))
    nodes = written(nodes.select("content", "fp", "lows", F.col("m.doc_id").alias("node"), F.col("m.row").alias("row")), "simhash-nodes")
    band = lambda i: F.xxhash64(F.lit(i), F.substring("lows", 8 * ROWS * i + 1, 8 * ROWS))
    keyed = nodes.select("row", "fp", "lows", F.explode(F.array(*[band(i) for i in range(BANDS)])).alias("key"))
    n = spread(docs.sparkSession)
    found = None

    def near_prints(held: list[tuple]) -> list[tuple]:
        rows = np.array([x[0] for x in held], np.int64)
        fps = np.frombuffer(b"".join(x[1] for x in held), np.uint64).reshape(-1, WIDE)
        out = []
        for own in families(fps, max_bits):
            name = xxhash.xxh64_intdigest(rows[own].tobytes()) - (1 << 63)  # keys with the same members give the same family
            out += [(name, int(r)) for r in rows[own].tolist()]
        return out

    def near_sets(held: list[tuple]) -> list[tuple]:
        return set_links(np.array([x[0] for x in held], np.int64), [np.frombuffer(x[1], np.uint64) for x in held], similarity)

    def families_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return by_key(batches, near_prints, [pa.int64(), pa.int64()], ["family", "row"])

    def edges_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return by_key(batches, near_sets, [pa.int64(), pa.int64()], ["u", "v"])

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingle_set(t, words).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["row", "shingles"])

    for level in range(LEVELS + 1):
        keyed = written(keyed, "simhash-bands")
        many = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        marked = written(keyed.join(many, "key"), "simhash-marked")
        last = level == LEVELS
        own = (marked if last else marked.where(F.col("n") <= crowd)).select("key", "row", "fp")
        some = own.repartition(n, "key").sortWithinPartitions("key", "row").mapInArrow(families_of, "family bigint, row bigint")
        found = some if found is None else found.union(some)
        rest = marked.where(F.col("n") > crowd)
        if last or rest.isEmpty():
            break
        low = lambda i, level=level: F.xxhash64("key", F.substring("lows", 8 * (ROWS * BANDS + SPLITS * level + i) + 1, 8))
        keyed = rest.select("row", "fp", "lows", F.explode(F.array(*[low(i) for i in range(SPLITS)])).alias("key"))
    found = written(found.distinct(), "simhash-families")
    lows = found.groupBy("family").agg(F.min("row").alias("v"))
    whole = components(found.join(lows, "family").select(F.col("row").alias("u"), "v"), "simhash-whole").select(F.col("node").alias("row"), "root")
    roots = whole.union(whole.select(F.col("root").alias("row"), "root")).distinct()
    small = roots.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= crowd).select("root")
    once = written(roots.join(small, "root").select(F.col("root").alias("family"), "row"), "simhash-once")
    found = once.union(found.join(once.select("row"), "row", "left_anti").select("family", "row"))
    texts = texts_of(docs, id_col, text_col).withColumn("row", F.xxhash64("doc_id", "text")).select("row", "text")
    sets = texts.join(found.select("row").distinct(), "row", "left_semi").dropDuplicates(["row"]).mapInArrow(sets_of, "row bigint, shingles binary")
    sets = sets.join(nodes.select("row", "node"), "row")
    sent = found.join(sets, "row").select("family", "node", "shingles")
    edges = sent.repartition(n, "family").sortWithinPartitions("family", "node").mapInArrow(edges_of, "u bigint, v bigint")
    roots = components(edges, "simhash-components").select("node", "root")
    named = nodes.join(roots, "node", "left").select("content", F.coalesce("root", "node").alias("group"))
    return prints.join(named, "content").select("doc_id", "row", "group")
