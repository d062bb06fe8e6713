"""Byte-level BPE encoding by a segment tree over adjacent pair ranks, and decoding.

A pre-token of n bytes is a row of symbols. Leaf i of its segment tree holds
rank(symbol i, its right neighbour) * width + i, or NONE if that pair has no
merge; an inner node holds the lesser child. So the root names the leftmost
pair of lowest rank. A merge writes the new symbol, unlinks its right
neighbour and updates three leaves and their paths, in logarithmic time, until
the root is NONE. Pre-tokens of up to 64 bytes go through together as the rows
of arrays; longer ones one by one, by the same tree (`merge_one`).

Pre-tokens are memoised per task within a fixed number of entries: the result
doesn't depend on it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, texts_of

NONE = np.int32(2**31 - 1)
#: Leaves of the tree by a pre-token's bytes, up to 64; one byte needs no tree.
WIDTH_OF = [1, 1, *(max(4, 1 << (n - 1).bit_length()) for n in range(2, 65))]
CACHE = 400_000

#: White space as the Unicode property has it.
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
#: A run without white space, with at most one space before it, or white space alone: each piece splits further by the pre-tokeniser's pattern alone.
PIECE = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]")
#: The pre-tokeniser's pattern (a fixed value of the vocabulary).
PATTERN = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")


def byte_characters() -> list[str]:
    """The printable character that a byte-level vocabulary writes for each byte: itself if printable in Latin-1, else the next from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in shown else next(others)) for b in range(256)]


class ByteBPE:
    """A vocabulary file of the tokenizers library with a byte-level BPE model."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        left = np.array([vocab[a] for a, _ in pairs], np.uint64)
        right = np.array([vocab[b] for _, b in pairs], np.uint64)
        keys = left << np.uint64(32) | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.rank_of = {(vocab[a], vocab[b]): i for i, (a, b) in enumerate(pairs)}
        byte_of = {c: b for b, c in enumerate(byte_characters())}
        self.byte_ids = np.array([vocab[c] for c in byte_characters()], np.int32)
        suffix = spec["model"].get("end_of_word_suffix") or ""
        self.last_ids = np.array([vocab[c + suffix] for c in byte_characters()], np.int32)  # of a pre-token's last byte
        left, right = np.repeat(self.byte_ids, 256), np.tile
        self.first = np.stack([self.rank(left, right(ids, 256)).reshape(256, 256) for ids in (self.byte_ids, self.last_ids)])
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.split_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.bytes_of: list[bytes] = [b""] * (max([*vocab.values(), *self.added.values()]) + 1)
        for token, i in [*vocab.items(), *self.added.items()]:
            self.bytes_of[i] = bytes(byte_of[c] for c in token) if token not in self.added and all(c in byte_of for c in token) else token.encode()
        self.cache: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs, -1 where there is no merge."""
        want = a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.ranks[at], np.int32(-1))

    def merge_rows(self, words: list[bytes], width: int) -> list[bytes]:
        """Ids, as little-endian int32, of words of 2 to `width` bytes each."""
        n, step = len(words), width + 2
        lens = np.fromiter(map(len, words), np.int64, n)
        flat = np.frombuffer(b"".join(words), np.uint8)
        row = np.repeat(np.arange(n), lens)
        col = np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)
        raw = np.zeros((n, width + 1), np.uint8)
        raw[row, col] = flat
        # positions are shifted by one, so that 0 stands before the first and len + 1 behind the last symbol
        sym = np.full((n, step), -1, np.int32)
        last = col == lens[row] - 1
        sym[row, col + 1] = np.where(last, self.last_ids[flat], self.byte_ids[flat])
        nxt = np.tile(np.arange(1, step + 1, dtype=np.int32), (n, 1)).ravel()
        prv = np.tile(np.arange(-1, step - 1, dtype=np.int32), (n, 1)).ravel()
        place = np.arange(width, dtype=np.int32)
        ranks = self.first[(place == (lens - 2)[:, None]).view(np.int8), raw[:, :-1], raw[:, 1:]]
        tree = np.full((n, 2 * width), NONE, np.int32)
        tree[:, width:] = np.where((ranks >= 0) & (place < (lens - 1)[:, None]), ranks * width + place, NONE)
        for level in range(width.bit_length() - 2, -1, -1):
            a = 1 << level
            tree[:, a : 2 * a] = np.minimum(tree[:, 2 * a : 4 * a : 2], tree[:, 2 * a + 1 : 4 * a : 2])
        sym, tree = sym.ravel(), tree.ravel()
        live = np.flatnonzero(tree[1 :: 2 * width] != NONE)
        while len(live):
            base, top = live * step, live * (2 * width)
            root = tree[top + 1]
            at, rank = root % width + 1, root // width
            right = nxt[base + at]
            after, before = nxt[base + right], prv[base + at]
            new = self.merged[rank]
            sym[base + at] = new
            sym[base + right] = -1
            nxt[base + at] = after
            prv[base + after] = at
            leaf = top + width - 1
            tree[leaf + right] = NONE
            far = sym[base + after]
            got = self.rank(new, np.maximum(far, 0))
            tree[leaf + at] = np.where((got >= 0) & (far >= 0), got * width + at - 1, NONE)
            near = sym[base + before]
            got = self.rank(np.maximum(near, 0), new)
            has = np.flatnonzero(before > 0)
            tree[(leaf + before)[has]] = np.where((got >= 0) & (near >= 0), got * width + before - 1, NONE)[has]
            paths = (at + (width - 1), right + (width - 1), np.maximum(before, 1) + (width - 1))
            for _ in range(width.bit_length() - 1):
                paths = tuple(p >> 1 for p in paths)
                for p in paths:
                    tree[top + p] = np.minimum(tree[top + 2 * p], tree[top + 2 * p + 1])
            live = live[tree[top + 1] != NONE]
        kept = sym.reshape(n, step)
        mask = kept >= 0
        data = kept[mask].astype("<i4").tobytes()
        ends = (4 * np.cumsum(mask.sum(1))).tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends)]

    def merge_one(self, word: bytes) -> bytes:
        """The same for one word of any length."""
        sym = self.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        sym[-1] = int(self.last_ids[word[-1]])
        n = len(sym)
        size = 1 << max(1, (n - 1).bit_length())
        none = 1 << 62
        rank_of, merged = self.rank_of, self.merged.tolist()
        tree = [none] * (2 * size)
        for i in range(n - 1):
            r = rank_of.get((sym[i], sym[i + 1]))
            if r is not None:
                tree[size + i] = r * size + i
        for i in range(size - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(i: int, value: int) -> None:
            i += size
            tree[i] = value
            while i > 1:
                i >>= 1
                a, b = tree[2 * i], tree[2 * i + 1]
                low = a if a < b else b
                if tree[i] == low:
                    break
                tree[i] = low

        while tree[1] != none:
            rank, i = divmod(tree[1], size)
            j = nxt[i]
            k, h = nxt[j], prv[i]
            sym[i], sym[j] = merged[rank], -1
            nxt[i] = k
            if k < n:
                prv[k] = i
            put(j, none)
            r = rank_of.get((sym[i], sym[k])) if k < n else None
            put(i, none if r is None else r * size + i)
            if h >= 0:
                r = rank_of.get((sym[h], sym[i]))
                put(h, none if r is None else r * size + h)
        return np.array([s for s in sym if s >= 0], "<i4").tobytes()

    def learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids of distinct pre-tokens."""
        by: dict[int, tuple[list[str], list[bytes]]] = {}
        out: dict[str, bytes] = {}
        for w in words:
            raw = w.encode()
            n = len(raw)
            names, raws = by.setdefault(WIDTH_OF[n] if n <= 64 else 0, ([], []))
            names.append(w)
            raws.append(raw)
        for width, (names, raws) in by.items():
            if width == 1:
                out.update((w, self.last_ids[raw[0]].astype("<i4").tobytes()) for w, raw in zip(names, raws))
            elif width:
                for a in range(0, len(names), 50_000):
                    out.update(zip(names[a : a + 50_000], self.merge_rows(raws[a : a + 50_000], width)))
            else:
                out.update((w, self.merge_one(raw)) for w, raw in zip(names, raws))
        return out

    def prepare(self, pieces: set[str]) -> None:
        """Afterwards the cache has the ids of all these pieces."""
        cache = self.cache
        if len(cache) + len(pieces) > CACHE:
            cache.clear()
        fresh = [p for p in pieces if p not in cache]
        whole = [p for p in fresh if p.isalpha() or p[0] == " " and p[1:].isalpha()]  # one pre-token each
        cache.update(self.learn(whole))
        fresh = [p for p in fresh if p not in cache]
        cut = [PATTERN.findall(p) for p in fresh]
        known = self.learn(list({w for c in cut for w in c}))
        for p, c in zip(fresh, cut):
            cache[p] = known[c[0]] if len(c) == 1 else b"".join([known[w] for w in c])

    def segments(self, text: str) -> list[list[str] | int]:
        """Runs of pieces, and ids of added tokens that the text spells out."""
        if self.split_added is None or not self.split_added.search(text):
            return [PIECE.findall(text)]
        return [self.added[x] if k % 2 else PIECE.findall(x) for k, x in enumerate(self.split_added.split(text))]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian int32."""
        cut = [self.segments(t) for t in texts]
        self.prepare({p for segs in cut for s in segs if not isinstance(s, int) for p in s})
        get = self.cache.__getitem__
        return [b"".join(np.int32(s).astype("<i4").tobytes() if isinstance(s, int) else b"".join(map(get, s)) for s in segs) for segs in cut]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(path: str) -> ByteBPE:
    return ByteBPE(path)


def _list_array(parts: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *(len(p) // 4 for p in parts)]).astype(np.int32)
    values = pa.array(np.frombuffer(b"".join(parts), "<i4"), pa.int32())
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def encode_decode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, decoded string) for each row, in no order.

    A narrow map: no shuffle; a lost task is run again from its input. A null
    or empty text has no ids and decodes to the empty string. Rows with the
    same or a null doc_id each give a row. Strings of added tokens in a text
    become their ids, as in the library.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(tokenizer_path)
        for batch in slices(batches):
            parts = model.encode(batch.column(1).to_pylist())
            decoded = [model.decode(np.frombuffer(p, "<i4")) for p in parts]
            yield pa.RecordBatch.from_arrays([batch.column(0), _list_array(parts), pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

    return texts_of(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, ids array<int>, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    """The columns of the query op3."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
