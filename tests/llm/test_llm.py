"""The ten operators against brute force, round trips and held-out labels, on small tables with nulls, ties, repeats and clashing columns."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from helioscope.llm import bpe, components, flac, knn, packing, pitman_yor, repeats, simhash, substring, suffix, toxicity, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYLLABLES = "ka lo mi ter sun dra po vel in ath or qui".split()
SCHEMA = "doc_id bigint, text string, lang string, score double, row string, start int"


def prose(rng, n):
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 3))) for _ in range(n))


def corpus(seed=1, n=60):
    """Prose with exact and near copies, shared passages, a very long word, odd characters, empty and null texts, repeated rows and a null id."""
    rng = random.Random(seed)
    shared = [prose(rng, 30) for _ in range(3)]
    texts = []
    for i in range(n):
        t = prose(rng, rng.choice([0, 1, 2, 12, 13, 14, 40, 200]))
        if i % 5 == 0:
            t = f"{t}\n{rng.choice(shared)} {prose(rng, 5)}"
        if i % 7 == 3 and texts:
            t = rng.choice(texts)
        if i % 11 == 4 and texts:
            w = rng.choice(texts).split()
            if w:
                w[rng.randrange(len(w))] = "Changed"
            t = " ".join(w)
        texts.append(t)
    texts += ["", "   \t ", "x" * 5000, "ab" * 900, "a<|endoftext|>b", "Ça  alors — 日本語 😀\x1c", "It's I'LL \r\n\r\n  end", "z " * 900]
    rows = [(i, t, "en", 0.5, "r", 1) for i, t in enumerate(texts)]
    rows += [(500, None, None, None, None, None), (rows[5][0], rows[5][1], "xx", 1.0, "q", 2), (None, rows[10][1], None, None, None, None), (None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def text_of(t):
    return t or ""


# op3


def test_bpe_equals_the_library(docs, rows):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    want = Counter()
    for i, t, *_ in rows:
        ids = tok.encode(text_of(t), add_special_tokens=False).ids
        want[(i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest())] += 1
    assert Counter(map(tuple, bpe.digests(bpe.encode_decode(docs, path)).collect())) == want


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=80), max_size=5))
def test_bpe_any_text(texts):
    path = public_tokenizers.path("byte_bpe_50k.json")
    model, tok = bpe.load(path), Tokenizer.from_file(path)
    for t, ids in zip(texts, model.encode(texts)):
        assert np.frombuffer(ids, "<i4").tolist() == tok.encode(t, add_special_tokens=False).ids
        assert model.decode(np.frombuffer(ids, "<i4")) == t


def test_bpe_one_word_and_many_agree():
    model = bpe.load(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(3)
    for width in (4, 8, 16, 32, 64):
        words = ["".join(rng.choices("abcdehinorst", k=rng.randint(2, width))).encode() for _ in range(50)]
        assert model.merge_rows(words, width) == [model.merge_one(w) for w in words]


def test_bpe_empty(empty):
    assert bpe.digests(bpe.encode_decode(empty, public_tokenizers.path("byte_bpe_50k.json"))).count() == 0


# op4


def check_packing(got, want_ids):
    """want_ids: Counter of (doc_id, ids). Pieces cover them once, and sequences have no gap."""
    by, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at and length > 0
            at += length
        assert at <= 4096
    for (i, ids), n in want_ids.items():
        for a in range(0, len(ids), 4096):
            own = np.array(ids[a : a + 4096], "<u4").tobytes()
            assert sum((r["start"], r["ids_crc32"], r["doc_tokens"], r["length"]) == (a, zlib.crc32(own), len(ids), len(own) // 4) for r in by[i]) == n
    assert sum(r["length"] for r in got) == sum(len(ids) * n for (_, ids), n in want_ids.items())
    return len(sequences)


def test_packing(docs, rows):
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    want = Counter((i, (*tok.encode(text_of(t), add_special_tokens=False).ids, 2)) for i, t, *_ in rows)
    n = check_packing(packing.pack(docs, path).collect(), want)
    assert n <= math.ceil(sum(len(ids) * k for (_, ids), k in want.items()) / 4096) + 1


@settings(max_examples=100, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=60))
def test_word_ids_equal_the_library(text):
    model = packing.tokens(public_tokenizers.path("word_bpe_49k.json"))
    assert np.frombuffer(model.encode([text])[0], "<u4").tolist() == model.tokenizer.encode(text, add_special_tokens=False).ids


def test_packing_empty(empty):
    assert packing.pack(empty, public_tokenizers.path("word_bpe_49k.json")).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 60), min_size=1, max_size=12))
def test_solution_holds_the_histogram(histogram):
    solution = packing.solve(histogram, 32)
    total = Counter()
    for pattern, uses in solution:
        assert sum(s * c for s, c in pattern.items()) <= 32
        total.update({s: c * uses for s, c in pattern.items()})
    assert total == histogram
    least = -(-sum(s * c for s, c in histogram.items()) // 32)
    assert sum(u for _, u in solution) <= max(least * 1.7 + len(histogram), sum(histogram.values()) and 1)


def test_knapsack_is_optimal():
    rng = np.random.default_rng(0)
    for _ in range(20):
        size, value = np.sort(rng.choice(np.arange(1, 20), 6, replace=False)), rng.random(6)
        best = np.zeros(41)
        for c in range(1, 41):
            best[c] = max([best[c - 1], *(best[c - s] + v for s, v in zip(size, value) if s <= c)])
        got, counts = packing.knapsack(value, size, 40)
        assert got == pytest.approx(best[40]) and counts @ size <= 40 and counts @ value == pytest.approx(got)


# op5


def brute_substring(rows, window):
    own = {}
    cut = [(i, WORD.findall(text_of(t))) for i, t, *_ in rows]
    order = lambda i: (i is None, i or 0)
    for i, w in cut:
        for a in range(len(w) - window + 1):
            k = tuple(w[a : a + window])
            own[k] = min(own.get(k, order(i)), order(i))
    out = Counter()
    for i, w in cut:
        off = [False] * len(w)
        for a in range(len(w) - window + 1):
            if own[tuple(w[a : a + window])] < order(i):
                off[a : a + window] = [True] * window
        out[(i, len(w), sum(off), hashlib.sha256(" ".join(x for x, o in zip(w, off) if not o).encode()).hexdigest())] += 1
    return out


@pytest.mark.parametrize("crowd", [20_000, 2])
def test_substring(docs, rows, crowd):
    assert Counter(map(tuple, substring.digests(substring.dedup(docs, crowd=crowd)).collect())) == brute_substring(rows, 13)


def test_substring_other_window_and_carried_columns(docs, rows):
    got = substring.dedup(docs, window=3, carry=("lang", "text"))
    assert got.columns[-2:] == ["lang", "text"]
    assert Counter(map(tuple, substring.digests(got).collect())) == brute_substring(rows, 3)


@pytest.mark.parametrize("crowd", [20_000, 2])
def test_substring_keeps_words_whose_hashes_end_alike(spark, crowd):
    """Two words with one low half of their 64-bit hashes, each in its own copy of a passage, are different words."""
    seen = {}
    for i in range(1_000_000):
        w = f"n{i}"
        low = xxhash.xxh64_intdigest(w) & 0xFFFFFFFF
        if low in seen:
            break
        seen[low] = w
    p = prose(random.Random(2), 60).split()
    rows = [(i, " ".join([*p[:30], x, *p[30:]])) for i, x in enumerate([seen[low], w, "other"])]
    got = {r["doc_id"]: (r["kept"], r["n_removed"]) for r in substring.dedup(spark.createDataFrame(rows, "doc_id bigint, text string"), crowd=crowd).collect()}
    assert got[1] == (w, 60) and got[2] == ("other", 60)


def test_substring_empty(empty):
    assert substring.dedup(empty).count() == 0


# op8


def brute_suffix(rows, window):
    seen = Counter()
    raw = [(i, text_of(t).encode()) for i, t, *_ in rows]
    for _, b in raw:
        seen.update(b[a : a + window] for a in range(len(b) - window + 1))
    out = Counter()
    for i, b in raw:
        off = np.zeros(len(b) + 1, int)
        for a in range(len(b) - window + 1):
            if seen[b[a : a + window]] > 1:
                off[a] += 1
                off[a + window] -= 1
        gone = np.cumsum(off)[: len(b)] > 0
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[(i, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())] += 1
    return out


@pytest.mark.parametrize("window,crowd", [(400, 20_000), (40, 20_000), (40, 2), (5, 20_000)])
def test_suffix(docs, rows, window, crowd):
    assert Counter(map(tuple, suffix.digests(suffix.dedup(docs, window=window, crowd=crowd)).collect())) == brute_suffix(rows, window)


def test_suffix_empty(empty):
    assert suffix.dedup(empty).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), min_size=1, max_size=60))
def test_two_stage_sort(letters):
    text = "".join(letters).encode() + b"\xff"
    got = suffix.two_stage_sort(text, len(text)).tolist()
    assert sorted(got) == list(range(len(text)))
    assert got == sorted(range(len(text)), key=lambda i: text[i:])


def test_direct_sort_both_ways(monkeypatch):
    rng = random.Random(2)
    text = "".join(rng.choices("ab", k=300)).encode() * 3
    at = np.arange(0, 500, 3)
    one = [text[i : i + 90] for i in suffix.direct_sort(text, at, 90)]
    monkeypatch.setattr(suffix, "KEYS", 0)
    assert [text[i : i + 90] for i in suffix.direct_sort(text, at, 90)] == one == sorted(one)


def test_sliding_min():
    x = np.random.default_rng(0).integers(0, 99, 200)
    for w in (1, 2, 3, 7, 8, 9, 64, 100):
        assert repeats.sliding_min(x, w).tolist() == [x[i : i + w].min() for i in range(len(x) - w + 1)]


# op6


def test_top_k(spark):
    rng = np.random.default_rng(5)
    data = [(i, [float(v) for v in rng.normal(size=4).round(2)], "x") for i in range(200)]
    data += [(300, None, "x"), (301, [1.0, None, 2.0, 3.0], "x"), (302, [1.0, float("nan"), 0.0, 0.0], "x"), (303, [float("inf")] * 4, "x"), (None, [1.0] * 4, "x"), (350, [], "x"), (50, data[50][1], "y"), (400, data[3][1], "x"), (450, [1.0, 2.0], "x"), (451, [2.0, 2.0], "x")]
    table = spark.createDataFrame(data, "vec_id bigint, embedding array<float>, score string")
    v = knn.integer_vectors(table)
    got = sorted(map(tuple, knn.top_k(v, v.where("vec_id % 50 = 0"), shard=30).collect()))
    ok = {i: [math.floor(256 * float(np.float32(x))) for x in e] for i, e, _ in data if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)}
    want = []
    for q in ok:
        if q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(ok[q], e)), i) for i, e in ok.items() if i != q and len(e) == len(ok[q]))
            want += [(q, k, i, -s) for k, (s, i) in enumerate(scores[:5], 1)]
    assert got == sorted(want)


def test_top_k_of_copies_clusters_and_empty_vectors(spark):
    rng = np.random.default_rng(6)
    data = [(i, [0.5, 0.25, -1.0]) for i in range(100)] + [(100 + i, (rng.normal(size=3) * 0.1 + 5 * (i % 4)).round(3).tolist()) for i in range(200)] + [(1000 + i, []) for i in range(0, 60, 10)]
    v = knn.integer_vectors(spark.createDataFrame(data, "vec_id bigint, embedding array<float>"))
    got = sorted(map(tuple, knn.top_k(v, v.where("vec_id % 50 = 0"), shard=20).collect()))
    ok = {i: [math.floor(256 * float(np.float32(x))) for x in e] for i, e in data}
    want = []
    for q in (i for i in ok if i % 50 == 0):
        scores = sorted((-sum(a * b for a, b in zip(ok[q], e)), i) for i, e in ok.items() if i != q and len(e) == len(ok[q]))
        want += [(q, k, i, -s) for k, (s, i) in enumerate(scores[:5], 1)]
    assert got == sorted(want)
    assert knn.top_k(v.limit(0), v.limit(0)).count() == 0


def test_splits_part_ties():
    x = np.array([[1, 5]] * 50 + [[2, 5]] * 5 + [[9, 0]] * 5)
    nodes, sizes = knn.splits(x, 6)
    leaf = knn.leaves_of(nodes, x)
    assert sum(sizes) == 60 and np.bincount(leaf, minlength=len(sizes)).tolist() == sizes
    assert len({tuple(v) for v in x[leaf == leaf[0]].tolist()}) == 1


def test_tree_ties_and_bounds():
    ids, x = np.arange(300), np.random.default_rng(1).integers(-3, 4, (300, 3))
    tree = knn.KDTree(ids, x, 8)
    got = tree.search(ids[:20], x[:20], 5, np.full(20, -(2**63)))
    for q in range(20):
        want = sorted((-int(x[q] @ x[i]), i) for i in range(300) if i != q)[:5]
        assert sorted((-s, i) for a, i, s in got if a == q) == want


# op9


def brute_components(prints):
    n, parent = len(prints), list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(n)]


def brute_print(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    runs = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_simhash(docs, rows):
    prints = [brute_print(text_of(t)) for _, t, *_ in rows]
    roots = brute_components(prints)
    low = {}
    for (i, *_), r in zip(rows, roots):
        if i is not None:
            low[r] = min(low.get(r, i), i)
    want = Counter((i, f"{p:016x}", low.get(r)) for (i, *_), p, r in zip(rows, prints, roots))
    assert Counter(map(tuple, simhash.digests(simhash.near_duplicates(simhash.fingerprints(docs))).collect())) == want


def test_links_with_crowded_keys(spark):
    rng = random.Random(4)
    seeds = [rng.getrandbits(64) for _ in range(6)]
    prints = list({s ^ sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 3, 5, 9]))) for s in seeds for _ in range(40)})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    fps = spark.createDataFrame([(x,) for x in signed], "fp bigint")
    edges = simhash.links(fps, crowd=8)
    got = {r["node"]: r["root"] for r in components.components(edges).collect()}
    roots = brute_components(prints)
    groups, want = defaultdict(set), defaultdict(set)
    for x, r in zip(signed, roots):
        groups[got.get(x, x)].add(x)
        want[r].add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_simhash_empty(empty):
    assert simhash.near_duplicates(simhash.fingerprints(empty)).count() == 0


def test_similar_finds_copies_of_similarity(spark):
    rng = random.Random(8)
    base = [prose(rng, 150) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(10):
        w = base[i].split()
        w[70] = "other"
        rows.append((100 + i, " ".join(w)))
    rows.append((200, base[29]))
    got = {r["doc_id"]: r["group"] for r in simhash.similar(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert all(got[100 + i] == i for i in range(10)) and got[200] == 29 and all(got[i] == i for i in range(30))


def shingles_of(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def jaccard(a, b):
    a, b = shingles_of(a), shingles_of(b)
    return len(a & b) / len(a | b)


def test_similar_decides_by_exact_similarity(spark):
    """Pairs from 0.75 to 0.85, most of them within a few bits of the mean at 0.8, against brute force."""
    rng = random.Random(12)
    rows, near = [], {}
    for i in range(120):
        w = [f"{i}w{j}" for j in range(300)]
        v = list(w)
        tail = rng.randint(24, 42)  # a new tail of n words: similarity (296 - n) / (296 + n)
        v[-tail:] = [f"{i}v{j}" for j in range(tail)]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(v))]
        near[i] = jaccard(rows[-2][1], rows[-1][1]) >= 0.8
    got = {r["doc_id"]: r["group"] for r in simhash.similar(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert 20 < sum(near.values()) < 100
    assert got == {2 * i + k: 2 * i if near[i] else 2 * i + k for i in near for k in (0, 1)}


def test_similar_links_edited_copies_in_one_key(spark):
    """A near B, B near C, A not near C; then families of copies edited again and again, against brute force."""
    w = [f"a{j}" for j in range(100)]
    cut = lambda lo, hi: np.unique([xxhash.xxh64_intdigest(x) for x in w[lo:hi]]).astype(np.uint64)
    assert sorted(simhash.set_links(np.array([1, 2, 3]), [cut(0, 80), cut(8, 88), cut(16, 96)], 0.8)) == [(1, 2), (2, 3)]
    rng = random.Random(4)
    rows = []
    for f in range(6):
        t = [f"{f}w{j}" for j in range(120)]
        for k in range(8):
            rows.append((len(rows), " ".join(t)))
            at, r = rng.randrange(100), rng.randint(1, 14)
            t = [*t[:at], *(f"{f}e{k}.{j}" for j in range(r)), *t[at + r :]]
    want = {i: i for i, _ in rows}
    for i, a in rows:
        for j, b in rows[:i]:
            if jaccard(a, b) >= 0.8 and want[i] != want[j]:
                lo, hi = sorted((want[i], want[j]))
                want = {k: lo if v == hi else v for k, v in want.items()}
    got = {r["doc_id"]: r["group"] for r in simhash.similar(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == want and 6 < len(set(want.values())) < 40


# op10


def test_media_round_trip(docs, rows):
    got = Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in flac.digests(flac.from_media(flac.to_media(docs))).collect())
    want = Counter()
    for i, t, *_ in rows:
        b = text_of(t).encode()
        p = b + b" " * (max(192, -(-len(b) // 192) * 192) - len(b))
        want[(i, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))] += 1
    assert got == want


@pytest.mark.parametrize("order", [0, 1, 4, 8])
def test_flac_any_bytes(order):
    rng = np.random.default_rng(order)
    walk = np.clip(np.cumsum(rng.integers(-3, 4, 9000)) + 128, 0, 255).astype(np.uint8).tobytes()
    payloads = [b"a", b"ab" * 300, bytes(range(256)) * 20, rng.integers(0, 256, 5000).astype(np.uint8).tobytes(), walk, b" " * 192]
    streams = flac.encode(payloads, order)
    assert [p for p, _, _ in flac.decode(streams)] == payloads
    for stream, (pcm, blocks, _) in zip(streams, flac.decode(streams)):
        for sample, byte, _n in blocks:  # seek points lead to frames
            assert stream[byte : byte + 2] == b"\xff\xf8"
        assert sum(b[2] for b in blocks) == len(pcm)
    assert len(streams[4]) < 0.6 * len(walk)


def test_flac_without_seek_points():
    payload = bytes(np.random.default_rng(1).integers(90, 120, 6000).astype(np.uint8))
    stream = flac.encode([payload])[0]
    at = 4 + 4 + 34
    n = int.from_bytes(stream[at + 1 : at + 4], "big")
    bare = stream[:4] + bytes([0x80]) + stream[5:at] + stream[at + 4 + n :]
    assert flac.decode([bare])[0][0] == payload


def test_flac_finds_damage():
    stream = bytearray(flac.encode([b"some words " * 300])[0])
    for at in (len(stream) - 40, len(stream) - 1, 30):
        bad = bytearray(stream)
        bad[at] ^= 0x10
        with pytest.raises(flac.MediaError):
            flac.decode([bytes(bad)])


def test_media_empty(empty):
    assert flac.from_media(flac.to_media(empty)).count() == 0


# op2


def test_warc(spark):
    pages = [(i, f"https://www.Ex{i % 3}.com:443/p?q={i % 4}", f"<p>{i % 6}</p>", "s", 1) for i in range(40)]
    pages += [(90, None, None, "s", 1), (91, "http://[bad", "", None, None), (None, "http://a.b/ü ü", "<p>0</p>", None, None), (5, pages[5][1], pages[5][2], "s", 2), (92, "x\r\ny", "😀", None, None)]
    table = spark.createDataFrame(pages, "page_id bigint, url string, html string, ts string, length int").repartition(3)
    index, folder = warc.archive(table)
    got = Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read_archives(index, folder).collect())
    top, want = {}, Counter()
    for i, _, h, *_ in pages:
        top[text_of(h)] = max(top.get(text_of(h), -1), -1 if i is None else i)
    for i, _, h, *_ in pages:
        b, t = text_of(h).encode(), top[text_of(h)]
        want[(i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if t == i else "revisit", None if t == i else t)] += 1
    assert got == want
    rows = [(r["url_key"], r["ts"]) for r in index.collect()]
    assert rows == sorted(rows) and len(rows) == len(pages)
    assert all(r["record_type"] == "response" for r in warc.read_archives(*(lambda x: (x[0], x[1]))(warc.archive(table, 100))).collect())


def test_warc_empty(spark):
    index, folder = warc.archive(spark.createDataFrame([], "page_id bigint, url string, html string"))
    assert index.count() == 0 and warc.read_archives(index, folder).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 20)), max_size=9))
def test_loser_tree(runs):
    tree = warc.LoserTree([[(x, None) for x in sorted(r)] for r in runs])
    assert [x for x, _ in tree] == sorted(x for r in runs for x in r)


def test_records_parse_and_check():
    raw = warc.record("response", "7", "2024-01-01T00:00:00Z", "http://a/", b"payload\r\n\r\nmore")
    got = warc.parse(raw)
    assert got["payload"] == b"payload\r\n\r\nmore" and got["payload_bytes"] == 15
    with pytest.raises(ValueError):
        warc.parse(raw.replace(b"more", b"mare"))


# op1


def test_toxicity_learns_insults(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(600):
        w = prose(rng, 40).split()
        bad = i % 4 == 0
        if bad:
            for x in rng.sample(["idiot", "moron", "scumbag"], 2):
                w.insert(rng.randrange(len(w)), x)
        rows.append((i, " ".join(w), "en"))
        labels.append((i, int(bad), 1.0))
    labels += [(None, 1, 0.0), (3, None, 0.0), (99999, 1, 0.0)]
    rows += [(700, None, "x"), (701, "", "x"), (702, "you i d i o t and m o r o n", "x"), (703, "what an idiiot and a morron", "x"), (704, "you i. d. i. o. t. and - m - o - r - o - n -", "x"), (None, prose(rng, 20), None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, predicted string")
    got = {r["doc_id"]: r for r in toxicity.judged(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int, text double")).collect()}
    assert len(got) == len(rows)
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i]["held_out"] == (i in set(held)) for i in range(600))
    assert sum(got[i]["predicted"] == (i % 4 == 0) for i in held) / len(held) > 0.97
    assert got[700]["predicted"] == got[701]["predicted"] == 0 and got[702]["predicted"] == got[703]["predicted"] == got[704]["predicted"] == 1
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_toxicity_without_labels(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert {r["score"] for r in toxicity.judged(docs, none).collect()} == {0.0}
    assert toxicity.judged(empty, none).count() == 0


def test_kernel_matches_its_definition():
    from itertools import combinations

    def weights(w):
        out = Counter()
        for p in (3, 4):
            for at in combinations(range(len(w)), p):
                if at[-1] - at[0] < toxicity.SPAN:
                    out["".join(w[i] for i in at)] += toxicity.DECAY ** (at[-1] - at[0] + 1)
        return out

    words = ["idiot", "idxiot", "worthless", "abcabcabc", "scum"]
    k = toxicity.Kernel(words)(words)
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            x, y = weights(a), weights(b)
            want = sum(v * y[u] for u, v in x.items()) / (toxicity.scale(len(a)) * toxicity.scale(len(b)))
            assert k[i, j] == pytest.approx(want, rel=1e-6)


# op7


def test_language_model(docs, rows):
    got = pitman_yor.score(docs).collect()
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    cut = [(i, WORD.findall(text_of(t).translate(low)) + [""]) for i, t, *_ in rows]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for i, ws in cut if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    want = Counter((i, held(i), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)) for i, ws in cut)
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    held_rows = [r for r in got if r["held_out"] and r["n_tokens"] > 20]
    assert sum(r["score"] for r in held_rows) > sum(r["base_score"] for r in held_rows)


def test_predictive_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    count = rng.integers(0, 50, 40)
    d, tables = 0.7, None
    tables = pitman_yor.seat(rng, count, d, np.full(40, 0.5))
    assert ((tables >= (count > 0)) & (tables <= count)).all()
    low = np.full(41, 1 / 41)
    p = (np.append(np.maximum(count - d * tables, 0), 0) + (pitman_yor.THETA + d * tables.sum()) * low) / (pitman_yor.THETA + count.sum())
    assert p.sum() == pytest.approx(1)


def dense_model(train, tests, sweeps=60, keep=40, seed=3):
    """Mean log10 probabilities of texts (lists of words) by the model as its docstring defines it: every customer seated by itself, all counts in dictionaries."""
    rng = random.Random(seed)
    ending = ("end",)
    pairs = lambda ws: list(zip([ending, *ws], [*ws, ending]))
    count = Counter(p for ws in train for p in pairs(ws))
    served = Counter()
    for (u, _), n in count.items():
        served[u] += n
    types = {w for _, w in count}
    base = 1 / (len(types) + 1)
    bound = lambda ones, twos: min(max(ones / max(ones + 2 * twos, 1), 0.1), 0.95)
    ups = Counter(w for _, w in count)
    d = bound(sum(n == 1 for n in count.values()), sum(n == 2 for n in count.values()))
    d1 = bound(sum(n == 1 for n in ups.values()), sum(n == 2 for n in ups.values()))
    theta = pitman_yor.THETA

    def seats(n, d, fresh):
        t = min(n, 1)
        for sat in range(1, n):
            t += rng.random() < fresh / (sat - d * t + fresh)
        return t

    tables, total = dict.fromkeys(count, 1), Counter()
    for s in range(sweeps):
        by_context, up = Counter(), Counter()
        for (u, w), t in tables.items():
            by_context[u] += t
            up[w] += t
        roots = {w: 1 for w in up} if not s else roots
        fresh = (theta + d1 * sum(roots.values())) * base
        roots = {w: seats(up[w], d1, fresh) for w in sorted(up, key=str)}
        customers, root_sum = sum(up.values()), sum(roots.values())
        low = lambda w: (max(up[w] - d1 * roots.get(w, 0), 0) + (theta + d1 * root_sum) * base) / (theta + customers)  # noqa: E731, B023
        if s >= sweeps - keep:
            for k, ws in enumerate(tests):
                for j, (u, w) in enumerate(pairs(ws)):
                    total[k, j] += (max(count[u, w] - d * tables.get((u, w), 0), 0) + (theta + d * by_context[u]) * low(w)) / (theta + served[u]) / keep
        tables = {(u, w): seats(n, d, (theta + d * by_context[u]) * low(w)) for (u, w), n in sorted(count.items(), key=str)}
    return [sum(math.log10(total[k, j]) for j in range(len(ws) + 1)) for k, ws in enumerate(tests)]


@pytest.mark.parametrize("own, burn, samples, off", [(pitman_yor.OWN, 1, 2, 0.02), (40, 2, 2, 0.02), (1, 6, 4, 0.01)])
def test_language_model_scores_as_dense_model(spark, own, burn, samples, off):
    rng = random.Random(5)
    vocabulary = [prose(rng, 1) for _ in range(300)]
    rank = [1 / (i + 1) for i in range(300)]
    follow = {w: rng.choices(vocabulary, rank, k=6) for w in vocabulary}
    texts = []
    for _ in range(300):
        ws = rng.choices(vocabulary, rank)
        while len(ws) < 40:
            ws.append(rng.choice(follow[ws[-1]]) if rng.random() < 0.7 else rng.choices(vocabulary, rank)[0])
        texts.append(ws)
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(300)]
    want = dense_model([t for t, h in zip(texts, held) if not h], texts)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(3)
    got = {r["doc_id"]: r["score"] for r in pitman_yor.score(docs, own=own, burn=burn, samples=samples).collect()}
    error = [abs(got[i] - w) / abs(w) for i, w in enumerate(want)]
    assert max(error) < 4 * off and sum(error) / len(error) < off


def test_grouped_seats_follow_single_ones():
    rng = np.random.default_rng(1)
    for n in (20, 200, 2000):
        for fresh in (0.05, 2.0):
            alone = []
            for _ in range(200):
                t = 1
                for sat in range(1, n):
                    t += rng.random() < fresh / (sat - 0.6 * t + fresh)
                alone.append(t)
            grouped = pitman_yor.seat(rng, np.full(2000, n), 0.6, np.full(2000, fresh))
            assert grouped.mean() == pytest.approx(np.mean(alone), rel=0.1, abs=0.1)


def test_word_hashes():
    from helioscope.llm.common import word_hashes

    import pyarrow as pa

    rng = random.Random(1)
    texts = ["".join(rng.choice("aAbB \t\n\x0b\x1cé日") for _ in range(rng.randint(0, 30))) for _ in range(2000)] + ["x" * 3_000_000 + " y", "", "Y"]
    hashes, lens = word_hashes(pa.array(texts).slice(7))
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = [WORD.findall(t.translate(low)) for t in texts[7:]]
    assert lens.tolist() == [len(w) for w in words]
    names = defaultdict(set)
    for w, h in zip((w for ws in words for w in ws), hashes.tolist()):
        names[w].add(h)
    assert all(len(x) == 1 for x in names.values()) and len(set.union(*names.values())) == len(names)


def test_language_model_empty(empty, spark):
    assert pitman_yor.score(empty).count() == 0
    only = spark.createDataFrame([(i, "a b") for i in range(50) if zlib.crc32(str(i).encode()) % 7 == 2], "doc_id bigint, text string")
    assert {(r["n_known"], r["train_tokens"]) for r in pitman_yor.score(only).collect()} == {(0, 0)}


# the pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    passage = prose(rng, 60)
    rows, labels = [], []
    for i in range(400):
        w = prose(rng, 80).split()
        if i % 4 == 0:
            w[10:10] = ["idiot", "moron"]
        t = " ".join(w)
        if i in (101, 203, 305):
            t = f"{t[:100]} {passage} {t[100:]}"
        rows.append((i, t, "en", "s", len(t)))
        labels.append((i, 1, int(i % 4 == 0)))
    rows.append((401, rows[1][1], "en", "s", 5))
    rows.append((402, None, None, None, None))
    near = rows[2][1].split()
    near[40] = "other"
    rows.append((403, " ".join(near), "en", "s", 5))
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    d = str(tmp_path)
    spark.createDataFrame(rows, schema).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    docs, kept = spark.read.parquet(f"{d}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"{d}/stage{k}"
        stage(spark, docs, d).write.parquet(path)
        docs = spark.read.parquet(path)
        if k < 3:
            assert docs.columns == corpus_pipeline.COLUMNS
            kept.append({r["doc_id"]: r["text"] for r in docs.collect()})
    clean = {i for i, *_ in rows if i % 4 or i > 400}
    assert set(kept[0]) == clean
    assert set(kept[1]) == clean - {401, 403}
    assert passage in kept[2][101] and all(passage not in kept[2][i] for i in (203, 305))
    assert all(kept[2][i] == kept[1][i] for i in kept[1] if i not in (203, 305))
    assert {r["doc_id"] for r in docs.collect()} == clean - {401, 403}


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11))
