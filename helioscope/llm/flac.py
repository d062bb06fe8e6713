"""Bytes kept as FLAC media columns, and FLAC read back.

A payload's bytes are mono 8-bit samples (byte - 128). The encoder picks for
each frame a constant, verbatim, fixed (order 0 to 2) or quantised linear
predictor (order `lpc_order`) with one Rice parameter, by the exact number of
bits. The decoder reads any such mono stream of 4 to 16 bits: all subframe
types, partitioned Rice residuals with both parameter sizes and escapes. It
verifies every frame's CRC-8 and CRC-16 and the stream's MD5, and raises
MediaError where one is wrong. Frames stand side by side as lanes of arrays:
step i decodes sample i of every frame of a slice.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, texts_of

UNIT = 192
BLOCK = 1152
RATE = 16_000
#: Block sizes and sample depths by their codes in a frame header (fixed values of the format).
BLOCK_CODES = {1: 192, **{c: 576 << (c - 2) for c in range(2, 6)}, **{c: 256 << (c - 8) for c in range(8, 16)}}
DEPTH_CODES = {1: 8, 2: 12, 4: 16}


class MediaError(ValueError):
    """A stream that is cut short or fails a check."""


def _crc_table(poly: int, width: int, bits: int) -> np.ndarray:
    """The register after `bits` more bits, for each value of its top `bits` bits."""
    x = np.arange(1 << bits, dtype=np.uint32) << (width - bits)
    top, mask = 1 << (width - 1), (1 << width) - 1
    for _ in range(bits):
        x = np.where(x & top, (x << 1) ^ poly, x << 1) & mask
    return x


CRC8 = _crc_table(0x07, 8, 8).astype(np.uint8)
CRC16 = _crc_table(0x8005, 16, 16).astype(np.uint16)
LEADING = np.array([16 - int(v).bit_length() for v in range(1 << 16)], np.uint8)


def _ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of each run, one run behind the other."""
    ends = np.cumsum(lens)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lens - starts, lens)


def crc16(data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """CRC-16 of each run of bytes. The register starts at zero, so runs may be filled with zeros in front."""
    out = np.zeros(len(starts), np.uint16)
    order = np.argsort(lens, kind="stable")
    for a in range(0, len(order), 2048):
        own = order[a : a + 2048]
        width = int(lens[own].max())
        width += width % 2
        rows = np.zeros((len(own), width), np.uint8)
        rows[np.arange(width) >= (width - lens[own])[:, None]] = data[_ragged(starts[own], lens[own])]
        words = np.ascontiguousarray(rows.view(">u2").astype(np.uint16).T)
        crc = np.zeros(len(own), np.uint16)
        for w in words:
            crc = CRC16[crc ^ w]
        out[own] = crc
    return out


def crc8(rows: np.ndarray, lens: np.ndarray) -> np.ndarray:
    crc = np.zeros(len(rows), np.uint8)
    for i in range(rows.shape[1]):
        crc = np.where(i < lens, CRC8[crc ^ rows[:, i]], crc)
    return crc


def _numbers(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame numbers in the format's extended UTF-8: bytes and how many."""
    out, lens = np.zeros((len(n), 6), np.uint8), np.ones(len(n), np.int64)
    for k, most in enumerate((1 << 7, 1 << 11, 1 << 16, 1 << 21, 1 << 26), 1):
        lens[n >= most] = k + 1
    for k in range(1, 7):
        own = np.flatnonzero(lens == k)
        if not len(own):
            continue
        v = n[own]
        for i in range(k - 1, 0, -1):
            out[own, i] = 0x80 | (v & 0x3F)
            v = v >> 6
        out[own, 0] = v if k == 1 else (0xFF00 >> k) & 0xFF | v
    return out, lens


def _zigzag(r: np.ndarray) -> np.ndarray:
    return (r << 1) ^ (r >> 31)


def _rice_bits(z: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best of the three Rice parameters round the mean's logarithm, and bits with it. z is zero behind each row's n values."""
    mean = z.sum(1) / np.maximum(n, 1)
    near = np.clip(np.floor(np.log2(np.maximum(mean, 1))).astype(np.int64), 0, 13)
    best_k, best = near, np.full(len(z), np.iinfo(np.int64).max)
    for d in (-1, 0, 1):
        k = np.clip(near + d, 0, 14)
        bits = (z >> k[:, None].astype(np.int32)).sum(1) + n * (k + 1)
        best_k, best = np.where(bits < best, k, best_k), np.minimum(bits, best)
    return best_k, best


def _lpc(x: np.ndarray, lens: np.ndarray, order: int) -> tuple[np.ndarray, int]:
    """Quantised predictor coefficients of each row (Levinson recursion on the autocorrelation), and their shift."""
    f = x.astype(np.float32)
    r = np.stack([np.einsum("ij,ij->i", f[:, k:], f[:, : f.shape[1] - k]) for k in range(order + 1)], 1).astype(np.float64)
    a, err = np.zeros((len(x), order)), np.maximum(r[:, 0], 1e-9)
    for i in range(order):
        k = (r[:, i + 1] - (a[:, :i] * r[:, i:0:-1]).sum(1)) / err
        a[:, :i], a[:, i] = a[:, :i] - k[:, None] * a[:, :i][:, ::-1], k
        err = np.maximum(err * (1 - k * k), 1e-9)
    return np.clip(np.rint(a * 32), -64, 63).astype(np.int32), 5


class _Bits:
    """A growing set of bit fields in one array of bits."""

    def __init__(self, n: int):
        self.a = np.zeros(n, np.uint8)

    def put(self, at: np.ndarray, value: np.ndarray, width: int) -> None:
        for b in range(width):
            self.a[at + b] = (value >> (width - 1 - b)) & 1


def encode(payloads: list[bytes], lpc_order: int = 4, block: int = BLOCK, rate: int = RATE) -> list[bytes]:
    """A FLAC stream of each payload (of one byte at least), with a seek point for every frame."""
    if not payloads:
        return []
    sizes = np.fromiter(map(len, payloads), np.int64, len(payloads))
    counts = -(-sizes // block)
    doc = np.repeat(np.arange(len(payloads)), counts)
    number = _ragged(np.zeros_like(counts), counts)
    n = np.minimum(block, sizes[doc] - number * block)
    data = np.frombuffer(b"".join(payloads), np.uint8)
    frames, x = len(doc), np.zeros((len(doc), block), np.int32)
    inside = np.arange(block) < n[:, None]
    x[inside] = data.astype(np.int32) - 128

    # kind -1: constant, -2: verbatim, 0 to 2: fixed order, 3: linear predictor
    kind, k_of, bits = np.full(frames, -2), np.zeros(frames, np.int64), 8 * n
    residual = x
    fixed = x
    for order in range(3):
        if order:
            fixed = np.diff(fixed, axis=1, prepend=np.int32(0))
        z = _zigzag(fixed)
        z[~inside] = 0
        z[:, :order] = 0
        k, b = _rice_bits(z, n - order)
        b = b + 8 * order + 10
        own = (b < bits) & (n > order)
        kind, k_of, bits = np.where(own, order, kind), np.where(own, k, k_of), np.where(own, b, bits)
        if own.any():
            residual = np.where(own[:, None], z, residual)
    coefs, shift = np.zeros((frames, max(lpc_order, 1)), np.int32), 0
    if lpc_order and block > lpc_order:
        coefs, shift = _lpc(x, n, lpc_order)
        guess = np.zeros_like(x)
        for j in range(lpc_order):
            guess[:, j + 1 :] += coefs[:, j : j + 1] * x[:, : block - j - 1]
        z = _zigzag(x - (guess >> shift))
        z[~inside] = 0
        z[:, :lpc_order] = 0
        k, b = _rice_bits(z, n - lpc_order)
        b = b + 8 * lpc_order + 19 + 7 * lpc_order
        own = (b < bits) & (n > lpc_order)
        kind, k_of, bits = np.where(own, 3, kind), np.where(own, k, k_of), np.where(own, b, bits)
        residual = np.where(own[:, None], z, residual)
    same = ((x == x[:, :1]) | ~inside).all(1)
    kind, bits = np.where(same, -1, kind), np.where(same, 8, bits)

    # headers: sync and fixed block size, block and rate codes, mono and 8 bits, number, block size where it has no code, CRC-8
    coded = {v: c for c, v in BLOCK_CODES.items()}
    code = np.array([coded.get(int(v), 7) for v in n])
    digits, n_digits = _numbers(number)
    head = np.zeros((frames, 12), np.uint8)
    head[:, 0], head[:, 1], head[:, 2], head[:, 3] = 0xFF, 0xF8, code << 4, 0x02
    rows = np.arange(frames)
    for i in range(6):
        head[:, 4 + i] = digits[:, i]
    at = 4 + n_digits
    odd = np.flatnonzero(code == 7)
    head[odd, at[odd]], head[odd, at[odd] + 1] = (n[odd] - 1) >> 8, (n[odd] - 1) & 255
    at[odd] += 2
    head[rows, at] = crc8(head, at)
    head_len = at + 1

    size = head_len + -(-(8 + bits) // 8) + 2
    start = np.cumsum(size) - size
    out = _Bits(8 * int(size.sum()))
    for i in range(head.shape[1]):
        own = np.flatnonzero(i < head_len)
        out.put(8 * (start[own] + i), head[own, i].astype(np.int64), 8)
    pos = 8 * (start + head_len)
    tag = np.select([kind == -1, kind == -2, kind < 3], [0, 1, 8 + np.maximum(kind, 0)], 32 + lpc_order - 1)
    out.put(pos, tag << 1, 8)
    pos = pos + 8
    own = np.flatnonzero(kind == -1)
    out.put(pos[own], x[own, 0] & 255, 8)
    own = np.flatnonzero(kind == -2)
    if len(own):
        out.put(np.repeat(pos[own], n[own]) + 8 * _ragged(np.zeros(len(own), np.int64), n[own]), x[own][inside[own]] & 255, 8)
    for what in range(4):
        own = np.flatnonzero(kind == what)
        if not len(own):
            continue
        order = what if what < 3 else lpc_order
        p = pos[own]
        for j in range(order):
            out.put(p, x[own, j] & 255, 8)
            p = p + 8
        if what == 3:
            out.put(p, np.full(len(own), 6), 4)
            out.put(p + 4, np.full(len(own), shift), 5)
            p = p + 9
            for j in range(order):
                out.put(p, coefs[own, j] & 127, 7)
                p = p + 7
        p = p + 6
        out.put(p, k_of[own], 4)
        p = p + 4
        for k in np.unique(k_of[own]):
            sub = np.flatnonzero(k_of[own] == k)
            r, lens = residual[own[sub]], n[own[sub]] - order
            z = r[:, order:][np.arange(block - order) < lens[:, None]].astype(np.int64)
            q = z >> k
            span = np.cumsum(q + (k + 1))
            first = np.cumsum(lens) - lens
            begin = span - (q + (k + 1))
            code_at = begin + np.repeat(p[sub] - begin[np.minimum(first, len(begin) - 1)], lens) + q
            out.a[code_at] = 1
            out.put(code_at + 1, z, int(k))
    packed = np.packbits(out.a)
    check = crc16(packed, start, size - 2)
    packed[start + size - 2], packed[start + size - 1] = check >> 8, check & 255
    raw, streams = packed.tobytes(), []
    firsts = np.cumsum(counts) - counts
    for i, payload in enumerate(payloads):
        a, c = int(firsts[i]), int(counts[i])
        own, begin = slice(a, a + c), int(start[a])
        info = struct.pack(">HH", block, block) + int(size[own].min()).to_bytes(3, "big") + int(size[own].max()).to_bytes(3, "big")
        info += (rate << 44 | 0 << 41 | 7 << 36 | len(payload)).to_bytes(8, "big") + hashlib.md5((np.frombuffer(payload, np.uint8) ^ 128).tobytes()).digest()
        points = np.zeros(c, [("sample", ">u8"), ("byte", ">u8"), ("n", ">u2")])
        points["sample"], points["byte"], points["n"] = number[own] * block, start[own] - begin, n[own]
        table = points.tobytes()
        streams.append(b"fLaC" + bytes([0]) + (34).to_bytes(3, "big") + info + bytes([0x83]) + len(table).to_bytes(3, "big") + table + raw[begin : begin + int(size[own].sum())])
    return streams


def _metadata(stream: bytes) -> dict:
    if stream[:4] != b"fLaC":
        raise MediaError("no FLAC stream")
    at, last, out = 4, False, {"points": None}
    while not last:
        if at + 4 > len(stream):
            raise MediaError("metadata cut short")
        last, kind, size = stream[at] >> 7, stream[at] & 127, int.from_bytes(stream[at + 1 : at + 4], "big")
        body = stream[at + 4 : at + 4 + size]
        if kind == 0:
            x = int.from_bytes(body[10:18], "big")
            out |= {"block": int.from_bytes(body[:2], "big"), "rate": x >> 44, "channels": (x >> 41 & 7) + 1, "depth": (x >> 36 & 31) + 1, "total": x & (1 << 36) - 1, "md5": body[18:34]}
        elif kind == 3:
            out["points"] = np.frombuffer(body, [("sample", ">u8"), ("byte", ">u8"), ("n", ">u2")])
        at += 4 + size
    return out | {"audio": at}


def _scan(stream: np.ndarray, audio: int) -> np.ndarray:
    """Where frames start, without seek points: sync codes whose header passes its CRC-8 and has the next number."""
    found, at = [], np.flatnonzero((stream[audio:-1] == 0xFF) & (stream[audio + 1 :] & 0xFE == 0xF8)) + audio
    for p in at.tolist():
        head = stream[p : p + 16].tolist()
        if len(head) < 6:
            continue
        lead = 8 - (head[4] ^ 255).bit_length() if head[4] != 255 else 8
        k = 1 if lead == 0 else lead
        number = head[4] if lead == 0 else head[4] & (0x7F >> lead)
        for b in head[5 : 4 + k]:
            number = number << 6 | b & 63
        end = 4 + k + {6: 1, 7: 2}.get(head[2] >> 4, 0) + {12: 1, 13: 2, 14: 2}.get(head[2] & 15, 0)
        crc = 0
        for b in head[:end]:
            crc = int(CRC8[crc ^ b])
        if end < len(head) and crc == head[end] and number == len(found):
            found.append(p)
    return np.array(found, np.int64)


def decode(streams: list[bytes]) -> list[tuple[bytes, list[tuple[int, int, int]], str]]:
    """Of each stream: PCM as unsigned 8-bit samples, blocks (sample offset, byte offset in the stream, samples), predictors by frames."""
    if not streams:
        return []
    metas = [_metadata(s) for s in streams]
    data = np.frombuffer(b"".join(streams) + bytes(16), np.uint8)
    sizes = np.fromiter(map(len, streams), np.int64, len(streams))
    base = np.cumsum(sizes) - sizes
    starts, docs = [], []
    for i, (m, s) in enumerate(zip(metas, streams)):
        if m["channels"] != 1 or m["depth"] != 8:
            raise MediaError("only mono streams of 8 bits are media columns")
        pts = m["points"]
        whole = pts is not None and int(pts["n"].astype(np.int64).sum()) == m["total"]
        own = pts["byte"].astype(np.int64) + m["audio"] if whole else _scan(np.frombuffer(s, np.uint8), m["audio"])
        starts.append(own + base[i])
        docs.append(np.full(len(own), i))
    start, doc = np.concatenate(starts), np.concatenate(docs)
    lanes = len(start)
    end = np.append(start[1:], sizes.sum())
    new = np.flatnonzero(np.diff(doc, append=-1))
    end[new] = base[doc[new]] + sizes[doc[new]]

    head = data[np.minimum(start[:, None] + np.arange(16), len(data) - 1)]
    if not ((head[:, 0] == 0xFF) & (head[:, 1] & 0xFE == 0xF8)).all():
        raise MediaError("a frame has no sync code")
    code, rate_code = head[:, 2] >> 4, head[:, 2] & 15
    lead = np.zeros(lanes, np.int64)
    for b in range(7):
        lead += (head[:, 4] >> (7 - b)) & 1 & (lead == b)
    rows = np.arange(lanes)
    at = 4 + np.maximum(lead, 1)
    n = np.array([BLOCK_CODES.get(c, 0) for c in range(16)])[code]
    for c, k in ((6, 1), (7, 2)):
        own = np.flatnonzero(code == c)
        n[own] = (head[own, at[own]] if k == 1 else head[own, at[own]].astype(np.int64) << 8 | head[own, at[own] + 1]) + np.int64(1)
        at[own] += k
    at += np.array([0] * 12 + [1, 2, 2, 0])[rate_code]
    if (crc8(head[:, :14], at) != head[rows, at]).any():
        raise MediaError("a frame header fails its CRC-8")
    stored = data[end - 2].astype(np.uint16) << 8 | data[end - 1]
    if (crc16(data, start, end - start - 2) != stored).any():
        raise MediaError("a frame fails its CRC-16")

    window = np.zeros(len(data) - 8, np.uint64)
    for i in range(8):
        window |= data[i : len(data) - 8 + i].astype(np.uint64) << np.uint64(56 - 8 * i)

    def take(p: np.ndarray, width: int) -> np.ndarray:
        return ((window[p >> 3] << (p & 7).astype(np.uint64)) >> np.uint64(64 - width)).astype(np.int64) if width else np.zeros(len(p), np.int64)

    def signed(v: np.ndarray, width: int) -> np.ndarray:
        return v - ((v >> (width - 1)) << width)

    pos = 8 * (start + at + 1)
    tag = take(pos + 1, 6)
    wasted = take(pos + 7, 1)
    pos = pos + 8
    if wasted.any():
        raise MediaError("wasted bits aren't used in media columns")
    longest = int(n.max())
    x = np.zeros((longest, lanes), np.int32)  # a row for each step
    own = np.flatnonzero(tag == 0)
    x[:, own] = signed(take(pos[own], 8), 8)
    own = np.flatnonzero(tag == 1)
    if len(own):
        lens = n[own]
        x[_ragged(np.zeros(len(own), np.int64), lens), np.repeat(own, lens)] = signed(take(np.repeat(pos[own], lens) + 8 * _ragged(np.zeros(len(own), np.int64), lens), 8), 8)
    order_of = np.where((tag >= 8) & (tag <= 12), tag - 8, np.where(tag >= 32, tag - 31, 0))
    coded = np.flatnonzero((tag >= 8) & (tag <= 12) | (tag >= 32))
    if len(coded) < ((tag > 1).sum()):
        raise MediaError("a reserved subframe type")
    coefs, shifts = np.zeros((32, lanes), np.int64), np.zeros(lanes, np.int64)
    for order in np.unique(order_of[coded]).tolist():
        own = coded[order_of[coded] == order]
        for j in range(order):
            x[j, own] = signed(take(pos[own], 8), 8)
            pos[own] += 8
        own = own[tag[own] >= 32]
        if len(own):
            precision = take(pos[own], 4) + 1
            shifts[own] = take(pos[own] + 4, 5)
            pos[own] += 9
            for width in np.unique(precision).tolist():
                sub = own[precision == width]
                for j in range(order):
                    coefs[j, sub] = signed(take(pos[sub], width), width)
                    pos[sub] += width
    if len(coded):
        coded = coded[np.argsort(-n[coded], kind="stable")]
        _residuals(x, coded, n, order_of, pos, take, signed, window)
        _restore(x, coded, tag, order_of, coefs, shifts)
    flat = (np.ascontiguousarray(x.T)[np.arange(longest) < n[:, None]] + 128).astype(np.uint8)
    counts = np.bincount(doc, minlength=len(streams))
    totals = np.bincount(doc, weights=n, minlength=len(streams)).astype(np.int64)
    sample = np.cumsum(n) - n
    out, a, f = [], 0, 0
    for i, m in enumerate(metas):
        pcm, c = flat[a : a + totals[i]], int(counts[i])
        if len(pcm) != m["total"] or m["md5"] != bytes(16) and hashlib.md5((pcm ^ 128).tobytes()).digest() != m["md5"]:
            raise MediaError("the samples don't match the stream's MD5")
        own = slice(f, f + c)
        blocks = list(zip((sample[own] - a).tolist(), (start[own] - base[i]).tolist(), n[own].tolist()))
        kinds, many = np.unique(tag[own], return_counts=True)
        out.append((pcm.tobytes(), blocks, " ".join(f"{k}:{v}" for k, v in zip(kinds.tolist(), many.tolist()))))
        a, f = a + int(totals[i]), f + c
    return out


def _residuals(x, coded, n, order_of, pos, take, signed, window) -> None:
    """Rice residuals of all coded lanes, sample by sample. coded: by falling number of samples."""
    method, part = take(pos[coded], 2), take(pos[coded] + 2, 4)
    if (method > 1).any():
        raise MediaError("a reserved residual coding")
    pos[coded] += 6
    p, order, lens = pos[coded], order_of[coded], n[coded]
    span, wide = lens >> part, 4 + method
    k, raw = np.zeros(len(coded), np.int64), np.zeros(len(coded), bool)
    fall = -lens
    simple = bool((part == 0).all())
    u = np.uint64
    for i in range(int(lens[0])):
        live = int(np.searchsorted(fall, -i, "left"))  # lanes with more than i samples
        go = order[:live] <= i
        if not simple or i <= 32:
            begin = np.flatnonzero(go & ((i % span[:live] == 0) | (order[:live] == i)))
            for w in (4, 5):
                own = begin[wide[begin] == w]
                if len(own):
                    k[own] = take(p[own], w)
                    raw[own] = k[own] == (1 << w) - 1
                    p[own] += w
            own = begin[raw[begin]]
            if len(own):
                k[own] = take(p[own], 5)
                p[own] += 5
        all_go = bool(go.all()) and not raw[:live].any()
        own = slice(0, live) if all_go else np.flatnonzero(go & ~raw[:live])
        at, kk = p[own], k[own]
        w = window[at >> 3] << (at & 7).astype(u)
        q = LEADING[w >> u(48)].astype(np.int64)
        if (q == 16).any():
            far = np.flatnonzero(q == 16)
            while len(far):
                step = LEADING[take(at[far] + q[far], 16)].astype(np.int64)
                q[far] += step
                far = far[step == 16]
            w = window[(at + q) >> 3] << ((at + q) & 7).astype(u)
            rest = w << u(1)
        else:
            rest = w << (q + 1).astype(u)
        low = ((rest >> u(1)) >> (63 - kk).astype(u)).astype(np.int64)
        z = q << kk | low
        x[i, coded[own]] = (z >> 1) ^ -(z & 1)
        p[own] = at + q + 1 + kk
        if not all_go:
            own = np.flatnonzero(go & raw[:live])
            for width in np.unique(k[own]).tolist():
                sub = own[k[own] == width]
                x[i, coded[sub]] = signed(take(p[sub], width), width) if width else 0
                p[sub] += width
    pos[coded] = p


def _restore(x, coded, tag, order_of, coefs, shifts) -> None:
    """Samples from residuals and warm-up samples, in place."""
    fixed = {0: (), 1: (1,), 2: (2, -1), 3: (3, -3, 1), 4: (4, -6, 4, -1)}
    for linear in (False, True):
        for order in np.unique(order_of[coded]).tolist():
            own = coded[(order_of[coded] == order) & ((tag[coded] >= 32) == linear)]
            if not len(own) or not order:
                continue
            y = np.ascontiguousarray(x[:, own])
            if linear:
                c, s = coefs[:order, own], shifts[own]
                for i in range(order, len(y)):
                    y[i] += (c * y[i - order : i][::-1]).sum(0) >> s
            elif order == 1:
                y = np.cumsum(y, 0, dtype=np.int32)
            else:
                for i in range(order, len(y)):
                    for j, c in enumerate(fixed[order]):
                        y[i] += c * y[i - 1 - j]
            x[:, own] = y


def payload_of(text: str) -> bytes:
    raw = text.encode()
    return raw + b" " * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lpc_order: int = 4) -> DataFrame:
    """(doc_id, n_bytes, media binary): each text's UTF-8, filled with spaces to a positive multiple of 192 bytes, as a FLAC stream.

    A narrow map. A null or empty text is 192 spaces. Equal texts give equal
    streams; repeated rows and null ids each give a row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=2 << 20):
            texts = batch.column(1).to_pylist()
            sizes = pa.array([len(t.encode()) for t in texts], pa.int64())
            media = pa.array(encode([payload_of(t) for t in texts], lpc_order), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, media], ["doc_id", "n_bytes", "media"])

    return texts_of(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, n_bytes bigint, media binary")


def from_media(media: DataFrame) -> DataFrame:
    """Adds pcm (unsigned 8-bit samples), blocks (sample offset, byte offset in the stream, samples) and feature to (doc_id, n_bytes, media)."""
    blocks = pa.list_(pa.struct([("sample_offset", pa.int64()), ("byte_offset", pa.int64()), ("n_samples", pa.int64())]))
    schema = "doc_id bigint, n_bytes bigint, media binary, pcm binary, blocks array<struct<sample_offset:bigint,byte_offset:bigint,n_samples:bigint>>, feature string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media", 2 << 20):
            got = decode(batch.column(2).to_pylist())
            seek = [[dict(zip(("sample_offset", "byte_offset", "n_samples"), b)) for b in bl] for _, bl, _ in got]
            feature = []
            for pcm, bl, kinds in got:
                s = np.frombuffer(pcm, np.uint8).astype(np.int32) - 128
                feature.append(f"rate={RATE} frames={len(bl)} subframes={kinds} peak={int(np.abs(s).max())} energy={int((s * s).sum(dtype=np.int64))} crossings={int((s[1:] * s[:-1] < 0).sum())}")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([g[0] for g in got], pa.binary()), pa.array(seek, blocks), pa.array(feature, pa.string())], ["doc_id", "n_bytes", "media", "pcm", "blocks", "feature"])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)


def digests(read: DataFrame) -> DataFrame:
    """The columns of the query op10."""
    return read.select(
        "doc_id", "n_bytes", F.length("pcm").cast("bigint").alias("payload_bytes"), F.sha2("pcm", 256).alias("payload_sha256"),
        F.crc32(F.substring("pcm", -16, 16)).alias("tail_crc32"), F.length("media").cast("bigint").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
    )
