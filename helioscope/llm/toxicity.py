"""Toxicity by a subsequence string-kernel SVM with Nystroem landmarks.

The instances are word windows of sentences: words in lower case without
punctuation at their edges, runs of single characters joined ("i d i o t",
"i. d. i. o. t."), and overlapping windows of long words. The kernel counts common subsequences of
three and four characters, weighted by DECAY to the power of their span (up to
SPAN characters), so inserted characters and gaps weaken a match without
breaking it. It is divided by the weight that a window of that length has.

Labels are of documents, so the windows that made a document toxic are found by
multiple-instance learning: witnesses are the windows whose character
4-grams are most enriched in toxic documents, then, after training, those of
highest margin. Nystroem features over landmarks (witnesses, variants with
inserted characters and gaps, and clean windows) train an L2-SVM. As the
decision function is linear in the kernel to the landmarks, it is folded into
one weight for each subsequence; scoring enumerates a window's subsequences.
A logistic model turns a document's highest margins into its score.

The training sample is bounded: at most `sample` labelled documents a class, in
the order of a hash of their ids. Scoring covers every whole text.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, texts_of

DECAY = 0.6
SPAN = 8
WIDTH = 24
LANDMARKS = 160
SAMPLE = 2000
THRESHOLD = 0.7
CACHE = 300_000
#: Characters with a code of their own; others share sixteen codes.
LETTERS = "abcdefghijklmnopqrstuvwxyzàáâäçéèêëíîïñóôöúùûüß"
EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "¡¿«»“”‘’…–—"
BUCKETS = 1 << 20
#: Where a document's highest, second and third margins are cut into steps.
STEPS = np.array([-0.2, 0.0, 0.2, 0.4, 0.0, 0.2, 0.4, 0.2])
STEP_OF = np.array([0, 0, 0, 0, 1, 1, 1, 2])


def _codes() -> np.ndarray:
    table = (np.arange(0x250) % 16 + 48).astype(np.int64)
    for i, c in enumerate(LETTERS):
        table[ord(c)] = i + 1
    return table


CODES = _codes()


@lru_cache(maxsize=None)
def subsequences(n: int, p: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all subsequences of length p within SPAN characters of a window of n, and their weights."""
    rows = [(a, *(a + x for x in rest)) for a in range(n) for rest in combinations(range(1, min(SPAN, n - a)), p - 1)]
    at = np.array(rows, np.int64).reshape(-1, p)
    return at, DECAY ** (at[:, -1] - at[:, 0] + 1.0) if len(at) else np.zeros(0)


def scale(n: int) -> float:
    """What the kernel of windows of length n is divided by: the root of its subsequences' squared weights. Windows of fewer than six characters count as six, so that their few subsequences don't outweigh longer matches."""
    n = max(n, 6)
    return float(np.sqrt(sum((subsequences(n, p)[1] ** 2).sum() for p in (3, 4))) or 1.0)


def windows(token: str) -> list[str]:
    """Windows of one token, which is in lower case."""
    word = token.strip(EDGES)
    if len(word) <= WIDTH:
        return [word] if len(word) > 2 else []
    return [word[a : a + WIDTH] for a in range(0, len(word) - WIDTH // 2, WIDTH // 2)]


def joined(tokens: list[str]) -> list[str]:
    """Runs of three or more single characters, joined: signs at their edges go first ("i. d. i. o. t."), tokens of signs alone are passed over ("i - d - i")."""
    out, run = [], []
    for t in [*tokens, "  "]:
        t = t.strip(EDGES)
        if len(t) == 1:
            run.append(t)
        elif t:
            if len(run) > 2:
                out.append("".join(run))
            run = []
    return out


def tokens_of(text: str) -> list[str]:
    own = text.lower().split()
    return own + joined(own)


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(indices, codes) of the words of each length."""
    lens = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(lens).tolist():
        if n < 3:
            continue
        at = np.flatnonzero(lens == n)
        points = np.frombuffer("".join([words[i] for i in at.tolist()]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        yield at, np.where(points < 0x250, CODES[np.minimum(points, 0x24F)], 48 + points % 16).reshape(len(at), n)


def features(codes: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
    """(feature of each row, weight) for each subsequence of windows of one length."""
    s = scale(codes.shape[1])
    for p in (3, 4):
        at, weight = subsequences(codes.shape[1], p)
        for positions, w in zip(at, weight.tolist()):
            key = codes[:, positions[0]]
            for i in positions[1:]:
                key = key << 6 | codes[:, i]
            yield (key if p == 3 else BUCKETS + ((key * 0x9E3779B1) >> 7) % BUCKETS), w / s


SIZE = 2 * BUCKETS


class Kernel:
    """Kernels of windows to a fixed list of landmarks."""

    def __init__(self, landmarks: list[str]):
        own = [(i, k, w) for at, codes in by_length(landmarks) for keys, w in features(codes) for i, k in zip(at.tolist(), keys.tolist())]
        self.keys = np.unique(np.array([k for _, k, _ in own], np.int64))
        self.rows = np.zeros((len(self.keys) + 1, len(landmarks)), np.float64)  # the last row is for other subsequences
        np.add.at(self.rows, (np.searchsorted(self.keys, [k for _, k, _ in own]), [i for i, _, _ in own]), [w for *_, w in own])
        self.place = np.full(SIZE, len(self.keys), np.int32)
        self.place[self.keys] = np.arange(len(self.keys))

    def __call__(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), self.rows.shape[1]))
        for at, codes in by_length(words):
            for a in range(0, len(at), 2000):
                part = np.zeros((min(2000, len(at) - a), out.shape[1]))
                for keys, w in features(codes[a : a + 2000]):
                    hit = self.place[keys]
                    some = np.flatnonzero(hit < len(self.keys))
                    part[some] += w * self.rows[hit[some]]
                out[at[a : a + 2000]] = part
        return out

    def folded(self, beta: np.ndarray) -> np.ndarray:
        weights = np.zeros(SIZE, np.float32)
        weights[self.keys] = self.rows[:-1] @ beta
        return weights


def svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """L2-SVM (squared hinge) by Newton steps on the active set; the last coefficient is the offset."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    penalty = np.append(np.full(x.shape[1], ridge), 1e-9)
    active = np.ones(len(z), bool)
    for _ in range(30):
        a = z[active]
        c = weight[active] / weight.sum()
        w = np.linalg.solve((a * c[:, None]).T @ a + np.diag(penalty), (a * c[:, None]).T @ y[active])
        now = y * (z @ w) < 1
        if (now == active).all():
            break
        active = now
    return w


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 3e-4) -> np.ndarray:
    z = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) / len(y) + ridge * w
        step = np.linalg.solve((z * (p * (1 - p) / len(y))[:, None]).T @ z + ridge * np.eye(len(w)), grad)
        w -= step
        if np.abs(step).max() < 1e-7:
            break
    return w


def variants(word: str, seed: int) -> list[str]:
    """The word with an inserted character, with a doubled one, and with a sign in each gap."""
    rng = np.random.default_rng(seed)
    i, j = int(rng.integers(1, len(word))), int(rng.integers(0, len(word)))
    put = LETTERS[int(rng.integers(0, 26))]
    sign = ".-*_"[int(rng.integers(0, 4))]
    return [v[:WIDTH] for v in (word[:i] + put + word[i:], word[: j + 1] + word[j:], sign.join(word))]


class Model:
    """The folded weights, the offset and the logistic model; untrained, every score is zero."""

    def __init__(self, weights: np.ndarray | None = None, offset: float = 0.0, final: np.ndarray | None = None):
        self.weights, self.offset, self.final = weights, offset, final
        self.cache: dict[str, float] = {}

    def __getstate__(self):
        return {"weights": self.weights, "offset": self.offset, "final": self.final, "cache": {}}

    def margins(self, words: list[str]) -> np.ndarray:
        out = np.full(len(words), self.offset)
        for at, codes in by_length(words):
            for a in range(0, len(at), 20_000):
                part = np.zeros(min(20_000, len(at) - a))
                for keys, w in features(codes[a : a + 20_000]):
                    part += w * self.weights[keys]
                out[at[a : a + 20_000]] += part
        return out

    def prepare(self, tokens: set[str]) -> None:
        if len(self.cache) + len(tokens) > CACHE:
            self.cache.clear()
        fresh = [t for t in tokens if t not in self.cache]
        spans, words = [0], []
        for t in fresh:
            words += windows(t)
            spans.append(len(words))
        got = self.margins(words).tolist()
        for t, a, b in zip(fresh, spans, spans[1:]):
            self.cache[t] = max(got[a:b], default=self.offset)

    def summaries(self, texts: list[str]) -> np.ndarray:
        """Of each text: how far its highest margins climb STEPS, each of them from 0 to 1."""
        cut = [tokens_of(t) for t in texts]
        self.prepare(set().union(*cut))
        get, rows = self.cache.__getitem__, np.zeros((len(texts), len(STEPS)))
        for i, own in enumerate(cut):
            m = np.fromiter(map(get, own), np.float64, len(own))
            top = np.sort(m[m > -0.5])[::-1] if len(m) else m
            best = np.append(top[:3], [-1.0] * 3)
            rows[i] = np.clip((best[STEP_OF] - STEPS) / 0.2, 0, 1)
        return rows

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(texts))
        return 1 / (1 + np.exp(-np.clip(self.summaries(texts) @ self.final[:-1] + self.final[-1], -30, 30)))


def train(toxic: list[str], clean: list[str], landmarks: int = LANDMARKS) -> Model:
    """Fits a model to whole texts of both classes. Without a text of either class the model is untrained."""
    if not toxic or not clean:
        return Model()
    same: dict[str, str] = {}  # one object for each window: the sample's windows are few, its texts aren't
    bad, good = ([list({same.setdefault(w, w) for t in tokens_of(x) for w in windows(t)}) for x in own] for own in (toxic, clean))

    def grams(w: str) -> set[str]:
        return {w[i : i + 4] for i in range(len(w) - 3)} | {f"={w}"}

    ill, well = Counter(), Counter()
    for words in bad:
        ill.update(set().union(*map(grams, words)))
    ill = Counter({g: a for g, a in ill.items() if a >= min(3, len(bad))})
    for words in good:
        well.update(g for g in set().union(*map(grams, words)) if g in ill)
    lift = {g: np.log((a + 0.5) / (len(bad) + 1)) - np.log((well[g] + 0.5) / (len(good) + 1)) for g, a in ill.items()}
    rate = lambda w: max((lift.get(g, 0.0) for g in grams(w)), default=0.0)
    found = Counter()
    for words in bad:
        ranked = sorted(((rate(w), w) for w in words), reverse=True)[:4]
        found.update(w for r, w in ranked if r > 1.5 and r > 0.6 * ranked[0][0])
    seen = Counter(w for words in good for w in words)
    clean_words = sorted(seen, key=lambda w: zlib.crc32(w.encode()))
    hard: list[str] = []
    model = Model()
    for _ in range(4):
        positive = [w for w, _ in found.most_common(2500)]
        if not positive:
            return Model()
        changed = [v for i, w in enumerate(positive[:400]) for v in variants(w, i)]
        negative = list(dict.fromkeys(hard[:3000] + clean_words[:5000]))
        marks = list(dict.fromkeys(positive[: landmarks // 2] + hard[: landmarks // 4] + clean_words[: landmarks // 4] + changed[: landmarks // 8]))
        kernel = Kernel(marks)
        values, vectors = np.linalg.eigh(kernel(marks))
        keep = values > 1e-6 * values.max()
        half = vectors[:, keep] / np.sqrt(values[keep])
        words = positive + changed + negative
        y = np.append(np.ones(len(positive) + len(changed)), -np.ones(len(negative)))
        weight = np.concatenate([np.log1p([found[w] for w in positive]), np.full(len(changed), 0.5), np.minimum(np.sqrt([seen[w] for w in negative]), 20.0)])
        weight[y > 0] *= weight[y < 0].sum() / weight[y > 0].sum()
        w = svm(kernel(words) @ half, y, weight)
        model = Model(kernel.folded(half @ w[:-1]), float(w[-1]))
        every = list({w for words in [*bad, *good] for w in words})
        margin = dict(zip(every, model.margins(every).tolist()))
        hard = sorted(seen, key=lambda w: (-margin[w] - 0.2 * np.log(seen[w]), w))[:3000]
        found = Counter()
        for words in bad:
            ranked = sorted(((margin[w], w) for w in words), reverse=True)[:4]
            found.update(w for m, w in ranked if m > 0 and (w not in seen or rate(w) > 1.5))
    x = model.summaries(toxic + clean)
    y = np.append(np.ones(len(toxic)), np.zeros(len(clean)))
    model.final = logistic(x, y)
    model.cache.clear()
    return model


def fit(docs: DataFrame, labels: DataFrame, learn: F.col = None, sample: int = SAMPLE) -> Model:
    """Trains on at most `sample` labelled documents a class, those first in the order of a hash of their ids.

    labels: (doc_id, toxic); of several labels of a document the highest counts,
    null ids and labels don't. learn: a condition on doc_id. The ids of the
    sample, 2 * `sample` at most, are broadcast; their texts reach the driver.
    """
    rows = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    rows = (rows.where(learn) if learn is not None else rows).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = None
    for label in (0, 1):
        own = rows.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        picked = own if picked is None else picked.union(own)
    picked = docs.sparkSession.createDataFrame(picked.toPandas(), "doc_id bigint, toxic int")
    got = texts_of(docs).join(F.broadcast(picked), "doc_id").select("doc_id", "text", "toxic").toPandas().sort_values(["doc_id", "text"])
    return train(got.text[got.toxic == 1].tolist(), got.text[got.toxic == 0].tolist())


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of each row: a narrow map with the model broadcast (its size is fixed). Null texts are empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.scores(batch.column(1).to_pylist()), pa.float64())], ["doc_id", "score"])

    return texts_of(docs).mapInArrow(run, "doc_id bigint, score double")


def kept(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that score under the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            scores = shared.value.scores([t or "" for t in batch.column(at).to_pylist()])
            yield batch.filter(pa.array(scores < threshold))

    return docs.mapInArrow(run, docs.schema)


def fold(doc_id: F.col, parts: int) -> F.col:
    """crc32 of the id as text, modulo `parts`; null ids are in no fold."""
    return F.crc32(doc_id.cast("bigint").cast("string").cast("binary")) % parts


def judged(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The columns of the query op1: labels of the fold with remainder 1 are held out."""
    remainder = fold(F.col("doc_id"), 3)
    model = fit(docs, labels, remainder != 1)
    return score(docs, model).select("doc_id", F.coalesce(remainder == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
