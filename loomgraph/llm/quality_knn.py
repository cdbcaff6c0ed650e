"""Quality by nearest-neighbour voting over labelled latent-semantic vectors.

Terms are the words of a text (A-Z lowered runs of non-blanks) and, with more weight, how it is written: shapes of tokens (runs of lower-case letters, capitals, digits and
marks), pairs of shapes, whether a word repeats the one before it, how varied words and lines are. Both kinds are hashed to slots of their own; term counts are
damped, weighted by inverse document frequency, projected on the leading singular vectors of the labelled sample
(latent semantic analysis) and scaled to length one.

The sample is bounded: at most `per_class` labelled documents of each class, those of the smallest digest of their id,
so reruns agree; sizes of model and broadcast depend on it alone. Every document's cosine products with
all labelled vectors are computed exactly, block by block; the `neighbours` nearest vote with their similarity. Neighbours that tie for the last places
(equal to nine digits) share them evenly, so neither their order nor that of documents matters.

Null and empty texts get the vector of a text without words and are scored like any other. Labels other than 0 and 1 are
ignored; a document with contradicting labels counts with the smaller, repeated rows of a labelled id with the smallest text; repeated rows are scored alike, an empty table gives no rows. Without labels of both classes the score is
the share of ones (0.5 without any).
"""

from __future__ import annotations

import re
from collections import Counter
from operator import eq
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, raw_bytes

PER_CLASS = 1500
SHAPES, WORDS = 2048, 4096
DIMS = SHAPES + WORDS
WORD_WEIGHT = 0.35
LATENT = 48
NEIGHBOURS = 25
SHARPNESS = 8.0
THRESHOLD = 0.7
_CLASSES = bytes(
    97 if c >= 128 or 97 <= c <= 122 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else 10 if c == 10 else 32 if c == 32 or 9 <= c <= 13 else c for c in range(256)
)
_RUNS = re.compile(rb"([^\s])\1+")


def terms(text: bytes | None) -> Counter:
    """Term -> count of one text."""
    text = text or b""
    shown = np.frombuffer(text.translate(_CLASSES), np.uint8)
    if len(shown):
        keep = np.ones(len(shown), bool)
        keep[1:] = shown[1:] != shown[:-1]  # runs collapse: "Thing!!" has the shape "Aa!"
        shown = shown[keep].tobytes()
    else:
        shown = b""
    shapes = shown.split()
    out = Counter(shapes)
    n = len(shapes)
    if n > 1:
        for (a, b), c in Counter(zip(shapes, shapes[1:])).items():
            out[a + b" " + b] = c
    words = text.lower().split()
    if n:
        again = sum(map(eq, words, words[1:]))
        out[b"\x00again"] = 4 * again
        rare = len(set(words)) / n ** 0.9
        out[b"\x00varied%d" % min(9, int(rare * 10))] = max(1, n // 4)
        lines = [x for x in text.split(b"\n") if len(x) > 12]
        out[b"\x00lines"] = (n * (len(lines) - len(set(lines)))) // max(1, len(lines))
    out[b"\x00any"] = max(1, n // 8)
    return +out


_SLOTS: dict[bytes, int] = {}


def _slot(term: bytes) -> int:
    if len(term) > 32:
        return crc32(term)
    got = _SLOTS.get(term)
    if got is None:
        if len(_SLOTS) > 200_000:
            _SLOTS.clear()
        got = _SLOTS[term] = crc32(term)
    return got


def _hashed(counts: Counter, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots and the square roots of their shares."""
    slots = np.fromiter(map(_slot, counts), np.int64, len(counts)) % size
    got = np.bincount(slots, np.fromiter(counts.values(), np.float64, len(counts)), size)
    at = np.flatnonzero(got)
    return at, np.sqrt(got[at] / got.sum())


def features(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """(slots, values) of a text: damped shares of its shapes and, in slots of their own, of its words."""
    at, values = _hashed(terms(text), SHAPES)
    words = Counter((text or b"").lower().split())
    if not words:
        return at, values
    more, shares = _hashed(words, WORDS)
    return np.concatenate([at, more + SHAPES]), np.concatenate([values, WORD_WEIGHT * shares])


def _vectors(batches):
    for batch in batches:
        got = [features(t) for t in raw_bytes(batch.column("text"))]
        slots = pa.array([at.astype(np.int32).tobytes() for at, _ in got], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("label"), slots, pa.array([v.tobytes() for _, v in got], pa.binary())], names=["label", "slots", "shares"])


def _leading(a: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """The k leading right singular vectors by subspace iteration: needs a few columns beside `a`, not its Gram matrix."""
    q = np.linalg.qr(np.random.default_rng(11).normal(size=(a.shape[1], min(k + 16, *a.shape))))[0]
    for _ in range(rounds):
        q = np.linalg.qr(a.T @ (a @ q.astype(a.dtype)).astype(a.dtype))[0]
    _, _, v = np.linalg.svd(np.asarray(a @ q.astype(a.dtype), np.float64), full_matrices=False)
    return (q.astype(np.float64) @ v.T)[:, :k]


class Model:
    """What is broadcast: weights, projection, labelled latent vectors and their labels."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, latent: int = LATENT, neighbours: int = NEIGHBOURS):
        """`rows`: (slots, values) of the labelled texts, `y` their labels."""
        self.prior = float(y.mean()) if len(y) else 0.5
        self.neighbours = neighbours
        self.ready = len(set(y.tolist())) == 2
        if not self.ready:
            return
        seen = np.bincount(np.concatenate([at for at, _ in rows]), minlength=DIMS)
        self.idf = np.log((1 + len(rows)) / (1 + seen)) + 1
        weighted = np.zeros((len(rows), DIMS), np.float32)
        for i, (at, values) in enumerate(rows):
            w = values * self.idf[at]
            weighted[i, at] = w / np.linalg.norm(w)
        self.basis = _leading(weighted, latent)
        del weighted
        order = np.argsort(y, kind="stable")
        self.y = y[order].astype(np.float64)
        self.latent = self.project([rows[i] for i in order])
        # classes of unequal size vote with equal weight
        self.vote = np.where(self.y == 1, 0.5 / self.y.mean(), 0.5 / (1 - self.y.mean()))

    def project(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Latent vectors of length one of (slots, values), each for itself."""
        z = np.zeros((len(rows), self.basis.shape[1]))
        for i, (at, values) in enumerate(rows):
            z[i] = (values * self.idf[at]) @ self.basis[at]
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)

    def scores(self, rows: list[tuple[np.ndarray, np.ndarray]], block: int = 256) -> np.ndarray:
        if not self.ready:
            return np.full(len(rows), self.prior)
        out = np.empty(len(rows))
        k = min(self.neighbours, len(self.y))
        for lo in range(0, len(rows), block):
            cos = np.round(self.project(rows[lo : lo + block]) @ self.latent.T, 9)
            last = np.partition(cos, cos.shape[1] - k, axis=1)[:, cos.shape[1] - k]
            for i, sim in enumerate(cos):
                near = np.flatnonzero(sim >= last[i])
                s = sim[near]
                tied = s == last[i]
                weight = np.exp(SHARPNESS * (s - s.max())) * np.maximum(s, 1e-6) * self.vote[near]
                weight[tied] *= (k - np.count_nonzero(~tied)) / np.count_nonzero(tied)
                out[lo + i] = weight @ self.y[near] / weight.sum()
        return np.clip(out, 0.0, 1.0)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = PER_CLASS) -> Model:
    """`labels(id, label)` of the rows that may be learned from."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.min(label_col).cast("int").alias("label"))
    pick = [known.where(F.col("label") == c).orderBy(F.xxhash64("_id"), "_id").limit(per_class) for c in (0, 1)]
    chosen = pick[0].unionAll(pick[1])  # at most 2 * per_class rows
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "_id")
    texts = texts.groupBy("_id", "label").agg(F.min("text").alias("text"))  # repeated ids count once
    got = map_batches(texts.select("label", "text"), _vectors, "label int, slots binary, shares binary").toArrow()
    rows = sorted(zip(*[got.column(c).to_pylist() for c in ("label", "slots", "shares")]))
    return Model([(np.frombuffer(at, np.int32), np.frombuffer(v)) for _, at, v in rows], np.array([y for y, *_ in rows], np.int64))


def _scorer(shared, text_col: str):
    def run(batches):
        model = shared.value
        for batch in batches:
            rows = [features(t) for t in raw_bytes(batch.column(text_col))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.scores(rows))], names=[*batch.schema.names, "score"])

    return run


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """`docs` with score double, how likely label 1 is; a column of that name is replaced."""
    docs = docs.drop("score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    ddl = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return map_batches(docs, _scorer(shared, text_col), f"{ddl}, score double")
