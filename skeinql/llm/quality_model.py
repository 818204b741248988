"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network with calibrated output.

Every token has a sparse random index vector; a token's context vector sums the index vectors of its neighbours in all
documents. Tokens are hashed to VOCABULARY places; words in capitals share one place, as numbers do. A document is the
mean and the spread of its tokens' vectors, with a few shape measures. The network is fitted in numpy on a bounded sample
of labelled rows; a temperature, fitted on sample rows that the network has not seen, calibrates its probabilities.

A null text is empty; empty texts are scored as any other. Texts of any length are read whole. Documents that repeat, or
that have a null doc_id, are scored alike, each as a row; a score at the threshold counts as over it. Without labels of
both kinds every score is their share. A table without rows gives one. Only doc_id and text (and of labels doc_id and the
label) are read; other columns may have any name.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinql.llm.shared import labelled, remainder, slices

VOCABULARY, WIDTH, NONZERO, REACH = 1 << 15, 48, 4, 2
HIDDEN, EPOCHS, RATE, DECAY = 24, 60, 5e-3, 1e-4
#: Labelled documents that the model is fitted to, half of each label.
TRAINING_ROWS = 4000
THRESHOLD = 0.3
CACHE = 300_000
_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
_CAPITALS, _NUMBER, _RESERVED = 0, 1, 2


class _Places(dict):
    def __missing__(self, token: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        if token.isdigit():
            place = _NUMBER
        elif len(token) > 1 and token.isupper():
            place = _CAPITALS
        else:
            place = _RESERVED + zlib.crc32(token.lower().encode("utf-8", "surrogatepass")) % (VOCABULARY - _RESERVED)
        self[token] = place
        return place


def _ids(text: str, places: dict) -> np.ndarray:
    tokens = _TOKEN.findall(text)
    return np.fromiter(map(places.__getitem__, tokens), np.int32, len(tokens))


def index_vectors() -> np.ndarray:
    r = np.random.default_rng(77)
    out = np.zeros((VOCABULARY, WIDTH), np.float32)
    at = r.integers(0, WIDTH, (VOCABULARY, NONZERO))
    out[np.arange(VOCABULARY)[:, None], at] = r.choice([-1.0, 1.0], (VOCABULARY, NONZERO))
    return out


@lru_cache(1)
def _sparse_index() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the index vectors' NONZERO largest components; a sign of 0 where a vector has fewer."""
    index = index_vectors()
    at = np.argsort(-np.abs(index), axis=1, kind="stable")[:, :NONZERO]
    return at, np.take_along_axis(index, at, 1)


class Contexts:
    """Sums of neighbours' index vectors by place, whole numbers, so that their order never shows."""

    def __init__(self):
        self.sums, self.waiting, self.size = np.zeros(VOCABULARY * WIDTH, np.int64), [], 0

    def add(self, ids: np.ndarray) -> None:
        for at in range(0, len(ids), 1_000_000):  # with REACH tokens of what follows
            part = ids[at : at + 1_000_000 + REACH]
            self.waiting.append((part, min(len(part), 1_000_000)))
            self.size += len(part)
            if self.size >= 1_000_000:
                self.settle()

    def settle(self) -> None:
        where, signs = _sparse_index()
        lefts, rights = [], []
        for part, heads in self.waiting:
            for k in range(1, REACH + 1):
                n = min(heads, len(part) - k)
                if n > 0:
                    lefts.append(part[:n])
                    rights.append(part[k : k + n])
        self.waiting, self.size = [], 0
        if not lefts:
            return
        a, b = np.concatenate(lefts).astype(np.int64), np.concatenate(rights).astype(np.int64)
        for x, y in ((a, b), (b, a)):
            for j in range(NONZERO):
                self.sums += np.bincount(x * WIDTH + where[y, j], signs[y, j], VOCABULARY * WIDTH).astype(np.int64)

    def vectors(self) -> np.ndarray:
        """Unit vectors by place: the index vector plus the normalised context."""
        self.settle()
        context = self.sums.reshape(VOCABULARY, WIDTH).astype(np.float32)
        context /= np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1e-9)
        out = context + index_vectors() / np.sqrt(NONZERO)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def word_vectors(texts: list[np.ndarray]) -> np.ndarray:
    c = Contexts()
    for ids in texts:
        c.add(ids)
    return c.vectors()


#: Pieces that a task's context sums travel in.
PIECES = 64


def corpus_vectors(docs: DataFrame) -> np.ndarray:
    """Word vectors from the texts of all rows of ``docs``; tasks' sums are added up before they are fetched."""

    def run(batches):
        places, c = _Places(), Contexts()
        for b in slices(batches):
            for x in b.column(0).to_pylist():
                c.add(_ids(x or "", places))
        c.settle()
        rows = [p.astype(np.int64) for p in c.sums.reshape(PIECES, -1)]
        some = [i for i, p in enumerate(rows) if p.any()]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([rows[i].tobytes() for i in some], pa.binary())], ["piece", "sums"])

    def added(batches):
        total = np.zeros((PIECES, VOCABULARY * WIDTH // PIECES), np.int64)
        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total[i] += np.frombuffer(x, np.int64)
        some = np.flatnonzero(total.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([total[i].tobytes() for i in some], pa.binary())], ["piece", "sums"])

    schema = "piece int, sums binary"
    c = Contexts()
    out = c.sums.reshape(PIECES, -1)
    for piece, sums in docs.select("text").mapInArrow(run, schema).repartition(PIECES, "piece").mapInArrow(added, schema).collect():  # PIECES rows
        out[piece] += np.frombuffer(bytes(sums), np.int64)
    return c.vectors()


def pooled(ids: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean, spread and shape of a document's vectors; zeros for a document without tokens."""
    out = np.zeros(2 * WIDTH + 5, np.float32)
    n = len(ids)
    if not n:
        return out
    total, square = np.zeros(WIDTH, np.float64), np.zeros(WIDTH, np.float64)
    for at in range(0, n, 16_384):
        v = vectors[ids[at : at + 16_384]]
        total += v.sum(0)
        square += np.einsum("ij,ij->j", v, v)
    mean = total / n
    out[:WIDTH] = mean
    out[WIDTH : 2 * WIDTH] = np.sqrt(np.maximum(square / n - mean * mean, 0))
    out[2 * WIDTH :] = np.log1p(n) / 10, np.linalg.norm(mean), (ids == _CAPITALS).mean(), (ids == _NUMBER).mean(), (ids[1:] == ids[:-1]).mean() if n > 1 else 0
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


class Model:
    """Vectors and network; ``score`` gives the calibrated probability of label 1."""

    def __init__(self, texts: list[np.ndarray], labels: np.ndarray, share: float, vectors: np.ndarray | None = None):
        self.vectors = word_vectors(texts) if vectors is None else vectors
        y = labels.astype(np.float64)
        self.prior = min(max(share, 0.01), 0.99)
        if not len(y) or y.min() == y.max():
            self.layers = None
            return
        x = np.stack([pooled(t, self.vectors) for t in texts]).astype(np.float64)
        self.mean, self.spread = x.mean(0), np.maximum(x.std(0), 1e-3)
        x = np.clip((x - self.mean) / self.spread, -5, 5)
        part = np.arange(len(y)) % 5 == 0
        # rows weigh as their label does among all labelled rows, so that scores are probabilities there
        w = np.where(y == 1, self.prior / y.mean(), (1 - self.prior) / (1 - y.mean()))
        self._fit(x[~part], y[~part], w[~part])
        self.temperature = self._calibrate(self._logit(x[part]), y[part], w[part]) if part.sum() > 20 else 1.0

    def _fit(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> None:
        r = np.random.default_rng(5)
        p = [r.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), r.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.array(0.0)]
        m, s, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        for _ in range(EPOCHS):
            order = r.permutation(len(y))
            for at in range(0, len(y), 128):
                i = order[at : at + 128]
                h = np.tanh(x[i] @ p[0] + p[1])
                d = w[i] * (_sigmoid(h @ p[2] + p[3]) - y[i]) / len(i)
                back = np.outer(d, p[2]) * (1 - h * h)
                grad = [x[i].T @ back + DECAY * p[0], back.sum(0), h.T @ d + DECAY * p[2], d.sum()]
                step += 1
                for j, g in enumerate(grad):
                    m[j] = 0.9 * m[j] + 0.1 * g
                    s[j] = 0.999 * s[j] + 0.001 * g * g
                    p[j] = p[j] - RATE * (m[j] / (1 - 0.9**step)) / (np.sqrt(s[j] / (1 - 0.999**step)) + 1e-8)
        self.layers = p

    def _logit(self, x: np.ndarray) -> np.ndarray:
        p = self.layers
        return np.tanh(x @ p[0] + p[1]) @ p[2] + p[3]

    @staticmethod
    def _calibrate(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
        def loss(t: float) -> float:
            q = np.clip(_sigmoid(z / t), 1e-9, 1 - 1e-9)
            return float(-(w * (y * np.log(q) + (1 - y) * np.log(1 - q))).sum())

        return float(min(np.geomspace(0.5, 8, 60), key=loss))

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        if self.layers is None or not texts:
            return np.full(len(texts), self.prior)
        x = np.stack([pooled(t, self.vectors) for t in texts]).astype(np.float64)
        return _sigmoid(self._logit(np.clip((x - self.mean) / self.spread, -5, 5)) / self.temperature)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", bound: int = TRAINING_ROWS) -> Model:
    """The model: word vectors from all of ``docs``, the network from about ``bound`` labelled rows outside the held-out fold."""

    def tokens(batches):
        places = _Places()
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array([_ids(x or "", places).astype(np.uint16).tobytes() for x in b.column(0).to_pylist()], pa.binary()), b.column(1)], ["ids", "label"])

    share = labels.where((remainder("doc_id", 5) != 0) & F.col(label).isNotNull()).agg(F.avg(F.col(label).cast("double"))).first()[0]
    got = [(bytes(r["ids"]), r["label"]) for r in labelled(docs, labels, label, bound).mapInArrow(tokens, "ids binary, label int").collect()]
    got.sort(key=lambda r: (zlib.crc32(r[0]), r))  # an order of its own, whatever order rows came in
    return Model([np.frombuffer(i, np.uint16).astype(np.int32) for i, _ in got], np.array([y for _, y in got]), 0.5 if share is None else share, corpus_vectors(docs) if got else None)


def scored(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of ``docs`` (doc_id and text are read).

    A null text is empty; empty texts are scored as any other. Without labels of both kinds the score is their share.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        places = _Places()
        for b in slices(batches):
            s = shared.value.score([_ids(x or "", places) for x in b.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    held = (remainder("doc_id", 5) == 0).alias("held_out")
    return docs.select("doc_id", held, "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, score double, predicted int")
