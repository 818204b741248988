"""Language identification by nearest centroid.

A text is a vector of hashed 1- to 3-grams of its letters (case folded, anything else a border), TF-IDF weighted and
normalised; document frequencies are counted over all documents outside the held-out fold. Each language has several
centroids, by spherical k-means over a bounded sample; a text goes to the language of the nearest one by cosine, of
equally near ones to that which comes first by name. It is rejected if that cosine is far below what the sample's own
texts of about its length reach.

A null text, an empty one, or one without a letter is ``und`` with score 0 and rejected. Texts of any length are read
whole, in slices. Rows that repeat, or that have a null doc_id, are judged alike, each as a row. A table without rows, or
without a language to learn from, rejects all that it has. Only doc_id, text and, to learn, lang are read; other columns
may have any name, and ``accepted`` passes them on.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinql.llm.shared import bounded_sample, release, remainder, slices

BITS = 13
DIMENSIONS = 1 << BITS
#: Documents that the model is fitted to, all languages together; each has an equal quota.
TRAINING_ROWS = 2000
CENTROIDS, ROUNDS = 4, 8
#: A text is rejected below this part of the least cosine of sample texts of its length.
REJECT = 0.5
#: Sample texts that a length band needs to have a limit.
SUPPORT = 20
_ROWS, _CHARS = 64, 1_000_000


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def _counts(texts: list[str]) -> np.ndarray:
    """Gram counts (texts x DIMENSIONS) of a few texts."""
    low = [t.lower() for t in texts]
    codes = np.frombuffer(("\0" + "\0".join(low) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(low) + 1, dtype=np.int32), [1] + [len(t) + 1 for t in low]) - 1
    is_letter = _letters()[codes]
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # one border for each run of others
    keep[0] = True
    c, row, is_letter = np.where(is_letter, codes, 0)[keep].astype(np.uint32), row[keep].astype(np.int64), is_letter[keep]
    out = np.zeros(len(low) * DIMENSIONS, np.int64)
    shift = np.uint32(32 - BITS)

    def add(h: np.ndarray, rows: np.ndarray, ok: np.ndarray) -> None:
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        out.__iadd__(np.bincount((rows * DIMENSIONS + (h >> shift))[ok], minlength=len(out)))

    a = c * np.uint32(0x9E3779B1)
    add(a + np.uint32(1), row, is_letter)
    b = a[:-1] ^ (c[1:] * np.uint32(0x85EBCA77))
    add(b + np.uint32(2), np.where(is_letter[:-1], row[:-1], row[1:]), is_letter[:-1] | is_letter[1:])
    if len(c) > 2:
        add((b[:-1] * np.uint32(0xC2B2AE3D)) ^ (c[2:] * np.uint32(0x27D4EB2F)), row[1:-1], is_letter[1:-1])
    return out.reshape(len(low), DIMENSIONS)


def gram_counts(text: str) -> np.ndarray:
    """Counts of one text of any length, slice by slice; grams over a slice's border are counted too."""
    if len(text) <= _CHARS:
        return _counts([text])[0]
    total = np.zeros(DIMENSIONS, np.int64)
    for at in range(0, len(text), _CHARS):
        total += _counts([text[max(0, at - 2) : at + _CHARS]])[0]
        if at:
            total -= _counts([text[max(0, at - 2) : at]])[0]
    return np.maximum(total, 0)


def _grouped(texts: list[str]):
    """Counts of all texts, a few texts at a time."""
    at = size = 0
    for i, t in enumerate(texts):
        if i > at and (i - at >= _ROWS or size + len(t) > _CHARS):
            yield _counts(texts[at:i])
            at, size = i, 0
        if len(t) > _CHARS:
            yield gram_counts(t)[None]
            at, size = i + 1, 0
        else:
            size += len(t)
    if at < len(texts):
        yield _counts(texts[at:])


def _vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts.astype(np.float32)) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def _clusters(v: np.ndarray, k: int) -> np.ndarray:
    """Up to ``k`` unit centroids: farthest-first start, then spherical k-means."""
    chosen = [v.mean(0) / max(1e-12, np.linalg.norm(v.mean(0)))]
    near = v @ chosen[0]
    while len(chosen) < min(k, len(v)):
        chosen.append(v[near.argmin()])
        near = np.maximum(near, v @ chosen[-1])
    c = np.stack(chosen)
    for _ in range(ROUNDS):
        own = (v @ c.T).argmax(1)
        means = [v[own == j].sum(0) for j in range(len(c)) if (own == j).any()]
        c = np.stack([m / max(1e-12, np.linalg.norm(m)) for m in means])
    return c


def _bands(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(counts.sum(1), 1)).astype(int), 31)


class Model:
    """``frequencies``: documents that hold each gram and documents in all; by default those of ``counts``."""

    def __init__(self, counts: np.ndarray, langs: list[str], frequencies: tuple[np.ndarray, int] | None = None):
        df, n = frequencies or ((counts > 0).sum(0), len(counts))
        self.idf = np.log((1 + n) / (1 + df)).astype(np.float32) + np.float32(0.1)
        v, names = _vectors(counts, self.idf), np.array(langs, dtype=object)
        self.langs, parts = [], []
        for name in sorted(set(langs)):
            c = _clusters(v[names == name], CENTROIDS)
            parts.append(c)
            self.langs += [name] * len(c)
        self.centroids = np.concatenate(parts) if parts else np.zeros((0, DIMENSIONS), np.float32)
        # least cosine by length band, from bands with enough sample texts; it never falls with length, and is 0 below
        self.floor = np.zeros(32, np.float32)
        if parts:
            best, band = (v @ self.centroids.T).max(1), _bands(counts)
            least = [float(best[band == b].min()) if (band == b).sum() >= SUPPORT else None for b in range(32)]
            known = [b for b in range(32) if least[b] is not None]
            for b in range(32):
                if known and b >= known[0]:
                    self.floor[b] = REJECT * min(least[k] for k in known if k >= min(b, known[-1]))

    def predict(self, counts: np.ndarray) -> list[tuple[str, float, bool]]:
        if not self.langs:
            return [("und", 0.0, True)] * len(counts)
        cos = _vectors(counts, self.idf) @ self.centroids.T
        best = cos.argmax(1)
        score, any_letter = np.clip(cos[np.arange(len(best)), best], 0, 1), counts.sum(1) > 0
        out = score < self.floor[_bands(counts)]
        return [(self.langs[b], float(s), bool(r)) if a else ("und", 0.0, True) for b, s, r, a in zip(best, score, out, any_letter, strict=True)]


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Rows of ``texts`` (text) that hold each gram, and rows in all; tasks' counts are summed before they are fetched."""

    def run(batches):
        held, n = np.zeros(DIMENSIONS + 1, np.int64), 0
        for b in slices(batches):
            for g in _grouped([x or "" for x in b.column(0).to_pylist()]):
                held[:-1] += (g > 0).sum(0)
            n += b.num_rows
        held[-1] = n
        (at,) = np.nonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(held[at])], ["cell", "n"])

    out = np.zeros(DIMENSIONS + 1, np.int64)
    for cell, n in texts.select("text").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n")).collect():  # DIMENSIONS + 1 rows at most
        out[cell] = n
    return out[:-1], int(out[-1])


def fit(docs: DataFrame, bound: int = TRAINING_ROWS) -> Model:
    """The model: frequencies from all of ``docs`` outside the held-out fold, centroids from (text, lang) of about ``bound`` of them."""
    learnt = docs.where(F.col("text").isNotNull() & (remainder("doc_id", 4) != 2))
    rows = learnt.where(F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    sample = bounded_sample(rows, "lang", bound).select("text", "lang")

    def sparse(batches):
        for b in slices(batches):
            at, n = [], []
            for g in _grouped(b.column(0).to_pylist()):
                for c in g:
                    (i,) = np.nonzero(c)
                    at.append(i.astype(np.uint16).tobytes())
                    n.append(c[i].astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(at, pa.binary()), pa.array(n, pa.binary())], ["lang", "at", "n"])

    got = sample.mapInArrow(sparse, "lang string, at binary, n binary").collect()
    got.sort(key=lambda r: (r["lang"], bytes(r["at"]), bytes(r["n"])))  # as fetched, the order may vary
    counts = np.zeros((len(got), DIMENSIONS), np.int32)
    for i, r in enumerate(got):
        counts[i, np.frombuffer(r["at"], np.uint16)] = np.frombuffer(r["n"], np.uint32)
    return Model(counts, [r["lang"] for r in got], document_frequencies(learnt) if got else None)


def predicted(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) of each row of ``docs`` (doc_id, text, lang are read, lang to learn only).

    A null text, or one without a letter, is ``und`` with score 0 and rejected; so is every text if no row has a
    language to learn from.
    """
    model = model or fit(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in slices(batches):
            found = [r for g in _grouped([x or "" for x in b.column(2).to_pylist()]) for r in m.predict(g)]
            lang, score, out = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(out, pa.bool_())], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    held = (remainder("doc_id", 4) == 2).alias("held_out")
    return docs.select("doc_id", held, "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text the model does not reject, all columns as they are."""
    model = fit(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in slices(batches):
            texts = [x or "" for x in b.column(b.schema.get_field_index("text")).to_pylist()]
            keep = [not r[2] for g in _grouped(texts) for r in shared.value.predict(g)]
            yield b.filter(pa.array(keep, pa.bool_()))
        release()

    return docs.mapInArrow(run, docs.schema)
