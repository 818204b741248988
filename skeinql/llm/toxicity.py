"""Toxicity scores by noisy-channel deobfuscation.

Tokens that may be disguised (letters mixed with look-alike signs, letters repeated three times or more, letters set
apart by signs or spaces) are lattices of characters: a sign is itself or a letter that it looks like, a repeated
letter or a separator may be dropped. Viterbi decoding finds the likeliest letters under a character trigram model.
Restored words, and their first letters, are scored by shrunken log odds learned from labelled documents; a logistic
function of a document's highest word scores is its score.

A null text is empty; an empty text has no words and scores as such. Texts of any length are read whole. Documents that
repeat, or that have a null doc_id, are scored alike, each as a row; of tied words any gives the same score. Without
labels of both kinds every score is their share. A table without rows gives one. Only doc_id and text (and of labels
doc_id and the label) are read; other columns may have any name.
"""

from __future__ import annotations

import heapq
import math
import string
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinql.llm.quality_model import _sigmoid
from skeinql.llm.shared import labelled, remainder, slices, written

FEATURES, PREFIX, TOP = 1 << 18, 5, 3
#: Labelled documents that the model is fitted to, half of each label; tasks that they are dealt to.
TRAINING_ROWS, PARTS = 8000, 8
THRESHOLD = 0.5
#: Pseudo-counts that pull a word's odds to the prior.
SHRINK = 4.0
CACHE = 300_000
_LETTERS = string.ascii_lowercase + "".join(c for c in map(chr, range(0xDF, 0x100)) if c.isalpha()) + "œ"
_AT = {c: i + 2 for i, c in enumerate(_LETTERS)}
#: Symbols of the character model: 0 border, 1 other, then letters.
SYMBOLS = len(_LETTERS) + 2
LOOKALIKES = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
_COST_LOOK, _COST_DROP, _COST_REPEAT, _COST_KEEP, _COST_BORDER = 1.0, 0.5, 0.5, 0.5, 1.0
_STRIP = string.punctuation.replace("@", "").replace("$", "").replace("!", "") + "«»“”„‘’…–—"
_SEPARATORS = set(" .-_*~'·,")


def _triples(words, counts: np.ndarray) -> None:
    """Adds the trigrams of (word, times) pairs."""
    for w, n in words:
        a = b = 0
        for c in w:
            s = _AT.get(c, 1)
            counts[a, b, s] += n
            a, b = b, s
        counts[a, b, 0] += n


class CharacterModel:
    """Costs (negative log) of a symbol after two others: trigrams, interpolated with bigrams and single symbols."""

    def __init__(self, counts: np.ndarray):
        c = counts.astype(np.float64)
        one = c.sum((0, 1)) + 0.5
        one /= one.sum()
        two = c.sum(0)
        two = (two + 20 * one) / (two.sum(1, keepdims=True) + 20)
        three = (c + 5 * two[None]) / (c.sum(2, keepdims=True) + 5)
        self.cost = (-np.log(three)).astype(np.float32)

    def decode(self, token: str) -> str:
        """The likeliest letters behind ``token`` (lower case); a space in it may be a border of words.

        All states are kept: as many as pairs of letters that the last signs may stand for, which no length of the
        token increases beyond the pairs of symbols.
        """
        cost = self.cost
        states: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
        before = ""
        for i, c in enumerate(token):
            if c in _AT:
                options = [(0.0, _AT[c], c)]
            else:
                options = [(_COST_LOOK, _AT[x], x) for x in LOOKALIKES.get(c, "")] + [(_COST_KEEP, 1, c)]
            drop = _COST_DROP if c in _SEPARATORS else _COST_REPEAT if c == before and (token[i - 2 : i] == c * 2 or token[i + 1 : i + 2] == c) else None
            new: dict[tuple[int, int], tuple[float, tuple]] = {}
            for (a, b), (total, path) in states.items():
                for extra, s, x in options:
                    t = total + extra + float(cost[a, b, s])
                    if (b, s) not in new or t < new[b, s][0]:
                        new[b, s] = (t, (path, x))
                if drop is not None and ((a, b) not in new or total + drop < new[a, b][0]):
                    new[a, b] = (total + drop, path)
                if c == " " and path and ((0, 0) not in new or total + _COST_BORDER + float(cost[a, b, 0]) < new[0, 0][0]):
                    new[0, 0] = (total + _COST_BORDER + float(cost[a, b, 0]), (path, " "))
            states, before = new, c
        _, path = min(((t + float(cost[a, b, 0]), p) for (a, b), (t, p) in states.items()), key=lambda e: e[0])
        out = []
        while path:
            path, x = path
            out.append(x)
        return "".join(reversed(out))


def disguised(token: str) -> bool:
    """May ``token`` (stripped, lower case, not letters alone) hide a word? It has two letters, or signs that look like letters and a letter."""
    letters = sum(c in _AT for c in token)
    return letters >= 1 and letters + sum(c in LOOKALIKES for c in token) >= 3 and all(c in _AT or c in LOOKALIKES or c in _SEPARATORS for c in token)


def _stretched(word: str) -> bool:
    return any(a == b == c for a, b, c in zip(word, word[1:], word[2:], strict=False))


def readings(token: str, model: CharacterModel) -> tuple[str, ...]:
    """The words that a token without white space stands for: as it is, and as restored."""
    word = token.strip(_STRIP)
    if word.isalpha() and not _stretched(word):
        return (word,)
    plain = token.strip(string.punctuation + _STRIP)
    words = (plain,) if plain else ()
    if word and (_stretched(word) and word.isalpha() or disguised(word)):
        for w in dict.fromkeys((word, word.rstrip("!$@"))):
            if w:
                words += tuple(model.decode(w).split())
    return tuple(dict.fromkeys(words))


def _features(word: str) -> tuple[int, ...]:
    f = (zlib.crc32(word.encode("utf-8", "surrogatepass")) % FEATURES,)
    return f if len(word) <= PREFIX else (*f, zlib.crc32(b"^" + word[:PREFIX].encode("utf-8", "surrogatepass")) % FEATURES)


class _Cached(dict):
    """token -> value of its readings, kept for CACHE tokens."""

    def __init__(self, model: CharacterModel, value):
        self.model, self.value = model, value

    def __missing__(self, token: str):
        if len(self) >= CACHE:
            self.clear()
        self[token] = out = self.value([f for w in readings(token, self.model) for f in _features(w)])
        return out


def tokens(text: str) -> set[str]:
    """Distinct tokens of a text in lower case; runs of three or more single characters are a token as well, joined by spaces."""
    parts = text.lower().split()
    out = set(parts)
    ones = [i for i, t in enumerate(parts) if len(t) == 1]
    at = 0
    while at < len(ones):
        end = at
        while end + 1 < len(ones) and ones[end + 1] == ones[end] + 1:
            end += 1
        if end - at >= 2:
            out.add(" ".join(parts[ones[at] : ones[end] + 1]))
        at = end + 1
    return out


def _weights(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    p = (n_toxic + 1) / (n_toxic + n_clean + 2)
    return (np.log((toxic + SHRINK * p) / (clean + SHRINK * (1 - p))) - math.log(p / (1 - p))).astype(np.float32)


def _best(text: str, cached: dict) -> list[float]:
    """The TOP highest word weights, and the log of how many words there were."""
    words = tokens(text)
    top = heapq.nlargest(TOP, map(cached.__getitem__, words))
    return [*top, *[0.0] * (TOP - len(top)), math.log1p(len(words)) / 10]


def _highest(weights: np.ndarray):
    return lambda f: max((float(weights[i]) for i in f), default=0.0)


class Model:
    def __init__(self, letters: CharacterModel, weights: np.ndarray, logit: np.ndarray):
        self.letters, self.weights, self.logit = letters, weights, logit

    def score(self, texts: list[str], cached: dict) -> np.ndarray:
        x = np.array([_best(t, cached) for t in texts]).reshape(len(texts), TOP + 1)
        return _sigmoid(x @ self.logit[:-1] + self.logit[-1])

    def cached(self) -> dict:
        return _Cached(self.letters, _highest(self.weights))


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weights and intercept by Newton steps with a small ridge."""
    x = np.c_[x, np.ones(len(x))]
    b = np.zeros(x.shape[1])
    ridge = np.diag([*[0.05] * (x.shape[1] - 1), 1e-6])
    for _ in range(40):
        p = _sigmoid(x @ b)
        h = (x * (w * p * (1 - p))[:, None]).T @ x + ridge
        step = np.linalg.solve(h, x.T @ (w * (y - p)) - ridge @ b)
        b += np.clip(step, -2, 2)
    return b


def _arrays(df: DataFrame, make) -> list[list[np.ndarray]]:
    """One list of arrays from each task of ``df`` (text, label): ``make`` gets its (text, label) pairs. PARTS tasks at most."""

    def run(batches):
        rows = (r for b in slices(batches) for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        got = [np.ascontiguousarray(a) for a in make(rows)]
        yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in got] + [pa.array([a.dtype.str]) for a in got], [*(f"a{i}" for i in range(len(got))), *(f"t{i}" for i in range(len(got)))])

    k = make.arrays
    rows = df.mapInArrow(run, ", ".join([*(f"a{i} binary" for i in range(k)), *(f"t{i} string" for i in range(k))])).collect()
    return [[np.frombuffer(bytes(r[i]), r[k + i]) for i in range(k)] for r in rows]


def letter_counts(docs: DataFrame) -> np.ndarray:
    """Trigram counts of the plain words of all rows of ``docs`` (text is read), each word once a text.

    A task keeps one table and the tokens that it has not yet counted; tables are summed before they reach the driver.
    """

    def run(batches):
        counts, seen = np.zeros((SYMBOLS,) * 3, np.int64), Counter()

        def settle() -> None:
            _triples(((w, n) for t, n in seen.items() if (w := t.strip(_STRIP)).isalpha() and not _stretched(w)), counts)
            seen.clear()

        for b in slices(batches):
            for text in b.column(0).to_pylist():
                seen.update(tokens(text or ""))
                if len(seen) >= CACHE:
                    settle()
        settle()
        (at,) = np.nonzero(counts.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts.ravel()[at])], ["cell", "n"])

    out = np.zeros(SYMBOLS**3, np.int64)
    for cell, n in docs.select("text").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n")).collect():
        out[cell] = n
    return out.reshape((SYMBOLS,) * 3)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", bound: int = TRAINING_ROWS) -> Model:
    """The model: letters from all of ``docs`` in one pass, words from about ``bound`` labelled rows outside the held-out fold in two."""
    share = labels.where((remainder("doc_id", 5) != 0) & F.col(label).isNotNull()).agg(F.avg(F.col(label).cast("double"))).first()[0]
    sample = labelled(docs, labels, label, bound).select(F.coalesce("text", F.lit("")).alias("text"), "label")
    sample = written(sample.repartition(PARTS, F.xxhash64("text")), "toxicity-sample").coalesce(PARTS)

    letters = CharacterModel(letter_counts(docs))
    shared = docs.sparkSession.sparkContext.broadcast(letters)

    def half(text: str) -> int:
        return zlib.crc32(text.encode("utf-8", "surrogatepass")) & 1

    def counted(rows):
        counts, n = np.zeros((2, 2, FEATURES), np.int32), np.zeros((2, 2), np.int64)
        cached = _Cached(shared.value, tuple)
        for text, y in rows:
            f = list({i for t in tokens(text) for i in cached[t]})
            counts[half(text), y, f] += 1
            n[half(text), y] += 1
        return [counts.ravel(), n.ravel()]

    counted.arrays = 2
    got = _arrays(sample, counted)
    counts = sum((a for a, _ in got), np.zeros(4 * FEATURES, np.int64)).reshape(2, 2, FEATURES)
    n = sum((a for _, a in got), np.zeros(4, np.int64)).reshape(2, 2)
    prior = min(max(share or 0.0, 1e-3), 1 - 1e-3)
    if not n.sum(0).all():
        return Model(letters, np.zeros(FEATURES, np.float32), np.array([*[0.0] * (TOP + 1), math.log(prior / (1 - prior))]))

    halves = docs.sparkSession.sparkContext.broadcast([_weights(counts[h, 1], counts[h, 0], n[h, 1], n[h, 0]) for h in (0, 1)])

    def crossed(rows):  # each half is scored with what the other half taught
        cached = [_Cached(shared.value, _highest(w)) for w in halves.value]
        out = [[*_best(text, cached[1 - half(text)]), y] for text, y in rows]
        return [np.array(out, np.float64).ravel()]

    crossed.arrays = 1
    x = np.concatenate([a for (a,) in _arrays(sample, crossed)]).reshape(-1, TOP + 2)
    x = x[np.lexsort(x.T)]
    y = x[:, -1]
    w = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean()))
    both = counts.sum(0)
    return Model(letters, _weights(both[1], both[0], n[:, 1].sum(), n[:, 0].sum()), _logistic(x[:, :-1], y, w))


def scored(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of ``docs`` (doc_id and text are read).

    A null text is empty; an empty text has no words and scores as such. Without labels of both kinds every score is
    their share.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        cached = model.cached()
        for b in slices(batches):
            s = model.score([x or "" for x in b.column(2).to_pylist()], cached)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    held = (remainder("doc_id", 5) == 0).alias("held_out")
    return docs.select("doc_id", held, "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, score double, predicted int")
