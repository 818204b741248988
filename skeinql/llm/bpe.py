"""Byte-level BPE encoding and decoding in padded numpy matrices.

A text is cut by the pattern; its distinct pieces are bucketed by byte length into padded matrices of ids. In each
round every row merges its leftmost pair of least rank, found by hashed pair lookup, and is compacted by one place;
rows without a pair leave the matrix. A piece of more than LONG bytes is a matrix of its own; there a round also merges
all later pairs of the same rank, which would come next anyway, so that rounds follow the vocabulary and not the length.

Every operator here takes a null text as empty, an empty text as one without ids, and texts of any length whole. Rows
that repeat, or that have a null doc_id, are rows of their own; a table without rows gives one. Only doc_id and text (or
ids) are read, so other columns may have any name. Two pairs of one rank: the left one is merged first.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from skeinql.llm.shared import release, slices

LONG = 256
#: Distinct pieces whose ids a task keeps; beyond that only those of the texts at hand.
CACHE = 150_000
#: Cells of a matrix.
CELLS = 1 << 20
NONE = np.int32(2**31 - 1)
_BUCKETS = (2, 4, 8, 16, 32, 64, 128, LONG)


def read_ranks(path: str) -> list[bytes]:
    """Tokens by rank, of a file with a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens: list[bytes] = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


class PairTable:
    """(left id, right id) -> rank of the joined token, open addressing with linear probes; NONE where there is none."""

    def __init__(self, tokens: list[bytes]):
        rank = {t: i for i, t in enumerate(tokens)}
        keys, values = [], []
        for t, r in rank.items():
            for cut in range(1, len(t)):
                a, b = rank.get(t[:cut]), rank.get(t[cut:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    values.append(r)
        size = 1 << max(4, (2 * len(keys)).bit_length())
        self.mask = np.uint64(size - 1)
        self.keys = np.full(size, -1, np.int64)
        self.values = np.full(size, NONE, np.int32)
        keys, values = np.array(keys, np.int64), np.array(values, np.int32)
        at = self._slot(keys)
        while len(keys):  # all that find a free slot take it, one key a slot; the others go on by one
            free = self.keys[at] < 0
            _, first = np.unique(at[free], return_index=True)
            take = np.flatnonzero(free)[first]
            self.keys[at[take]], self.values[at[take]] = keys[take], values[take]
            rest = np.ones(len(keys), bool)
            rest[take] = False
            keys, values, at = keys[rest], values[rest], (at[rest] + 1) & int(self.mask)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        x = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((x ^ (x >> np.uint64(29))) & self.mask).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.int64) << 32) | right
        at = self._slot(keys.ravel()).reshape(keys.shape)
        found = self.keys[at]
        out = self.values[at]
        open_ = (found != keys) & (found >= 0)
        out[found != keys] = NONE
        if open_.any():
            where = np.nonzero(open_)
            k, s = keys[where], at[where]
            got = np.full(len(k), NONE, np.int32)
            going = np.arange(len(k))
            while len(going):
                s[going] = (s[going] + 1) & int(self.mask)
                seen = self.keys[s[going]]
                hit = seen == k[going]
                got[going[hit]] = self.values[s[going[hit]]]
                going = going[(seen >= 0) & ~hit]
            out[where] = got
        return out


class Codec:
    """Encodes texts to ids and ids to bytes with the ranks of ``tokens``; no special tokens."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens, self.table, self.find = tokens, PairTable(tokens), regex.compile(pattern).findall
        rank = {t: i for i, t in enumerate(tokens)}
        self.single = np.array([rank[bytes([b])] for b in range(256)], np.int32)
        self.whole = rank
        self.ids: dict[str, tuple[int, ...]] = {}

    def encode_pieces(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        out: list[tuple[int, ...]] = [()] * len(pieces)
        order: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if (r := self.whole.get(p)) is not None:
                out[i] = (r,)
            elif len(p) > LONG:
                out[i] = self._row(p)
            else:
                order.setdefault(next(b for b in _BUCKETS if len(p) <= b), []).append(i)
        for width, rows in order.items():
            step = max(64, CELLS // width)
            for at in range(0, len(rows), step):
                self._matrix([pieces[i] for i in rows[at : at + step]], width, rows[at : at + step], out)
        return out

    def _matrix(self, pieces: list[bytes], width: int, rows: list[int], out: list) -> None:
        length = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ids = self.single[np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(len(pieces), width)]
        rows = np.array(rows)
        ranks = self.table.ranks(ids[:, :-1], ids[:, 1:])
        ranks[np.arange(width - 1)[None, :] >= length[:, None] - 1] = NONE
        while True:
            at = ranks.argmin(1)  # the leftmost of equal ones
            best = ranks[np.arange(len(at)), at]
            over = best == NONE
            if over.any():
                for r, i, n in zip(rows[over], ids[over], length[over], strict=True):
                    out[r] = tuple(i[:n].tolist())
                go = ~over
                rows, ids, ranks, length, at, best = rows[go], ids[go], ranks[go], length[go], at[go], best[go]
                if not len(rows):
                    return
            every = np.arange(len(rows))
            ids[every, at] = best
            if ids.shape[1] > 2:  # all right of the pair moves one place to the left, and ranks with it
                cols = np.arange(ids.shape[1] - 1)[None, :]
                ids = np.where(cols <= at[:, None], ids[:, :-1], ids[:, 1:])
                ranks = np.where(cols[:, :-1] < at[:, None], ranks[:, :-1], ranks[:, 1:])
            else:
                ids, ranks = ids[:, :1], np.full((len(rows), 1), NONE, np.int32)
            length -= 1
            if ids.shape[1] > 1:
                for side in (at - 1, at):  # the two pairs that hold the new token
                    ok = (side >= 0) & (side < length - 1)
                    w = every[ok]
                    ranks[w, side[ok]] = self.table.ranks(ids[w, side[ok]], ids[w, side[ok] + 1])
                ranks[every, np.minimum(length - 1, ranks.shape[1] - 1)] = np.where(length - 1 < ranks.shape[1], NONE, ranks[every, np.minimum(length - 1, ranks.shape[1] - 1)])

    def _row(self, piece: bytes) -> tuple[int, ...]:
        """The rounds of ``_matrix`` on one long row; a round merges the leftmost pair of least rank and the equal pairs that come next.

        Those are the equal pairs right of it, every second one where they overlap, as long as no merge makes a pair
        that does not rank behind them.
        """
        ids = self.single[np.frombuffer(piece, np.uint8)]
        ranks = self.table.ranks(ids[:-1], ids[1:])
        while len(ranks) and (best := ranks.min()) != NONE:
            at = np.flatnonzero(ranks == best)
            place = np.arange(len(at))
            start = np.maximum.accumulate(np.where(np.diff(at, prepend=-2) > 1, place, 0))
            at = at[(place - start) % 2 == 0]
            merged = np.full(len(at), best, np.int32)
            left = np.where(np.diff(at, prepend=-3) == 2, best, ids[at - 1])  # as a merge finds it, those left of it done
            early = (at > 0) & (self.table.ranks(left, merged) <= best)
            early |= (at + 2 < len(ids)) & (self.table.ranks(merged, ids[np.minimum(at + 2, len(ids) - 1)]) <= best)
            if early.any():
                at = at[: early.argmax() + 1]
            ids[at] = best
            ids, ranks = np.delete(ids, at + 1), np.delete(ranks, at)
            new = at - np.arange(len(at))
            for side in (new - 1, new):
                w = side[(side >= 0) & (side < len(ranks))]
                ranks[w] = self.table.ranks(ids[w], ids[w + 1])
        return tuple(ids.tolist())

    def encode(self, texts: list[str]) -> list[list[int]]:
        cut = [self.find(t) for t in texts]
        here = dict.fromkeys(p for pieces in cut for p in pieces)
        new = [p for p in here if p not in self.ids]
        if len(self.ids) + len(new) > CACHE:  # common pieces are in most groups of texts: what this one has stays
            self.ids = {p: self.ids[p] for p in here if p in self.ids}
        self.ids.update(zip(new, self.encode_pieces([p.encode() for p in new]), strict=True))
        get = self.ids.__getitem__
        return [[i for p in pieces for i in get(p)] for pieces in cut]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_codecs: dict = {}


def _codec(vocabulary) -> Codec:
    tokens, pattern, key = vocabulary.value
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(tokens, pattern)
    return _codecs[key]


#: Texts are encoded together up to so many characters, so that what a task holds does not follow the batch.
GROUP = 2_000_000


def _groups(texts: list[str]):
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size > GROUP:
            yield texts[at : i + 1]
            at, size = i + 1, 0
    if at < len(texts):
        yield texts[at:]


def vocabulary(spark: SparkSession, path: str, pattern: str):
    """The vocabulary at ``path`` of the driver as a broadcast variable; a rank file has a few MB at most."""
    tokens = read_ranks(path)
    return spark.sparkContext.broadcast((tokens, pattern, hashlib.sha256(pattern.encode() + b"\0".join(tokens)).hexdigest()))


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids array<int>) of each row of ``docs``; a null text is empty and has no ids. Any doc_id goes through."""
    vocab = vocabulary(docs.sparkSession, path, pattern)

    def run(batches):
        codec = _codec(vocab)
        for b in slices(batches):
            for part, texts in _parts(b):
                yield pa.RecordBatch.from_arrays([part, pa.array(codec.encode(texts), pa.list_(pa.int32()))], ["doc_id", "ids"])
        codec.ids = {}
        release()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, ids array<int>")


def _parts(b: pa.RecordBatch):
    texts, at = [x or "" for x in b.column(1).to_pylist()], 0
    for group in _groups(texts):
        yield b.column(0).slice(at, len(group)), group
        at += len(group)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, bytes binary) of rows (doc_id, ids); null ids are none."""
    vocab = vocabulary(encoded.sparkSession, path, pattern)

    def run(batches):
        codec = _codec(vocab)
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([codec.decode(i or []) for i in b.column(1).to_pylist()], pa.binary())], ["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {dict(encoded.dtypes)['doc_id']}, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row of ``docs``; see ``encode`` for nulls.

    Encodes, then decodes the ids, in one pass, so that the ids of a corpus are never moved.
    """
    vocab = vocabulary(docs.sparkSession, path, pattern)

    def run(batches):
        codec = _codec(vocab)
        names = [str(i) for i in range(len(codec.tokens))]
        sha = hashlib.sha256
        for b in slices(batches, 2048):
            for part, texts in _parts(b):
                n, a, d = [], [], []
                for ids in codec.encode(texts):
                    n.append(len(ids))
                    a.append(sha(" ".join(map(names.__getitem__, ids)).encode()).hexdigest())
                    d.append(sha(codec.decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays([part, pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        codec.ids = {}
        release()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string")
