"""Approximate nearest neighbours by cosine, with score-aware (anisotropic) product quantisation.

Vectors of length one are cut into pairs of components, each coded in four bits. Codes and codebooks minimise
``|r|^2 + (eta - 1) <r, x>^2`` of the residual r: error along the vector, which changes the scores of the queries that
matter, costs eta times what error across it does. Blocks of codes are scanned with a table of 16 products for each
pair and query; the best of each scan are scored exactly on the original vectors.

The index is fitted to a bounded sample and holds every vector. Equal vectors are one entry with its least ids, so
that copies in any number cost nothing; entries and queries are dealt in blocks of bounded size. Vectors that form
clusters can be put in coarse cells, of which a query scans only the nearest; by default there is one cell, as vectors
without clusters lose a tenth of their neighbours even if half of all cells are scanned.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skeinql.llm.shared import written

#: Vectors that codebooks and cells are fitted to.
TRAINING_ROWS = 20_000
#: Dot product from which on queries matter, for the weight eta.
THRESHOLD = 0.2
CODES = 16
#: Entries and queries of a block; entries of a block's scan that are scored exactly at first. The scan's error on these
#: then tells which others may belong among the nearest; all of them are scored too.
BLOCK, QUERIES, RERANKED = 8192, 8192, 160


class Index:
    def __init__(self, sample: np.ndarray, cells: int):
        x = _unit(sample)
        self.dim = x.shape[1]
        self.eta = max(1.0, (self.dim - 1) * THRESHOLD**2 / (1 - THRESHOLD**2))
        self.cells = _kmeans(x, cells, 10, True)
        self.books = [_kmeans(p, CODES, 6, False) for p in _pairs(x)]
        for _ in range(4):
            codes = self.encode(x)
            self._fit(x, codes)

    def _fit(self, x: np.ndarray, codes: np.ndarray) -> None:
        parts = _pairs(x)
        along = np.stack([(b[codes[:, m]] * p).sum(1) for m, (b, p) in enumerate(zip(self.books, parts, strict=True))], 1)
        for m, p in enumerate(parts):
            left = 1 - (along.sum(1) - along[:, m])
            for k in range(len(self.books[m])):
                own = codes[:, m] == k
                if own.any():
                    q = p[own]
                    a = own.sum() * np.eye(q.shape[1]) + (self.eta - 1) * q.T @ q
                    self.books[m][k] = np.linalg.solve(a, (q * (1 + (self.eta - 1) * left[own, None])).sum(0))
            along[:, m] = (self.books[m][codes[:, m]] * p).sum(1)

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Codes (rows x pairs, uint8) of unit vectors, by two sweeps of coordinate descent on the anisotropic loss."""
        parts = _pairs(x)
        far = [((p[:, None, :] - b[None]) ** 2).sum(2) for p, b in zip(parts, self.books, strict=True)]
        dot = [p @ b.T for p, b in zip(parts, self.books, strict=True)]
        codes = np.stack([f.argmin(1) for f in far], 1).astype(np.uint8)
        rows = np.arange(len(x))
        along = np.stack([d[rows, codes[:, m]] for m, d in enumerate(dot)], 1)
        total = along.sum(1)
        for _ in range(2):
            for m in range(len(parts)):
                left = 1 - (total - along[:, m])
                codes[:, m] = (far[m] + (self.eta - 1) * (left[:, None] - dot[m]) ** 2).argmin(1)
                new = dot[m][rows, codes[:, m]]
                total += new - along[:, m]
                along[:, m] = new
        return codes

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Products (queries x pairs x CODES) of unit queries with all codewords."""
        out = np.zeros((len(q), len(self.books), CODES), np.float32)
        for m, (p, b) in enumerate(zip(_pairs(q), self.books, strict=True)):
            out[:, m, : len(b)] = p @ b.T
        return out

    def byte_tables(self, q: np.ndarray) -> np.ndarray:
        """Tables of two pairs each, by the byte that holds both codes."""
        t = self.tables(q)
        if t.shape[1] % 2:
            t = np.concatenate([t, np.zeros((len(t), 1, CODES), np.float32)], 1)
        byte = np.arange(256)
        return t[:, ::2, byte & 15] + t[:, 1::2, byte >> 4]


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _pairs(x: np.ndarray) -> list[np.ndarray]:
    return [x[:, i : i + 2] for i in range(0, x.shape[1], 2)]


def _kmeans(x: np.ndarray, k: int, rounds: int, unit: bool) -> np.ndarray:
    k = max(1, min(k, len(x)))
    c = x[np.random.default_rng(3).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        own = (x @ c.T - (0 if unit else 0.5 * (c * c).sum(1))).argmax(1)
        n = np.bincount(own, minlength=k)
        new = np.stack([np.bincount(own, x[:, j], k) for j in range(x.shape[1])], 1)
        c = np.where(n[:, None] > 0, new / np.maximum(n, 1)[:, None], c)
        if unit:
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def _packed(codes: np.ndarray) -> np.ndarray:
    if codes.shape[1] % 2:
        codes = np.c_[codes, np.zeros(len(codes), np.uint8)]
    return codes[:, ::2] | codes[:, 1::2] << 4


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _taking_part(vectors: DataFrame) -> DataFrame:
    """(vec_id, e): rows with an id and a finite vector other than zero, as it is: floats, or doubles."""
    exact = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"
    odd = F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(exact).alias("e"))
    return rows.where("vec_id is not null and e is not null").where(~odd & F.exists("e", lambda x: x != 0))


def _uid():
    """128 bits of a vector: two hashes of it with different seeds."""
    return F.concat(F.hex(F.xxhash64("e")), F.hex(F.xxhash64(F.lit(1), "e")))


def search(vectors: DataFrame, every: int = 50, k: int = 5, cells: int = 1, probes: int = 1) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose vec_id ``every`` divides, its k nearest other rows.

    Rows that are null, zero or not finite take no part, nor do those without an id. Vectors of several dimensions are
    as many tables: a query's neighbours are of its own dimension, of any length. Rows that repeat are one; an id with
    several vectors is a query and a candidate with each, never its own neighbour. Ties go to the smaller id. An empty
    table gives an empty result. Only vec_id and embedding are read; other columns may have any name. ``cells`` and
    ``probes``: coarse cells, and how many of them a query scans.
    """
    rows = written(_taking_part(vectors), "vectors")
    out = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sizes = sorted(r[0] for r in rows.select(F.size("e")).distinct().collect())  # one row a dimension
    parts = [_searched(rows.where(F.size("e") == d) if len(sizes) > 1 else rows, every, k, cells, probes) for d in sizes]
    return reduce(DataFrame.unionByName, parts) if parts else out


def _searched(rows: DataFrame, every: int, k: int, cells: int, probes: int) -> DataFrame:
    """``search`` among vectors of one dimension."""
    spark = rows.sparkSession
    queries = rows.where(F.col("vec_id") % every == 0).select("vec_id", _uid().alias("uid"))
    least = Window.partitionBy("e").orderBy("vec_id")
    entries = rows.withColumn("r", F.dense_rank().over(least)).where(F.col("r") <= k + 1).groupBy("e").agg(F.sort_array(F.collect_set("vec_id")).alias("ids"))
    entries = written(entries.select(_uid().alias("uid"), "ids", "e"), "entries")
    n, kind = entries.count(), dict(entries.dtypes)["e"]

    part = F.pmod(F.xxhash64("uid", F.lit(5)), F.lit(1 << 30))
    sample = _matrix(entries.where(part < int((1 << 30) * min(1.0, TRAINING_ROWS / n))).orderBy("uid").select("e").limit(2 * TRAINING_ROWS).toArrow()["e"]) if n > 1 else _matrix(entries.select("e").toArrow()["e"])
    index = spark.sparkContext.broadcast(Index(sample, cells))
    probes = min(probes, len(index.value.cells))

    def coded(batches):
        for b in batches:
            if b.num_rows:
                x = _unit(_matrix(b.column(2)))
                cell = (x @ index.value.cells.T).argmax(1)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(cell.astype(np.int32)), pa.array([r.tobytes() for r in _packed(index.value.encode(x))], pa.binary())], ["uid", "ids", "e", "cell", "codes"])

    def probed(batches):
        for b in batches:
            if b.num_rows:
                near = _unit(_matrix(b.column(1))) @ index.value.cells.T
                best = np.argpartition(-near, probes - 1, axis=1)[:, :probes]
                at = pa.array(np.repeat(np.arange(b.num_rows), probes))
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(best.ravel().astype(np.int32))], ["uid", "e", "cell"])

    entries = written(entries.mapInArrow(coded, f"uid string, ids array<long>, e {kind}, cell int, codes binary"), "codes")
    asked = entries.join(queries.select("uid").distinct(), "uid", "left_semi").select("uid", "e")
    asked = written(asked.mapInArrow(probed, f"uid string, e {kind}, cell int"), "probes")
    size = max(BLOCK, min(8 * BLOCK, n // 64))  # each block gives k + 1 rows a query: larger ones where there are many
    sizes = entries.groupBy("cell").count().select("cell", F.ceil(F.col("count") / size).cast("int").alias("vb"))
    sizes = sizes.join(asked.groupBy("cell").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("qb")), "cell")
    sizes = F.broadcast(sizes)  # one row a cell

    def block(by: str):
        return F.pmod(F.xxhash64("uid", F.lit(13)), F.col(by)).cast("int")

    left = entries.join(sizes, "cell").withColumn("i", block("vb")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("qb") - 1)))
    right = asked.join(sizes, "cell").withColumn("j", block("qb")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("vb") - 1)))
    tiles = left.select("cell", "i", "j", "uid", "e", "ids", "codes").unionByName(right.select("cell", "i", "j", "uid", "e"), allowMissingColumns=True)

    def scanned(t: pa.Table) -> pa.Table:
        is_query = t["codes"].is_null().to_numpy(zero_copy_only=False)
        entry, query = t.filter(pa.array(~is_query)), t.filter(pa.array(is_query))
        out: tuple[list, list, list] = ([], [], [])
        if len(entry) and len(query):
            v, q = _matrix(entry["e"]).astype(np.float64), _matrix(query["e"]).astype(np.float64)
            nv, nq = np.linalg.norm(v, axis=1), np.linalg.norm(q, axis=1)
            codes = np.ascontiguousarray(np.frombuffer(b"".join(entry["codes"].to_pylist()), np.uint8).reshape(len(v), -1).T)
            quids, ids = query["uid"].to_pylist(), entry["ids"].to_pylist()
            first = np.array([i[0] for i in ids])
            for at in range(0, len(q), 64):
                tables = index.value.byte_tables(q[at : at + 64] / nq[at : at + 64, None])
                scan = np.zeros((len(tables), len(v)), np.float32)
                for m, two in enumerate(codes):
                    scan += np.take(tables[:, m], two, axis=1)
                top = min(RERANKED, len(v))
                best = np.argpartition(-scan, top - 1, axis=1)[:, :top] if top < len(v) else np.tile(np.arange(len(v)), (len(scan), 1))
                for r in range(len(scan)):

                    def exact(c: np.ndarray, u: np.ndarray = q[at + r], size: float = nq[at + r]) -> np.ndarray:
                        return (v[c] * u).sum(1) / (nv[c] * size)

                    c = best[r]
                    score = exact(c)
                    if len(c) < len(v):  # entries that the scan puts so near the cut that its error may decide
                        wrong = np.abs(score - scan[r][c])
                        more = scan[r] >= np.sort(score)[-(k + 1)] - wrong.max() - wrong.std()
                        more[c] = False
                        more = np.flatnonzero(more)
                        c, score = np.concatenate([c, more]), np.concatenate([score, exact(more)])
                    for i in np.lexsort((first[c], -score))[: k + 1]:
                        out[0].append(quids[at + r])
                        out[1].append(ids[c[i]])
                        out[2].append(float(score[i]))
        return pa.table([pa.array(out[0], pa.string()), pa.array(out[1], pa.list_(pa.int64())), pa.array(out[2], pa.float64())], names=["uid", "ids", "score"])

    found = tiles.groupBy("cell", "i", "j").applyInArrow(scanned, "uid string, ids array<long>, score double")
    order = Window.partitionBy("uid").orderBy(F.desc("score"), F.col("ids")[0])
    found = found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).drop("r")
    pairs = queries.distinct().join(found, "uid").select(F.col("vec_id").alias("query_id"), "uid", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    pairs = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
