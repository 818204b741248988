"""Similarity join on five-word shingles: every link with Jaccard >= 0.75, as classes of linked documents.

1. A pass over the texts makes a 128-bit digest of each document's shingle set (64-bit hashes), and counts shingles in a
   sketch of CELLS cells, which only orders them: common ones last. Equal sets are one representative from here on.
2. A second pass takes each set's first shingles in that order: so many that two sets that reach the threshold have one
   of them in common, whatever they are. Those that several representatives have make groups; equal groups are one.
3. Representatives of a group meet in size-banded tiles: a tile holds sizes of one band and of the next, as sizes
   further apart cannot reach the threshold. There, hashed bitmaps bound the overlap from above. What passes gives only
   a spanning forest of each tile, never its pairs.
4. The families that those forests tie together hold every link, as the bound never falls short. Each family is tiled
   in the same way; there the sorted hash arrays of pairs that pass the bound are intersected exactly.

Groups over TILE rows are not tiled as they are. Their rows first meet one pivot each, in pieces; those that pass are a
star, and two members of one star need not meet. Then the largest star's rows, in blocks, meet all other rows, and
these each other, also in blocks: no tile has more than about 2 * TILE rows, whatever the group. A group of g near copies
with r others so costs g + r * g / TILE rows, not g * g.

A null or empty text has no shingles and is linked with nothing. Texts of any length are read whole. Rows with one
doc_id are one document, linked with what any of their texts is linked with; rows without a doc_id stand alone. A table
without rows gives one. Only doc_id and text are read; other columns may have any name.
"""

from __future__ import annotations

import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skeinql.llm.graph import components
from skeinql.llm.shared import BROADCAST_ROWS, discard, fresh, release, shuffled, slices, small_or_shuffled, written

WIDTH, PERCENT = 5, 75
#: Cells of the sketch; a cell is common from COMMON times the mean count on, and from COMMON * FEW counts on.
CELLS, COMMON, FEW = 1 << 18, 4, 16
#: Rows of a tile, and shingles of its rows together, beyond which a group is hot; rounds of stars in a hot group.
TILE, TILE_SHINGLES, ROUNDS = 1024, 2_000_000, 4
CACHE = 150_000
_M = np.uint64


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _M(30))) * _M(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _M(27))) * _M(0x94D049BB133111EB)
    return x ^ (x >> _M(31))


def shingle_set(text: bytes | None, cache: dict, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles; a shorter text's whole sequence is one, no words give none."""
    words = (text or b"").lower().split()  # of bytes: only A-Z change, only ASCII white space splits
    h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    if not len(h):
        return h
    k = min(width, len(h))
    s = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        s = _mixed(s + h[i : len(h) - k + 1 + i])
    return np.unique(s)


def common_classes(counts: np.ndarray) -> np.ndarray:
    """Class of each cell: 0, or the more the commoner, doubling by doubling."""
    mean = max(counts.sum() / len(counts), FEW)
    return np.clip(np.log2(np.maximum(counts, 1) / mean).astype(np.int64) - int(np.log2(COMMON)) + 1, 0, 31).astype(np.uint8)


def prefix(s: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, int]:
    """The first shingles of a set in the common order (by class, then hash), and how many of them are of class 0.

    A link of sets of x <= y shingles has an overlap of 3/7 (x + y) at least, so of 3/4 y and of 6/7 x: one of the first
    y - ceil(3/4 y) + 1 of the larger is among the first x - ceil(6/7 x) + 1 of the smaller.
    """
    n = len(s)
    c = classes[(s & _M(len(classes) - 1)).astype(np.int64)]
    first = np.argsort((c.astype(np.uint64) << _M(58)) | (s >> _M(6)), kind="stable")[: n - (3 * n + 3) // 4 + 1]
    return s[first], int((c[first] == 0).sum())


def bitmap(s: np.ndarray, bits: int) -> np.ndarray:
    """``bits`` (a power of two) hashed bits; halves folded together are the bitmap of half the size."""
    b = np.zeros(bits, np.uint8)
    b[(s & _M(bits - 1)).astype(np.int64)] = 1
    return np.packbits(b, bitorder="little").view(np.uint64)


def bits_for(n: int) -> int:
    return max(256, 1 << int(4 * n - 1).bit_length())


def folded(b: np.ndarray, words: int) -> np.ndarray:
    while len(b) > words:
        b = b[: len(b) // 2] | b[len(b) // 2 :]
    return b


def band_of(n):
    """Size band of a Column: sizes whose ratio reaches the threshold lie in one band or in two neighbours."""
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(100.0 / PERCENT)) + F.lit(1e-9)).cast("int")


def passing(n: np.ndarray, bits: np.ndarray, size: np.ndarray, own: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """May a row and a column (places in the tile) reach the threshold? By an upper bound on their overlap.

    size: bits set. own: places in the tile's own size band; two of the next band meet in that band's own tile.
    """
    both = np.bitwise_count(bits[rows, None, :] & bits[None, columns, :]).sum(2, dtype=np.int64)
    x, y = n[rows, None], n[None, columns]
    most = np.minimum(x - (size[rows, None] - both), y - (size[None, columns] - both))
    return ((100 + PERCENT) * most >= PERCENT * (x + y)) & (own[rows, None] | own[None, columns])


def forest(n: np.ndarray, bits: np.ndarray, own: np.ndarray, confirm=None, star: np.ndarray | None = None, main: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a tile's pairs that pass, and that ``confirm(i, j)`` confirms.

    A search from place to place: each place meets only those that no tree has yet, so copies of one text cost few
    comparisons, and pairs within a tree none. Places of one ``star`` are in one tree from the start; with ``main``,
    only pairs of a main place and another one are of interest.
    """
    found, left, size = [], np.arange(len(n)), np.bitwise_count(bits).sum(1, dtype=np.int64)

    def with_stars(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of ``left``, the places ``new`` (a mask) with all of their stars, and the others."""
        if star is not None:
            new = np.isin(star[left], star[left[new]])
        return left[new], left[~new]

    while len(left):
        start = np.zeros(len(left), bool)
        start[0] = True
        front, left = with_stars(start)
        while len(front) and len(left):
            step = max(1, min(64, 1_000_000 // (len(left) * bits.shape[1])))
            rows, front = front[:step], front[step:]
            ok = passing(n, bits, size, own, rows, left)
            if main is not None:
                ok &= main[rows, None] ^ main[None, left]
            if confirm is not None:
                for c in np.flatnonzero(ok.any(0)):
                    true = next((r for r in np.flatnonzero(ok[:, c]) if confirm(rows[r], left[c])), None)
                    ok[:, c] = False
                    if true is not None:
                        ok[true, c] = True
            hit = ok.any(0)
            found += zip(rows[ok[:, hit].argmax(0)].tolist(), left[hit].tolist(), strict=True)
            new, left = with_stars(hit)
            front = np.concatenate([front, new])
    return found


_EDGES = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _edges(ids: np.ndarray, found: list[tuple[int, int]]) -> pa.Table:
    return pa.table([pa.array([int(ids[i]) for i, _ in found], pa.int64()), pa.array([int(ids[j]) for _, j in found], pa.int64())], schema=_EDGES)


class _Rows:
    """Rows of a tile by size: ids, sizes, bitmaps and, for exact tests, the sets."""

    def __init__(self, t: pa.Table):
        ids, n = t["doc_id"].to_numpy(), t["n"].to_numpy().astype(np.int64)
        order = np.lexsort((ids, n))
        self.t, self.order, self.ids, self.n = t, order, ids[order], n[order]
        self.own = self.flag("own")

    def flag(self, name: str) -> np.ndarray:
        return self.t[name].to_numpy(zero_copy_only=False).astype(bool)[self.order]

    def compare(self) -> tuple[np.ndarray, object]:
        """Bitmaps of one width, and the exact test if the rows hold their sets."""
        if "hashes" not in self.t.column_names:
            maps = [np.frombuffer(x, np.uint64) for x in self.t["bits"].to_pylist()]
            words = min(map(len, maps))
            return np.stack([folded(maps[i], words) for i in self.order]), None
        sets = self.t["hashes"].to_pylist()
        sets = [np.frombuffer(sets[i], np.uint64) for i in self.order]

        def linked(i: int, j: int) -> bool:
            x, y = sets[i], sets[j]
            at = np.searchsorted(y, x)
            at[at == len(y)] = 0
            common = int((y[at] == x).sum())
            return 100 * common >= PERCENT * (len(x) + len(y) - common)

        return np.stack([bitmap(s, bits_for(int(self.n[0]))) for s in sets]), linked


def _tile(t: pa.Table) -> pa.Table:
    """A spanning forest of the pairs of a tile that pass the bound and, if sets are there, are linked."""
    rows = _Rows(t)
    if len(rows.ids) < 2 or not rows.own.any():
        return _edges(rows.ids, [])
    bits, confirm = rows.compare()
    return _edges(rows.ids, forest(rows.n, bits, rows.own, confirm))


_STARS = pa.schema([("group", pa.int64()), ("doc_id", pa.int64()), ("star", pa.int64())])


def _star(t: pa.Table) -> pa.Table:
    """The rows of a piece that pass with its pivot, which is one of its rows."""
    rows = _Rows(t)
    pivot = np.flatnonzero(rows.flag("pivot"))
    if not len(pivot):
        return _STARS.empty_table()
    bits, confirm = rows.compare()
    others = np.flatnonzero(~rows.flag("pivot"))
    ok = passing(rows.n, bits, np.bitwise_count(bits).sum(1, dtype=np.int64), rows.own, pivot[:1], others)[0]
    hit = [i for i in others[ok] if confirm is None or confirm(pivot[0], i)]
    return pa.table([np.full(len(hit), t["group"][0].as_py(), np.int64), rows.ids[hit], np.full(len(hit), rows.ids[pivot[0]], np.int64)], schema=_STARS)


def _dealt(t: pa.Table) -> pa.Table:
    """As ``_tile``, of rows in stars; in a block of a main star, other rows meet its rows only."""
    rows = _Rows(t)
    if len(rows.ids) < 2 or not rows.own.any():
        return _edges(rows.ids, [])
    bits, confirm = rows.compare()
    main = rows.flag("main")
    return _edges(rows.ids, forest(rows.n, bits, rows.own, confirm, t["star"].to_numpy()[rows.order], main if main.any() else None))


def _banded(rows: DataFrame) -> DataFrame:
    """Each row in the tile of its own size band (``own``) and in that of the band below; ``low`` is the tile's band."""
    rows = rows.withColumn("band", band_of(F.col("n"))).withColumn("own", F.explode(F.array(F.lit(True), F.lit(False))))
    return rows.withColumn("low", F.when(F.col("own"), F.col("band")).otherwise(F.col("band") - 1)).drop("band")


def _parts(rows, work):
    return F.ceil(F.greatest(rows / TILE, work / TILE_SHINGLES)).cast("int")


def _linked(rows: DataFrame, key: str, sets: DataFrame, on: list[str]) -> DataFrame:
    """Edges (u, v) that tie together what passes within the groups of ``rows`` (key, doc_id, n, early).

    ``sets`` has the rows' bitmaps or hashes by ``on``. A group that none but late shingles share has no link.
    """
    rows = _banded(rows)
    sizes = rows.groupBy(key, "low").agg(F.count("*").alias("g"), F.count(F.when(F.col("own"), 1)).alias("mine"), F.count(F.when(F.col("early"), 1)).alias("heads"), F.sum("n").alias("work"))
    sizes = written(sizes.where("g > 1 and mine > 0 and heads > 0").select(key, "low", _parts(F.col("g"), F.col("work")).alias("parts")), "sizes")
    rows = rows.drop("early")
    hot, cold = sizes.where("parts > 1"), sizes.where("parts = 1").select(key, "low")
    some = hot.limit(BROADCAST_ROWS + 1).count()
    held = F.broadcast(hot) if some <= BROADCAST_ROWS else hot  # one row a hot group
    calm = rows.join(held.select(key, "low"), [key, "low"], "left_anti") if some else rows
    tiles = calm.join(shuffled(cold), [key, "low"], "left_semi").withColumn("tile", F.xxhash64(key, "low")).drop(key, "low")
    edges = tiles.join(sets, on).groupBy("tile").applyInArrow(_tile, "u long, v long")
    if not some:
        return edges
    rows = rows.join(held, [key, "low"]).withColumn("group", F.xxhash64(key, "low")).select("group", "doc_id", "n", "own", "parts")
    return edges.unionByName(_hot_edges(written(rows, "hot-rows"), sets, on))


def _hot_edges(rows: DataFrame, sets: DataFrame, on: list[str]) -> DataFrame:
    """``_linked`` for rows (group, doc_id, n, own, parts) of groups that are too large for a tile."""
    left, stars = rows, []
    for _ in range(ROUNDS):
        pivots = left.where("own").groupBy("group").agg(F.min_by(F.struct("doc_id", "n"), F.xxhash64("doc_id")).alias("p"), F.max("parts").alias("parts"))
        pivots = pivots.select("group", "p.*", F.lit(True).alias("own"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("piece"), F.lit(True).alias("pivot"))
        pieces = left.select("group", "doc_id", "n", "own", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.col("parts")).cast("int").alias("piece"), F.lit(False).alias("pivot"))
        found = pieces.unionByName(pivots).join(sets, on).groupBy("group", "piece").applyInArrow(_star, "group long, doc_id long, star long")
        stars.append(written(found.distinct(), "stars"))
        left = written(left.join(shuffled(stars[-1].select("group", "doc_id")), ["group", "doc_id"], "left_anti"), "left")
        if left.isEmpty():
            break
    stars = reduce(DataFrame.unionByName, stars)
    rows = rows.join(shuffled(stars.groupBy("group", "doc_id").agg(F.min("star").alias("star"))), ["group", "doc_id"], "left").withColumn("star", F.coalesce("star", "doc_id"))
    rows = written(rows, "starred")
    sizes = rows.groupBy("group", "star").agg(F.count("*").alias("a"), F.sum("n").alias("w"))
    sizes = sizes.groupBy("group").agg(F.max_by(F.struct("star", "a", "w"), F.struct("a", "star")).alias("m"), F.sum("a").alias("g"), F.sum("w").alias("work"))
    sizes = sizes.where("g > m.a").select("group", F.col("m.star").alias("main_star"), _parts(F.col("m.a"), F.col("m.w")).alias("blocks"), _parts(F.col("g") - F.col("m.a"), F.col("work") - F.col("m.w")).alias("salts"))
    rows = rows.drop("parts").join(small_or_shuffled(written(sizes, "main-stars")), "group").withColumn("main", F.col("star") == F.col("main_star"))
    salt = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.col("salts")).cast("int")
    block = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.col("blocks")).cast("int")

    def place(kind: int, a, b):
        return F.struct(F.lit(kind).alias("kind"), a.cast("int").alias("a"), b.cast("int").alias("b"))

    zero = F.lit(0)
    blocks, salts = F.sequence(zero, F.col("blocks") - 1), F.sequence(zero, F.col("salts") - 1)
    own = F.transform(salts, lambda j: place(0, block, j))
    others = F.concat(F.transform(blocks, lambda i: place(0, i, salt)), F.transform(salts, lambda j: place(1, F.least(salt, j), F.greatest(salt, j))))
    rows = rows.withColumn("place", F.explode(F.when(F.col("main"), own).otherwise(others))).drop("main_star", "blocks", "salts")
    met = rows.join(sets, on).groupBy("group", "place").applyInArrow(_dealt, "u long, v long")
    return met.unionByName(stars.where("doc_id <> star").select(F.col("doc_id").alias("u"), F.col("star").alias("v")))


def _digests(batches, width: int):
    """(doc_id, n, digest) of each row, and at the end a row of the task's sketch."""
    cache, counts, waiting, size = _WordHash(), np.zeros(CELLS, np.int64), [], 0
    names = ["doc_id", "n", "digest", "sketch"]

    def settle() -> None:
        if waiting:
            counts.__iadd__(np.bincount(np.concatenate(waiting), minlength=CELLS))
            waiting.clear()

    for b in slices(batches):
        n, digest = [], []
        for text in b.column(1).to_pylist():
            s = shingle_set(text, cache, width)
            n.append(len(s))
            digest.append(xxhash.xxh128_digest(s.tobytes()) if len(s) else None)
            waiting.append((s & _M(CELLS - 1)).astype(np.int64))
            size += len(s)
            if size > CELLS:
                settle()
                size = 0
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.nulls(len(n), pa.binary())], names)
    settle()
    (at,) = np.nonzero(counts)
    packed = zlib.compress(np.stack([at, counts[at]]).astype(np.int64).tobytes(), 1)
    yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([packed], pa.binary())], names)
    cache.clear()
    release()


def _cells(batches):
    for b in batches:
        for x in b.column(0).to_pylist():
            at, n = np.frombuffer(zlib.decompress(x), np.int64).reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n)], ["cell", "n"])


def shingle_classes(sketches: DataFrame) -> np.ndarray:
    """Class of each cell, over all documents: tasks' sketches are summed before they are fetched."""
    rows = sketches.mapInArrow(_cells, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # CELLS rows at most
    counts = np.zeros(CELLS, np.int64)
    counts[rows["cell"].to_numpy()] = rows["n"].to_numpy()
    return common_classes(counts)


def _prefixes(batches, width: int, classes: np.ndarray):
    cache = _WordHash()
    for b in slices(batches):
        out: tuple[list, ...] = ([], [], [], [], [])
        for text in b.column(1).to_pylist():
            s = shingle_set(text, cache, width)
            first, light = prefix(s, classes) if len(s) else (s, 0)
            row = len(s), xxhash.xxh128_digest(s.tobytes()) if len(s) else None, first.tobytes(), light, bitmap(s, bits_for(len(s))).tobytes() if len(s) else b""
            for column, x in zip(out, row, strict=True):
                column.append(x)
        types = pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.binary()
        yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, out, types)], ["doc_id", "n", "digest", "keys", "light", "bits"])
    cache.clear()
    release()


def _keyed(batches):
    """(key, doc_id) for each shingle of a prefix; the last two bits of a key: is it early enough for a smaller set; is it common."""
    for b in slices(batches):
        keys = b.column(2).to_pylist()
        count = np.fromiter((len(k) // 8 for k in keys), np.int64, len(keys))
        n, light = b.column(1).to_numpy(), b.column(3).to_numpy()
        place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        early = place < np.repeat(n - (6 * n + 6) // 7 + 1, count)
        key = np.frombuffer(b"".join(keys), np.int64) & -4 | 2 * early | (place >= np.repeat(light, count))
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.repeat(b.column(0).to_numpy(), count))], ["key", "doc_id"])


def _arrays(batches, width: int):
    cache = _WordHash()
    for b in slices(batches):
        sets = [shingle_set(x, cache, width) for x in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["doc_id", "n", "hashes"])
    cache.clear()
    release()


def jaccard_classes(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row for each row of ``docs`` (doc_id long, text string; others unread).

    n_shingles is 0 for a null or empty text; component_id is the least doc_id that links reach, null for rows without
    a doc_id.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    sets = written(texts.mapInArrow(lambda b: _digests(b, width), "doc_id long, n long, digest binary, sketch binary"), "sets")
    classes = docs.sparkSession.sparkContext.broadcast(shingle_classes(sets.where("sketch is not null").select("sketch")))  # CELLS bytes
    sets = sets.where("sketch is null").drop("sketch")
    valid = sets.where("doc_id is not null and n > 0")
    reps = written(valid.groupBy("digest").agg(F.min("doc_id").alias("doc_id")), "representatives")

    marked = texts.mapInArrow(lambda b: _prefixes(b, width, classes.value), "doc_id long, n long, digest binary, keys binary, light int, bits binary")
    marked = written(marked.join(shuffled(reps), ["digest", "doc_id"], "left_semi").select("doc_id", "n", "keys", "light", "bits"), "prefixes")
    keyed = marked.select("doc_id", "n", "keys", "light").mapInArrow(_keyed, "key long, doc_id long")
    # what the sketch calls common is shared, and may be by very many: only the others are gathered by shingle
    over, early = Window.partitionBy(F.expr("key & -4")), F.expr("key & 2 = 2").alias("early")
    rare = keyed.where("key & 1 = 0").repartition(F.expr("key & -4")).withColumn("g", F.count("*").over(over)).where("g > 1").withColumn("who", F.bit_xor(F.xxhash64("doc_id")).over(over))
    rare = rare.select(F.xxhash64("g", "who").alias("key"), "doc_id", early)  # groups of the same documents are one
    keyed = rare.unionByName(keyed.where("key & 1 = 1").select(F.xxhash64(F.expr("key & -4")).alias("key"), "doc_id", early))
    keyed = keyed.groupBy("key", "doc_id").agg(F.max("early").alias("early"))
    keyed = written(keyed.join(shuffled(marked.select("doc_id", "n")), "doc_id"), "groups")

    families = written(components(_linked(keyed, "key", marked.select("doc_id", "bits"), ["doc_id"])), "families")
    near = written(texts.join(shuffled(families.select(F.col("node").alias("doc_id"))), "doc_id", "left_semi").mapInArrow(lambda b: _arrays(b, width), "doc_id long, n long, hashes binary"), "arrays")
    members = families.select(F.col("node").alias("doc_id"), F.col("component").alias("family")).join(near.select("doc_id", "n").distinct(), "doc_id").withColumn("early", F.lit(True))
    exact = _linked(members, "family", near, ["doc_id", "n"])

    # an id with several texts ties their representatives; only such ids are looked up
    several = valid.groupBy("doc_id").agg(F.countDistinct("digest").alias("texts")).where("texts > 1").select("doc_id")
    twins = valid.join(shuffled(several), "doc_id", "left_semi").join(reps.select("digest", F.col("doc_id").alias("rep")), "digest").select("doc_id", "rep")
    several = twins.groupBy("doc_id").agg(F.min("rep").alias("v"))
    several = several.select("doc_id", "v").join(twins, "doc_id").select(F.col("rep").alias("u"), "v")
    linked = written(components(exact.unionByName(several)), "linked")
    discard(marked, keyed, near, families)

    of_rep = reps.select("digest", F.col("doc_id").alias("node")).join(linked, "node", "left").select("digest", F.coalesce("component", "node").alias("component_id"))
    # copies in any number share a digest: AQE splits what they make large; rows without one meet nobody
    out = sets.where("n > 0").join(of_rep, "digest", "left").select("doc_id", "n", "component_id")
    out = out.unionByName(sets.where("n = 0").select("doc_id", "n", F.lit(None).cast("long").alias("component_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near copies: of each class the document whose id is least, once; rows without an id stay."""
    classes = jaccard_classes(docs)
    (own,) = fresh(docs, "kept")
    kept = written(classes.where("doc_id = component_id").groupBy(F.col("doc_id").alias(own)).agg(F.count("*").alias("copies")), "kept")
    out = docs.join(shuffled(kept.select(own)), docs["doc_id"] == F.col(own), "left_semi")
    out = out.dropDuplicates(["doc_id"]) if kept.where("copies > 1").limit(1).count() else out
    return out.unionByName(docs.where(F.col("doc_id").isNull()))


SQL = """
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(x, y) AS (SELECT x, y FROM both_ways UNION SELECT reach.x, b.y FROM reach JOIN both_ways b ON reach.y = b.x),
least_of AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(sizes.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(least_of.y, d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes ON sizes.doc_id = d.doc_id LEFT JOIN least_of ON least_of.x = d.doc_id
"""
