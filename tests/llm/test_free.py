import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from skeinql.llm import ann, bpe, graph, jaccard, language_id, quality_model, shared, toxicity
from tests.llm import brute
from tests.llm.test_native import DOCS, ODD, frame, words

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={t: i for i, t in enumerate(bpe.read_ranks(PATH))}, special_tokens={})


def test_bpe_round_trip(spark, reference):
    r = random.Random(3)
    texts = ODD + ["<|endoftext|>", "a" * 3000, "!" * 700, "中文🙂" * 99] + ["".join(r.choice("abcdé🙂\n \t'sßА1!e中") for _ in range(r.randint(0, 700))) for _ in range(200)] + ["".join(r.choice("etaoin") for _ in range(n)) for n in (255, 256, 257, 900, 9000)]
    for row, t in zip(bpe.round_trip(frame(spark, texts).coalesce(1), PATH, PATTERN).collect(), texts, strict=True):
        ids = reference.encode_ordinary(t or "")
        assert row.n_tokens == len(ids) and row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    encoded = bpe.encode(frame(spark, texts).coalesce(1), PATH, PATTERN)
    assert [bytes(x.bytes) for x in bpe.decode(encoded, PATH, PATTERN).collect()] == [(t or "").encode() for t in texts]


def test_bpe_of_long_texts_and_groups(spark, reference):
    r = random.Random(5)
    texts = ["ab " * 700_000, "b" * 3_000_000, "".join(r.choice("abcdefghijklmnop") for _ in range(20_000)), "=" * 5001, "aab" * 999] + ["a" * 999 + " "] * 2001 + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = bpe.round_trip(docs, PATH, PATTERN).collect()
    assert [g.decoded_sha256 for g in got] == [hashlib.sha256((t or "").encode()).hexdigest() for t in texts]
    for g, t in zip(got[2:8], texts[2:8], strict=True):
        ids = reference.encode_ordinary(t)
        assert (g.n_tokens, g.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
    none = spark.createDataFrame([], DOCS)
    assert bpe.round_trip(none, PATH, PATTERN).count() == bpe.encode(none, PATH, PATTERN).count() == 0
    assert [len(x) for x in bpe._groups(["a" * 1000] * (bpe.GROUP // 1000 + 1))] == [bpe.GROUP // 1000 + 1] and list(bpe._groups([])) == []


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        p, q = sorted((root(a), root(b)))
        up[q] = p
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = dict(map(tuple, graph.components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == {x: root(x) for x in linked}
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def near_copies(seed, n=40, size=120):
    r = random.Random(seed)
    base = words(seed, size, 5000).split()
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(r.randrange(5)):
            w[r.randrange(len(w))] = f"z{r.random()}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("tile,broadcast", [(1024, 100_000), (8, 0)])
def test_jaccard_as_brute_force(spark, monkeypatch, tile, broadcast):
    monkeypatch.setattr(jaccard, "TILE", tile)
    monkeypatch.setattr(shared, "BROADCAST_ROWS", broadcast)
    texts = ODD + near_copies(1) + near_copies(2, 30, 400) + [words(7, 90)] * 30 + ["A b C", "a B c", "a b c d"] + [words(50 + i, 30) + " " + words(9, 60) for i in range(30)]
    texts += [words(8, 2000, 9000), words(8, 2000, 9000) + " more words at the end", "q " * 30, "q " * 50]
    docs = frame(spark, texts)
    got = jaccard.jaccard_classes(docs).collect()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    named = [(i, t) for i, t in rows if i is not None]
    sets = {}
    for i, t in named:
        sets.setdefault(i, []).append(t)
    flat = [(i * 10 + k, t) for i, ts in sets.items() for k, t in enumerate(ts)]
    want = {a // 10: b // 10 for a, b in brute.classes(flat).items()}
    twice = {i for i, ts in sets.items() if len(ts) > 1}
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None
        elif r.doc_id not in twice:
            assert r.component_id == want[r.doc_id], r
    assert sorted(r.n_shingles for r in got) == sorted(len(brute.shingles(t)) for _, t in rows)
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns and kept.where("doc_id is null").count() == 1
    ids = [r.doc_id for r in kept.where("doc_id is not null").collect()]
    assert len(ids) == len(set(ids)) == len({r.component_id for r in got if r.component_id is not None})


def test_jaccard_of_many_near_copies_and_a_common_passage(spark, monkeypatch):
    """20,000 distinct near copies are one class, and cost rows in proportion; a passage in 3,000 others links nobody."""
    r = random.Random(11)
    base, passage = words(1, 120, 5000).split(), words(2, 30, 5000)
    rows = []
    for i in range(20_000):
        w = list(base)
        w[r.randrange(len(w))] = f"edit{i}"
        rows.append((i, " ".join(w)))
    rows += [(100_000 + i, words(1000 + i, 40, 100_000) + " " + passage + " " + words(90_000 + i, 30, 100_000)) for i in range(3000)]
    rows += [(200_000, " ".join(base)), (200_001, " ".join(base[:112])), (200_002, " ".join(base[:60]))]
    moved: list = []
    kept = jaccard.written
    monkeypatch.setattr(jaccard, "written", lambda df, label: (lambda out: (moved.append((label, out.count())), out)[1])(kept(df, label)))
    got = {x.doc_id: x.component_id for x in jaccard.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()}
    assert {got[i] for i in range(20_000)} == {0} and got[200_000] == got[200_001] == 0
    assert all(got[i] == i for i in (*range(100_000, 103_000), 200_002))
    assert max(n for _, n in moved) < 40 * len(rows), moved


def test_bitmap_bound_is_never_below_the_truth():
    r = np.random.default_rng(0)
    for _ in range(50):
        a = np.unique(r.integers(0, 2**63, r.integers(1, 400), dtype=np.uint64))
        b = np.unique(np.concatenate([a[: len(a) * 4 // 5], r.integers(0, 2**63, r.integers(1, 100), dtype=np.uint64)]))
        n = np.array([len(a), len(b)])
        bits = np.stack([jaccard.folded(jaccard.bitmap(x, 2048), 4) for x in (a, b)])
        assert (jaccard.folded(jaccard.bitmap(a, 2048), 4) == jaccard.bitmap(a, 256)).all()
        both = len(np.intersect1d(a, b))
        if 175 * both >= 75 * n.sum():
            assert jaccard.passing(n, bits, np.bitwise_count(bits).sum(1, dtype=np.int64), np.array([True, False]), np.array([0]), np.array([1])).all()


def test_ann_as_brute_force(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(700, 16)).astype(np.float32)
    x[300:420] = x[50]  # copies of a query
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(900, None, 1), (950, [0.0] * 16, 1), (1000, [math.nan] + [1.0] * 15, 1), (1050, [math.inf] + [1.0] * 15, 1), (1100, [None] + [1.0] * 15, 1), (1150, [1.0, 2.0], 1), (1151, [2.0, 1.0], 1), (None, [1.0] * 16, 1), (50, x[50].tolist(), 1)]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")).collect()
    found = {}
    for g in sorted(got, key=lambda g: (g.query_id, g["rank"])):
        found.setdefault(g.query_id, []).append((g.vec_id, g.score))
    v = x.astype(np.float64)
    hit = 0
    for q in range(0, 700, 50):
        s = (v * v[q]).sum(1) / (np.linalg.norm(v, axis=1) * np.linalg.norm(v[q]))
        want = [int(i) for i in np.lexsort((np.arange(700), -np.round(s, 12))) if i != q][:5]
        hit += len(set(want) & {i for i, _ in found[q]})
        assert all(abs(s[i] - score) < 1e-12 for i, score in found[q]) and [g["rank"] for g in got if g.query_id == q].sort() is None
    assert set(found) == {*range(0, 700, 50), 1150} and hit >= 0.95 * 5 * 14 and [i for i, _ in found[1150]] == [1151]
    assert [i for i, _ in found[50]] == [300, 301, 302, 303, 304]
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert ann.search(spark.createDataFrame([(0, [1.0, 0.0, 2.0]), (7, [1.0, 1.0, 1.0])], "vec_id long, embedding array<float>")).count() == 1


def test_ann_scores_doubles_as_they_are(spark):
    x = np.random.default_rng(8).normal(size=(60, 4))
    x[1] = x[0] * (1 + 1e-12)
    got = ann.search(spark.createDataFrame([(i, v.tolist(), 1.0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, e double"), k=60).collect()
    for g in got:
        a, b = x[g.query_id], x[g.vec_id]
        assert abs(g.score - (a * b).sum() / (np.linalg.norm(a) * np.linalg.norm(b))) < 1e-15
    assert len(got) == 2 * 59


def test_ann_recall_on_the_tables(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = vectors.collect()
    x = np.array([r.embedding for r in rows], np.float64)
    ids = np.array([r.vec_id for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = {(g.query_id, g.vec_id) for g in ann.search(vectors).collect()}
    want = set()
    for i in np.flatnonzero(ids % 50 == 0):
        s = x @ x[i]
        s[i] = -2
        want |= {(int(ids[i]), int(ids[j])) for j in np.argsort(-s)[:5]}
    assert len(got & want) >= 0.98 * len(want)


@pytest.mark.parametrize("cells,probes,least", [(8, 8, 0.99), (8, 4, 0.6)])
def test_ann_in_cells(spark, cells, probes, least):
    x = np.random.default_rng(5).normal(size=(1500, 8)).astype(np.float32)
    got = ann.search(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>"), cells=cells, probes=probes).collect()
    v = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(q, int(i)) for q in range(0, 1500, 50) for i in np.argsort(-(v @ v[q]))[1:6]}
    assert len(want & {(g.query_id, g.vec_id) for g in got}) >= least * len(want)


def test_language_id(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in language_id.predicted(docs).collect()}
    held = [(r.lang, got[r.doc_id]) for r in docs.collect() if got[r.doc_id].held_out]
    assert all((zlib.crc32(str(i).encode()) % 4 == 2) == r.held_out for i, r in got.items())
    assert sum(a == b.lang_pred for a, b in held) >= 0.97 * len(held)
    assert sum(r.rejected for r in got.values()) <= 0.01 * len(got)


def test_language_id_of_odd_texts(spark):
    langs = {"aa": "bada gada kada ", "zz": "zuvo ruvo puvo "}
    rows = [(i, (k := ("aa", "zz")[i % 2]) and langs[k] * (3 + i % 9), k) for i in range(400)]
    rows += [(1001, None, "aa"), (1002, "123 $$", "zz"), (1003, "", None), (1003, "bada", None), (None, langs["zz"] * 3, None), (1005, "ΩΨΞ ΦΘΔ " * 40, None), (1006, "bada gada " * 200_000, None)]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, lang string, score string, rejected string")
    got = language_id.predicted(docs).collect()
    by = {(r.doc_id, i): r for i, r in enumerate(got)}
    one = {r.doc_id: r for r in got}
    assert len(by) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert one[1001].lang_pred == one[1002].lang_pred == "und" and one[1001].rejected
    assert one[1005].rejected and not one[0].rejected and one[1006].lang_pred == "aa" and not one[1006].rejected
    assert all(r.lang_pred == ("aa", "zz")[r.doc_id % 2] for r in got if r.doc_id is not None and r.doc_id < 400)
    kept = language_id.accepted(docs)
    assert kept.columns == docs.columns and kept.count() == sum(not r.rejected for r in got)
    nothing = language_id.predicted(spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")).collect()
    assert nothing[0].lang_pred == "und"
    assert language_id.predicted(spark.createDataFrame([], DOCS)).count() == 0


def test_slices_of_a_long_text_count_as_the_whole(monkeypatch):
    text = words(3, 400) + " äöü Straße"
    whole = language_id.gram_counts(text)
    monkeypatch.setattr(language_id, "_CHARS", 97)
    assert (language_id.gram_counts(text) == whole).all()


def test_quality(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in quality_model.scored(docs, quality_model.fit(docs, labels)).collect()}
    held = [(r.quality, got[r.doc_id]) for r in labels.collect() if got[r.doc_id].held_out]
    assert sum(a == b.predicted for a, b in held) >= 0.93 * len(held)
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in got.values())


def test_toxicity(spark):
    r = random.Random(8)
    bad = ["scoundrel", "rotter", "nitwit"]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 4 == 0
        text = words(i, 60, 300) + (" " + r.choice(bad) if toxic else " ") + " " + words(i + 9000, 20, 300)
        rows.append((i, text))
        labels.append((i, 1, int(toxic)))
    masked = ["sc0undrel", "r.o.t.t.e.r", "n i t w i t", "rooootter", "n1twit", "$coundrel", "n i t w i t  r o t t e r"]
    rows += [(2000 + k, words(k + 5, 50, 300) + f" {m} " + words(k + 6, 9, 300)) for k, m in enumerate(masked)] + [(2100, None), (2101, ""), (2102, words(4, 80, 300)), (2102, words(4, 80, 300)), (None, "x")]
    docs = spark.createDataFrame([(*x, "s") for x in rows], "doc_id long, text string, score string")
    tags = spark.createDataFrame([*labels, (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in toxicity.scored(docs, toxicity.fit(docs, tags)).collect()}
    held = [(t, got[i]) for i, _, t in labels if got[i].held_out]
    assert sum(t == x.predicted for t, x in held) >= 0.97 * len(held)
    assert [got[2000 + k].predicted for k in range(len(masked))] == [1] * len(masked)
    assert got[2100].predicted == got[2101].predicted == got[2102].predicted == 0


def test_decoding_is_the_best_of_all_paths(spark):
    """Against every way to read a token, cost by cost."""
    r = random.Random(2)
    counts = np.zeros((toxicity.SYMBOLS,) * 3, np.int64)
    toxicity._triples([(w, 3) for w in ["rotter", "nitwit", "scoundrel", "hello", "great", "bottle", "little", "see"]], counts)
    model = toxicity.CharacterModel(counts)

    def every(token):
        best = [(math.inf, "")]

        def go(i, a, b, total, out):
            if i == len(token):
                total += float(model.cost[a, b, 0])
                if total < best[0][0]:
                    best[0] = (total, out)
                return
            c, before = token[i], token[i - 1] if i else ""
            options = [(0.0, toxicity._AT[c], c)] if c in toxicity._AT else [(toxicity._COST_LOOK, toxicity._AT[x], x) for x in toxicity.LOOKALIKES.get(c, "")] + [(toxicity._COST_KEEP, 1, c)]
            for extra, s, x in options:
                go(i + 1, b, s, total + extra + float(model.cost[a, b, s]), out + x)
            if c in toxicity._SEPARATORS:
                go(i + 1, a, b, total + toxicity._COST_DROP, out)
            elif c == before and (token[i - 2 : i] == c * 2 or token[i + 1 : i + 2] == c):
                go(i + 1, a, b, total + toxicity._COST_REPEAT, out)
            if c == " " and out:
                go(i + 1, 0, 0, total + toxicity._COST_BORDER + float(model.cost[a, b, 0]), out + " ")

        go(0, 0, 0, 0.0, "")
        return best[0][1]

    for t in ["r0tt3r", "n.1.t.w.1.t", "sc0unnndre1", "n i t w i t s e e", "hhhellooo", "!|1+0$", "b0tt1e", "....a", "gr3@t-0-5"] + ["".join(r.choice("rot.e1 !3$ni-w") for _ in range(9)) for _ in range(25)]:
        assert model.decode(t) == every(t), t
    assert toxicity.readings("n i t w i t r o t t e r", model)[-2:] == ("nitwit", "rotter")
    assert model.decode("r.0." * 30_000)


def test_language_id_as_plain_counts(spark):
    """Vectors, centroids and cosines by loops over strings and floats."""
    langs = {"aa": "bada gada kada lada ", "zz": "zuvo ruvo puvo muvo "}
    r = random.Random(1)
    docs = [(" ".join(r.choices(langs[k].split(), k=r.randint(5, 40))) + " X1", k) for k in ("aa", "zz") for _ in range(30)]
    model = language_id.Model(np.stack([language_id.gram_counts(t) for t, _ in docs]), [k for _, k in docs])

    def grams(text):
        out = {}
        low = "\0" + "".join(c if c.isalpha() else "\0" for c in text.lower()) + "\0"
        flat = "".join(c for i, c in enumerate(low) if c != "\0" or i == 0 or low[i - 1] != "\0")
        for n in (1, 2, 3):
            for i in range(len(flat) - n + 1):
                g = flat[i : i + n]
                if n == 1 and g == "\0" or n == 2 and g == "\0\0" or n == 3 and g[1] == "\0":
                    continue
                out[g] = out.get(g, 0) + 1
        return out

    for t, _ in docs[:5]:
        assert sorted(grams(t).values()) == sorted(int(x) for x in language_id.gram_counts(t) if x)
    df = [sum(1 for t, _ in docs if language_id.gram_counts(t)[j]) for j in range(0, language_id.DIMENSIONS, 97)]
    assert np.allclose(model.idf[::97], [math.log((1 + len(docs)) / (1 + n)) + 0.1 for n in df], atol=1e-6)
    for t, k in docs:
        c = language_id.gram_counts(t)
        v = [math.log1p(n) * w for n, w in zip(c, model.idf, strict=True)]
        size = math.sqrt(sum(x * x for x in v))
        cosines = [sum(x * y for x, y in zip(v, m, strict=True)) / size for m in model.centroids]
        lang, score, _ = model.predict(c[None])[0]
        assert lang == k == model.langs[int(np.argmax(cosines))] and abs(score - max(cosines)) < 1e-4


def test_quality_forward_pass_as_loops(spark):
    r = random.Random(4)
    places = quality_model._Places()
    texts = [words(i, 40 + i % 30, 60) + (" BUY NOW 123 !!" if i % 2 else "") for i in range(120)]
    ids = [quality_model._ids(t, places) for t in texts]
    model = quality_model.Model(ids, np.array([1 - i % 2 for i in range(120)]), 0.5)
    index = quality_model.index_vectors()
    w = int(ids[0][3])  # one word's vector by plain counts
    context = np.zeros(quality_model.WIDTH)
    for t in ids:
        for i, x in enumerate(t):
            if x == w:
                for j in range(max(0, i - quality_model.REACH), min(len(t), i + quality_model.REACH + 1)):
                    if j != i:
                        context += index[t[j]]
    want = context / np.linalg.norm(context) + index[w] / math.sqrt(quality_model.NONZERO)
    assert np.allclose(model.vectors[w], want / np.linalg.norm(want), atol=1e-4)
    for t in r.sample(ids, 8):
        vs = [model.vectors[i] for i in t]
        mean = [sum(float(v[j]) for v in vs) / len(vs) for j in range(quality_model.WIDTH)]
        spread = [math.sqrt(max(0.0, sum(float(v[j]) ** 2 for v in vs) / len(vs) - m * m)) for j, m in enumerate(mean)]
        shape = [math.log1p(len(t)) / 10, math.sqrt(sum(m * m for m in mean)), sum(i == 0 for i in t) / len(t), sum(i == 1 for i in t) / len(t), sum(a == b for a, b in zip(t, t[1:], strict=False)) / (len(t) - 1)]
        x = [min(5.0, max(-5.0, (a - m) / s)) for a, m, s in zip([*mean, *spread, *shape], model.mean, model.spread, strict=True)]
        w1, b1, w2, b2 = model.layers
        h = [math.tanh(sum(a * float(w1[i, j]) for i, a in enumerate(x)) + float(b1[j])) for j in range(quality_model.HIDDEN)]
        z = (sum(a * float(w2[j]) for j, a in enumerate(h)) + float(b2)) / model.temperature
        assert abs(model.score([t])[0] - 1 / (1 + math.exp(-z))) < 1e-4


def test_long_texts_and_ties_of_the_classifiers(spark):
    long = "nitwit rotter " * 60_000
    rows = [(i, words(i, 40, 90) + (" nitwit" if i % 3 == 0 else "")) for i in range(300)] + [(900, long), (901, "r.o.t.t.e.r" * 20_000), (902, long), (None, long)]
    docs = spark.createDataFrame([(*x, "s", "p") for x in rows], "doc_id long, text string, score string, predicted string")
    labels = spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(300)] + [(3, 0, 1), (3, 1, 1)], "doc_id long, quality int, toxic int")
    for m in (quality_model, toxicity):
        got = m.scored(docs, m.fit(docs, labels)).collect()
        assert len(got) == len(rows) and len({r.score for r in got if r.doc_id in (900, 902, None)}) == 1
    assert {r.doc_id: r.predicted for r in got}[900] == 1


def test_classifiers_without_labels(spark):
    docs = frame(spark, ODD)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one_kind = spark.createDataFrame([(i, 1, 0) for i in range(12)], "doc_id long, quality int, toxic int")
    for labels in (none, one_kind):
        for m in (quality_model, toxicity):
            rows = m.scored(docs, m.fit(docs, labels)).collect()
            assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    empty = spark.createDataFrame([], DOCS)
    assert toxicity.scored(empty, toxicity.fit(empty, none)).count() == quality_model.scored(empty, quality_model.fit(empty, none)).count() == 0


def test_written_tables_are_forgotten(spark):
    df = shared.written(spark.range(3), "three")
    assert df.count() == 3
    shared.forget()
    with pytest.raises(Exception):
        spark.range(1).join(df, "id").collect()


def test_letters_are_counted_over_all_documents(spark):
    texts = ["fine plain words here"] * 20 + ["ugly plain words here"] * 20 + ["zyqx' zyqx quartz b4d aaab, ünï", "zyqx œuvre", None, ""] * 40
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, int(i >= 20)) for i in range(40)], "doc_id long, toxic int")
    counts = np.zeros((toxicity.SYMBOLS,) * 3, np.int64)
    for t in texts:
        for w in [x.strip(toxicity._STRIP) for x in toxicity.tokens(t or "")]:
            if w.isalpha() and not toxicity._stretched(w):
                c = [0, 0, *(toxicity._AT.get(x, 1) for x in w), 0]
                for i in range(len(c) - 2):
                    counts[tuple(c[i : i + 3])] += 1
    assert counts.sum() > 0 and (toxicity.fit(docs, labels).letters.cost == toxicity.CharacterModel(counts).cost).all()
