import hashlib
import math

import public_tokenizers
import tiktoken

import corpus_pipeline
from skeinql.llm import bpe, language_id, secret_scan
from tests.llm import brute
from tests.llm.test_native import words

SF = "/root/testdata/sf0.001"


def test_pipeline_as_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rejected = {r.doc_id for r in language_id.predicted(docs).collect() if r.rejected}
    rows = [r for r in docs.collect() if r.doc_id not in rejected]
    assert len(rows) > 0.97 * docs.count()
    least = brute.classes([(r.doc_id, r.text) for r in rows])
    rows = [r for r in rows if least[r.doc_id] == r.doc_id]
    random = {r.doc_id: [tuple(int(x) for x in s.split(":")[1:]) for s in r.spans.split(",") if s.startswith("random")] for r in secret_scan.secret_spans(docs).collect()}
    texts = {r.doc_id: brute.redact(r.text, [*brute.base_spans(r.text), *((s, 3, e) for s, e in random[r.doc_id])]) for r in rows}
    mix = brute.mixture([(r.doc_id, texts[r.doc_id], r.source) for r in rows])
    ranks = {t: i for i, t in enumerate(bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, size, _, _, taken in mix:
        ids = encoding.encode_ordinary(texts[i])
        row = (i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts[i].encode()).hexdigest())
        want += [row] * (min(3, math.ceil(taken / size)) if size else 1)
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(want)


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        docs = out


def test_stages_on_odd_and_empty_tables(spark):
    """Each stage alone: nulls in every column, empty and long texts, rows that repeat, extra columns, no rows."""
    rows = [(i, words(i, 80), "en", "a", 1, "x", 1) for i in range(30)] + [(None, None, None, None, None, None, None), (50, None, "en", "a", 0, "x", 1), (51, "", None, "b", 0, "x", 1), (52, words(3, 80), "en", None, 9, "x", 1), (53, words(9, 90_000, 9000), "en", "b", 9, "x", 1), (54, "token=abcdefghij " * 3000, "en", "b", 9, "x", 1)]
    rows += [rows[0], rows[0]]
    schema = "doc_id long, text string, lang string, source string, n_chars long, __text string, __kept int"
    docs, none = spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        got = out.collect()
        assert stage(spark, none, SF).count() == 0
        if name == "byte_bpe":
            assert len(got) == len(rows) and {r.n_tokens for r in got if r.doc_id in (50, 51)} == {0}
            continue
        assert out.columns == docs.columns
        ids = [r.doc_id for r in got]
        if name == "language_id":
            assert 50 not in ids and 51 not in ids and {*range(30), 52, 53} <= set(ids)
        if name == "ngram_jaccard_join":
            assert ids.count(0) == 1 and 52 not in ids and {50, 51, 53, 54, None} <= set(ids)
        if name == "secret_scan":
            assert len(got) == len(rows) and next(r for r in got if r.doc_id == 54).text == "[secret] " * 3000
        if name == "source_mixing":
            assert {50, 51, None} <= set(ids)
