"""Clashing columns, extreme vectors and texts that are no UTF-8."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tessera.llm import ann, decontam, fim, lm, line_dedup, pii, quality, queries, simhash, spm, token_counts, token_files

CLASHING = ["__t", "__places", "__gone", "__n", "__part", "__text", "t", "k", "pos", "cell", "fp", "ids", "h", "hash", "node", "root", "salt", "key", "row", "line", "train", "units", "form"]
BPE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def clashing(spark):
    menu = "home about this very common menu line"
    texts = [(i, f"{menu}\nown words of text number {i} and {i * 7} some more") for i in range(12)] + [(20, "the same long text of several words twice"), (21, "the same long text of several words twice")]
    rows = [(i, t, f"s{i}", "en", len(t), *[f"{c}{i}" for c in CLASHING]) for i, t in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars int, " + ", ".join(f"`{c}` string" for c in CLASHING)), texts


def test_stages_give_clashing_columns_back(spark, clashing):
    import corpus_pipeline

    docs, texts = clashing
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i, _ in texts], "doc_id long, quality int, toxic int")
    item = spark.createDataFrame([(1, "no such words anywhere")], "item_id long, text string")
    stages = {
        "quality": quality.keep(docs, quality.fit(docs, labels), least=0.0),
        "lines": line_dedup.remove_spread_lines(docs, min_sites=10),
        "the pipeline's lines": corpus_pipeline.drop_spread_lines(spark, docs, ""),
        "near copies": simhash.one_of_each(docs),
        "leaks": decontam.clean(docs, item),
    }
    for name, got in stages.items():
        assert got.columns == docs.columns, name
        rows = got.collect()
        assert len(rows) == len(texts) - (name == "near copies"), name
        assert all(r[c] == f"{c}{r.doc_id}" for r in rows for c in CLASHING), name
    assert all("menu" not in r.text for r in stages["lines"].collect())


def test_operators_take_clashing_columns(spark, clashing):
    docs, texts = clashing
    item = spark.createDataFrame([(1, "no such words anywhere")], "item_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i, _ in texts], "doc_id long, quality int, toxic int")
    model, numbered = lm.fit(docs, F.lit(True), order=3, least=1)
    for got in (
        simhash.near_duplicates(docs, words=3, radius=3),
        quality.score(docs, quality.fit(docs, labels)),
        pii.extract(docs),
        spm.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model")),
        token_files.encode(docs, BPE),
        token_counts.count(docs, BPE),
        lm.score(numbered, model),
        fim.transform(docs),
    ):
        assert sorted(r.doc_id for r in got.collect()) == sorted(i for i, _ in texts)
    assert decontam.overlaps(docs, item).collect() == []


@pytest.mark.parametrize("scale", [1e200, 1e-200, 1e-310])
def test_cosines_of_extreme_vectors(spark, scale):
    x = np.random.default_rng(3).standard_normal((60, 16))
    rows = ann.valid(spark.createDataFrame([(i, (v * (scale if i % 2 else 1)).tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"))
    got = ann.search(rows, F.col("id") % 10 == 1, ann.fit(rows, k=3), k=3).collect()
    c = x @ x.T / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1))
    close = 1e-12 if scale != 1e-310 else 1e-2  # so small numbers have few digits themselves
    assert {r.query_id for r in got} == {1, 11, 21, 31, 41, 51}
    assert all(abs(r.score - c[r.query_id, r.vec_id]) < close for r in got)
    for q in (1, 11, 21, 31, 41, 51):
        best = sorted((j for j in range(60) if j != q), key=lambda j: -c[q, j])[:3]
        assert len({*best} & {r.vec_id for r in got if r.query_id == q}) >= 2


def test_bytes_that_are_no_utf8_read_as_a_replacement(spark):
    docs = spark.sql("select 1L doc_id, cast(unhex('6162FF63') as string) text, 's' source union all select 2L, 'plain', 't'")
    read = "ab�c"
    tokens = {r.doc_id: r for r in token_counts.count(docs, BPE).collect()}
    assert tokens[1].n_bytes == len(read.encode()) and tokens[2].n_tokens == 1
    assert {r.doc_id: read in r.output for r in fim.transform(docs).collect()} == {1: True, 2: False}
    assert {r.doc_id: r.decoded for r in spm.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model")).collect()}[1] == read
    assert {r.doc_id for r in token_files.encode(docs, BPE).collect()} == {1, 2}
    assert {r.doc_id: len(r.spans) for r in pii.extract(docs).collect()} == {1: 0, 2: 0}
    item = docs.filter("doc_id = 1").select(F.lit(7).alias("item_id"), F.lit("plain").alias("text"))
    assert [(r.doc_id, r.item_id) for r in decontam.overlaps(docs, item).collect()] == [(2, 7)]


def test_repeated_ids_with_different_texts_are_scored_apart(spark):
    docs = spark.createDataFrame([(1, "one text of words"), (1, "9 9 9 9 9 9 9 9 9"), (1, "one text of words"), (2, "another text")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    got = [round(r.score, 12) for r in quality.score(docs, quality.fit(docs, labels)).collect() if r.doc_id == 1]
    assert len(got) == 3 and len({*got}) <= 2


def test_digest_of_an_unchanged_document(spark, tmp_path):
    spark.createDataFrame([(5, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    (row,) = queries.op11_fill_in_middle(spark, str(tmp_path)).collect()
    assert (row.n, row.form, row.prefix_chars, row.output_sha256) == (0, "plain", None, hashlib.sha256(b"").hexdigest())
