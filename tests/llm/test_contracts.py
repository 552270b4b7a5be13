"""The registered queries themselves, on a small folder of tables: digests, folds, columns; and their odd cases."""

import hashlib
import math
import random
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tessera.llm import common, queries
from tests.llm.test_dedup import DOCS, brute_components, brute_fingerprint, exhaustive, words
from tests.llm.test_text_models import bad_text, good_text, rule_spans

COLUMNS = {
    "op2_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op4_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op5_pii": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    "op6_multi_index_hashing": "query_id bigint, rank int, vec_id bigint, score double",
    "op7_token_files": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op8_sentencepiece": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op10_lm_scoring": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
}


def put(spark, folder, texts, labels=(), items=(), vectors=(), pages=()):
    """The tables of a scale factor; documents have columns whose names clash with internal ones."""
    rows = [(i, t, "en", f"s{k % 3}", len(t or ""), "x", "y", True, 7) for k, (i, t) in enumerate(texts)]
    spark.createDataFrame(rows, f"{DOCS}, train boolean, h int").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(list(vectors), "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    spark.createDataFrame(list(pages), "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")


@pytest.fixture(scope="module")
def case(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    r = random.Random(12)
    texts = [(i, good_text(i) if i % 4 else bad_text(i)) for i in range(90)]
    texts += [(100 + i, f"Mail a.b{i}@x-y.org or +49 30 12345{i:02d}, host 10.0.{i}.300 and 10.0.{i}.7, card 4111 1111 1111 1111.") for i in range(20)]
    texts += [(200, None), (201, ""), (202, "one TWO"), (203, "ONE two"), (204, "é日本 \U0001f600 x"), (205, "w" * 30_000), (206, texts[1][1]), (206, texts[1][1]), (207, f"{' '.join(words(30, 1))} {' '.join(words(20, 2))}")]
    vectors = [(i, np.round(np.random.default_rng(i).standard_normal(16), 3).tolist(), 0) for i in range(160)] + [(900, None, 0), (950, [0.0] * 16, 0)]
    pages = [(i, f"http://h{r.randrange(30)}.example.org/p{i % 3}/x", "") for i in range(60)] + [(70, None, ""), (71, "no url", "")]
    put(spark, folder, texts, [(i, int(i % 4 > 0), 0) for i in range(90)], [(1, " ".join(words(20, 2)))], vectors, pages)
    return folder, texts, vectors


def rows_of(spark, case, name):
    df = queries.QUERIES[name](spark, case[0])
    told = ", ".join(f"{c} {t}" for c, t in df.dtypes)
    assert told.startswith(COLUMNS.get(name, "")), told
    return df.collect()


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


def test_fingerprints(spark, case):
    got = rows_of(spark, case, "op2_simhash")
    prints = {i: brute_fingerprint(t) for i, t in case[1]}
    roots = brute_components(list(prints.items()))
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == sorted((i, f"{brute_fingerprint(t):016x}", roots[i]) for i, t in case[1])


def test_overlaps(spark, case):
    item = " ".join(words(20, 2))
    got = [tuple(r) for r in rows_of(spark, case, "op3_decontamination")]
    assert got == [(207, 1, *exhaustive(case[1][-1][1], item))]


def test_scores_of_quality(spark, case):
    got = rows_of(spark, case, "op4_quality")
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in case[1])
    for r in got:
        assert 0 <= r.score <= 1 and r.held_out == (fold(r.doc_id, 3) == 1) and r.predicted == int(r.score >= 0.5)
    held = [r for r in got if r.held_out and r.doc_id < 90]
    assert np.mean([r.predicted == int(r.doc_id % 4 > 0) for r in held]) >= 0.9
    twins = [r.score for r in got if r.doc_id in (1, 206)]
    assert len(twins) == 3 and len(set(twins)) == 1


def test_personal_data(spark, case):
    names = ("email", "ip", "card", "phone")
    texts = dict(case[1])
    for r in rows_of(spark, case, "op5_pii"):
        base = rule_spans(texts[r.doc_id] or "")
        told = ",".join(f"{names[k]}:{a}:{b}" for a, k, b in base)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for _, x, _ in base) for k in range(4)]
        assert r.base_sha256 == hashlib.sha256(told.encode()).hexdigest()
        every = [x.split(":") for x in r.spans.split(",")] if r.spans else []
        assert {(int(a), names.index(k), int(b)) for k, a, b in every} >= set(base) and len(every) == r.n_spans
        assert [(int(a), names.index(k)) for k, a, _ in every] == sorted((int(a), names.index(k)) for k, a, _ in every)


def test_neighbours(spark, case):
    x = np.array([np.float32(v) for i, v, _ in case[2] if i < 160], np.float64)
    n = np.linalg.norm(x, axis=1)
    got = rows_of(spark, case, "op6_multi_index_hashing")
    assert Counter(r.query_id for r in got) == {0: 5, 50: 5, 100: 5, 150: 5}
    hits = 0
    for q in (0, 50, 100, 150):
        c = x @ x[q] / (n * n[q])
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == [1, 2, 3, 4, 5] and all(abs(r.score - c[r.vec_id]) < 1e-12 for r in mine)
        best = [j for j in np.argsort(-c) if j != q][:5]
        hits += len({*best} & {r.vec_id for r in mine})
    assert hits >= 18


def test_token_files(spark, case):
    from tokenizers import Tokenizer

    lib, start, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0, []
    for i, t in sorted(case[1], key=lambda x: x[0]):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    assert sorted(map(tuple, rows_of(spark, case, "op7_token_files")), key=lambda x: x[:2]) == want


def test_sentencepiece(spark, case):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [(i, len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids))) for i, t in case[1] for ids in [sp.encode(t or "")]]
    assert sorted(map(tuple, rows_of(spark, case, "op8_sentencepiece"))) == sorted(want)


def test_language_model(spark, case):
    tokens = [(i, (t or "").encode().lower().split() + [b"<end>"]) for i, t in case[1]]
    c = Counter(w for i, ws in tokens if fold(i, 7) != 2 for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted((i, fold(i, 7) == 2, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)) for i, ws in tokens)
    got = rows_of(spark, case, "op10_lm_scoring")
    assert sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    known = [r for r in got if not r.held_out and r.n_tokens > 5]
    assert sum(r.score for r in known) > sum(r.base_score for r in known)


def test_captures_and_lines(spark, case):
    assert len(rows_of(spark, case, "op1_url_filter")) == 62
    assert sorted((r.doc_id, r.text) for r in rows_of(spark, case, "op9_line_dedup") if r.text) == sorted((i, t) for i, t in case[1] if t)


@pytest.mark.parametrize("texts", [[], [(None, None), (None, "a b\nc"), (1, ""), (1, "")]])
def test_empty_tables_and_null_ids(spark, tmp_path, texts):
    import corpus_pipeline

    put(spark, str(tmp_path), texts)
    for name in queries.QUERIES:
        rows = queries.QUERIES[name](spark, str(tmp_path)).collect()
        if name in ("op1_url_filter", "op3_decontamination", "op6_multi_index_hashing"):
            assert rows == []
        else:
            assert sorted(str(r.doc_id) for r in rows) == sorted(str(i) for i, _ in texts), name
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = [i for i, t in texts if i is None] + [i for i, _ in texts if i is not None]
    assert sorted(str(r.doc_id) for r in rows) == sorted(map(str, kept))


def test_a_frame_without_further_columns_passes_the_line_stage(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([(1, "a\nb", "s")], "doc_id long, text string, source string")
    assert [tuple(r) for r in corpus_pipeline.drop_spread_lines(spark, docs, "").collect()] == [(1, "a\nb", "s")]


def test_replaced_tables_are_deleted(spark):
    import os

    first = common.written(spark.range(3).select(F.col("id").alias("a")), "t")
    second = common.written(first.select((F.col("a") + 1).alias("a")), "t", instead=[first])
    assert sorted(r.a for r in second.collect()) == [1, 2, 3]
    assert not os.path.exists(first.written_at.removeprefix("file:")) and os.path.exists(second.written_at.removeprefix("file:"))
