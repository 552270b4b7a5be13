"""Fill-in-middle against plain Python, and token counts against the library."""

import hashlib
import random
import re

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import fim, queries, token_counts

BPE = public_tokenizers.path("byte_bpe_50k.json")
MARKS = ("<P>", "<S>", "<M>")


def brute(doc_id, text, seed=7, share=100, spm=50, marks=MARKS):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n, h = len(units), hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in marks) or h[2] % 100 >= share:
        return n, "plain", None, None, text
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), marks[1] + s + marks[0] + p + marks[2] + m
    return n, "psm", len(p), len(m), marks[0] + p + marks[1] + s + marks[2] + m


def texts(n=300):
    r = random.Random(5)
    made = ["".join(r.choice(["a", "é", "日", "\U0001f600", "\n", "\n", "\r", "\0", " ", "<", "S>", "<P", "word"]) for _ in range(r.randrange(60))) for _ in range(n)]
    return [*made, None, "", "\n", "\n\n\n", "one line", "one\n", "x <P> y\nz", "<S>", "a\n<M>\n", "long\n" * 50_000, "w" * 200_000]


DOCS = "doc_id long, text string, n int, form string, output string, c0 string, hash string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, "f", "o", "c", "h") for i, t in rows], DOCS)


@pytest.mark.parametrize("share, spm, marks", [(100, 50, MARKS), (60, 0, ("[[pre]]", "[[suf]]", "[[mid]]"))])
def test_fill_in_middle(spark, share, spm, marks):
    rows = [*enumerate(texts()), (None, "a\nb\nc"), (None, None), (3, "b\nc\n"), (3, "b\nc\n")]
    made = fim.transform(docs(spark, rows), share=share, spm=spm, sentinels=marks)
    told = fim.restore(made, sentinels=marks).collect()
    want = [(i, *brute(i, t, share=share, spm=spm, marks=marks), t or "") for i, t in rows]
    assert sorted(map(tuple, told), key=repr) == sorted(want, key=repr)
    assert {w[2] for w in want} >= {"plain", "psm" if spm == 0 else "spm"}


def test_sentinels_must_be_told_apart():
    for marks in (("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("<P>", "<P><", "<M>"), ("ab", "ba", "c"), ("aba", "x", "y")):
        with pytest.raises(ValueError):
            fim._named(marks)


def test_restored_texts_may_go_to_a_column_of_another_name(spark):
    made = fim.transform(docs(spark, [(1, "a\nb")])).withColumn("text", F.lit("mine"))
    with pytest.raises(ValueError):
        fim.restore(made)
    assert [(r.text, r.back) for r in fim.restore(made, as_col="back").collect()] == [("mine", "a\nb")]


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BPE)


PIECES = ["a", "the", " the", "'", "'r", "'re", "e", "'ll", " ", "  ", "\n", "\t", "1", "23", "é", "日", "\U0001f600", "<|endoftext|>", "<|endof", "text|>", "<", "|>", "!?", " ", " ", "w" * 40, " " * 30]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=80), st.integers(1, 60), st.integers(1, 30))
def test_spliced_counts_are_the_whole_text_s(parts, chunk, overlap):
    tokenizer, text = library(), "".join(parts)
    got = token_counts.spliced(tokenizer, text, token_counts.margin_of(tokenizer), chunk, overlap)
    assert got[0] == len(tokenizer.encode(text, add_special_tokens=False))


def test_overlaps_widen_until_a_place_is_proven():
    tokenizer = library()
    text = "some words " * 30 + "x" * 3000 + " more words" * 30
    tokens, chunks, widened = token_counts.spliced(tokenizer, text, token_counts.margin_of(tokenizer), 200, 40)
    assert tokens == len(tokenizer.encode(text, add_special_tokens=False)) and widened > 1 and chunks > 5


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts_of_documents(spark, name):
    path, r = public_tokenizers.path(name), random.Random(2)
    rows = [(i, "".join(r.choice(PIECES) for _ in range(r.randrange(300)))) for i in range(120)]
    rows += [(200, None), (201, ""), (None, "null id"), (202, "twice"), (202, "twice"), (203, "z" * 9000), (204, "a b " * 9000)]
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = lambda t: len(model.encode(t))
    else:
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        model.no_truncation()
        size = lambda t: len(model.encode(t, add_special_tokens=False))
    got = token_counts.count(docs(spark, rows), path, chunk=400, overlap=50).collect()
    want = [(i, len((t or "").encode()), size(t or "")) for i, t in rows]
    assert sorted((tuple(g)[:3] for g in got), key=repr) == sorted(want, key=repr)
    assert any(g.n_chunks > 1 for g in got) == (name == "byte_bpe_50k.json")
    assert any(g.n_widened > 0 for g in got) == (name == "byte_bpe_50k.json")


def test_only_tokenizers_with_a_proof_are_cut():
    from tokenizers import Tokenizer

    assert token_counts.margin_of(library()) == 14
    assert token_counts.margin_of(Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))) is None


def test_registered_queries(spark, tmp_path):
    rows = [*enumerate(texts(40)), (900, "word " * 30_000), (901, "<|endoftext|> x"), (None, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    tokenizer, sha = library(), lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = queries.op11_fill_in_middle(spark, str(tmp_path)).collect()
    want = [(i, *made[:4], sha(made[4]), sha(t or "")) for i, t in rows for made in [brute(i, t)]]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    got = queries.op12_token_counts(spark, str(tmp_path)).collect()
    sizes = {i: len(tokenizer.encode(t or "", add_special_tokens=False)) for i, t in rows}
    want = [(i, len((t or "").encode()), sizes[i], sizes[i] > 1024) for i, t in rows]
    assert sorted((tuple(g)[:4] for g in got), key=repr) == sorted(want, key=repr)
