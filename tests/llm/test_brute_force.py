"""The quality score and the whole pipeline against plain Python, one text after the other."""

import math
import random
import zlib

import public_tokenizers
import pytest
import sentencepiece
import zstandard

from tessera.llm import quality
from tests.llm.test_dedup import brute_lines, documents, exhaustive
from tests.llm.test_text_models import bad_text, good_text


def sizes(model, text):
    """Bytes of a text, and of what each dictionary and none make of it."""
    out = [len(text)]
    for data in (model.good, model.bad, b""):
        d = zstandard.ZstdCompressionDict(data) if data else None
        frame = zstandard.ZstdCompressor(level=model.level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
        out.append(len(frame.compress(text)))
    return out


def row(model, text):
    size, good, bad, plain = sizes(model, text)
    d, whole = (bad - good) / (bad + good), size + 16
    return [1.0, 8 * d, 32 * d * d, good / whole, bad / whole, plain / whole, math.log((plain + 16) / whole), math.log(whole) / 8]


def plain_score(model, text):
    z = sum(w * x for w, x in zip(model.weights, row(model, text), strict=True))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def test_scores_of_the_classifier(spark):
    texts = [(i, good_text(i) if i % 4 else bad_text(i)) for i in range(200)]
    texts += [(300 + i, f"{good_text(i)} {bad_text(i)}"[: 20 * i]) for i in range(40)] + [(400, None), (401, ""), (402, "é日本 \U0001f600 x"), (403, "w" * 300_000), (404, "a"), (404, "a")]
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(0, 200, 2)], "doc_id long, quality int")
    model = quality.fit(docs, labels, dict_size=4096)
    want = sorted((i, plain_score(model, (t or "").encode())) for i, t in texts)
    got = sorted((x.doc_id, x.score) for x in quality.score(docs, model).collect())
    assert [i for i, _ in got] == [i for i, _ in want]
    assert max(abs(a - b) for (_, a), (_, b) in zip(got, want, strict=True)) < 1e-9


def test_training_of_the_classifier():
    """Dictionaries are the library's, of every other text; the weights are where the penalised likelihood is flat."""
    good, bad = ([f(i).encode() for i in range(120)] for f in (good_text, bad_text))
    model = quality.train(good, bad, dict_size=4096)
    assert model.good == zstandard.train_dictionary(4096, good[::2]).as_bytes()
    assert model.bad == zstandard.train_dictionary(4096, bad[::2]).as_bytes()
    rows = [(row(model, t), y) for ts, y in ((good, 1), (bad, 0)) for t in ts[1::2]]
    for k, w in enumerate(model.weights):
        slope = sum(x[k] * (y - 1 / (1 + math.exp(-sum(a * b for a, b in zip(model.weights, x, strict=True))))) for x, y in rows)
        assert abs(slope - 1e-4 * len(rows) * w) < 1e-5


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def least_of_group(texts):
    """The least id of each id's group of texts with a similarity of 0.8 or more, by comparing all pairs."""
    sets, root = {i: shingles(t) for i, t in texts}, {i: i for i, _ in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and a and b and len(a & b) >= 0.8 * len(a | b):
                u, v = find(i), find(j)
                root[max(u, v)] = min(u, v)
    # texts without a word are all the same text
    none = sorted(i for i, s in sets.items() if not s)
    return {i: none[0] if i in none else find(i) for i in sets}


def corpus(seed):
    """Junk, prose, near copies about the similarity asked for, spread notices, leaked items with substitutions, odd texts."""
    r = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in ("riv", "vall", "walk", "day", "peop", "hill", "str", "mead") for b in ("er", "ey", "ing", "s", "le", "side", "eam", "ow", "and")]
    prose = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [(k, prose(r.randrange(9, 30))) for k in range(6)]
    notices = [" ".join(["notice", str(k), *prose(5)]) for k in range(4)]
    texts, sources = [], {}

    def put(w, lines=()):
        i = len(texts)
        texts.append((i, "\n".join([" ".join(w), *lines])))
        sources[i] = f"s{r.randrange(14)}"

    for k in range(60):
        put(prose(r.randrange(40, 90)), r.sample(notices, 2) if k % 2 else ())
    for i in range(0, 60, 2):
        w = texts[i][1].split("\n")[0].split()
        for _ in range(r.randrange(0, 4)):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        put(w)
    for k, w in items * 2:
        leak = [x if r.random() > 0.15 else "other" for x in w]
        put([*prose(30), *leak, *prose(30)])
    for k in range(40):
        texts.append((1000 + k, bad_text(k)))
        sources[1000 + k] = f"s{k % 5}"
    for k, t in enumerate((None, "", " \n ", "ONE two", "one TWO", notices[0], "é日本 \U0001f600 x")):
        texts.append((2000 + k, t))
        sources[2000 + k] = None if k % 2 else "s1"
    r.shuffle(texts)
    return texts, sources, [(k, " ".join(w)) for k, w in items]


@pytest.mark.parametrize("seed", [1, 2])
def test_pipeline_end_to_end(spark, tmp_path, seed):
    import corpus_pipeline

    texts, sources, items = corpus(seed)
    marks = [(i, int(i < 1000), 0) for i, _ in texts if i < 2000]
    documents(spark, texts, sources).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    known = spark.createDataFrame([m for m in marks if zlib.crc32(str(m[0]).encode()) % 3 != 1], "doc_id long, quality int, toxic int")
    model = quality.fit(spark.read.parquet(str(tmp_path / "documents.parquet")), known)
    kept = [(i, t) for i, t in texts if plain_score(model, (t or "").encode()) >= 0.5]
    cleaned = list(brute_lines(kept, sources, 10).items())
    group = least_of_group(cleaned)
    single = [(i, t) for i, t in cleaned if group[i] == i]
    clean = [(i, t) for i, t in single if not any(exhaustive((t or "").lower(), it) for _, it in items)]
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = {i: lib.encode(t or "") for i, t in clean}

    assert len(texts) > len(kept) > len(single) > len(clean) > 40 and dict(kept) != dict(cleaned)  # every stage has work
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {x.doc_id: x.ids for x in got} == want and len(got) == len(want)
    assert all(x.n_tokens == len(x.ids) for x in got)
