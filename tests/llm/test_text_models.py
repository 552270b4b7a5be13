"""Quality, personal data, tokens and language models: held-out accuracy, brute force and exact round trips."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import public_tokenizers
from pyspark.sql import functions as F

from tests.llm.test_dedup import documents, words
from tessera.llm import ann, common, elias_fano, lm, pii, quality, spm, token_files

ODD = ["", None, " ", "  a", "a  ", "a\tb\nc", "\n\n a \n", "x\0y", "▁a ▁", "é é", "日本語の文章", "🙂🙂", "ｆｕｌｌ", "<s>a</s>", "<|endoftext|> a<|endoftext|>", " " * 700, "the" * 400, "a b " * 3000, "x" * 5000, " x  y", "can't won't"]


def test_sentencepiece_matches_the_library(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    r = random.Random(1)
    texts = [*ODD, *("".join(r.choice("abcdefgthe \n ▁éñ.,1日🙂\t") for _ in range(r.randrange(1, 80))) for _ in range(1500)), *("".join(r.choice("abet") for _ in range(1500)) for _ in range(5))]
    docs = documents(spark, list(enumerate(texts)))
    got = {x.doc_id: x for x in spm.encode_decode(docs, path).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = sp.encode(t or "")
        assert got[i].ids == want and got[i].decoded == sp.decode(want), repr(t)[:60]
    assert spm.encode_decode(documents(spark, []), path).count() == 0
    v = spm.vocabulary(path)
    for ids in ([3 + 0xFF, 3 + 0x41, 3 + 0xE2, 3 + 0x82], [1, 2, 500, 0], [259, 259]):
        assert v.decode(ids) == sp.decode(ids)


def test_store_forgets_and_stays_right():
    store = common.Store(lambda parts: (np.array([len(p) for p in parts], np.int32), np.ones(len(parts), np.int64)), max_parts=50, max_chars=10_000)
    r = random.Random(2)
    for _ in range(60):
        texts = [["x" * r.randrange(1, 30 + 40 * (r.random() < 0.1)) for _ in range(r.randrange(5))] for _ in range(10)]
        ids, counts = store.ids(texts)
        assert ids.tolist() == [len(p) for t in texts for p in t] and counts.tolist() == [len(t) for t in texts]


def test_token_files_round_trip(spark, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    r = random.Random(3)
    texts = [*ODD, *("".join(r.choice("abcthe  \n\t éñ.,1日'sX") for _ in range(r.randrange(1, 300))) for _ in range(300))]
    docs = documents(spark, [(7 * i + 3, t) for i, t in enumerate(texts)]).repartition(5)
    shards = token_files.write(docs, str(tmp_path / "f"), path, length=64, per_batch=4, shards=3)
    got = {x.doc_id: x for x in token_files.read(spark, str(tmp_path / "f"), shards).collect()}
    start = 0
    for i, t in enumerate(texts):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 0]
        x = got[7 * i + 3]
        assert (x.start, x.n_tokens, x.ids_crc32) == (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))), repr(t)[:60]
        start += len(ids)
    names = [f"shard-{s.shard:05d}" for s in shards.collect()]
    assert len(names) == 3
    for name, s in zip(names, shards.collect(), strict=True):
        seq = token_files.Sequences(str(tmp_path / "f"), name)
        ids, mask = seq.sequence(len(seq) - 1)
        assert len(ids) == len(mask) == 64 and (len(seq) - 1) * 64 + mask.sum() == s.n_tokens
        assert not ids.flags.owndata and seq.sequence(0)[1].all()
    for case in ([], [(None, "a"), (None, "b"), (4, "c"), (4, "c"), (4, "d")]):
        where = str(tmp_path / f"g{len(case)}")
        rows = token_files.read(spark, where, token_files.write(documents(spark, case), where, path)).orderBy("start").collect()
        assert [x.doc_id for x in rows] == [i for i, _ in case] and sum(x.n_tokens for x in rows) == (rows[-1].start + rows[-1].n_tokens if rows else 0)


def good_text(seed):
    return " ".join(random.Random(seed).choice(["the", "river", "runs", "through", "a", "valley", "and", "people", "walk", "along", "it", "every", "day"]) for _ in range(60)) + "."


def bad_text(seed):
    r = random.Random(seed)
    return " ".join(r.choice(["BUY!!", "$$$", "click&&&", "###", "free***", "%%%"]) + str(r.randrange(99)) for _ in range(60))


def test_quality_on_held_out_rows(spark):
    texts = [(i, good_text(i) if i % 4 else bad_text(i)) for i in range(400)] + [(900, None), (901, ""), (902, "x" * 200_000)]
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(0, 400, 2)] + [(None, 1, 0), (3, None, 0), (5, 0, 0), (5, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels, dict_size=4096)
    got = {x.doc_id: x.score for x in quality.score(docs, model).collect()}
    assert len(got) == len(texts) and all(0 <= s <= 1 for s in got.values())
    held = [i for i in range(1, 400, 2)] + [i for i in range(0, 400, 4)]
    assert sum((got[i] >= 0.5) == (i % 4 > 0) for i in held) >= 0.97 * len(held)
    kept = quality.keep(docs, model)
    assert kept.columns == docs.columns and {x.doc_id for x in kept.collect()} == {i for i, s in got.items() if s >= 0.5}
    one = quality.fit(docs, labels.filter("quality = 1"))
    assert {x.score for x in quality.score(docs, one).collect()} == {1.0}
    none = quality.fit(documents(spark, []), labels)
    assert {x.score for x in quality.score(docs, none).collect()} == {0.5} and quality.score(documents(spark, []), none).count() == 0


RULES = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def rule_spans(text):
    out = []
    for k, rule in enumerate(RULES):
        for m in re.finditer(rule, text):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
            if (True, k != 1 or all(int(p) <= 255 for p in m[0].split(".")), 12 <= len(d) <= 19 and luhn, 9 <= len(d) <= 15)[k]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_personal_data_rules():
    r = random.Random(3)
    for _ in range(30_000):
        alphabet = r.choice(["a@.b1-", "12.0 ", "0123456789 -", "+1(2) .-3", "a@b.c1 +2-5.é"])
        text = "".join(r.choice(alphabet) for _ in range(r.randrange(40)))
        assert pii.base_spans(text) == rule_spans(text), text
    assert pii.base_spans("a" * 300_000 + "@" + "1" * 300_000 + "." * 10) == []


def test_bootstrapped_extraction(spark):
    def number(seed):
        d = [random.Random(seed).randrange(10) for _ in range(15)]
        s = sum(x if i % 2 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d), 0))
        return "".join(map(str, d)) + str(-s % 10)

    texts = [(i, f"{' '.join(words(5, i))} card number {number(i)} please {' '.join(words(5, i + 99))}") for i in range(40)]
    plain = "1234567890123456"  # no rule takes it
    texts += [(100, f"my card number {plain} please"), (101, f"the code is {plain} here"), (102, None), (103, ""), (104, "mail bob@example.com now"), (104, "mail bob@example.com now"), (None, "+1 (523) 555-7040")]
    texts += [(200 + i, "of the " + (number(i + 500) if i < 6 else f"word{i}")) for i in range(60)] + [(300, f"of the {plain[::-1]}")]
    got = pii.extract(documents(spark, texts)).collect()
    assert len(got) == len(texts)
    found = {r.doc_id: [(s.start, s.kind, s.end, s.base) for s in r.spans] for r in got}
    assert found[100] == [(15, 2, 31, False)]
    assert found[101] == found[102] == found[103] == found[300] == []
    assert found[104] == [(5, 0, 20, True)] and found[None] == [(0, 3, 17, True)]
    for i, t in texts:
        assert [s[:3] for s in found[i] if s[3]] == rule_spans(t or "")
    assert pii.extract(documents(spark, [])).count() == 0


def test_bootstrapped_extraction_goes_on_until_nothing_is_new(spark):
    frame = lambda h, x: f"w{h} by{h} {x} end{h}"
    texts = [(k, frame(0, f"user{k}@example.com")) for k in range(48)]  # seeds stand in the first frame only
    for h in range(5):  # strings of a frame stand in the next one as well, more often than that one's own
        texts += [(1000 * (h + 1) + k, frame(h, f"handle{h}{k}at")) for k in range(8)]
        texts += [(10_000 * (h + 1) + k, frame(h + 1, f"handle{h}{k % 8}at")) for k in range(48)]
    found = {r.doc_id: [(s.kind, s.base) for s in r.spans] for r in pii.extract(documents(spark, texts)).collect()}
    assert [i for i, _ in texts if found[i] != [(0, i < 48)]] == []


def test_bootstrapped_extraction_around_several_words(spark):
    texts = [(k, f"front{k} dial +49 30 1234{k:02d}{k:02d} soon") for k in range(10)]  # no single word stands in this frame
    texts += [(100, "elsewhere dial 030 7654321 soon"), (101, "elsewhere see 030 7654321 later")]
    found = {r.doc_id: [(s.kind, s.base) for s in r.spans] for r in pii.extract(documents(spark, texts)).collect()}
    assert found == {i: [(3, True)] for i in range(10)} | {100: [(3, False)], 101: []}


def brute_bootstrap(texts, support=5, confidence=0.75):
    """The scoring rounds in plain Python: discovered (text, start, kind, end)."""
    mentions = [(i, m) for i, t in enumerate(texts) for m in pii.mentions_of(t or "")]
    edges, kinds = defaultdict(Counter), {}
    for _, m in mentions:
        for p in m["patterns"]:
            edges[p][m["instance"]] += 1
    for p in edges:
        for x in edges[p]:
            kinds[p, x] = max(m["kind"] for _, m in mentions if m["instance"] == x and p in m["patterns"])
    wanted = {p for p, xs in edges.items() if len(xs) >= support}
    total = Counter()
    for t in texts:
        w = ["", "", *(t or "").lower().split(), ""]
        for k in range(2, len(w) - 1):
            total[f"{w[k - 2]} {w[k - 1]} _"] += 1
            total[f"{w[k - 1]} {w[k + 1]} |"] += 1
    for _, m in mentions:
        total[m["patterns"][1]] += m["wide"]
        for p in m["patterns"][2:]:  # with a shape
            total[p] += 1
    known = {(x, k): 1.0 for (p, x), k in kinds.items() if p in wanted and k >= 0}
    while True:
        good = {}
        for p in wanted:
            for k in range(4):
                mine = [(x, m) for x, m in edges[p].items() if (x, k) in known]
                hits = sum(m * known[x, k] for x, m in mine)
                if len(mine) >= support and min(1.0, hits / max(total[p], hits)) >= confidence:
                    good[p, k] = min(1.0, hits / max(total[p], hits))
        found = defaultdict(lambda: 1.0)
        for (p, k), conf in good.items():
            for x in edges[p]:
                if kinds[p, x] < 0:
                    found[x, k] *= 1 - min(conf, 0.999)
        new = {y: v for y, v in known.items() if v == 1.0} | {y: max(1 - v, known.get(y, 0)) for y, v in found.items() if 1 - v >= confidence and known.get(y) != 1.0}
        if set(new) == set(known) and all(abs(new[y] - known[y]) < 1e-12 for y in new):
            break
        known = new
    out = set()
    for i, m in mentions:
        claims = [(conf, -k) for (p, k), conf in good.items() if p in m["patterns"]]
        if m["kind"] < 0 and claims:
            out.add((i, m["start"], -max(claims)[1], m["end"]))
    return out


def random_people(seed, n=500):
    """Texts whose identifiers stand behind label words; some no rule takes. And which those are."""
    r = random.Random(seed)
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    filler = lambda: " ".join(r.choice(["the", "old", "mill", "by", "a", "river", "was", "sold", "again"]) for _ in range(r.randrange(3, 9)))
    texts, planted, clean = [], set(), 0
    for i in range(n):
        kind = r.choice([*["phone", "mail"] * 6, "local", "masked", "order", "plain", *["joined"] * 3])
        said = {
            "phone": lambda: f"dial phone +49 30 {digits(7)} soon",
            "local": lambda: f"dial phone 030-{digits(7)} soon",  # a phone without its plus
            "mail": lambda: f"write to mail person{r.randrange(900)}@example.com today",
            "masked": lambda: f"write to mail person{r.randrange(900)}(at)example.com today",  # a hidden e-mail
            "order": lambda: f"your order {digits(8)} left",
            "plain": lambda: f"number {digits(9)} of many",
            "joined": lambda: f"call +1 ({digits(3)}) 555-{digits(4)} 10.{r.randrange(99)}.{r.randrange(99)}.7",  # the rule takes both for one
        }[kind]()
        head = filler()
        texts.append(f"{head} {said} {filler()}" if kind != "joined" or i % 6 == 1 else f"{head} call +1 ({digits(3)}) 555-{digits(4)} now")
        at = len(head) + 1
        if kind in ("local", "masked"):
            a = texts[-1].index(said.split()[-2], at)
            planted.add((i, a, 3 if kind == "local" else 0, a + len(said.split()[-2])))
        elif kind == "joined" and i % 6 == 1:
            a = texts[-1].index("+", at)
            planted.add((i, a, 3, a + 17))
        clean += kind in ("order", "plain")
    return texts, planted, clean


@pytest.mark.parametrize("seed", [1, 2])
def test_bootstrap_matches_plain_rounds_and_finds_planted_identifiers(spark, seed):
    texts, planted, clean = random_people(seed)
    rows = pii.extract(documents(spark, list(enumerate(texts)))).collect()
    got = {(r.doc_id, s.start, s.kind, s.end) for r in rows for s in r.spans if not s.base}
    assert got == brute_bootstrap(texts)
    assert len(got & planted) >= 0.9 * len(planted) and len(got & planted) >= 0.95 * len(got) and clean > 20


def test_shapes_and_runs_next_to_spans():
    assert pii._shape("+1 (826) 555-4081") == "+d1 (d3) d3-d4" and pii._shape("É9x@a.io") == "ad1a@a.a"
    text = "x +1 (826) 555-4081 190.137.223.20 y"
    assert [(m["kind"], text[m["start"] : m["end"]]) for m in pii.mentions_of(text)] == [(-1, "+1 (826) 555-4081"), (1, "190.137.223.20")]
    assert [m["kind"] for m in pii.mentions_of("call1234567+a@b.io")] == [0]


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((3000, 32)).astype(np.float32)
    x[100:110] = x[99]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    rows += [(5000, None, 1), (5001, [0.0] * 32, 1), (5002, [float("nan")] * 32, 1), (5003, [1.0, None] * 16, 1), (5004, [float("inf")] + [0.0] * 31, 1), (5005, [1.0, 2.0], 1), (None, [1.0] * 32, 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, id int")
    clean = ann.valid(table)
    assert clean.count() == 3000
    q = F.col("id") % 50 == 0
    got = defaultdict(list)
    for r in ann.search(clean, q, ann.fit(clean), shard_rows=700, block=16).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    v = x.astype(np.float64)
    n = np.linalg.norm(v, axis=1)
    hits = 0
    for i in range(0, 3000, 50):
        c = v @ v[i] / (n * n[i])
        best = [j for j in np.lexsort((np.arange(3000), -np.round(c, 14))) if j != i][:5]
        assert len(got[i]) == 5 and all(abs(c[j] - s) < 1e-12 for j, s in got[i])
        hits += len(set(best) & {j for j, _ in got[i]})
    assert hits >= 0.9 * 300
    assert [j for j, _ in got[100]] == [99, 101, 102, 103, 104]
    few = clean.filter("id < 3")
    assert sorted((r.query_id, r.vec_id) for r in ann.search(few, F.lit(True), ann.fit(few)).collect()) == [(a, b) for a in range(3) for b in range(3) if a != b]
    assert ann.search(clean.limit(0), q, ann.fit(clean.limit(0))).count() == 0
    narrow = ann.Codes(ann.fit(clean).centre, ann.fit(clean).rotation, 3)  # nearly nothing within: all are searched whole
    again = ann.search(clean, q, narrow).filter("query_id = 50").orderBy("rank").collect()
    c = v @ v[50] / (n * n[50])
    assert [r.vec_id for r in again] == [j for j in np.argsort(-c) if j != 50][:5]


def test_repeated_query_ids_search_each_for_themselves(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((120, 16)).astype(np.float32)
    ids = [*range(100), *[50] * 3, *range(103, 120)]
    x[101] = x[7]
    table = ann.valid(spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>"))
    got = defaultdict(list)
    v = x.astype(np.float64)
    c = v @ v.T / np.outer(np.linalg.norm(v, axis=1), np.linalg.norm(v, axis=1))
    codes = ann.Codes(ann.fit(table).centre, ann.fit(table).rotation, 64)
    for r in ann.search(table, F.col("id") == 50, codes, shard_rows=30).collect():
        got[r.rank].append((r.vec_id, round(r.score, 9)))
    rows = [i for i, n in enumerate(ids) if n == 50]
    assert len(rows) == 4
    for rank in range(1, 6):
        want = []
        for i in rows:
            best = sorted((j for j in range(120) if j != i), key=lambda j, i=i: (-round(c[i, j], 12), ids[j]))
            want.append((ids[best[rank - 1]], round(c[i, best[rank - 1]], 9)))
        assert sorted(got[rank]) == sorted(want)
    other = spark.createDataFrame([(7, x[7].tolist()), (7, x[9].tolist())], "id long, v array<float>")
    top = sorted((r.vec_id, round(r.score, 6)) for r in ann.search(table, other, codes).filter("rank = 1").collect())
    assert top == [(7, 1.0), (9, 1.0)]  # a table of others: no row is their own


@pytest.mark.parametrize("n", [2000, 20_000])
def test_probing_of_clustered_vectors_touches_few_codes(spark, n):
    rng = np.random.default_rng(n)
    centres = rng.standard_normal((n // 20, 64))
    x = (centres[rng.integers(0, len(centres), n)] + 0.25 * rng.standard_normal((n, 64))).astype(np.float32)
    table = ann.valid(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>"))
    codes = ann.fit(table)
    shard = ann.Shard(codes, np.arange(n), np.arange(n), x)
    v = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = touched = 0
    asked = range(0, n, n // 100)
    for i in asked:
        rows = shard.probed(shard.c[i], codes.radius)
        touched += n if rows is None else len(rows)
        away = np.bitwise_count(shard.whole ^ shard.whole[i]).sum(axis=1)
        assert shard.within(shard.c[i], codes.radius).tolist() == np.nonzero(away <= codes.radius)[0].tolist()
        c = v @ v[i]
        c[i] = -2
        hits += len({*np.argsort(-c)[:5].tolist()} & {*shard.nearest(i, x[i], shard.c[i], 5, codes.radius)[0].tolist()})
    assert touched < 0.1 * n * len(asked) and hits >= 0.9 * 5 * len(asked)


@pytest.mark.parametrize("bits", [16, 40, 64])
def test_pigeonhole_finds_every_code(bits):
    rng = np.random.default_rng(bits)
    codes = ann.Codes(np.zeros(64), np.linalg.qr(rng.standard_normal((64, 64)))[0], bits)
    shard = ann.Shard(codes, np.arange(500), np.arange(500), rng.standard_normal((500, 64)))
    for i in range(20):
        for radius in (0, 7, 20, 30, 64):
            away = np.bitwise_count(shard.whole ^ shard.whole[i]).sum(axis=1)
            assert shard.within(shard.c[i], radius).tolist() == np.nonzero(away <= radius)[0].tolist()


@pytest.mark.parametrize(("n", "universe"), [(0, 10), (1, 1), (1, 100), (5, 5), (1000, 1 << 62), (20_000, 1 << 40), (20_000, 30_000)])
def test_elias_fano(tmp_path, n, universe):
    rng = np.random.default_rng(n)
    v = np.unique(rng.integers(0, universe, n)) if n else np.zeros(0, np.int64)
    elias_fano.save(str(tmp_path), "f", {"v": elias_fano.EliasFano.build(v, universe)}, {"a": np.arange(3, dtype=np.uint16)}, {"k": 1})
    (seq, arrays, meta), mapped = elias_fano.load(str(tmp_path), "f")
    assert mapped and arrays["a"].tolist() == [0, 1, 2] and meta["k"] == 1
    if len(v):
        assert (seq["v"].access(np.arange(len(v))) == v).all()
    q = np.sort(np.r_[v, rng.integers(0, universe, 2000)])
    at = {int(x): i for i, x in enumerate(v)}
    assert seq["v"].find(q).tolist() == [at.get(int(x), -1) for x in q]
    twice = np.sort(np.r_[v, v])
    assert (elias_fano.EliasFano(*elias_fano.EliasFano.build(twice, universe)).access(np.arange(len(twice))) == twice).all()


def brute_lm(texts, train, discount=0.75, least=1):
    tok = [(t or "").encode().lower().split() + [b""] for t in texts]
    c, b, t3 = Counter(), Counter(), Counter()
    for w, ok in zip(tok, train, strict=True):
        if ok:
            f = [b"", *w]
            c.update(w)
            b.update(zip(f, f[1:], strict=False))
            t3.update(zip(f, f[1:], f[2:], strict=False))
    n, v = sum(c.values()), len(c)
    b, t3 = ({k: x for k, x in d.items() if x >= least} for d in (b, t3))
    used2, used3 = defaultdict(float), defaultdict(float)
    for k, x in b.items():
        used2[k[0]] += x - discount
    for k, x in t3.items():
        used3[k[:2]] += x - discount
    p1 = lambda w: (c[w] + 1) / (n + v + 1)
    p2 = lambda a, w: p1(w) if a not in c else max(b.get((a, w), 0) - discount, 0) / c[a] + (1 - used2[a] / c[a]) * p1(w)
    p3 = lambda a, h, w: p2(h, w) if (a, h) not in b else max(t3.get((a, h, w), 0) - discount, 0) / b[a, h] + (1 - used3[a, h] / b[a, h]) * p2(h, w)
    out = []
    for w in tok:
        f = [b"", *w]
        score = sum(math.log10(p2(f[k - 1], f[k]) if k == 1 else p3(f[k - 2], f[k - 1], f[k])) for k in range(1, len(f)))
        out.append((len(w), sum(c[x] > 0 for x in w), sum(math.log10(p1(x)) for x in w), score))
    return out, n


def test_language_model(spark, monkeypatch):
    texts = [" ".join(words(1 + i % 50, i, 40)) for i in range(200)] + ["", None, "unseen word", "W1 w1 W1", "w1 " * 5000]
    docs = documents(spark, list(enumerate(texts)))
    train = [i % 7 != 2 for i in range(len(texts))]
    for segment, least in ((2_000_000, 1), (40, 1), (40, 2)):  # few files a level, and many, that cut contexts
        want, n = brute_lm(texts, train, least=least)
        monkeypatch.setattr(lm, "SEGMENT", segment)
        model, numbered = lm.fit(docs, F.col("doc_id") % 7 != 2, least=least)
        assert model.tokens == n and (segment > 40 or len(model.segments[1]) > 30)
        size = model.words + 1
        assert segment > 40 or any(first % size for first, *_ in model.segments[1]) and any(first % size for first, *_ in model.segments[2])
        for r in lm.score(numbered, model).collect():
            size, known, base, score = want[r.doc_id]
            assert (r.n_tokens, r.n_known) == (size, known) and abs(r.base_score - base) < 1e-6
            assert abs(r.score - score) < 1e-3 * size
    none, numbered = lm.fit(docs, F.lit(False))
    assert none.tokens == 0 and {r.score for r in lm.score(numbered, none).collect()} == {0.0}
    empty, numbered = lm.fit(documents(spark, []), F.lit(True))
    assert lm.score(numbered, empty).count() == 0
    rows, _ = documents(spark, [(None, "a b"), (1, "a b"), (1, "a b")]), None
    model, numbered = lm.fit(rows, F.col("doc_id") > 0)
    assert lm.score(numbered, model).count() == 3 and model.tokens == 6


def test_language_model_counts_every_gram(spark, tmp_path):
    from tessera.llm import queries

    texts = [(i, f"a{i} b{i} c{i}") for i in range(60)] + [(60 + i, f"a{i} b{i} c{i + 1}") for i in range(0, 60, 3)]
    documents(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.op10_lm_scoring(spark, str(tmp_path)).collect()}
    train = [(f"{t} ".split(" "), not got[i].held_out) for i, t in texts]
    c, b, t3 = Counter(), Counter(), Counter()
    for w, ok in train:
        if ok:
            f = ["", *w]
            c.update(w)
            b.update(zip(f, f[1:], strict=False))
            t3.update(zip(f, f[1:], f[2:], strict=False))
    n, v = sum(c.values()), len(c)
    kinds2, kinds3 = Counter(k[0] for k in b), Counter(k[:2] for k in t3)
    p1 = lambda w: (c[w] + 1) / (n + v + 1)
    p2 = lambda a, w: (max(b[a, w] - 0.75, 0) + 0.75 * kinds2[a] * p1(w)) / c[a] if c[a] else p1(w)
    p3 = lambda a, h, w: (max(t3[a, h, w] - 0.75, 0) + 0.75 * kinds3[a, h] * p2(h, w)) / b[a, h] if b[a, h] else p2(h, w)
    for (i, _), (w, _) in zip(texts, train, strict=True):
        f = ["", *w]
        want = math.log10(p2("", w[0])) + sum(math.log10(p3(f[k - 2], f[k - 1], f[k])) for k in range(2, len(f)))
        assert abs(got[i].score - want) < 1e-3 * len(w), i


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(5)
    vocabulary = ["the", "river", "runs", "through", "a", "valley", "and", "people", "walk", "along", "it", "every", "day"]
    prose = lambda seed, n=80: " ".join(random.Random(seed).choice(vocabulary) + random.Random(seed * 1000 + j).choice(["", "s", "ing", str(j)]) for j in range(n)) + "."
    leak = "which seven wandering gnomes painted thirty purple windmills beside an old granite harbour wall last winter"
    texts = [(i, prose(i) if i % 5 else bad_text(i)) for i in range(100)]
    texts += [(200, prose(1)), (201, f"{prose(777)} {leak.upper()} {prose(778)}")]
    texts += [(300 + k, f"{prose(300 + k)}\nAll rights reserved by everyone here.") for k in range(12)]
    sources = {i: f"s{r.randrange(12)}" for i, _ in texts} | {300 + k: f"s{k}" for k in range(12)}
    documents(spark, texts, sources).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(100)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for _, stage in corpus_pipeline.STAGES:
        out = common.written(stage(spark, docs, str(tmp_path)), "stage")
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert out.columns == docs.columns
        seen.append({x.doc_id: x for x in out.collect()})
        docs = out
    assert len(corpus_pipeline.STAGES) == 5
    assert set(seen[0]) == {i for i, _ in texts if i >= 100 or i % 5}
    assert all("reserved" not in seen[1][300 + k].text for k in range(12)) and set(seen[1]) == set(seen[0])
    assert all(x.n_chars == len(x.text) for x in seen[1].values())
    assert 1 in seen[2] and 200 not in seen[2]
    assert set(seen[2]) - set(seen[3]) == {201}
    assert set(seen[4]) == set(seen[3])
    v = spm.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    assert all(v.decode(x.ids) == seen[3][i].text and x.n_tokens == len(x.ids) for i, x in seen[4].items())
    assert hashlib.sha256(",".join(map(str, seen[4][1].ids)).encode()).hexdigest()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(seen[4])
