"""SimHash, line de-duplication, decontamination and URL filters, against brute force."""

import datetime
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import common, decontam, line_dedup, simhash, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, k string"


def documents(spark, texts, sources=None):
    """Documents with extra columns whose names clash with internal ones."""
    rows = [(i, t, "en", (sources or {}).get(i, f"s{(i or 0) % 3}"), len(t or ""), "x", "y") for i, t in texts]
    return spark.createDataFrame(rows, DOCS)


def words(n, seed, vocabulary=5000):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, radius=3):
    root = {i: i for i, _ in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in prints:
        for j, b in prints:
            if bin(a ^ b).count("1") <= radius:
                u, v = find(i), find(j)
                root[max(u, v)] = min(u, v)
    return {i: find(i) for i, _ in prints}


def test_simhash(spark):
    texts = [(i, " ".join(words(40, i))) for i in range(60)]
    long = words(3000, 99)
    for k in range(30):  # near copies, a few words changed
        w = list(long)
        for j in range(k % 7):
            w[(k * 97 + j * 411) % 3000] = f"changed{k}"
        texts.append((100 + k, " ".join(w)))
    texts += [(200, ""), (201, None), (202, " \n\t "), (203, "one"), (204, "ONE"), (205, "one two"), (206, "A b C d"), (207, "a B c é"), (208, texts[0][1]), (209, texts[0][1].upper())]
    docs = documents(spark, texts)
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    prints = [(i, brute_fingerprint(t)) for i, t in texts]
    assert {i: r.fp & (1 << 64) - 1 for i, r in got.items()} == dict(prints)
    want = brute_components(prints)
    assert {i: r.component_id for i, r in got.items()} == want
    assert want[129] == want[100] and got[203].fp == got[204].fp


def brute_similar(texts, words_=5, least=0.8):
    sets = {}
    for i, t in texts:
        w = (t or "").encode().lower().split()
        sets[i] = (w, {tuple(w[k : k + words_]) for k in range(max(1, len(w) - words_ + 1))} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (wi, a) in sets.items():
        for j, (wj, b) in sets.items():
            if wi == wj or (a and b and len(a & b) >= least * len(a | b)):
                u, v = find(i), find(j)
                root[max(u, v)] = min(u, v)
    return {i: find(i) for i in sets}


def test_similar_documents(spark, monkeypatch):
    r = random.Random(8)
    texts = [(i, " ".join(words(r.randrange(1, 60), i))) for i in range(80)]
    for g in range(6):  # groups whose members differ more and more, some in length
        base = words(150 * (g + 1), 1000 + g)
        for k in range(12):
            w = list(base)
            for _ in range(k * (g + 1)):
                w[r.randrange(len(w))] = f"other{r.random()}"
            texts.append((1000 + 20 * g + k, " ".join(w[: len(w) - 3 * k])))
    texts += [(5000, ""), (5001, None), (5002, " \n"), (5003, "one two"), (5004, "One  TWO"), (5005, "one two three"), (5006, "x " * 40_000), (5007, "x " * 40_001)]
    docs = documents(spark, texts)
    want = brute_similar(texts)
    assert {x.doc_id: x.component_id for x in simhash.similar(docs).collect()} == want
    monkeypatch.setattr(simhash, "TILE", 16)  # many tiles
    monkeypatch.setattr(simhash, "SET_TILE", 5)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(x.doc_id for x in kept.collect()) == sorted(set(want.values()))


def test_radius_misses_hardly_any_pair_of_the_similarity():
    rng = np.random.default_rng(0)
    for n, m in ((5, 4), (9, 9), (20, 25), (90, 90), (225, 225)):
        both = -(-4 * (n + m) // 9)
        away = []
        for _ in range(3000):
            h = rng.integers(0, 1 << 63, n + m - both, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, n + m - both, dtype=np.uint64)
            a, b = (np.array(simhash._code(x), np.uint64) for x in (h[:n], np.r_[h[:both], h[n:]]))
            away.append(np.bitwise_count(a ^ b))
        bits = 64 * len(away) * simhash.CODE
        p = [q for k, q in simhash._disagreement(0.8) if k <= min(n, m)][-1]
        share = np.sum(away) / bits
        assert share <= p + 5 * (p / bits) ** 0.5 and share >= 0.8 * p  # the probability is that of the worst pair
        assert np.sum(away, axis=1).max() <= simhash.radius_of(min(n, m), 0.8, 64 * simhash.CODE)
        assert np.sum(np.array(away)[:, : simhash.FIRST], axis=1).max() <= simhash.radius_of(min(n, m), 0.8, 64 * simhash.FIRST)


def test_pairs_just_above_the_similarity_are_all_found(spark):
    texts, want = [], []
    for i in range(400):  # a chunk of other words at the end, so few that four fifths of the shingles are shared
        n = 5 + i % 120
        base = words(n + 4, i)
        k = int(n * (1 - 0.8) / (1 + 0.8) + 1e-9)  # n shingles each, n - k shared: (n - k) / (n + k) is at least 0.8
        texts += [(1000 + i, " ".join(base)), (2000 + i, " ".join([*base[: n + 4 - k], *words(k, 5000 + i)]))]
        want.append((2000 + i, 1000 + i))
    got = {x.doc_id: x.component_id for x in simhash.similar(documents(spark, texts)).collect()}
    assert [(i, got[i]) for i, _ in want] == want


def test_large_groups_of_near_copies_are_one(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SET_TILE", 64)
    monkeypatch.setattr(simhash, "TILE", 128)
    base, r, texts = words(200, 3), random.Random(3), []
    for i in range(600):  # a component of many tiles
        w = list(base)
        for _ in range(i % 3):
            w[r.randrange(200)] = f"other{i}"
        texts.append((i, " ".join(w)))
    texts += [(1000 + i, " ".join(words(200, 100 + i))) for i in range(50)]
    got = {x.doc_id: x.component_id for x in simhash.similar(documents(spark, texts)).collect()}
    assert got == {i: 0 if i < 1000 else i for i, _ in texts}


@pytest.mark.parametrize("n", [1, 100_000, 3_000_000])
def test_links_for_any_number_of_parts(spark, n):
    rng = np.random.default_rng(n)
    fp = rng.integers(0, 1 << 63, 400, dtype=np.uint64) * 2 + rng.integers(0, 2, 400, dtype=np.uint64)
    near = [int(fp[i]) ^ sum(1 << int(b) for b in rng.integers(0, 64, i % 5)) for i in range(200)]
    every = sorted({*map(int, fp), *near})
    chain = [every[0] ^ ((1 << 3 * i) - 1) for i in range(1, 12)]  # each a link from the next, the ends far apart
    every = sorted({*every, *chain})
    frame = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in every], "fp long")
    roots = {r.node & (1 << 64) - 1: r.root for r in simhash.components(simhash.links(frame, n)).collect()}
    want = brute_components([(x, x) for x in every])
    groups = {}
    for x, r in want.items():
        groups.setdefault(r, set()).add(x)
    linked = {frozenset(g) for g in groups.values() if len(g) > 1}
    found = {}
    for x, r in roots.items():
        found.setdefault(r, set()).add(x)
    assert {frozenset(g) for g in found.values()} == linked


def test_simhash_edges(spark):
    empty = documents(spark, [])
    assert simhash.near_duplicates(empty).count() == 0 and simhash.similar(empty).count() == 0 and simhash.one_of_each(empty).count() == 0
    rows = documents(spark, [(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (7, "A B C D"), (None, "q")])
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(rows).collect()), key=str)
    assert got == sorted([(None, 5), (5, 5), (5, 5), (7, 5), (None, None)], key=str)
    assert sorted((r.doc_id for r in simhash.one_of_each(rows).collect()), key=str) == sorted([None, 5, 5, None], key=str)


def test_similar_documents_where_ids_repeat(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SET_TILE", 5)  # many cells
    texts = []
    for i in range(20):
        for k in (0, 1):  # two texts of one id, each with a near copy of its own
            w = words(100, 50 * i + k)
            texts += [(i, " ".join(w)), (100 + 100 * k + i, " ".join([*w, "more"]))]
    got = simhash.similar(documents(spark, texts)).collect()
    assert sorted((x.doc_id, x.component_id) for x in got) == sorted((i, i % 100) for i, _ in texts)


def brute_lines(texts, sources, least):
    sites, whole = {}, {}
    for i, t in texts:
        for line in (t or "").split("\n"):
            if line.strip(" ") and sources[i] is not None:
                sites.setdefault(line, set()).add(sources[i])
                whole.setdefault(line, set()).add(t)
    out = {}
    for i, t in texts:
        lines = (t or "").split("\n")
        out[i] = None if t is None else "\n".join(x for x in lines if not x.strip(" ") or min(len(sites.get(x, ())), len(whole.get(x, ()))) < least)
    return out


@pytest.mark.parametrize("least", [1, 2, 5, 10])
def test_line_dedup(spark, least):
    r = random.Random(least)
    common_lines = [f"boilerplate {k} é" for k in range(14)]
    texts, sources = [], {}
    for i in range(150):
        lines = [" ".join(words(6, 1000 * i + j)) for j in range(r.randrange(0, 6))]
        for k in r.sample(range(14), r.randrange(0, 4)):
            lines.insert(r.randrange(len(lines) + 1), common_lines[k])
        texts.append((i, "\n".join([*lines, ""] if i % 5 == 0 else lines)))
        sources[i] = f"s{r.randrange(12)}" if i % 20 else None
    texts += [(900, None), (901, ""), (902, "\n\n"), (903, common_lines[0]), (904, f"{common_lines[0]}\n" * 500 + "x" * 20_000)]
    texts += [(910 + i, "of a copy\non many sites") for i in range(20)] + [(940, "ends\r\n\t\nends"), (941, "ends\r\n\t\nends too")]
    sources |= dict.fromkeys([*range(900, 905), 940], "s1") | {910 + i: f"s{i % 12}" for i in range(20)} | {941: "s2"}
    docs = documents(spark, texts, sources)
    got = line_dedup.remove_spread_lines(docs, min_sites=least)
    assert got.columns == docs.columns
    assert {x.doc_id: x.text for x in got.collect()} == brute_lines(texts, sources, least)


def test_line_dedup_of_every_text(spark):
    import corpus_pipeline

    notice, passage = "All rights reserved by everyone, everywhere, at all times and for good.", "A copied passage of some length."
    texts = [(i, f"own {i}\n{notice}") for i in range(40)]  # mostly notice, and each its own text
    texts += [(100 + i, f"{passage}\nend") for i in range(40)] + [(200, f"{passage}\nother"), (201, None), (202, "")]
    docs = documents(spark, texts, {i: f"s{i % 20}" for i, _ in texts})
    want = {i: f"own {i}" if i < 40 else t for i, t in texts}  # a copy on many sites makes no line spread
    assert {x.doc_id: x.text for x in line_dedup.remove_spread_lines(docs, min_sites=10).collect()} == want
    got = corpus_pipeline.drop_spread_lines(spark, docs, "")
    assert {x.doc_id: (x.text, x.n_chars) for x in got.collect()} == {i: (t, None if t is None else len(t)) for i, t in want.items()}


def test_line_dedup_edges(spark):
    assert line_dedup.remove_spread_lines(documents(spark, [])).count() == 0
    rows = documents(spark, [(1, "a\nb"), (1, "a\nb"), (None, "a\nlonger line")], {1: "s", None: "t"})
    got = sorted((x.doc_id, x.text) for x in line_dedup.remove_spread_lines(rows, min_sites=2).filter("doc_id is not null").collect())
    assert got == [(1, "b"), (1, "b")]


def test_decontamination(spark):
    items = [(k, " ".join(words(18 + k % 20, 5000 + k))) for k in range(30)]
    items += [(90, "four words found whole"), (91, None), (92, ""), (None, " ".join(words(20, 77)))]
    bench = spark.createDataFrame([(i, t, "extra") for i, t in items], "item_id long, text string, doc_id string")
    texts, want = [(i, " ".join(words(300, i))) for i in range(40)], set()
    for k in range(30):
        w = items[k][1].split()
        if k % 3 == 0:  # whole, in other case and punctuation
            put = [x.upper() + "," for x in w]
        elif k % 3 == 1:  # 13 words of it, two of them substituted five or more apart
            put = list(w[3:16])
            put[3], put[9] = "other", "words"
        else:  # too few words in a row
            put = w[:8]
        texts.append((100 + k, " ".join([*words(50, 300 + k), *put, *words(50, 400 + k)])))
        if k % 3 < 2:
            want.add((100 + k, k))
    texts += [(200, None), (201, ""), (202, items[-1][1]), (203, f"{items[0][1]} " * 400)]
    texts += [(204, "x Four, words found WHOLE y"), (205, "four words found here")]
    want |= {(202, None), (203, 0), (204, 90)}
    docs = documents(spark, texts)
    for block in (4_000_000, 150):  # one block, and many
        assert {(r.doc_id, r.item_id) for r in decontam.overlaps(docs, bench, block_words=block).collect()} == want
    kept = decontam.clean(docs, bench)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in texts} - {i for i, _ in want}
    assert decontam.overlaps(documents(spark, []), bench).count() == 0
    assert decontam.overlaps(docs, bench.filter("item_id < 0")).count() == 0
    assert decontam.clean(docs, bench.filter("item_id < 0")).count() == len(texts)


def exhaustive(doc, item, window=13, least=0.8):
    """The best window over all alignments: (agreeing words, first place), or None."""
    d, it, best = doc.split(), item.split(), None
    w = min(window, len(it))
    for i in range(len(d) - w + 1):
        for j in range(len(it) - w + 1):
            n = sum(x == y for x, y in zip(d[i : i + w], it[j : j + w], strict=True))
            if n >= least * w - 1e-9 and (best is None or n > best[0]):
                best = n, i
    return best


def test_decontamination_matches_an_exhaustive_search(spark):
    r = random.Random(6)
    items = [(k, " ".join(words(k + 1, 100 + k, 60))) for k in range(40)]  # of every length from 1 to 40
    texts = []
    for i in range(240):
        w = words(70, i, 60)
        it = items[i % 40][1].split()
        at = r.randrange(30)
        w[at : at + len(it)] = [x if r.random() > 0.15 else "zz" for x in it]
        texts.append((i, " ".join(w)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {(i, k): exhaustive(t, it) for i, t in texts for k, it in items}
    want = {pair: best for pair, best in want.items() if best}
    assert len({k for _, k in want}) == 40
    for block in (1_000_000, 300):
        got = decontam.overlaps(documents(spark, texts), bench, block_words=block).collect()
        assert {(x.doc_id, x.item_id): (x.matched, x.start) for x in got} == want and len(got) == len(want)
    long = decontam.overlaps(documents(spark, texts), bench, least_words=13)
    assert {(x.doc_id, x.item_id) for x in long.collect()} == {(i, k) for i, k in want if k >= 12}


@pytest.mark.parametrize(("window", "least"), [(13, 0.8), (13, 0.7), (8, 0.5), (20, 0.9)])
def test_decontamination_finds_items_wherever_substitutions_stand(window, least):
    for n in range(1, 17):
        item = words(n, n)
        block = decontam.Benchmark([1], [" ".join(item)], window, least)
        for i in range(n):
            for j in range(i, n):
                text = " ".join(["before", *("other" if k in (i, j) else w for k, w in enumerate(item)), "behind"])
                best = exhaustive(text, " ".join(item), window, least)
                assert list(block.found([text])) == ([(0, 0, *best)] if best else []), (n, i, j)


def test_decontamination_query_finds_short_items(spark, tmp_path):
    import corpus_pipeline
    from tessera.llm import queries

    item = words(6, 1)
    docs = documents(spark, [(1, " ".join(["x", *item[:3], "other", *item[4:], "y"])), (2, " ".join(words(50, 2)))])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(7, " ".join(item))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [tuple(x) for x in queries.op3_decontamination(spark, str(tmp_path)).collect()] == [(1, 7, 5, 1)]
    assert [x.doc_id for x in corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path)).collect()] == [2]


def test_url_filter(spark):
    day = lambda n: datetime.date(2024, 1, 1) + datetime.timedelta(n)
    entries = [("example.com", "add", day(10)), ("example.com", "remove", day(20)), ("example.com", "add", day(30)), ("a.b.org", "add", day(5)), ("x.net/bad", "add", day(0)), ("same.io", "add", day(3)), ("same.io", "remove", day(3)), (None, "add", day(1)), ("null.io", None, day(1)), ("late.io", "add", None)]
    listed = url_filter.intervals(spark.createDataFrame([(*e, "z") for e in entries], "key string, action string, day date, since string"))
    assert listed.count() == 4
    cases = [
        ("https://user@WWW.Example.com:80/p?q#f", 15, 1, "example.com"), ("http://example.com.", 20, 0, None), ("http://m.example.com/x", 29, 0, None), ("http://example.com", 30, 1, "example.com"),
        ("http://b.org/", 9, 0, None), ("http://z.a.b.org/", 9, 1, "a.b.org"), ("http://x.net/bad/1", 0, 1, "x.net/bad"), ("http://x.net/badly", 5, 0, None), ("http://same.io", 3, 0, None),
        (None, 15, 0, None), ("no url", 15, 0, None), ("http://example.com", None, 0, None), ("http://notexample.com/", 15, 0, None), ("http://localhost/a", 1, 0, None), ("", 1, 0, None),
    ]
    rows = [(i, u, day(n) if n is not None else None, "e") for i, (u, n, _, _) in enumerate(cases)]
    captures = spark.createDataFrame([*rows, rows[0], (None, cases[0][0], day(15), "e")], "page_id long, url string, day date, key string")
    got = url_filter.evaluate(captures, listed).collect()
    assert len(got) == len(cases) + 2
    for r in got:
        n, key = cases[r.page_id][2:] if r.page_id is not None else (1, "example.com")
        assert (r.n_active, r.first_key, r.blocked) == (n, key, n > 0), cases[r.page_id or 0]
    assert url_filter.evaluate(captures.limit(0), listed).count() == 0
    assert url_filter.evaluate(captures, listed.limit(0)).filter("blocked").count() == 0


def test_shared_folder_is_the_sessions(spark):
    assert spark.conf.get("spark.checkpoint.dir") in common.shared_dir(spark)
    empty = spark.createDataFrame([], "a long")
    assert common.written(empty, "t").count() == 0
    assert common.written(spark.range(3).select(F.col("id").alias("a")), "t").count() == 3
