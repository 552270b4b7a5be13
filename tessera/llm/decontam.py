"""Benchmark decontamination with spaced seeds.

Words are runs of letters and digits, in lower case. Fixed masks of six chosen positions out of up to
ten slide over benchmark items and documents; a hash of the chosen words ignores what stands between
them, so a hit survives substitutions there. Each hit names an alignment of an item with the document
(no gaps); every alignment is verified word by word: the document is contaminated if any ``window``
consecutive words of it (the whole item, where that is shorter) agree in at least ``least`` of their
places. Nothing of this is lost: where some placement of the allowed substitutions would hide an item of
a length from every mask (which is tried out), items of that length have seeds of so few words in a row
that one of them must be whole instead.

The benchmark's hashes are joined to the documents inside the tasks that read them: a block of the
benchmark of at most ``block_words`` words, some 80 bytes each, goes to every task, and a larger benchmark
is worked off in several blocks, each a pass over the documents. Documents are never shuffled.

Defined cases: a null or empty text is clean; an item of fewer than ``least_words`` words (by default one
without words) is left out, and an item of one to four words is found wherever just these words stand;
items with a null text are left out, those with a null id are reported with it; rows that repeat an id are
reported each; an empty table, of documents or items, gives an empty result; further columns are passed
on by ``clean`` and ignored by ``overlaps``.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Chosen positions of each mask. Any two substitutions five or more words apart leave one of them whole.
MASKS = ((0, 1, 2, 3, 4, 5), (0, 1, 2, 4, 5, 6), (0, 1, 3, 4, 6, 7), (0, 2, 3, 5, 7, 8), (0, 1, 4, 5, 8, 9))
WORD = re.compile(r"[^\W_]+")
_STORE = 300_000


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        import xxhash

        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in a row, and where each text's begin (and the last one's end)."""
    hashes = common.sole("decontam", _Hashes)
    if len(hashes) > _STORE:
        hashes.clear()
    lists = [WORD.findall(t.lower()) for t in texts]
    bounds = np.r_[0, np.cumsum([len(x) for x in lists])].astype(np.int64)
    flat = np.fromiter((h for x in lists for h in map(hashes.__getitem__, x)), np.uint64, int(bounds[-1]))
    return flat, bounds


def _seeds(words: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """The hash of the chosen words at each place where the mask fits."""
    n = len(words) - mask[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in mask:
        total *= np.uint64(0x9E3779B97F4A7C15)
        total += words[k : k + n]
        total ^= total >> np.uint64(29)
    return total


def _needed(n: int, least: float) -> int:
    """How many of n words must agree."""
    return max(1, math.ceil(least * n - 1e-9))


@lru_cache(maxsize=256)
def seeds_for(n: int, least: float) -> tuple[tuple[int, ...], ...]:
    """The masks that find every n words in a row that agree with an item in enough places."""
    wrong = n - _needed(n, least)
    placed = [{*(x + k for x in m)} for m in MASKS for k in range(n - m[-1])]
    if wrong <= 3 and all(any(not m.intersection(c) for m in placed) for c in combinations(range(n), wrong)):
        return MASKS
    return (tuple(range(n // (wrong + 1))),)


class Benchmark:
    """The seeds of a block of items, sorted by hash for each mask."""

    def __init__(self, ids: list, texts: list[str], window: int, least: float) -> None:
        self.ids, self.window, self.least = ids, window, least
        self.words, self.bounds = _words(texts)
        sizes = np.diff(self.bounds)
        self.item = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)
        self.need = np.array([_needed(n, least) for n in range(window + 1)])
        by_size = [seeds_for(n, least) if n else () for n in range(window + 1)]
        self.tables = []
        for mask in sorted({m for masks in by_size for m in masks}):
            used = np.array([mask in masks for masks in by_size])[np.minimum(sizes, window)]
            h = _seeds(self.words, mask)
            inside = self.item[: len(h)] == self.item[len(self.item) - len(h) :]
            ok = np.nonzero(inside & used[self.item[: len(h)]])[0].astype(np.int32)
            if not len(ok):
                continue
            order = ok[np.argsort(h[ok], kind="stable")]
            bits = np.zeros(1 << 20, bool)
            bits[(h[order] >> np.uint64(44)).astype(np.int64)] = True
            self.tables.append((mask, h[order], order, bits))

    def found(self, texts: list[str]) -> Iterator[tuple[int, int, int, int]]:
        """text, item, words that agree in the best window, its first word; for each contaminated pair."""
        words, bounds = _words(texts)
        keys = []
        for mask, hashes, places, bits in self.tables:
            h = _seeds(words, mask)
            at = np.nonzero(bits[(h >> np.uint64(44)).astype(np.int64)])[0] if len(h) else np.zeros(0, np.int64)
            lo, hi = np.searchsorted(hashes, h[at], "left"), np.searchsorted(hashes, h[at], "right")
            real = hi > lo
            at, lo, hi = at[real], lo[real], hi[real]
            text = np.searchsorted(bounds, at, "right") - 1
            inside = at + mask[-1] < bounds[text + 1]
            at, lo, hi, text = at[inside], lo[inside], hi[inside], text[inside]
            n = hi - lo
            for a, b in common.grouped(n.tolist(), 1 << 20):  # an alignment is met at many of its words: keep it once
                m = n[a:b]
                place = places[np.repeat(lo[a:b] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))]
                item = self.item[place]
                shift = np.repeat(at[a:b] - bounds[text[a:b]], m) - (place - self.bounds[item])
                keys.append(np.unique(np.stack([np.repeat(text[a:b], m), item, shift], axis=1), axis=0))
        if not keys:
            return
        t, i, shift = np.unique(np.concatenate(keys), axis=0).T
        a = np.maximum(0, -shift)
        n = np.minimum(np.diff(self.bounds)[i], np.diff(bounds)[t] - shift) - a
        w = np.minimum(self.window, np.diff(self.bounds)[i])
        whole = n >= w
        t, i, shift, a, n, w = (x[whole] for x in (t, i, shift, a, n, w))
        got, start = np.zeros(len(t), np.int64), np.zeros(len(t), np.int64)
        for x, y in common.grouped(n.tolist(), 1 << 20):
            got[x:y], start[x:y] = self._best(words, bounds[t[x:y]] + shift[x:y] + a[x:y], self.bounds[i[x:y]] + a[x:y], n[x:y], w[x:y])
        ok = got >= self.need[w]
        t, i, got, start = t[ok], i[ok], got[ok], (start + a + shift)[ok]
        order = np.lexsort((start, -got, i, t))
        t, i = t[order], i[order]
        head = np.r_[True, (t[1:] != t[:-1]) | (i[1:] != i[:-1])] if len(t) else np.zeros(0, bool)
        yield from zip(t[head].tolist(), i[head].tolist(), got[order][head].tolist(), start[order][head].tolist(), strict=True)

    def _best(self, words: np.ndarray, doc: np.ndarray, item: np.ndarray, n: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For alignments of n words from places of document and item on: agreeing words of the best w in a row, and the first such place."""
        first = np.cumsum(n) - n
        step = np.arange(int(n.sum())) - np.repeat(first, n)
        sums = np.r_[0, np.cumsum(words[np.repeat(doc, n) + step] == self.words[np.repeat(item, n) + step])]
        m = n - w + 1
        begin = np.cumsum(m) - m
        step = np.arange(int(m.sum())) - np.repeat(begin, m)
        at = np.repeat(first, m) + step
        best = np.maximum.reduceat(((sums[at + np.repeat(w, m)] - sums[at]) << 32) - step, begin)
        got = -(-best >> 32)
        return got, (got << 32) - best


def _blocks(items: DataFrame, window: int, least: float, block_words: int, least_words: int) -> Iterator[Benchmark]:
    """The benchmark in blocks of about block_words words (bytes / 2 bounds the words of a text)."""
    usable = items.select(F.col("item_id").alias("id"), F.col("text").alias("t")).filter("t is not null")
    n = -(-(usable.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0] // 2 + 1) // block_words)
    for k in range(n):
        rows = (usable if n == 1 else usable.filter(F.pmod(F.xxhash64("t"), F.lit(n)) == k)).collect()
        rows = [r for r in rows if len(WORD.findall(r.t)) >= max(1, least_words)]
        if rows:
            yield Benchmark([r.id for r in rows], [r.t for r in rows], window, least)


def overlaps(docs: DataFrame, items: DataFrame, window: int = 13, least: float = 0.8, block_words: int = 1_000_000, least_words: int = 1) -> DataFrame:
    """doc_id, item_id, matched, start: each document with each item found in it."""
    schema = "doc_id long, item_id long, matched long, start long"
    sc, parts = docs.sparkSession.sparkContext, []
    for block in _blocks(items, window, least, block_words, least_words):
        shared = sc.broadcast(block)

        def f(batch: pa.RecordBatch, texts: list[bytes], shared=shared) -> pa.Table:
            b = shared.value
            found = list(b.found([t.decode() for t in texts]))
            ids = batch.column(0).take(pa.array([x[0] for x in found], pa.int64()))
            rest = [pa.array([b.ids[x[1]] for x in found], pa.int64()), pa.array([x[2] for x in found], pa.int64()), pa.array([x[3] for x in found], pa.int64())]
            return pa.Table.from_arrays([ids, *rest], ["doc_id", "item_id", "matched", "start"])

        parts.append(common.map_texts(docs, [F.col("doc_id").cast("long").alias("doc_id")], schema, f))
    return reduce(DataFrame.unionAll, parts) if parts else docs.sparkSession.createDataFrame([], schema)


def clean(docs: DataFrame, items: DataFrame, window: int = 13, least: float = 0.8, block_words: int = 1_000_000, least_words: int = 1) -> DataFrame:
    """The documents in which no item is found, with all their columns."""
    sc = docs.sparkSession.sparkContext
    for block in _blocks(items, window, least, block_words, least_words):
        shared = sc.broadcast(block)

        def run(batches, shared=shared, at=docs.columns.index("text")):
            for batch in batches:
                texts = common.text_bytes(batch.column(at))
                keep = np.ones(len(texts), bool)
                for a, b in common.grouped([len(t) for t in texts]):
                    keep[[a + x[0] for x in shared.value.found([t.decode() for t in texts[a:b]])]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
