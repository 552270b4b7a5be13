"""Language-model scoring with an Elias-Fano n-gram trie.

The model is an interpolated back-off model with absolute discounting. Its first level holds the words
by hash with their exact counts; each further level holds, for the nodes of the level above, the words
that follow: monotone pointers from each node to its children, the children as one monotone sequence
(context-relative: a context's place times the vocabulary's size, plus the word), running counts, all
Elias-Fano coded, and smoothed log probabilities and back-off weights quantised to 16 bits. Levels are
cut into files in the folder that all executors share, and memory-mapped. A successor is searched within
its context's pointers.

All training texts are counted, in blocks whose distinct n-grams go, sorted and compressed, to the task
that writes their file: tasks hold consecutive (context, word) pairs, and their bounds follow from the
level above, so that each gets about equally many occurrences and no sample is drawn. A context with more
than a quarter of a task's share is itself cut by words; the mass that its pieces keep is summed before
the files that hold them are finished, so a word that a third of all tokens follow costs no single task.

n-grams of two and more words are kept from ``least`` occurrences on (all by default); what is left out
goes to the back-off weight, so probabilities sum to one up to quantisation. A longer n-gram is counted
only where both its shorter ones are kept, which loses none that is frequent enough.

Defined cases: a null text counts as empty and is the end token alone; a null id is neither held out nor
learned from; without any training text every score is 0 or the base's; repeated ids keep their rows and
count each; an empty table gives an empty result; further columns are ignored. Words whose 62-bit
hashes agree (one pair in about four billion words) count as one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, elias_fano

STEP = 4096.0
BLOCK = 2_000_000
#: Occurrences in a file of the trie.
SEGMENT = 2_000_000
GROUP = 8 << 20
STORE = 400_000
#: Different words that a worker counts at a time.
WORDS = 700_000
#: Words whose probabilities a worker holds side by side; of more, it looks them up file by file.
FIRST = 16 << 20
#: Bytes of files that a worker holds where the shared folder cannot be mapped.
HELD = 256 << 20


@dataclass
class Model:
    """Where the trie lies: for each level, (first key, first node, occurrences before, number) of each file."""

    folder: str
    order: int
    discount: float
    tokens: int = 0
    words: int = 0
    end: int = -1
    segments: list[list[tuple[int, int, int, int]]] = field(default_factory=list)
    totals: list[int] = field(default_factory=list)
    nodes: list[int] = field(default_factory=list)


def _quantised(log10: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-log10 * STEP), 0, 65535).astype(np.uint16)


class Trie:
    """Look-ups in the mapped files of a model."""

    def __init__(self, model: Model) -> None:
        self.m = model
        self.files: dict[tuple[int, int], tuple] = {}
        self.held: dict[tuple[int, int], int] = {}
        self.probs: np.ndarray | None = None
        columns = [np.array(level, np.int64).reshape(-1, 4).T for level in model.segments]
        self.first, self.base, self.mass, self.number = ([c[i] for c in columns] for i in range(4))

    def file(self, level: int, k: int):
        """Mapped files stay; of others, at most HELD bytes."""
        key = level, k
        if key not in self.files:
            self.files[key], mapped = elias_fano.load(self.m.folder, f"level{level}-{self.number[level - 1][k]:05d}")
            if not mapped:
                self.held[key] = self.files[key][2]["bytes"]
                while sum(self.held.values()) > HELD and len(self.held) > 1:
                    oldest = next(iter(self.held))
                    del self.files[oldest], self.held[oldest]
        return self.files[key]

    @staticmethod
    def _by_segment(firsts: np.ndarray, keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Each segment that keys fall into, and their places in order."""
        if len(firsts) == 1:
            yield 0, np.arange(len(keys))
        elif len(firsts) and len(keys):
            seg = np.maximum(np.searchsorted(firsts, keys, "right") - 1, 0)
            order = np.argsort(seg, kind="stable")
            seg = seg[order]
            cuts = np.nonzero(np.r_[True, seg[1:] != seg[:-1]])[0]
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(seg)], strict=True):
                yield int(seg[a]), order[a:b]

    def word_ids(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), -1, np.int64)
        for k, at in self._by_segment(self.first[0], hashes):
            seq, _, meta = self.file(1, k)
            h = hashes[at] - meta["from"]
            at, h = at[(h >= 0) & (h < meta["span"])], h[(h >= 0) & (h < meta["span"])]
            got = seq["hashes"].find(h)
            out[at] = np.where(got >= 0, got + self.base[0][k], -1)
        return out

    def counts(self, level: int, nodes: np.ndarray) -> np.ndarray:
        """How often each node's n-gram occurs; 0 for -1."""
        out = np.zeros(len(nodes), np.int64)
        for k, at in self._by_segment(self.base[level - 1], nodes):
            at = at[nodes[at] >= 0]
            i = nodes[at] - self.base[level - 1][k]
            sums = self.file(level, k)[0]["counts"]
            out[at] = sums.access(i + 1) - sums.access(i)
        return out

    def holding(self, level: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The node whose occurrences, all in the nodes' order, hold each place; the place of its first one, and its count."""
        node, before, count = (np.zeros(len(at), np.int64) for _ in range(3))
        for k, i in self._by_segment(self.mass[level - 1], at):
            sums, start = self.file(level, k)[0]["counts"], self.mass[level - 1][k]
            lo, hi = np.zeros(len(i), np.int64), np.full(len(i), sums.n - 1, np.int64)
            while (hi - lo > 1).any():
                mid = (lo + hi) >> 1
                below = sums.access(mid) <= at[i] - start
                lo, hi = np.where(below, mid, lo), np.where(below, hi, np.maximum(mid, lo + 1))
            first = sums.access(lo)
            node[i], before[i], count[i] = lo + self.base[level - 1][k], first + start, sums.access(lo + 1) - first
        return node, before, count

    def find(self, level: int, contexts: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Node, log probability (0 without a node) and back-off weight of each word behind a context node of the level above."""
        known = np.nonzero(contexts >= 0)[0]
        if not len(known) or not len(self.first[level - 1]):
            return np.full(len(words), -1, np.int64), np.zeros(len(words), np.float32), np.zeros(len(words), np.float32)
        size = self.m.words + 1
        key = contexts[known] * (size + 1) + words[known] + 1
        order = np.argsort(key)
        key = key[order]
        head = np.r_[True, key[1:] != key[:-1]]
        c, w = np.divmod(key[head], size + 1)
        w -= 1
        # what is found of each different pair; the last one stands for places without a context
        which = np.full(len(words), len(c), np.int64)
        which[known[order]] = np.cumsum(head) - 1
        n, p, b = np.full(len(c) + 1, -1, np.int64), np.zeros(len(c) + 1, np.float32), np.zeros(len(c) + 1, np.float32)
        for k, at in self._by_segment(self.first[level - 1], c * size + np.maximum(w, 0)):
            seq, arrays, meta = self.file(level, k)
            j = c[at] - meta["context"]
            inside = (j >= 0) & (j < meta["contexts"])
            at, j = at[inside], j[inside]
            b[at] = arrays["back"][j] / np.float32(-STEP)
            at, j = at[w[at] >= 0], j[w[at] >= 0]
            if not len(at):
                continue
            one = np.r_[True, j[1:] != j[:-1]]  # what belongs to a context is looked up once
            place = np.cumsum(one) - 1
            low, high = np.split(seq["pointers"].access(np.concatenate([j[one], j[one] + 1])), 2)
            got = seq["children"].find(j * size + w[at], low[place], high[place])
            at, got = at[got >= 0], got[got >= 0]
            n[at] = got + self.base[level - 1][k]
            p[at] = arrays["prob"][got] / np.float32(-STEP)
        return n[which], p[which], b[which]

    def first_prob(self, words: np.ndarray) -> np.ndarray:
        """Quantised log probability of each word by itself."""
        if self.m.words <= FIRST:  # side by side, a spare one for unknown words at the end
            if self.probs is None:
                parts = [self.file(1, k)[1]["prob"] for k in range(len(self.base[0]))]
                self.probs = np.concatenate([*parts, np.zeros(1, np.uint16)]) / np.float32(STEP)
            return self.probs[words] + self.unigram(np.zeros(1))[0]
        out = np.zeros(len(words))
        for k, at in self._by_segment(self.base[0], words):
            at = at[words[at] >= 0]
            out[at] = self.file(1, k)[1]["prob"][words[at] - self.base[0][k]] / STEP
        return out + self.unigram(np.zeros(1))[0]

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 1) / (self.m.tokens + self.m.words + 1))


class Reader:
    """Turns texts into word numbers of a trie, with a store of known words."""

    def __init__(self, model: Model) -> None:
        self.trie = Trie(model)
        self.clear()

    def clear(self) -> None:
        self.index = common._Index()
        self.ids, self.logp = np.zeros(0, np.int64), np.zeros(0)

    def stream(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word numbers (-1 unknown) and log probabilities of an end, then all texts with an end behind each; the lengths with the end."""
        import xxhash

        if len(self.index) > STORE:
            self.clear()
        known = len(self.index)
        lists = [t.lower().split() for t in texts]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists)) + 1
        end = self.index[b""]
        ends = np.cumsum(sizes)
        at = np.full(int(sizes.sum()) + 1, end, np.int64)
        inner = np.ones(len(at), bool)
        inner[0] = inner[ends] = False
        at[inner] = np.fromiter(map(self.index.__getitem__, chain.from_iterable(lists)), np.int64, len(at) - 1 - len(lists))
        if len(self.index) > known:
            fresh = list(self.index)[known:]
            h = np.fromiter((xxhash.xxh64_intdigest(w, 42) >> 2 for w in fresh), np.int64, len(fresh))
            order = np.argsort(h)
            ids, n = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
            found = self.trie.word_ids(h[order])
            ids[order], n[order] = found, self.trie.counts(1, found)
            self.ids, self.logp = np.r_[self.ids, ids], np.r_[self.logp, self.trie.unigram(n)]
        return self.ids[at], self.logp[at], sizes

    def nodes(self, s: np.ndarray, upto: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """node, prob, back of the n-grams of 2, 3.. words that end at each place from 1 on."""
        end = self.trie.m.end
        above = s[:-1]
        for level in range(2, upto + 1):
            node, prob, back = self.trie.find(level, above, s[1:])
            yield node, prob, back
            above = np.r_[-1, node[:-1]]
            above[s[:-1] == end] = -1  # nothing is known across the beginning of a text


def _reader(model: Model) -> Reader:
    return common.sole(("lm", model.folder, len(model.segments)), lambda: Reader(model))


def _blob(keys: np.ndarray, counts: np.ndarray, low: np.ndarray | None) -> bytes:
    """Sorted keys as differences, byte plane by byte plane, counts, and quantised lower probabilities, compressed."""
    import zstandard

    plane = lambda x, kind: np.ascontiguousarray(x.astype(kind).view(np.uint8).reshape(len(x), -1).T).tobytes()
    planes = plane(np.diff(keys, prepend=0), "<u8") + plane(counts, "<u4") + (b"" if low is None else plane(low, "<u2"))
    return len(keys).to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(planes)


def _unblob(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    import zstandard

    n = int.from_bytes(blob[:8], "little")
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[8:]), np.uint8)
    value = lambda a, width: np.ascontiguousarray(planes[a * n : (a + width) * n].reshape(width, n).T).view(f"<u{width}").ravel()
    low = value(12, 2) if len(planes) > 12 * n else np.zeros(n, np.uint16)
    return np.cumsum(value(0, 8).astype(np.int64)), value(8, 4).astype(np.int64), low


def _summed(keys: np.ndarray, counts: np.ndarray | None, low: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Different keys in order, their counts in all, and what is equal for equal keys."""
    if low is None and counts is None:
        return *np.unique(keys, return_counts=True), None
    order = np.argsort(keys)
    keys = keys[order]
    head = np.nonzero(np.r_[True, keys[1:] != keys[:-1]])[0]
    counts = np.diff(np.r_[head, len(keys)]) if counts is None else np.add.reduceat(counts[order], head)
    return keys[head], counts, None if low is None else low[order][head]


def _dealt(keys: np.ndarray, counts: np.ndarray, low: np.ndarray | None, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
    """shard, blob: sorted keys cut at the bounds."""
    cuts = np.r_[0, np.searchsorted(keys, bounds), len(keys)]
    for s in np.nonzero(np.diff(cuts))[0].tolist():
        a, b = cuts[s], cuts[s + 1]
        blob = _blob(keys[a:b], counts[a:b], None if low is None else low[a:b])
        yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([blob], pa.binary())], ["shard", "blob"])


def _merged(batches) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    parts = [_unblob(x) for batch in batches for x in batch.column(1).to_pylist()]
    return _summed(*map(np.concatenate, zip(*parts, strict=True))) if parts else None


def _sums(counts: np.ndarray) -> tuple[dict, dict]:
    sums = np.r_[0, np.cumsum(counts, dtype=np.int64)]
    return elias_fano.EliasFano.build(sums, int(sums[-1]) + 1)


def _count_words(docs: DataFrame, model: Model, shards: int) -> None:
    """The first level: the hash of each word and of the end (the empty word), and how often it occurs."""
    bounds = np.array([(k << 62) // shards for k in range(1, shards)], np.int64)
    def run(batches):
        import xxhash

        index, counts = common._Index(), np.zeros(0, np.int64)

        def flush():
            keys = np.fromiter((xxhash.xxh64_intdigest(w, 42) >> 2 for w in index), np.int64, len(index))
            index.clear()
            yield from _dealt(*_summed(keys, counts, None), bounds)

        for batch in batches:
            column = batch.column(0)
            for a, b in common.grouped(pa.compute.fill_null(pa.compute.binary_length(column), 0).to_pylist(), GROUP):
                lists = [t.lower().split() for t in common.text_bytes(column.slice(a, b - a))]
                at = np.fromiter(map(index.__getitem__, chain.from_iterable(lists)), np.int64, sum(map(len, lists)))
                end = index[b""]
                seen = np.bincount(at, minlength=len(index))
                seen[: len(counts)] += counts
                seen[end] += len(lists)
                counts = seen
                if len(index) > WORDS:
                    yield from flush()
                    counts = np.zeros(0, np.int64)
        if index:
            yield from flush()

    def write(batches):
        from pyspark import TaskContext

        got = _merged(batches)
        if got:
            k, (h, c, _) = TaskContext.get().partitionId(), got
            meta = {"from": int(h[0]), "span": int(h[-1] - h[0]) + 1}
            sequences = {"hashes": elias_fano.EliasFano.build(h - h[0], meta["span"]), "counts": _sums(c)}
            prob = np.clip(np.rint(np.log10(c + 1.0) * STEP), 0, 65535).astype(np.uint16)
            elias_fano.save(model.folder, f"level1-{k:05d}", sequences, {"prob": prob}, meta)
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (k, int(h[0]), len(h), int(c.sum()))], ["k", "first", "n", "mass"])

    blobs = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "shard int, blob binary")
    written = blobs.repartitionById(shards, "shard").mapInArrow(write, "k long, first long, n long, mass long")
    _add_level(model, [(r.k, r.first, r.n, r.mass) for r in sorted(written.collect())])


def _add_level(model: Model, files: list[tuple[int, int, int, int]]) -> None:
    """A row for each file of the level, of SEGMENT occurrences or more, in order."""
    segments, node, mass = [], 0, 0
    for k, first, n, m in files:
        segments.append((first, node, mass, k))
        node, mass = node + n, mass + m
    model.segments.append(segments)
    model.totals.append(mass)
    model.nodes.append(node)


def _bounds(model: Model, level: int, shards: int) -> np.ndarray:
    """Keys that cut the level into ranges of like occurrences; only a context of more than a quarter of a range is cut itself."""
    total, size, trie = model.totals[level - 2], model.words + 1, Trie(model)
    if not total:
        return np.zeros(0, np.int64)
    at = np.arange(1, shards, dtype=np.int64) * total // shards
    node, before, count = trie.holding(level - 1, at)
    inside = ((at - before) / np.maximum(count, 1) * model.totals[0]).astype(np.int64)
    word = trie.holding(1, np.minimum(inside, model.totals[0] - 1))[0]
    return np.maximum.accumulate(np.where(count * 4 > total // shards, node * size + word, (node + 1) * size))


def _grams_file(model: Model, level: int, k: int, keys: np.ndarray, c: np.ndarray, low: np.ndarray, masses: dict[int, float]) -> None:
    """The file of consecutive n-grams; masses: what a context keeps where not all its successors are here."""
    trie, size = _reader(model).trie, model.words + 1
    context, word = keys // size, keys % size
    first = int(context[0])
    j = context - first
    children = np.bincount(j)
    some = np.nonzero(children)[0]
    kept = c - model.discount
    held = np.bincount(j, kept)[some]
    for i, m in masses.items():
        if first <= i <= context[-1]:
            held[np.searchsorted(some, i - first)] = m
    total = np.ones(len(children))
    total[some] = trie.counts(level - 1, some + first)
    rest = np.ones(len(children))
    rest[some] = 1 - held / total[some]
    back = _quantised(np.log10(np.maximum(rest, 1e-15)))
    lower = trie.first_prob(word) if level == 2 else low / -STEP
    prob = np.log10(kept / total[j] + 10 ** (back[j] / -STEP + lower))
    sequences = {
        "pointers": elias_fano.EliasFano.build(np.r_[0, np.cumsum(children)], len(word) + 1),
        "children": elias_fano.EliasFano.build(j * size + word, len(children) * size),
    }
    if level < model.order:
        sequences["counts"] = _sums(c)
    elias_fano.save(model.folder, f"level{level}-{k:05d}", sequences, {"prob": _quantised(prob), "back": back}, {"context": first, "contexts": len(children)})


def _width(model: Model) -> np.dtype:
    return np.dtype(np.int32 if model.words < 1 << 31 else np.int64)


def _streams(column: pa.Array, model: Model) -> Iterator[np.ndarray]:
    """The word numbers of a column of numbered texts, in groups, with an end in front."""
    kind = _width(model)
    for a, b in common.grouped(pa.compute.binary_length(column).to_pylist(), GROUP // 2):
        flat = b"".join(x.as_buffer() for x in column.slice(a, b - a))
        yield np.r_[model.end, np.frombuffer(flat, kind).astype(np.int64)]


def number(docs: DataFrame, model: Model, train: Column | None = None) -> DataFrame:
    """doc_id, train, n_tokens, n_known, base_score, ids: each text as packed word numbers (-1 unknown) with the end's behind it."""

    def f(batch: pa.RecordBatch, texts: list[bytes]) -> pa.RecordBatch:
        reader, kind = _reader(model), _width(model)
        s, logp, sizes = reader.stream(texts)
        starts = np.r_[0, np.cumsum(sizes)]
        base = np.add.reduceat(logp[1:], starts[:-1])
        known = np.add.reduceat((s[1:] >= 0).astype(np.int64), starts[:-1])
        ids = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer((starts * kind.itemsize).astype(np.int32)), pa.py_buffer(s[1:].astype(kind).tobytes())])
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes), pa.array(known), pa.array(base), ids], ["doc_id", "train", "n_tokens", "n_known", "base_score", "ids"])

    keep = [F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(train if train is not None else F.lit(False), F.lit(False)).alias("train")]
    return common.map_texts(docs, keep, "doc_id long, train boolean, n_tokens long, n_known long, base_score double, ids binary", f, limit=GROUP)


def _count_level(numbered: DataFrame, model: Model, level: int, least: int) -> None:
    """The n-grams of `level` words that occur at least `least` times, as a level of the trie."""
    spark = numbered.sparkSession
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), model.tokens // SEGMENT)
    size, bounds = model.words + 1, _bounds(model, level, shards)
    cut = np.unique(bounds[bounds % size != 0] // size)  # the contexts that lie in several files

    def run(batches):
        held, n, reader = [], 0, _reader(model)

        def flush():
            keys, low = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            if len(keys):
                yield from _dealt(*_summed(keys, None, low if level > 2 else None), bounds)

        for batch in batches:
            for s in _streams(batch.column(0), model):
                context, ok, low = s[:-1], slice(None), np.zeros(0, np.uint16)
                if level > 2:
                    node, prob, _ = list(reader.nodes(s, level - 1))[-1]
                    context = np.r_[-1, node[:-1]]
                    ok = (context >= 0) & (node >= 0) & (s[:-1] != model.end)
                    low = _quantised(prob)[ok]
                held.append((context[ok] * size + s[1:][ok], low))
                n += len(held[-1][0])
                if n >= BLOCK:
                    n = 0
                    yield from flush()
        if held:
            yield from flush()

    def write(batches):
        from pyspark import TaskContext

        got = _merged(batches)
        if not got:
            return
        k, (keys, c, low) = TaskContext.get().partitionId(), got
        keys, c, low = keys[c >= least], c[c >= least], low[c >= least]
        if not len(keys):
            return
        here = cut[np.isin(cut, keys // size)]
        masses = [float((c[keys // size == i] - model.discount).sum()) for i in here.tolist()]
        if len(here):
            elias_fano.save(model.folder, f"part{level}-{k:05d}", {}, {"keys": keys, "c": c, "low": low}, {})
        else:
            _grams_file(model, level, k, keys, c, low, {})
        numbers = [pa.array([x], pa.int64()) for x in (k, int(keys[0]), len(keys), int(c.sum()))]
        yield pa.RecordBatch.from_arrays([*numbers, pa.array([here.tolist()], pa.list_(pa.int64())), pa.array([masses], pa.list_(pa.float64()))], ["k", "first", "n", "mass", "cut", "masses"])

    blobs = numbered.select("ids").mapInArrow(run, "shard int, blob binary").repartitionById(shards, "shard")
    found = sorted(blobs.mapInArrow(write, "k long, first long, n long, mass long, cut array<long>, masses array<double>").collect())
    masses: dict[int, float] = {}
    for r in found:
        for i, m in zip(r.cut, r.masses, strict=True):
            masses[i] = masses.get(i, 0) + m
    unfinished = [r.k for r in found if r.cut]
    if unfinished:

        def finish(batches):
            for batch in batches:
                for i in batch.column(0).to_pylist():
                    k = unfinished[i]
                    part = elias_fano.load(model.folder, f"part{level}-{k:05d}")[0][1]
                    _grams_file(model, level, k, part["keys"], part["c"], part["low"], masses)
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64())], ["k"])

        spark.range(len(unfinished), numPartitions=len(unfinished)).mapInArrow(finish, "k long").collect()
        for k in unfinished:
            elias_fano.remove(model.folder, f"part{level}-{k:05d}")
    files, before = [], set()
    for r in found:
        context = r.first // size
        # a context's own first key leads to the first file that holds a piece of it
        files.append((r.k, int(bounds[r.k - 1]) if context in before else context * size, r.n, r.mass))
        before = set(r.cut)
    _add_level(model, files)


def fit(docs: DataFrame, train: Column, order: int = 3, least: int = 1, discount: float = 0.75) -> tuple[Model, DataFrame]:
    """A model of all rows of docs for which train holds, and all of docs numbered by it (a written table)."""
    import xxhash

    spark = docs.sparkSession
    with common.shuffles_removed(spark):
        model = Model(common.new_path(spark, "trie"), order, discount)
        fs, path = elias_fano.filesystem(model.folder)
        fs.create_dir(path, recursive=True)
        _count_words(docs.filter(F.coalesce(train, F.lit(False))), model, max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions()))
        model.tokens = model.totals[0]
        model.words = model.nodes[0]
        model.end = int(Trie(model).word_ids(np.array([xxhash.xxh64_intdigest(b"", 42) >> 2], np.int64))[0])
        numbered = common.written(number(docs, model, train), "numbered")
        for level in range(2, order + 1):
            if model.nodes[-1] * (model.words + 2) >= 1 << 63:
                raise ValueError("the trie's keys exceed 63 bits")
            _count_level(numbered.filter("train"), model, level, least)
    return model, numbered


def score(numbered: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score of every numbered text."""
    names = ["doc_id", "n_tokens", "n_known", "base_score"]

    def run(batches):
        for batch in batches:
            sizes = batch.column(1).to_numpy()
            at = 0
            for s in _streams(batch.column(4), model):
                reader = _reader(model)
                logp = reader.trie.first_prob(s[1:]).astype(np.float64)
                for node, prob, back in reader.nodes(s, model.order):
                    logp = np.where(node >= 0, prob, back + logp)
                ends = np.cumsum(sizes[at:])
                n = int(np.searchsorted(ends, len(logp))) + 1
                starts = np.r_[0, ends[: n - 1]]
                yield pa.RecordBatch.from_arrays([*batch.slice(at, n).columns[:4], pa.array(np.add.reduceat(logp, starts))], [*names, "score"])
                at += n

    return numbered.select(*names, "ids").mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")
