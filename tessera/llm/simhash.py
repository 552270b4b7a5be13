"""SimHash near-duplicate detection by tiled exact comparison.

1. ``fingerprints``: 64 majority bits of the XXH64 hashes of 3-word shingles.
2. ``links``: the *distinct* fingerprints are dealt into tiles whose key is the tuple of
   population counts of the fingerprint's sub-words. Two fingerprints within ``radius`` bits have
   population-count tuples within an L1 distance of ``radius``, so a tile meets only the tiles in
   that neighbourhood; all other tile pairs are skipped. Met pairs are compared exactly, with
   numpy exclusive-or and bit counts. Each comparison returns a spanning forest of the links it
   found: no link between different fingerprints loses its effect on the components, and a group
   of near copies costs rows in proportion to its size.
3. ``components``: smallest-label propagation with pointer jumping over those forests.

``similar`` and ``one_of_each`` hold documents against a similarity of their shingle sets instead: the same tiles, now
of classes of set sizes, find candidates by 256 bits, and the sets themselves decide about each. The radius follows
from the exact probability that a bit differs between sets of just that similarity, so that it misses a pair in a
thousand million, while two unrelated sets come that near more rarely still.

Defined cases: a null text counts as empty; an empty text has fingerprint zero and links like any
other; rows with a null id are fingerprinted and linked, and their component is that of their
fingerprint's smallest non-null id (null if it has none); repeated ids keep their rows; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SEED = 42
#: Fingerprints in a tile: a pair of tiles is compared in one step of bounded memory.
TILE = 8192


def _fingerprint(text: bytes, words: int) -> int:
    import xxhash

    w = text.lower().split()  # of bytes: A-Z, and space or \t-\r
    if not w:
        return 0
    n = max(1, len(w) - words + 1)
    h = xxhash.xxh64_intdigest
    total = np.zeros(64, np.int64)
    for a in range(0, n, 1 << 16):
        z = min(n, a + (1 << 16))
        part = w[a : z + words - 1]
        hashes = np.array([h(b" ".join(x), SEED) for x in zip(*(part[i:] for i in range(words)), strict=False)] or [h(b" ".join(part), SEED)], dtype=">u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, fp: the fingerprint as a signed long."""

    def f(batch: pa.RecordBatch, texts: list[bytes]) -> pa.RecordBatch:
        fp = np.array([_fingerprint(t, words) for t in texts], dtype=np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], ["doc_id", "fp"])

    return common.map_texts(docs, [F.col("doc_id").cast("long").alias("doc_id")], "doc_id long, fp long", f)


def _parts(n: int) -> int:
    """Sub-words whose population counts key the tiles: more, smaller tiles for more rows. All choices are exact."""
    return 1 if n <= 20_000 else 2 if n <= 2_000_000 else 4


def _counts(fp: np.ndarray, parts: int) -> np.ndarray:
    width = {1: np.uint64, 2: np.uint32, 4: np.uint16}[parts]
    return np.bitwise_count(fp.view(width)).reshape(len(fp), parts).astype(np.int64)


def _joined(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Labels (each its component's least place) after links between places u and v."""
    while len(u):
        lu, lv = label[u], label[v]
        keep = lu != lv
        u, v = u[keep], v[keep]
        np.minimum.at(label, np.maximum(lu, lv)[keep], np.minimum(lu, lv)[keep])
        while (label[label] != label).any():
            label = label[label]
    return label


def _forest(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within radius between two tiles (or within one)."""
    nodes = a if same else np.concatenate([a, b])
    label = np.arange(len(nodes))
    off = 0 if same else len(a)
    step = max(1, (1 << 20) // max(1, len(b)))
    for i in range(0, len(a), step):
        u, v = np.nonzero(np.bitwise_count(a[i : i + step, None] ^ b[None, :]) <= radius)
        u, v = u + i, v + off
        u, v = (u[u < v], v[u < v]) if same else (u, v)
        label = _joined(label, u, v)
    moved = np.nonzero(label != np.arange(len(nodes)))[0]
    return nodes[moved], nodes[label[moved]]


def _dealt(rows: DataFrame, key: str) -> DataFrame:
    """Rows by cell, crowded cells dealt over tasks: a tile's worth each, or a few parts where that is more."""
    # a row for each cell, of which there are at most 17 ** 4
    counts = F.broadcast(rows.groupBy("cell").agg(F.count(F.lit(1)).alias("__n")))
    salts = F.greatest(F.ceil(F.col("__n") / TILE), F.least(F.ceil(F.col("__n") / 512), F.lit(8)))
    dealt = rows.join(counts, "cell").withColumn("__salt", F.pmod(F.xxhash64(key), salts)).repartition("cell", "__salt")
    return dealt.select(*rows.columns)


def _met(tiles: DataFrame, offsets: list[int]) -> DataFrame:
    """a, b: each pair of tiles (cell, tile) whose cells differ by an offset, of those at offset 0 each pair once, dealt evenly."""
    tiles = common.written(tiles.withColumn("id", F.xxhash64("tile")), "tiles")
    sent = tiles.select("id", "tile", F.explode(F.array(*[F.struct((F.col("cell") + o).alias("at"), F.lit(o == 0).alias("home")) for o in offsets])).alias("o"))
    return (
        sent.select(F.col("o.at").alias("cell"), "o.home", F.col("id").alias("id_a"), F.col("tile").alias("a"))
        .join(tiles.select("cell", F.col("id").alias("id_b"), F.col("tile").alias("b")), "cell")
        .filter("not home or id_a <= id_b")
        .repartition(int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id_a", "id_b")
        .select("a", "b")
    )


def _pairs(batches) -> Iterator[tuple[bytes, bytes]]:
    """The pairs of tiles of a task, one at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
    common.release()


def links(distinct: DataFrame, n: int, radius: int = 3) -> DataFrame:
    """a, b: edges whose components are those of all pairs of fingerprints within radius bits.

    distinct: one column fp of different fingerprints, n: about how many.
    """
    parts = _parts(n)
    half = [o for o in product(range(-radius, radius + 1), repeat=parts) if sum(map(abs, o)) <= radius and o >= (0,) * parts]
    base = 65
    pops = [F.bit_count(F.shiftrightunsigned("fp", 64 // parts * i).bitwiseAND((1 << 64 // parts) - 1 if parts > 1 else -1)) for i in range(parts)]
    key = sum((p.cast("long") * base**i for i, p in enumerate(pops)), F.lit(0).cast("long"))
    # pack fingerprints into tiles: a row for each cell of at most TILE fingerprints
    cells = distinct.select(key.alias("cell"), "fp")

    def pack(batches):
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            c, x = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            order = np.argsort(c, kind="stable")
            c, x = c[order], x[order]
            cut = np.nonzero(np.diff(c))[0] + 1
            for k, v in zip(c[np.r_[0, cut]].tolist() if len(c) else [], np.split(x, cut), strict=False):
                held.setdefault(k, []).append(v)
        for k, vs in held.items():
            v = np.concatenate(vs)
            tiles = [np.sort(v[i : i + TILE]).tobytes() for i in range(0, len(v), TILE)]
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(tiles), pa.int64()), pa.array(tiles, pa.binary())], ["cell", "tile"])

    tiles = _dealt(cells, "fp").mapInArrow(pack, "cell long, tile binary")
    met = _met(tiles, [sum(x * base**i for i, x in enumerate(o)) for o in half])

    def compare(batches):
        for x, y in _pairs(batches):
            a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            pa_, pb = _counts(a, parts), _counts(b, parts)
            gap = np.maximum(0, np.maximum(pa_.min(0) - pb.max(0), pb.min(0) - pa_.max(0))).sum()
            if gap > radius:
                continue
            u, v = _forest(a, b, radius, x == y)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["a", "b"])

    return met.mapInArrow(compare, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, root for each node of the edges: root names its component.

    Each round every node takes the smallest label of itself and its neighbours, and edges are then
    re-drawn between labels (contraction), so a component of n nodes takes about log n rounds.
    """
    edges = common.written(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    nodes = common.written(both.select(F.col("a").alias("node")).distinct().select("node", F.col("node").alias("root")), "nodes")
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # each label hooks to its smallest neighbour if that is smaller; chains are then followed once
        hook = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("to"))
        jump = hook.select(F.col("a").alias("to"), F.col("to").alias("next"))
        hook = common.written(hook.join(jump, "to").select("a", F.col("next").alias("to")), "hook")
        nodes = common.written(nodes.join(hook, nodes.root == hook.a, "left").select("node", F.coalesce("to", "root").alias("root")), "nodes", instead=[nodes])
        e = edges.join(hook.select("a", F.col("to").alias("x")), "a").join(hook.select(F.col("a").alias("b"), F.col("to").alias("y")), "b")
        edges = common.written(e.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges", instead=[edges, hook])
    common.drop(edges)
    return nodes


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, fp (signed long), component_id: the smallest doc_id reachable over links."""
    prints = common.written(fingerprints(docs, words), "prints")
    classes = common.written(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")), "classes")
    n = classes.count()
    roots = components(links(classes.select("fp"), n, radius))
    joined = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    joined = common.written(joined, "roots")
    names = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    named = joined.join(names, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


# Similarity of shingle sets. Fingerprints of 256 bits, compared tile by tile, find the candidates; the sets decide.

SET_TILE_BYTES, SET_TILE = 4 << 20, 1024
#: Words of a fingerprint, and of what is compared first.
CODE, FIRST = 4, 2
#: The probability with which a pair of just the similarity asked for may differ in more bits than the radius.
MISS = 1e-9


def _binomial(n: int) -> np.ndarray:
    return np.array([math.comb(n, k) for k in range(n + 1)], float) / 2.0**n


@lru_cache(maxsize=8)
def _disagreement(least: float) -> tuple[tuple[int, float], ...]:
    """(size, p): the greatest probability that a majority bit differs between two sets of the similarity, the smaller of up to so many elements.

    Bits of hashes are fair coins: a bit's probability follows from the binomial distributions of the common and
    the own elements. It falls as sets grow.
    """
    out = []
    for n in (*range(1, 33), 48, 64, 96, 128, 192, 256):
        worst = 0.0
        for m in range(n, math.floor(n / least + 1e-9) + 1):
            both = math.ceil(least * (n + m) / (1 + least) - 1e-9)
            if both > n or n == m == both:
                continue
            c, a, b = _binomial(both), np.r_[0, np.cumsum(_binomial(n - both))], np.r_[0, np.cumsum(_binomial(m - both))]
            k = np.arange(both + 1)
            # the bit is set if more than half the elements set it; below: not set, given k of the common ones
            low_a, low_b = (x[np.clip(size // 2 - k + 1, 0, len(x) - 1)] for x, size in ((a, n), (b, m)))
            worst = max(worst, float((c * (low_a * (1 - low_b) + low_b * (1 - low_a))).sum()))
        out.append((n, worst))
    worst = np.maximum.accumulate([p for _, p in out[::-1]])[::-1]  # of this size and all greater ones
    return tuple((n, float(p)) for (n, _), p in zip(out, worst, strict=True))


@lru_cache(maxsize=4096)
def radius_of(size: int, least: float, bits: int) -> int:
    """So many bits hold all but MISS of the pairs of similarity `least` whose smaller set has `size` elements."""
    p = next((q for n, q in reversed(_disagreement(least)) if n <= size), 0.0)
    total, r = 0.0, bits
    while r > 0:  # the distribution's upper tail
        total += math.comb(bits, r) * p**r * (1 - p) ** (bits - r)
        if total > MISS:
            return r
        r -= 1
    return 0


def _set(text: bytes, words: int) -> tuple[int, np.ndarray]:
    """A hash of the text's words, and the sorted different hashes of its shingles."""
    import xxhash

    w = text.lower().split()
    h = xxhash.xxh64_intdigest
    node = h(b" ".join(w))
    if len(w) <= words:
        return node, np.array([node] if w else [], np.uint64)
    return node, np.unique(np.fromiter((h(b" ".join(x), SEED) for x in zip(*(w[i:] for i in range(words)), strict=False)), np.uint64, len(w) - words + 1))


def _code(hashes: np.ndarray) -> list[int]:
    """Majority bits of the hashes, and of other mixings of them."""
    out, x = [], hashes
    for _ in range(CODE):
        total = np.zeros(64, np.int64)
        for a in range(0, len(x), 1 << 16):
            total += np.unpackbits(x[a : a + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        out.append(int.from_bytes(np.packbits(total * 2 > len(x)).tobytes(), "big"))
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        x = x ^ (x >> np.uint64(29))
    return out


def _candidates(a: tuple, b: tuple, same: bool, least: float):
    """Pairs of places (in blocks) of two tiles (nodes, sizes, codes) that may be similar."""
    (_, na, ca), (_, nb, cb) = a, b
    if not len(na) or not len(nb):
        return
    size = min(int(na.min()), int(nb.min()))
    first, whole = radius_of(size, least, 64 * FIRST), radius_of(size, least, 64 * CODE)
    pa_, pb = np.bitwise_count(ca[:, :FIRST]).sum(axis=1), np.bitwise_count(cb[:, :FIRST]).sum(axis=1)
    if max(int(pa_.min()) - int(pb.max()), int(pb.min()) - int(pa_.max())) > first:
        return
    fa, fb = ([np.ascontiguousarray(c[:, k]) for k in range(FIRST)] for c in (ca, cb))
    step = max(1, (1 << 20) // len(cb))
    for i in range(0, len(ca), step):
        away = np.bitwise_count(fa[0][i : i + step, None] ^ fb[0][None, :])
        for x, y in zip(fa[1:], fb[1:], strict=True):
            away += np.bitwise_count(x[i : i + step, None] ^ y[None, :])
        u, v = np.nonzero(away <= first)
        u = u + i
        ok = np.minimum(na[u], nb[v]) >= least * np.maximum(na[u], nb[v])
        if same:
            ok &= u < v
        u, v = u[ok], v[ok]
        near = np.bitwise_count(ca[u] ^ cb[v]).sum(axis=1) <= whole
        if near.any():
            yield u[near], v[near]


def _first_tile(blob: bytes) -> tuple:
    x = np.frombuffer(blob, np.uint64).reshape(-1, 2 + CODE)
    return x[:, 0], x[:, 1].astype(np.int64), np.ascontiguousarray(x[:, 2:])


def _set_tile(blob: bytes) -> tuple[tuple, list[np.ndarray]]:
    n = int.from_bytes(blob[:8], "little")
    width = 8 * (2 + CODE)
    head = _first_tile(blob[8 : 8 + width * n])
    return head, np.split(np.frombuffer(blob[8 + width * n :], np.uint64), np.cumsum(head[1])[:-1])


def _similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    both = np.concatenate([a, b])
    both.sort()
    common_ = int((both[1:] == both[:-1]).sum())  # within a set all are different
    return common_ >= least * (len(a) + len(b) - common_)


def _verified(a: tuple, sa: list, b: tuple, sb: list, same: bool, least: float) -> list[tuple[int, int]]:
    """Links (nodes) that connect all similar sets of two tiles; pairs that others connect already are not compared."""
    off = 0 if same else len(a[0])
    label = np.arange(off + len(b[0]))
    edges = []

    def compare(u: np.ndarray, v: np.ndarray) -> np.ndarray:
        nonlocal label
        ok = np.array([_similar(sa[i], sb[j], least) for i, j in zip(u.tolist(), v.tolist(), strict=True)], bool)
        edges.extend(zip(a[0][u[ok]].tolist(), b[0][v[ok]].tolist(), strict=True))
        label = _joined(label, u[ok], v[ok] + off)
        return ok

    for u, v in _candidates(a, b, same, least):
        while len(u):
            lu, lv = label[u], label[v + off]
            apart = lu != lv
            u, v, lu, lv = u[apart], v[apart], lu[apart], lv[apart]
            if not len(u):
                break
            # one pair for each two components, which mostly connects them; then the others, some at a time
            one = np.unique(np.stack([np.minimum(lu, lv), np.maximum(lu, lv)]), axis=1, return_index=True)[1]
            failed = one[~compare(u[one], v[one])]
            rest = np.ones(len(u), bool)
            rest[one] = False
            u, v = u[rest], v[rest]
            if len(failed):
                lu, lv = label[u], label[v + off]
                apart = lu != lv
                u, v = u[apart], v[apart]
                compare(u[:256], v[:256])
                u, v = u[256:], v[256:]
    return edges


def similar(docs: DataFrame, words: int = 5, least: float = 0.8) -> DataFrame:
    """doc_id, component_id: the least id reachable over documents whose shingle sets have a Jaccard similarity of at least `least`.

    Cells are classes of set sizes, a factor 1 / least wide: similar sets lie in one class or in two next to each other.
    Documents of the same words are one class from the start. Rows with a null id take no part.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null")
    width = -math.log(least)
    names = [f"c{k}" for k in range(CODE)]
    head = f"node long, size long, {', '.join(f'{c} long' for c in names)}"

    def sketch(texts: list[bytes]) -> list[pa.Array]:
        nodes, sets = zip(*(_set(t, words) for t in texts), strict=True)
        codes = [_code(x) for x in sets]
        columns = [nodes, [len(x) for x in sets], *zip(*codes, strict=True)]
        return [pa.array(np.array(c, np.uint64).view(np.int64)) for c in columns]

    def f(batch: pa.RecordBatch, texts: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), *sketch(texts)], ["doc_id", "node", "size", *names])

    found = common.written(common.map_texts(docs, ["doc_id"], f"doc_id long, {head}", f), "sketches")
    first = [F.first(c).alias(c) for c in ("size", *names)]  # equal within a class
    classes = common.written(found.groupBy("node").agg(F.min("doc_id").alias("least"), *first), "classes")
    cell = F.when(F.col("size") > 0, F.floor(F.log(F.col("size").cast("double")) / width)).otherwise(-9).cast("long")

    def pack(batches):
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            c = batch.column(0).to_numpy()
            rows = np.stack([batch.column(i).to_numpy() for i in range(1, 3 + CODE)], axis=1).view(np.uint64)
            for k in np.unique(c).tolist():
                held.setdefault(k, []).append(rows[c == k])
        for k, parts in held.items():
            rows = np.concatenate(parts)
            rows = rows[np.argsort(np.bitwise_count(rows[:, 2 : 2 + FIRST]).sum(axis=1), kind="stable")]  # tiles of like population counts
            tiles = [rows[i : i + TILE].tobytes() for i in range(0, len(rows), TILE)]
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(tiles), pa.int64()), pa.array(tiles, pa.binary())], ["cell", "tile"])

    rows = classes.filter("size > 0").select(cell.alias("cell"), "node", "size", *names)
    tiles = _dealt(rows, "node").mapInArrow(pack, "cell long, tile binary")

    def link(batches):
        for x, y in _pairs(batches):
            a, b = _first_tile(x), _first_tile(y)
            nodes = a[0] if x == y else np.concatenate([a[0], b[0]])
            label = np.arange(len(nodes))
            for u, v in _candidates(a, b, x == y, least):
                label = _joined(label, u, v + (0 if x == y else len(a[0])))
            moved = np.nonzero(label != np.arange(len(nodes)))[0]
            yield pa.RecordBatch.from_arrays([pa.array(nodes[moved].view(np.int64)), pa.array(nodes[label[moved]].view(np.int64))], ["a", "b"])

    # similar documents are in one component of candidates: only within these do sets meet. Small components share
    # cells; a large one has a cell of its own, which is dealt over tasks
    near = components(_met(tiles, [0, 1]).mapInArrow(link, "a long, b long"))
    buckets = max(1, near.count() // SET_TILE)
    sized = near.join(near.groupBy("root").agg(F.count(F.lit(1)).alias("n")), "root")
    small = F.col("n") <= SET_TILE
    cell = F.when(small, F.pmod(F.xxhash64("root"), F.lit(buckets))).otherwise(F.xxhash64("root"))
    salt = F.when(small, F.lit(0)).otherwise(F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / SET_TILE)))
    chosen = classes.join(sized, "node").select("node", F.col("least").alias("doc_id"), cell.alias("cell"), salt.cast("long").alias("salt"))
    chosen = common.written(chosen, "chosen")

    def sets(batch: pa.RecordBatch, texts: list[bytes]) -> pa.RecordBatch:
        blobs = [_set(t, words)[1].tobytes() for t in texts]
        made = sketch(texts)
        rows = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made, pa.array(blobs, pa.binary())], ["cell", "salt", "node", "size", *names, "hashes"])
        # other texts may repeat the id: only the class's own text belongs in its cell
        return rows.filter(pa.array(made[0].to_numpy() == batch.column(2).to_numpy()))

    whole = common.map_texts(docs.join(chosen, "doc_id"), ["cell", "salt", "node"], f"cell long, salt long, {head}, hashes binary", sets).dropDuplicates(["node"])

    def pack_sets(batches):
        held: dict[tuple[int, int], tuple[list, list]] = {}
        size: dict[tuple[int, int], int] = {}

        def blob(k: tuple[int, int]) -> pa.RecordBatch:
            heads, bodies = held.pop(k)
            size[k] = 0
            data = len(heads).to_bytes(8, "little") + np.array(heads, np.int64).tobytes() + b"".join(bodies)
            return pa.RecordBatch.from_arrays([pa.array([k[0]], pa.int64()), pa.array([data], pa.binary())], ["cell", "tile"])

        for batch in batches:
            for cell_, salt_, *head_, hashes in zip(*(batch.column(i).to_pylist() for i in range(5 + CODE)), strict=True):
                k = cell_, salt_
                heads, bodies = held.setdefault(k, ([], []))
                heads.append(head_)
                bodies.append(hashes)
                size[k] = size.get(k, 0) + len(hashes)
                if len(heads) >= SET_TILE or size[k] >= SET_TILE_BYTES:
                    yield blob(k)
        for k in list(held):
            yield blob(k)

    def decide(batches):
        for x, y in _pairs(batches):
            (a, sa), (b, sb) = _set_tile(x), _set_tile(y)
            edges = _verified(a, sa, b, sb, x == y, least)
            if edges:
                e = np.array(edges, np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], ["a", "b"])

    linked = _met(whole.repartition("cell", "salt").mapInArrow(pack_sets, "cell long, tile binary"), [0]).mapInArrow(decide, "a long, b long")
    roots = components(linked)
    joined = common.written(classes.select("node", "least").join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root")), "roots")
    names = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    named = common.written(joined.join(names, "root").select("node", "component_id"), "named")
    return found.select("doc_id", "node").join(named, "node").select("doc_id", "component_id")


def one_of_each(docs: DataFrame, words: int = 5, least: float = 0.8) -> DataFrame:
    """The documents of smallest id of each component of similar documents, with all their columns.

    A document with a null id stays. Of rows that repeat an id, each stays if the id does.
    """
    name = common.fresh(docs, "__gone")[0]
    gone = similar(docs, words, least).filter("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col("doc_id") == F.col(name), "left_anti")
