"""Approximate nearest neighbours by multi-index hashing.

``fit`` learns rotations (iterative quantisation of the centred, normalised vectors, from several starts)
whose signs are a vector's binary code, and the Hamming radius within which a given share of the
nearest neighbours of a sample lies. It uses a bounded sample of ``rows`` vectors, drawn by a hash of
the id; every vector is indexed.

``search`` deals the indexed vectors into shards of about ``shard_rows``. In a shard every 16-bit
substring of the codes has an index of its own, from each value to its rows. By the pigeonhole principle a
code within the radius agrees with the query's in some substring up to its part of the radius, so probing
the values within that part, in all substrings, retrieves every code within the radius. Where the probes would
retrieve as many rows as there are, the codes are compared without them. Codes are then compared whole,
and the survivors ranked by the cosine of the original vectors in double precision. Each shard is sent to
one task (to a few where there are fewer shards than tasks) and indexed there once; queries come to it in
blocks behind it. A query that finds fewer than k rows in all shards is searched again with the radius of
the whole code, which retrieves every row.

Defined cases: vectors that are null, zero, of another length than most, or hold null or non-finite
components neither search nor are found; rows with a null id take no part; each row of a repeated id is a
query of its own, and a candidate for the others; ties go to the smaller id; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

WORD = 16
#: All values of a substring by their number of set bits, and how many have up to 0, 1, .. 16.
_FLIPS = np.argsort(np.bitwise_count(np.arange(1 << WORD, dtype=np.uint32)), kind="stable")
_UPTO = np.cumsum(np.bincount(np.bitwise_count(np.arange(1 << WORD, dtype=np.uint32))))


@dataclass(frozen=True)
class Codes:
    """Centre, rotations and the learned radius."""

    centre: np.ndarray
    rotation: np.ndarray
    radius: int

    @property
    def bits(self) -> int:
        return self.rotation.shape[1]

    def of(self, x: np.ndarray) -> np.ndarray:
        """Codes of normalised vectors as rows of 16-bit substrings."""
        parts = [np.packbits((x[a : a + 4096] - self.centre) @ self.rotation > 0, axis=1) for a in range(0, max(1, len(x)), 4096)]
        return np.concatenate(parts).view(np.uint16)


def valid(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id, v: the vectors that take part, of floats where they are, else of doubles."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kind = "float" if table.schema[vec_col].dataType.elementType.typeName() == "float" else "double"
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(f"array<{kind}>").alias("v"))
    rows = rows.filter(F.col("id").isNotNull() & F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False)))
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("v") == (length.n if length else 0))


def _scaled(x: np.ndarray) -> np.ndarray:
    """The vectors times powers of two that bring their largest components to about one: no cosine changes, no square overflows."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=-1, keepdims=True))[1])


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit(rows: DataFrame, bits: int = 256, sample: int = 10_000, k: int = 5, share: float = 0.97) -> Codes | None:
    """Codes from a sample of rows (id, v); None without any row."""
    x = np.array([r.v for r in rows.orderBy(F.xxhash64("id"), "id").limit(sample).collect()], np.float64)
    if not len(x):
        return None
    x = _unit(x)
    centre, dim = x.mean(axis=0), x.shape[1]
    bits = max(64, -(-bits // 64) * 64)
    parts = []
    for start in range(-(-bits // dim)):
        r = np.linalg.qr(np.random.default_rng(start).standard_normal((dim, dim)))[0]
        for _ in range(20):
            u, _, w = np.linalg.svd(np.sign((x - centre) @ r).T @ (x - centre))
            r = (u @ w).T
        parts.append(r)
    codes = Codes(centre, np.hstack(parts)[:, :bits], bits)
    if len(x) <= k:
        return codes
    q = x[:400]
    near = q @ x.T
    near[np.arange(len(q)), np.arange(len(q))] = -2
    top = np.argpartition(-near, k - 1, axis=1)[:, :k]
    c = codes.of(x)
    away = np.bitwise_count(c[: len(q), None] ^ c[top]).sum(axis=2)
    return Codes(codes.centre, codes.rotation, int(np.quantile(away, share)))


class Shard:
    """The substring indexes of some rows: their numbers, ids and vectors."""

    def __init__(self, codes: Codes, rows: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        self.codes, self.rows, self.ids, self.x = codes, rows, ids, _scaled(x.astype(np.float64))
        self.norms = np.linalg.norm(self.x, axis=1)
        self.c = codes.of(_unit(self.x))
        self.index = []
        for j in range(self.c.shape[1]):
            first = np.r_[0, np.cumsum(np.bincount(self.c[:, j], minlength=1 << WORD))]
            self.index.append((first.astype(np.int32), np.argsort(self.c[:, j], kind="stable").astype(np.int32)))
        self.whole = self.c.view(np.uint64)

    def probed(self, code: np.ndarray, radius: int) -> np.ndarray | None:
        """The rows that some substring's probes retrieve; None if they would be as many as there are rows."""
        part, extra = divmod(radius, len(self.index))
        found, total = [], 0
        for j, (first, order) in enumerate(self.index):
            r = part if j <= extra else part - 1
            if r < 0:
                continue
            values = _FLIPS[: _UPTO[min(r, WORD)]] ^ int(code[j])
            a = first[values]
            n = first[values + 1] - a
            some = np.nonzero(n)[0]
            a, n = a[some], n[some].astype(np.int64)
            total += int(n.sum())
            if total >= len(self.ids):
                return None
            found.append(order[np.repeat(a - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))])
        return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """The rows whose code is within radius of a code."""
        rows = self.probed(code, radius)
        whole = self.whole if rows is None else self.whole[rows]
        near = np.nonzero(np.bitwise_count(whole ^ code.view(np.uint64)[None, :]).sum(axis=1) <= radius)[0]
        return near if rows is None else rows[near]

    def nearest(self, own: int, q: np.ndarray, code: np.ndarray, k: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and cosines of the k nearest rows within the radius but for the query's own row."""
        rows = self.within(code, radius)
        rows = rows[self.rows[rows] != own]
        q = _scaled(q.astype(np.float64))
        length = np.linalg.norm(q)
        if len(rows) > k:  # a product of matrices rounds by a row's place: it only tells which rows to look at
            about = self.x[rows] @ q / (self.norms[rows] * length)
            rows = rows[about >= np.partition(about, len(about) - k)[len(about) - k] - 1e-9]
        score = (self.x[rows] * q).sum(axis=1) / (self.norms[rows] * length)
        order = np.lexsort((self.ids[rows], -score))[:k]
        return self.ids[rows[order]], score[order]


def _packed(rows: DataFrame, key, tag: str, size: int) -> DataFrame:
    """key, rows, ids, vectors: the rows (row, id, v) of each key packed into binary rows of at most size rows each."""

    def pack(batches):
        held: dict[int, list] = {}

        def row(k):
            parts = [np.concatenate(x) for x in zip(*held.pop(k), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in parts)], ["key", "rows", "ids", "vectors"])

        for batch in batches:
            keys, number, ids = (batch.column(i).to_numpy() for i in range(3))
            x = batch.column(3).flatten().to_numpy().reshape(len(ids), -1)
            for k in np.unique(keys).tolist():
                held.setdefault(k, []).append((number[keys == k], ids[keys == k], x[keys == k]))
                if sum(len(i) for i, *_ in held[k]) >= size:
                    yield row(k)
        for k in list(held):
            yield row(k)

    packed = rows.select(key.alias("key"), "row", "id", "v").repartition("key").mapInArrow(pack, "key long, rows binary, ids binary, vectors binary")
    return common.written(packed, tag)


def search(rows: DataFrame, queries: DataFrame | Column, codes: Codes | None, k: int = 5, shard_rows: int = 50_000, block: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows (id, v) found of each query.

    queries: a condition that picks rows, which are then no candidates of their own; or a table of others (id, v).
    """
    spark, schema = rows.sparkSession, "query long, query_id long, vec_id long, score double"
    if codes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    numbered = lambda df, tag: common.written(df.withColumn("row", F.monotonically_increasing_id()), tag)
    rows = numbered(rows, "rows")
    among = isinstance(queries, Column)
    queries = rows.filter(queries) if among else numbered(queries, "queries")
    kind = np.dtype(np.float32 if rows.schema["v"].dataType.elementType.typeName() == "float" else np.float64)
    queries = queries.withColumn("v", F.col("v").cast(rows.schema["v"].dataType)) if kind == np.float64 else queries
    shards = max(1, -(-rows.count() // shard_rows))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    copies = max(1, tasks // shards)  # of each shard, so that all tasks have one
    index = _packed(rows, F.pmod(F.xxhash64("row"), F.lit(shards)), "index", shard_rows)

    def found(wanted: DataFrame, radius: int) -> DataFrame:
        blocks = max(copies, -(-wanted.count() // block))
        packed = _packed(wanted, F.pmod(F.xxhash64("row", F.lit(1)), F.lit(blocks)), "blocks", block)
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))
        columns = ["at", "behind", "rows", "ids", "vectors"]
        first = index.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).withColumn("at", F.col("key") * copies + F.col("copy")).withColumn("behind", F.lit(False))
        later = packed.withColumn("shard", every).withColumn("at", F.col("shard") * copies + F.pmod("key", F.lit(copies))).withColumn("behind", F.lit(True))
        dealt = first.select(columns).unionAll(later.select(columns)).repartitionById(max(tasks, 1), F.pmod("at", F.lit(tasks)).cast("int")).sortWithinPartitions("at", "behind")

        def run(batches):
            here, held = None, []
            for batch in batches:
                for i in range(batch.num_rows):
                    at, behind, number, ids, x = (batch.column(c)[i].as_py() for c in range(5))
                    number, ids = np.frombuffer(number, np.int64), np.frombuffer(ids, np.int64)
                    x = np.frombuffer(x, kind).reshape(len(ids), -1)
                    if at != here:
                        here, held = at, []
                    if not behind:
                        held.append(Shard(codes, number, ids, x))
                        continue
                    c = codes.of(_unit(x.astype(np.float64)))
                    for shard in held:
                        got = [shard.nearest(int(number[a]) if among else -1, x[a], c[a], k, radius) for a in range(len(ids))]
                        n = [len(g[0]) for g in got]
                        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(number, n)), pa.array(np.repeat(ids, n)), pa.array(np.concatenate([g[0] for g in got])), pa.array(np.concatenate([g[1] for g in got]))], ["query", "query_id", "vec_id", "score"])

        return common.written(dealt.mapInArrow(run, schema), "found")

    first = found(queries, codes.radius)
    enough = first.groupBy("query").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k).select(F.col("query").alias("row"))
    short = common.written(queries.join(enough, "row", "left_anti"), "short")
    if not short.isEmpty():
        again = found(short.select(*queries.columns), codes.bits)
        first = first.join(short.select(F.col("row").alias("query")), "query", "left_anti").unionAll(again)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return first.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
