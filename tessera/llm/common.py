"""Shared helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.lineage import cut, drop, shared_dir  # noqa: F401  drop is the operators' too
from tessera.operators.names import fresh  # noqa: F401

#: Whole texts are handled in groups of about so many bytes inside a Python worker.
GROUP_BYTES = 4 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_removed(spark: SparkSession):
    """Queries made and run within remove their shuffle files when they are done: for those whose results are written."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def written(df: DataFrame, tag: str, instead: Iterable[DataFrame] = ()) -> DataFrame:
    """The frame, written to the shared folder and read again: its lineage is cut. Tables it stands instead of are deleted."""
    return cut(df, tag, instead)


def text_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def grouped(sizes: list[int], limit: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of rows whose sizes add up to about limit; a larger row stands alone."""
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def map_texts(docs: DataFrame, keep: list[str], schema: str, f: Callable, text_col: str = "text", limit: int = GROUP_BYTES) -> DataFrame:
    """mapInArrow over the kept columns and the text: f gets batches in groups of bounded bytes.

    f(batch, texts) returns an Arrow batch or table of ``schema``, texts being UTF-8 bytes: bytes of a text that are
    not UTF-8 read as U+FFFD.
    """
    frame = docs.select(*keep, F.make_valid_utf8(text_col).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            lengths = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_pylist()
            for a, b in grouped(lengths, limit):
                part = batch.slice(a, b - a)
                out = f(part, text_bytes(part.column(part.num_columns - 1)))
                yield from out.to_batches() if isinstance(out, pa.Table) else [out]
        release()

    import pyarrow.compute  # noqa: F401

    return frame.mapInArrow(run, schema)


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def release() -> None:
    """Gives memory that a Python worker has freed back to the system: workers outlive the tasks they run."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # a C library without it
        pass


_sole: dict = {}


def sole(key, make: Callable):
    """make()'s result, kept for the next call with the key; a Python worker keeps one such object at a time."""
    if key not in _sole:
        _sole.clear()
        release()
        _sole[key] = make()
    return _sole[key]


class _Index(dict):
    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


class Store:
    """The ids of parts of texts, each different part encoded once.

    encode(parts) returns the ids of all parts in a row and the number of each. Beyond max_parts parts or
    max_chars characters, parts that were met once are forgotten, and all if that is not enough.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], max_parts: int = 500_000, max_chars: int = 12_000_000) -> None:
        self.encode, self.max_parts, self.max_chars = encode, max_parts, max_chars
        self.index, self.chars, self.used = _Index(), 0, 0
        self.flat = np.zeros(1 << 16, np.int32)
        self.starts, self.counts, self.hits = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def _forget(self) -> None:
        for least in (2, 4, 1 << 30):
            keep = np.nonzero(self.hits >= least)[0]
            keys = list(self.index)
            kept = [keys[i] for i in keep.tolist()]
            chars = sum(map(len, kept))
            if len(kept) <= self.max_parts // 2 and chars <= self.max_chars // 2:
                break
        n = self.counts[keep].astype(np.int64)
        ends = np.cumsum(n)
        self.used = int(n.sum())
        ids = self.flat[np.repeat(self.starts[keep] - (ends - n), n) + np.arange(self.used)]
        self.flat = np.concatenate([ids, np.zeros(1 << 16, np.int32)])
        self.index, self.chars = _Index(zip(kept, range(len(kept)), strict=True)), chars
        self.starts, self.counts, self.hits = ends - n, self.counts[keep], np.zeros(len(keep), np.int32)

    def ids(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, given as lists of parts, in a row, and the number of each text's."""
        if len(self.index) > self.max_parts or self.chars > self.max_chars:
            self._forget()
        known = len(self.index)
        per_text = np.fromiter(map(len, texts), np.int64, len(texts))
        at = np.fromiter(map(self.index.__getitem__, chain.from_iterable(texts)), np.int64, int(per_text.sum()))
        if len(self.index) > known:
            fresh = list(self.index)[known:]
            self.chars += sum(map(len, fresh))
            ids, counts = self.encode(fresh)
            need = self.used + len(ids)
            if need > len(self.flat):
                self.flat = np.concatenate([self.flat[: self.used], np.zeros(need + need // 2 - self.used, np.int32)])
            self.flat[self.used : need] = ids
            self.starts = np.concatenate([self.starts, self.used + np.cumsum(counts) - counts])
            self.counts = np.concatenate([self.counts, counts.astype(np.int32)])
            self.hits = np.concatenate([self.hits, np.zeros(len(fresh), np.int32)])
            self.used = need
        self.hits += np.bincount(at, minlength=len(self.hits)).astype(np.int32)
        n = self.counts[at].astype(np.int64)
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(self.starts[at] - (ends - n), n) + np.arange(total)]
        return ids, np.diff(np.r_[0, ends][np.r_[0, np.cumsum(per_text)]])
