"""Token ids in Arrow stream files of fixed-size lists.

``encode`` tokenizes whole texts (an end id behind each document). ``write`` deals the documents by
ascending id into shards of consecutive ids and writes, for every shard, two Arrow stream files:

* ``shard-NNNNN.arrow``: record batches of ``ids fixed_size_list<uintN>[length]`` and
  ``mask fixed_size_list<bool>[length]``. All sequences have equal length and every batch but the last
  equally many, so sequence ``i`` lies at a computable place of a memory map and is read without a copy.
  Documents follow each other without a gap; only the tail of a shard's last sequence is padding,
  which the mask tells.
* ``shard-NNNNN.docs.arrow``: ``doc_id, start, n_tokens`` of the shard's documents in order, start
  counted from the shard's first token.

A shard is written to a name of its task's own and renamed, so a task that runs twice leaves the same
files. ``read`` maps the files and gives each document's ids back from them.

Defined cases: a null text counts as empty and consists of the end id; documents with a null id
come first; rows that repeat an id all stay, ordered by their text's hash; an empty table writes no
shard and reads as an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import uuid
from bisect import bisect_right
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Texts with two blanks in a row are cut only at single blanks between other characters.
_SAFE = re.compile(r"(?<=\S) (?=\S)")
_TWO = re.compile(r"\s\s")
#: Bytes of text in a shard, where that makes more shards than there are tasks.
SHARD_BYTES = 256 << 20
#: Words that go to the tokenizer in one string.
JOINED = 64


class WordEncoder:
    """A byte-level BPE tokenizer of the tokenizers library, asked once for each different part.

    A byte-level BPE never joins what stands before a single blank (or line break) between two other
    characters with what stands behind it, so the ids of a text are those of its parts cut there. A
    part is a word without the blank in front of it, or, marked by a line break, a text of its own.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.line_break = self.tokenizer.encode("\n", add_special_tokens=False).ids[0]
        self.store = common.Store(self._ids, max_parts=600_000, max_chars=15_000_000)

    def _ids(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words without line breaks or blanks at their end are asked for many at a time, a line break in front of each."""
        alone = [("\n" in p or p[-1].isspace()) for p in parts]
        words = [" " + p for p, a in zip(parts, alone, strict=True) if not a]
        others = [p[1:] if p[0] == "\n" else " " + p for p, a in zip(parts, alone, strict=True) if a]
        joined = ["\n" + "\n".join(words[i : i + JOINED]) for i in range(0, len(words), JOINED)]
        # the library's results are some hundred bytes a token: few at a time
        some = (self.tokenizer.encode_batch_fast(joined[i : i + 64], add_special_tokens=False) for i in range(0, len(joined), 64))
        flat = np.concatenate([np.zeros(0, np.int32), *(np.fromiter(chain.from_iterable(e.ids for e in x), np.int32) for x in some)])
        breaks = np.nonzero(flat == self.line_break)[0]
        single = [e.ids for e in self.tokenizer.encode_batch_fast(others, add_special_tokens=False)]
        mask, counts = np.array(alone, bool), np.zeros(len(parts), np.int64)
        counts[~mask] = np.diff(np.r_[breaks, len(flat)]) - 1
        counts[mask] = np.fromiter(map(len, single), np.int64, len(single))
        whose = np.repeat(mask, counts)
        ids = np.zeros(int(counts.sum()), np.int32)
        ids[~whose] = np.delete(flat, breaks)
        ids[whose] = np.fromiter(chain.from_iterable(single), np.int32)
        return ids, counts

    @staticmethod
    def parts(text: str) -> list[str]:
        if not text:
            return []
        if _TWO.search(text) or text[0].isspace() or text[-1].isspace():
            return _SAFE.split("\n" + text)
        return ("\n" + text.replace("\n", " \n\n \n")).split(" ")

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the number of each."""
        return self.store.ids([self.parts(t) for t in texts])


def encoder(path: str) -> WordEncoder:
    return common.sole(("tokens", path), lambda: WordEncoder(path))


@lru_cache(maxsize=4)
def _dtype(path: str) -> np.dtype:
    return np.dtype(np.uint16 if encoder(path).size <= 1 << 16 else np.uint32)


def encode(docs: DataFrame, tokenizer: str, end_id: int = 0, bounds: list[tuple] | None = None) -> DataFrame:
    """doc_id, tie, ids, shard: the ids with the end id as packed little-endian integers of the vocabulary's width, and how many bounds lie up to the row's place."""
    bounds = bounds or []

    def f(batch: pa.RecordBatch, texts: list[bytes]) -> pa.RecordBatch:
        kind = _dtype(tokenizer)
        ids, counts = encoder(tokenizer).encode([t.decode() for t in texts])
        ends = np.cumsum(counts)
        packed = np.insert(ids.astype(kind), ends, end_id).tobytes()
        cuts = np.r_[0, ends + np.arange(1, len(ends) + 1)] * kind.itemsize
        out = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(packed)])
        places = ((i is not None, i or 0, t) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        shard = pa.array([bisect_right(bounds, p) for p in places], pa.int32())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), out, shard], ["doc_id", "tie", "ids", "shard"])

    keep = [F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie")]
    return common.map_texts(docs, keep, "doc_id long, tie long, ids binary, shard int", f)


def _filesystem(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", folder) if folder.startswith("file:") else folder) if ":" in folder else (fs.LocalFileSystem(), folder)


class _Shard:
    """Writes one shard's two files as documents come in, with one batch of sequences in memory."""

    def __init__(self, folder: str, name: str, kind: np.dtype, length: int, per_batch: int) -> None:
        self.fs, self.path = _filesystem(folder)
        self.name, self.length, self.room, self.kind = name, length, length * per_batch, kind
        self.mine = uuid.uuid4().hex
        value = pa.from_numpy_dtype(kind)
        self.schema = pa.schema([("ids", pa.list_(value, length)), ("mask", pa.list_(pa.bool_(), length))], {"length": str(length), "rows_per_batch": str(per_batch)})
        self.docs_schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.sink = self.fs.open_output_stream(f"{self.path}/.{name}.{self.mine}")
        self.out = pa.ipc.new_stream(self.sink, self.schema)
        self.docs_sink = self.fs.open_output_stream(f"{self.path}/.{name}.docs.{self.mine}")
        self.docs = pa.ipc.new_stream(self.docs_sink, self.docs_schema)
        self.held: list[np.ndarray] = []
        self.n_held = self.total = self.n_docs = 0

    def add(self, doc_ids: list, parts: list[np.ndarray]) -> None:
        counts = np.array([len(p) for p in parts], np.int64)
        starts = self.total + np.cumsum(counts) - counts
        self.docs.write_batch(pa.record_batch([pa.array(doc_ids, pa.int64()), pa.array(starts), pa.array(counts)], schema=self.docs_schema))
        self.total += int(counts.sum())
        self.n_docs += len(parts)
        self.held += parts
        self.n_held += int(counts.sum())
        if self.n_held >= self.room:
            flat = np.concatenate(self.held)
            whole = len(flat) // self.room * self.room
            for i in range(0, whole, self.room):
                self._batch(flat[i : i + self.room], self.room)
            self.held, self.n_held = [flat[whole:]], len(flat) - whole

    def _batch(self, ids: np.ndarray, valid: int) -> None:
        mask = pa.array(np.arange(len(ids)) < valid)
        self.out.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(ids), self.length), pa.FixedSizeListArray.from_arrays(mask, self.length)], schema=self.schema))

    def close(self) -> None:
        if self.n_held:
            flat = np.concatenate(self.held)
            padded = np.zeros(-(-len(flat) // self.length) * self.length, self.kind)
            padded[: len(flat)] = flat
            self._batch(padded, len(flat))
        for out, sink, mine, name in ((self.out, self.sink, f".{self.name}.{self.mine}", f"{self.name}.arrow"), (self.docs, self.docs_sink, f".{self.name}.docs.{self.mine}", f"{self.name}.docs.arrow")):
            out.close()
            sink.close()
            self.fs.move(f"{self.path}/{mine}", f"{self.path}/{name}")


#: Places that are drawn to find the bounds of shards: at most so many; so many for a task, and one of so many rows.
DRAWN, PER_TASK, ONE_OF = 1_000_000, 60, 2000


def _bounds(docs: DataFrame, tasks: int, shards: int | None) -> tuple[int, list[tuple]]:
    """How many shards, and up to as many places (known, id, tie) less one that cut the rows into shards of like numbers.

    From a sample of bounded size, of the keys and the lengths of the texts; its share is of all rows.
    """
    rows = docs.count()
    wanted = min(DRAWN, max(tasks * PER_TASK, rows // ONE_OF))
    drawn = docs.sample(min(1.0, wanted / max(1, rows)), seed=7).select(F.col("doc_id").isNotNull(), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), F.xxhash64("text"), F.coalesce(F.octet_length("text"), F.lit(0)))
    found = sorted(tuple(r) for r in drawn.collect())
    size = rows * sum(x[3] for x in found) // max(1, len(found))
    n = shards or max(tasks, size // SHARD_BYTES)
    return n, sorted({found[i * len(found) // n][:3] for i in range(1, n)}) if found else []


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, length: int = 2048, per_batch: int = 64, shards: int | None = None) -> DataFrame:
    """Write docs to files in folder, which all executors reach; a row for each shard: shard, n_docs, n_tokens.

    The result is a written table: what it tells is what the tasks that succeeded have written.
    """
    spark = docs.sparkSession
    fs, path = _filesystem(folder)
    fs.create_dir(path, recursive=True)
    # the ids, not the texts, are dealt; bounds come from a pass over the keys, so that texts are encoded once
    n, bounds = _bounds(docs, int(spark.conf.get("spark.sql.shuffle.partitions")), shards)
    dealt = encode(docs, tokenizer, end_id, bounds).repartitionById(n, "shard").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie")

    def run(batches):
        from pyspark import TaskContext

        k, shard = TaskContext.get().partitionId(), None
        kind = _dtype(tokenizer)
        for batch in batches:
            shard = shard or _Shard(folder, f"shard-{k:05d}", kind, length, per_batch)
            column = batch.column(2)
            for a, b in common.grouped([len(x.as_buffer()) for x in column]):
                shard.add(batch.column(0).slice(a, b - a).to_pylist(), [np.frombuffer(x, kind) for x in column.slice(a, b - a).to_pylist()])
        if shard:
            shard.close()
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([shard.n_docs]), pa.array([shard.total])], ["shard", "n_docs", "n_tokens"])

    return common.written(dealt.mapInArrow(run, "shard long, n_docs long, n_tokens long"), "shards")


class Sequences:
    """Random access to the sequences of one shard file, memory-mapped where the file is local."""

    def __init__(self, folder: str, name: str) -> None:
        from pyarrow import fs as pfs

        self.fs, self.path = _filesystem(folder)
        file = f"{self.path}/{name}.arrow"
        self.source = pa.memory_map(file) if isinstance(self.fs, pfs.LocalFileSystem) else pa.BufferReader(self.fs.open_input_file(file).read_buffer())
        reader = pa.ipc.open_stream(self.source)
        self.per_batch, self.length = int(reader.schema.metadata[b"rows_per_batch"]), int(reader.schema.metadata[b"length"])
        self.batches = list(reader)

    def __len__(self) -> int:
        return sum(b.num_rows for b in self.batches)

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """ids (a view of the map) and mask of sequence i."""
        batch, row = self.batches[i // self.per_batch], i % self.per_batch
        ids = batch.column(0).values.to_numpy(zero_copy_only=True)[row * self.length : (row + 1) * self.length]
        return ids, batch.column(1).values.slice(row * self.length, self.length).to_numpy(zero_copy_only=False)

    def tokens(self, start: int, n: int) -> np.ndarray:
        """n ids from token start of the shard on."""
        room, out = self.per_batch * self.length, []
        while n > 0:
            batch = self.batches[start // room].column(0).values.to_numpy(zero_copy_only=True)
            got = batch[start % room : start % room + n]
            out.append(got)
            start, n = start + len(got), n - len(got)
        return out[0] if len(out) == 1 else np.concatenate(out) if out else np.zeros(0, np.uint16)


def read(spark: SparkSession, folder: str, shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, all from the files of the listed shards."""
    listed = shards.select("shard", "n_tokens")
    before = F.coalesce(F.sum("n_tokens").over(_in_order()), F.lit(0)).alias("before")
    listed = listed.select("shard", before)  # a row for each file, not for each document

    def run(batches):
        from zlib import crc32

        for batch in batches:
            for k, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                name = f"shard-{k:05d}"
                seq = Sequences(folder, name)
                with seq.fs.open_input_stream(f"{seq.path}/{name}.docs.arrow") as f:
                    for part in pa.ipc.open_stream(f):
                        start, n = part.column(1).to_numpy(), part.column(2).to_numpy()
                        sums = [crc32(seq.tokens(a, b).astype("<u4").tobytes()) for a, b in zip(start.tolist(), n.tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(start + base), part.column(2), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return listed.repartition(tasks, "shard").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _in_order():
    from pyspark.sql import Window

    return Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
