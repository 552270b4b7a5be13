"""Elias-Fano coded monotone sequences on numpy arrays, and their memory-mapped files."""

from __future__ import annotations

import json
import os
import re
import uuid

import numpy as np

_ONE = np.uint64(1)
_X55, _X33, _X0F, _X01, _X80 = (np.uint64(int(x * 4, 16)) for x in ("5555", "3333", "0F0F", "0101", "8080"))
#: Place of the (r+1)-th set bit of a byte.
_SELECT = np.array([[[i for i in range(8) if b >> i & 1][r] if r < bin(b).count("1") else 0 for r in range(8)] for b in range(256)], np.uint64)


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """The values' low `width` bits, one behind the other, in 64-bit words (and a spare word)."""
    words = np.zeros((len(values) * width + 63) // 64 + 1, np.uint64)
    if width:
        at = np.arange(len(values), dtype=np.int64) * width
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        v = values.astype(np.uint64)
        np.bitwise_or.at(words, word, v << shift)
        over = np.nonzero(shift.astype(np.int64) + width > 64)[0]
        np.bitwise_or.at(words, word[over] + 1, v[over] >> (np.uint64(64) - shift[over]))
    return words


class EliasFano:
    """A non-decreasing sequence of non-negative integers below `universe`."""

    def __init__(self, arrays: dict[str, np.ndarray], meta: dict) -> None:
        self.n, self.low_bits = meta["n"], meta["low_bits"]
        self.low, self.high, self.ones = arrays["low"], arrays["high"], arrays["ones"]

    @staticmethod
    def build(values: np.ndarray, universe: int) -> tuple[dict[str, np.ndarray], dict]:
        n = len(values)
        bits = max(0, (max(universe, 1) // max(n, 1)).bit_length() - 1)
        values = values.astype(np.int64)
        buckets = (max(universe - 1, 0) >> bits) + 2
        high = np.zeros((n + buckets + 63) // 64 + 1, np.uint64)
        at = (values >> bits) + np.arange(n)
        np.bitwise_or.at(high, at >> 6, _ONE << (at & 63).astype(np.uint64))
        ones = np.r_[0, np.cumsum(np.bitwise_count(high), dtype=np.int64)].astype(np.uint32 if n < 1 << 32 else np.int64)
        low = _pack(values & ((1 << bits) - 1), bits)
        return {"low": low, "high": high, "ones": ones}, {"n": n, "low_bits": bits}

    def _lows(self, i: np.ndarray) -> np.ndarray:
        w = self.low_bits
        if not w:
            return np.zeros(len(i), np.int64)
        at = i * w
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        v = self.low[word] >> shift
        over = shift.astype(np.int64) + w > 64
        v = np.where(over, v | (self.low[word + 1] << ((np.uint64(64) - shift) & np.uint64(63))), v)
        return (v & np.uint64((1 << w) - 1)).astype(np.int64)

    @staticmethod
    def _in_word(words: np.ndarray, r: np.ndarray) -> np.ndarray:
        """Place of the (r+1)-th set bit of each word."""
        r = r.astype(np.uint64)
        pairs = words - ((words >> np.uint64(1)) & _X55)
        fours = (pairs & _X33) + ((pairs >> np.uint64(2)) & _X33)
        upto = ((fours + (fours >> np.uint64(4))) & _X0F) * _X01  # bytewise running counts
        place = np.bitwise_count((((r * _X01) | _X80) - upto) & _X80).astype(np.uint64) << np.uint64(3)
        left = r - (((upto << np.uint64(8)) >> place) & np.uint64(255))
        byte = (words >> place) & np.uint64(255)
        return (place + _SELECT[byte, left]).astype(np.int64)

    def access(self, i: np.ndarray) -> np.ndarray:
        """The values at places i."""
        i = np.asarray(i, np.int64)
        word = np.searchsorted(self.ones, i, "right") - 1
        at = word * 64 + self._in_word(self.high[word], i - self.ones[word].astype(np.int64))
        return ((at - i) << self.low_bits) | self._lows(i)

    def _bucket(self, h: np.ndarray) -> np.ndarray:
        """How many values lie in buckets up to h."""
        zeros = self._zeros()
        word = np.searchsorted(zeros, h, "right") - 1
        return word * 64 + self._in_word(~self.high[word], h - zeros[word]) - h

    def _zeros(self) -> np.ndarray:
        if not hasattr(self, "_z"):
            self._z = np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones.astype(np.int64)
        return self._z

    def find(self, q: np.ndarray, lo: np.ndarray | None = None, hi: np.ndarray | None = None) -> np.ndarray:
        """The place of each value in the (strictly increasing) sequence, -1 where it is not; between places lo and hi."""
        q = np.asarray(q, np.int64)
        out = np.full(len(q), -1, np.int64)
        if not self.n or not len(q):
            return out
        live = np.arange(len(q))
        if lo is not None:
            one = np.nonzero(hi - lo == 1)[0]  # a single value is looked at
            out[one] = np.where(self.access(lo[one]) == q[one], lo[one], -1)
            live = np.nonzero(hi - lo > 1)[0]
        h = q[live] >> self.low_bits
        ends = self._bucket(np.concatenate([np.maximum(h - 1, 0), h]))
        a, b = np.where(h > 0, ends[: len(live)], 0), ends[len(live) :]
        if lo is not None:
            a, b = np.maximum(a, lo[live]), np.minimum(b, hi[live])
        on = a < b
        live, a, b = live[on], a[on], b[on]
        want = q[live] & ((1 << self.low_bits) - 1)
        while len(live):
            mid = (a + b) >> 1
            got = self._lows(mid)
            same = got == want
            out[live[same]] = mid[same]
            a, b = np.where(got < want, mid + 1, a), np.where(got < want, b, mid)
            on = ~same & (a < b)
            live, a, b, want = live[on], a[on], b[on], want[on]
        return out


def filesystem(folder: str):
    from pyarrow import fs

    if ":" not in folder:
        return fs.LocalFileSystem(), folder
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", folder))


def save(folder: str, name: str, sequences: dict[str, tuple[dict, dict]], arrays: dict[str, np.ndarray], meta: dict) -> None:
    """One file of a head and aligned arrays; written under another name and renamed."""
    fs, path = filesystem(folder)
    head: dict = {"meta": meta, "sequences": {k: m for k, (_, m) in sequences.items()}, "arrays": {}}
    flat = {f"{k}.{x}": a for k, (parts, _) in sequences.items() for x, a in parts.items()} | arrays
    at = 0
    for k, a in flat.items():
        head["arrays"][k] = [at, a.dtype.str, len(a)]
        at += -(-a.nbytes // 64) * 64
    text = json.dumps(head).encode()
    text += b" " * (-(len(text) + 8) % 64)
    mine = f"{path}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(mine) as f:
        f.write(len(text).to_bytes(8, "little") + text)
        for a in flat.values():
            f.write(np.ascontiguousarray(a).tobytes() + bytes(-a.nbytes % 64))
    fs.move(mine, f"{path}/{name}")


def remove(folder: str, name: str) -> None:
    fs, path = filesystem(folder)
    fs.delete_file(f"{path}/{name}")


def load(folder: str, name: str) -> tuple[tuple[dict[str, EliasFano], dict[str, np.ndarray], dict], bool]:
    """The sequences, arrays and meta (with the size in bytes) of a file, and whether it is memory-mapped: where it is local, else it is read."""
    fs, path = filesystem(folder)
    local = f"{path}/{name}"
    mapped = os.path.exists(local)
    data = np.memmap(local, np.uint8, "r").view(np.ndarray) if mapped else np.frombuffer(fs.open_input_file(local).read_buffer(), np.uint8)
    n = int.from_bytes(data[:8].tobytes(), "little")
    head = json.loads(data[8 : 8 + n].tobytes())
    got = {k: data[8 + n + at : 8 + n + at + np.dtype(kind).itemsize * size].view(kind) for k, (at, kind, size) in head["arrays"].items()}
    sequences = {k: EliasFano({x: got.pop(f"{k}.{x}") for x in ("low", "high", "ones")}, m) for k, m in head["sequences"].items()}
    return (sequences, got, head["meta"] | {"bytes": len(data)}), mapped
