"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A text becomes segments between which no piece of the vocabulary reaches: runs of the space mark
``\\u2581`` with the characters behind them, cut also around line breaks where no piece holds one.
Different segments of a worker's texts are encoded once, together, as flat numpy symbol arrays. In
each round every segment finds the best rank among its adjacent pairs (a segmented minimum) and
merges its leftmost pair of that rank; all leftmost non-overlapping pairs of that rank at once where
the merged piece cannot take part in a better merge. Merged symbols are compacted and finished
segments leave, until no pair remains. Segments that still merge after ``ROUNDS`` rounds (thousands
of characters without a break) are finished with a heap, in the same order of merges. Characters
outside the vocabulary become byte pieces.

Defined cases: a null text counts as empty; an empty text has no ids and decodes to an empty text;
null and repeated ids keep their rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import codecs
import heapq
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MARK = "▁"
ROUNDS = 200
NONE = np.int32(1 << 30)


class Vocabulary:
    """Merge tables and byte strings of a SentencePiece BPE model with byte fallback."""

    def __init__(self, model_file: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(self.n)]
        self.bytes_id = np.full(256, sp.unk_id(), np.int32)
        plain: dict[str, int] = {}
        score: dict[str, float] = {}
        self.out: list[bytes] = []
        for i, p in enumerate(self.pieces):
            if sp.is_byte(i):
                b = int(p[1:-1], 16)
                self.bytes_id[b] = i
                self.out.append(bytes([b]))
            elif sp.is_control(i):
                self.out.append(b"")
            elif sp.is_unknown(i):
                self.out.append(" ⁇ ".encode())
            else:
                plain[p], score[p] = i, sp.get_score(i)
                self.out.append(p.replace(MARK, " ").encode())
        ranks = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        self.char_id = np.full(0x110000, -1, np.int32)
        self.rank = np.full(self.n + 1, NONE, np.int32)
        self.alone = np.zeros(self.n + 1, bool)
        pairs: dict[int, int] = {}
        for p, i in plain.items():
            self.rank[i] = ranks[score[p]]
            if len(p) == 1:
                self.char_id[ord(p)] = i
            for k in range(1, len(p)):
                a, b = plain.get(p[:k]), plain.get(p[k:])
                if a is not None and b is not None:
                    pairs[a * self.n + b] = i
                    for part in (p[:k], p[k:]):  # a merge to it may make a merge of at least its own rank possible
                        if len(part) > 1 and score[p] >= score[part]:
                            self.alone[plain[part]] = True
        self.keys = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()], np.int32)
        self.pairs = pairs
        inner = {c for p in plain for c in p[1:] if c != MARK} | {c for p in plain if len(p) > 1 for c in p}
        self.line_break = "\n" not in inner
        self.line_id = self._unit("\n")
        self.crossing = any(x != MARK and y == MARK for p in plain for x, y in zip(p, p[1:], strict=False))
        self.starts_blank = np.array([p.startswith(MARK) for p in self.pieces])

    def _unit(self, char: str) -> list[int]:
        i = int(self.char_id[ord(char)])
        return [i] if i >= 0 else self.bytes_id[list(char.encode())].tolist()

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id of the merged pair, or n where there is none."""
        key = left.astype(np.int64) * self.n + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((left >= 0) & (right >= 0) & (self.keys[at] == key), self.merged[at], np.int32(self.n))

    def _heap(self, ids: list[int]) -> list[int]:
        """The remaining merges of one long segment."""
        n, after, before, live = self.n, list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1)), [True] * len(ids)
        heap: list[tuple[int, int, int, int, int]] = []

        def push(i: int) -> None:
            j = after[i]
            if j < len(ids) and ids[i] >= 0 and ids[j] >= 0 and (m := self.pairs.get(ids[i] * n + ids[j])) is not None:
                heapq.heappush(heap, (int(self.rank[m]), i, m, ids[i], ids[j]))

        for i in range(len(ids) - 1):
            push(i)
        while heap:
            _, i, m, a, b = heapq.heappop(heap)
            j = after[i]
            if not live[i] or j >= len(ids) or ids[i] != a or ids[j] != b:
                continue
            ids[i], live[j] = m, False
            after[i] = after[j]
            if after[j] < len(ids):
                before[after[j]] = i
            if before[i] >= 0:
                push(before[i])
            push(i)
        return [x for x, ok in zip(ids, live, strict=True) if ok]

    def encode(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all segments in a row, and the number of each."""
        chars = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), np.uint32)
        count = np.fromiter(map(len, segments), np.int64, len(segments))
        word = np.repeat(np.arange(len(segments)), count)
        sym = self.char_id[chars]
        first = np.where(sym < 0, chars, 0).astype(np.int64)  # the code point of a character that has no piece
        done_word, done_at, done_sym, done_char = [], [], [], []
        at = np.arange(len(sym), dtype=np.int64)

        def leave(mask: np.ndarray) -> None:
            done_word.append(word[mask])
            done_at.append(at[mask])
            done_sym.append(sym[mask])
            done_char.append(first[mask])

        for round_ in range(ROUNDS + 1):
            if not len(sym):
                break
            new = np.full(len(sym), self.n, np.int32)
            same = word[1:] == word[:-1]
            new[:-1][same] = self.lookup(sym[:-1][same], sym[1:][same])
            rank = self.rank[new]
            start = np.nonzero(np.r_[True, ~same])[0]
            best = np.minimum.reduceat(rank, start)
            size = np.diff(np.r_[start, len(sym)])
            open_ = best < NONE
            if round_ == ROUNDS:
                for s, n_ in zip(start[open_].tolist(), size[open_].tolist(), strict=True):
                    got = self._heap([int(x) if x >= 0 else -1 - int(c) for x, c in zip(sym[s : s + n_], first[s : s + n_], strict=True)])
                    arr = np.array(got, np.int64)
                    done_word.append(np.full(len(arr), word[s]))
                    done_at.append(at[s] + np.arange(len(arr)))
                    done_sym.append(np.where(arr < 0, -1, arr).astype(np.int32))
                    done_char.append(np.where(arr < 0, -1 - arr, 0))
                leave(np.repeat(~open_, size))
                break
            if not open_.all():
                keep = np.repeat(open_, size)
                leave(~keep)
                word, sym, first, at, rank, new = (x[keep] for x in (word, sym, first, at, rank, new))
                best, size = best[open_], size[open_]
                if not len(sym):
                    break
            hit = rank == np.repeat(best, size)
            where = np.nonzero(hit)[0]
            # leftmost hit of each segment; all of them, overlaps left out, where the piece stands alone in no better pair
            lead = np.r_[True, word[where][1:] != word[where][:-1]]
            risky = np.zeros(int(word[-1]) + 1, bool)
            risky[word[where][self.alone[new[where]]]] = True
            run = np.r_[True, (np.diff(where) != 1) | lead[1:]]
            nth = np.arange(len(where)) - np.maximum.accumulate(np.where(run, np.arange(len(where)), 0))
            take = where[np.where(risky[word[where]], lead, nth % 2 == 0)]
            sym[take] = new[take]
            keep = np.ones(len(sym), bool)
            keep[take + 1] = False
            word, sym, first, at = (x[keep] for x in (word, sym, first, at))
        word, at, sym, first = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (done_word, done_at, done_sym, done_char))
        order = np.argsort(at, kind="stable")
        word, sym, first = word[order], sym[order], first[order]
        raw = sym < 0
        if raw.any():  # characters without a piece: their UTF-8 bytes
            code = first[raw]
            width = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
            flat = np.frombuffer("".join(map(chr, code.tolist())).encode("utf-8", "surrogatepass"), np.uint8)
            times = np.ones(len(sym), np.int64)
            times[raw] = width
            is_raw = np.repeat(raw, times)
            word, sym = np.repeat(word, times), np.repeat(sym, times)
            sym[is_raw] = self.bytes_id[flat]
        return sym.astype(np.int32), np.bincount(word.astype(np.int64), minlength=len(segments))

    def decode(self, ids: list[int]) -> str:
        """The text of ids, as the library's decode() gives it: the blank that encoding puts in front is taken off."""
        out = b"".join(map(self.out.__getitem__, ids))
        first = next((i for i in ids if self.out[i]), None)  # controls in front are nothing
        if first is not None and self.starts_blank[first]:
            out = out[1:]
        try:
            return out.decode()
        except UnicodeDecodeError:
            return out.decode("utf-8", "tessera_each")


def _each(e: UnicodeError) -> tuple[str, int]:
    return "�", e.start + 1


codecs.register_error("tessera_each", _each)


@lru_cache(maxsize=2)
def vocabulary(model_file: str) -> Vocabulary:
    return Vocabulary(model_file)


class Encoder:
    """Encodes texts with a store of segments."""

    def __init__(self, model_file: str) -> None:
        self.v = vocabulary(model_file)
        self.store = common.Store(self.v.encode, max_parts=350_000, max_chars=9_000_000)

    def segments(self, text: str) -> list[str]:
        """Parts of the marked text; no piece reaches from one to another. A part that is a line break is one."""
        if not text:
            return []
        if self.v.crossing:
            return [MARK + text.replace(" ", MARK)]
        if " " in text[:1] or "  " in text or MARK in text:
            text = MARK + text.replace(" ", MARK)
            cut = re.findall(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n" if self.v.line_break else f"{MARK}*[^{MARK}]+|{MARK}+", text)
            return cut
        if not self.v.line_break or "\n" not in text:
            return [MARK + w for w in text.split(" ")]
        lines = text.split("\n")
        out = [MARK + w for w in lines[0].split(" ")]
        for line in lines[1:]:
            out.append("\n")
            if line:
                first, *rest = line.split(" ")
                if first:
                    out.append(first)
                out += [MARK + w for w in rest]
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the number of each."""
        return self.store.ids([self.segments(t) for t in texts])


def encoder(model_file: str) -> Encoder:
    return common.sole(("spm", model_file), lambda: Encoder(model_file))


def encode_decode(docs: DataFrame, model_file: str, text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>, decoded string: whole texts encoded, and their ids decoded."""

    def f(batch: pa.RecordBatch, texts: list[bytes]) -> pa.RecordBatch:
        enc = encoder(model_file)
        ids, counts = enc.encode([t.decode() for t in texts])
        offsets = np.r_[0, np.cumsum(counts)].astype(np.int32)
        flat = ids.tolist()
        decoded = [enc.v.decode(flat[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))
        return pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

    return common.map_texts(docs, [F.col("doc_id").cast("long").alias("doc_id")], "doc_id long, ids array<int>, decoded string", f, text_col, limit=common.GROUP_BYTES // 2)
