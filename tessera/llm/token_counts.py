"""Exact token counts of whole documents, huge ones by overlapping chunks.

A document of up to ``chunk`` characters and one overlap is counted as a whole. A longer one is encoded in chunks, each
of which reaches ``overlap`` characters into the next, with the offsets of its words; two neighbours are spliced
at a place where both have a word begin, and the tokens of either side are counted up to there. Of a text only two
chunks' tokens are held at a time.

Why such a place is proven stable. A byte-level tokenizer cuts a text into words from left to right, and where a
word begins nothing in front of it matters any more: words look ahead (by two characters, and by the length of an added
token), never back. A chunk that begins where a word begins therefore has the whole text's words, but for those
that its end may have cut: those within ``margin`` characters of it. So a place before the margin where the left chunk has a
word begin is a beginning in the whole text; if the right chunk has one there too, then all its words
from there on are the whole text's. Merges never cross words, so the tokens are as well.

Where the overlap holds no such place (one word longer than the overlap), it is widened: the left chunk is encoded
again from its last proven place, with twice the overlap, until a common place or the text's end is reached.

Tokenizers of other kinds (a normalizer, words that look back, dropout) have no such proof; their texts, and those of a
sentencepiece model, are encoded whole.

Defined cases: a null text counts as empty and has no tokens; null and repeated ids keep their rows; a text of one word
of any length is right, by widening; strings of special tokens in a text count as the library takes them by default;
bytes that are not UTF-8 read as U+FFFD; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, token_files

#: Characters of a chunk, and of its reach into the next.
CHUNK, OVERLAP = 1 << 15, 1 << 10


def margin_of(tokenizer) -> int | None:
    """How far from a chunk's end its words are certain, in characters; None if the tokenizer gives no such bound."""
    made = json.loads(tokenizer.to_str())
    before, model = made["pre_tokenizer"] or {}, made["model"]
    words = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    added = made["added_tokens"]
    plain = not any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added)
    if made["normalizer"] or not words or not plain or model.get("type") != "BPE" or model.get("dropout"):
        return None
    return 1 + max(1, *[len(t["content"]) for t in added]) if added else 2


class Piece:
    """The words of a part of a text, with their places in the whole."""

    def __init__(self, tokenizer, text: str, start: int, end: int) -> None:
        self.start, self.end = start, end
        self.coded = tokenizer.encode(text[start:end], add_special_tokens=False)

    def before(self, place: int) -> int | None:
        """The number of tokens before a place where a word begins; None for any other place."""
        if place == self.end:
            return len(self.coded)
        word = self.coded.char_to_word(place - self.start)
        if word is None or self.coded.word_to_chars(word)[0] + self.start != place:
            return None
        return self.coded.word_to_tokens(word)[0]

    def beginnings(self, last: int):
        """The places up to ``last`` where words begin, ascending."""
        word = 0
        while (found := self.coded.word_to_chars(word)) is not None and found[0] + self.start <= last:
            yield found[0] + self.start
            word += 1

    def last_before(self, place: int) -> int:
        """The last place up to ``place`` where a word begins."""
        word = self.coded.char_to_word(place - self.start)
        return self.coded.word_to_chars(word)[0] + self.start


def spliced(tokenizer, text: str, margin: int, chunk: int = CHUNK, overlap: int = OVERLAP) -> tuple[int, int, int]:
    """Tokens of a text, how many chunks were encoded, and how often an overlap was widened."""
    n, total, chunks, widened = len(text), 0, 1, 0
    width = max(overlap, 2 * margin)
    # everything before `at` is counted, and a word of the whole text begins there
    at, left = 0, Piece(tokenizer, text, 0, min(n, chunk + width))
    while left.end < n:
        right = Piece(tokenizer, text, left.end - width, min(n, left.end + chunk))
        chunks += 1
        common_place = next((p for p in right.beginnings(left.end - margin) if p > at and left.before(p) is not None), None)
        if common_place is not None:
            total += left.before(common_place) - left.before(at)
            at, left, width = common_place, right, max(overlap, 2 * margin)
            continue
        proven = max(at, left.last_before(left.end - margin))
        total += left.before(proven) - left.before(at)
        width *= 2
        at, left = proven, Piece(tokenizer, text, proven, min(n, left.end + width))
        chunks, widened = chunks + 1, widened + 1
    return total + len(left.coded) - left.before(at), chunks, widened


class Counter:
    """Counts of texts by one tokenizer file: .json of the tokenizers library, .model of sentencepiece."""

    def __init__(self, path: str, chunk: int, overlap: int) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.chunk, self.overlap, self.margin = chunk, overlap, None
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.whole = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
            return
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.margin = margin_of(self.tokenizer)
        if self.margin is None:
            self.whole = lambda texts: [len(x) for i in range(0, len(texts), 16) for x in self.tokenizer.encode_batch_fast(texts[i : i + 16], add_special_tokens=False)]
        else:
            words = token_files.WordEncoder(path)
            self.whole = lambda texts: words.encode(texts)[1]

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens, chunks and widenings of each text, as rows."""
        found = np.ones((len(texts), 3), np.int64) * [0, 1, 0]
        huge = [self.margin is not None and len(t) > self.chunk + self.overlap for t in texts]
        short = [i for i, h in enumerate(huge) if not h]
        if short:
            found[short, 0] = self.whole([texts[i] for i in short])
        for i in np.flatnonzero(huge).tolist():
            found[i] = spliced(self.tokenizer, texts[i], self.margin, self.chunk, self.overlap)
        return found


def count(docs: DataFrame, tokenizer: str, chunk: int = CHUNK, overlap: int = OVERLAP, text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, n_chunks, n_widened of each whole text."""

    def f(batch: pa.RecordBatch, texts: list[bytes]) -> pa.RecordBatch:
        counter = common.sole(("counts", tokenizer, chunk, overlap), lambda: Counter(tokenizer, chunk, overlap))
        found = counter.counts([t.decode() for t in texts])
        size = pc.cast(pc.fill_null(pc.binary_length(batch.column(1)), 0), pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0), size, *(pa.array(found[:, i]) for i in range(3))], ["doc_id", "n_bytes", "n_tokens", "n_chunks", "n_widened"])

    return common.map_texts(docs, [F.col("doc_id").cast("long").alias("doc_id")], "doc_id long, n_bytes long, n_tokens long, n_chunks long, n_widened long", f, text_col)
