"""Personal data by rules, and by bootstrapped contextual extraction.

1. ``scan`` finds base spans (e-mail, IP, card, phone; see the functions below) in whole texts, and
   candidates: identifier-like strings that no rule accepts. Each mention carries lexical patterns: the two words
   in front of it; the words on both sides; its shape (digits as their number, letters as one, other characters
   as they are) behind the word in front of it; and its shape alone, if a rule takes the string by itself (a
   phone, say, that a rule's match ran past).
2. ``patterns`` scores a graph of patterns and instances with Spark, in rounds until one adds no pattern and no
   instance. Base entities are the seeds. A pattern's confidence for a kind is the share of what it stands for, over the
   whole corpus, that are known instances of the kind: for patterns of words the words they stand around, for those
   with a shape the mentions of that shape. It needs ``support`` different known instances. An instance's score is
   the noisy-or of its confident patterns; instances that score high count as known in the next round.
3. ``extract`` marks candidates that stand in a confident pattern as spans of its kind; base spans stay.

The words around which patterns stand are counted in one pass over the corpus; what each task gets for it is a
bitmap of fixed size, which lets through all occurrences of the patterns in question and a few others.

Rules match leftmost and non-overlapping for each kind, in code points; a match that fails its check is
dropped without a retry. They are written so that no text costs more than linear time.

Defined cases: a null text counts as empty and has no spans; null and repeated ids keep their rows; where
two patterns of different kinds claim a candidate, the more confident wins, then the kind listed first;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")
#: What may be an identifier though no rule accepts it: a run of digits and their separators, or a word with a digit or an at sign.
_RUN = re.compile(r"\+?\(?[0-9][0-9().\x20-]{4,}[0-9]")
_WORD = re.compile(r"\S+")
_LETTERS, _DIGITS = re.compile(r"[^\W\d_]+"), re.compile(r"[0-9]+")
#: Base-2 logarithm of the bits of the bitmap that picks the patterns to count: 8 MB.
BITS = 26
_EDGE = "\"'()[]{}<>,;:!?.*#|=&%$"


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            end = m.end()
        else:
            end = at + 1
        at = text.find("@", end)


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """start, kind's place in KINDS, end of each base span, in order."""
    if not _ANY.search(text):
        return []
    out = [(a, 0, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and _luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def _candidates(text: str, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Identifier-like strings that touch no base span, in order and without overlaps."""
    found, start = [], 0
    for a, b in [*sorted(taken), (len(text), len(text))]:  # a run ends before a span, and begins behind one
        for m in _RUN.finditer(text, start, a):
            if sum(c.isdigit() for c in m[0]) >= 7 and (m.start() > start or not start) and (m.end() < a or a == len(text)):
                found.append(m.span())
        start = max(start, b)
    for m in _WORD.finditer(text):
        word = m[0]
        if not _ANY.search(word):
            continue
        a = m.start() + len(word) - len(word.lstrip(_EDGE))
        b = m.start() + len(word.rstrip(_EDGE))
        if b - a >= 6:
            found.append((a, b))
    end = -1
    busy = iter(sorted(taken))
    span = next(busy, None)
    for a, b in sorted(found, key=lambda s: (s[0], -s[1])):
        while span and span[1] <= a:
            span = next(busy, None)
        if a >= end and not (span and span[0] < b):
            yield a, b
            end = b


def _shape(instance: str) -> str:
    return _DIGITS.sub(lambda m: f"d{len(m[0])}", _LETTERS.sub("a", instance))


def _contexts(text: str, spans: list[tuple[int, int]]) -> list[tuple[list[str], bool]]:
    """The patterns of each span (in order of start), words in lower case: words in front, words on both sides, shape, shape behind the word in front. And whether the span has several words."""
    words = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    out, i = [], 0
    word = lambda k: text[words[k][0] : words[k][1]].lower() if 0 <= k < len(words) else ""
    for a, b in spans:
        while i < len(words) and words[i][1] <= a:
            i += 1
        j = i
        while j + 1 < len(words) and words[j + 1][0] < b:
            j += 1
        shape = _shape(text[a:b])
        out.append(([f"{word(i - 2)} {word(i - 1)} _", f"{word(i - 1)} {word(j + 1)} |", f"\t{shape}", f"{word(i - 1)}\t{shape}"], j > i))
    return out


MENTION = "struct<kind:int,start:long,end:long,instance:string,patterns:array<string>,wide:boolean>"
_ARROW = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("instance", pa.string()), ("patterns", pa.list_(pa.string())), ("wide", pa.bool_())]))


def mentions_of(text: str) -> list[dict]:
    """Base spans (kind 0 to 3) and candidates (kind -1) of a text with their patterns, in order."""
    base = base_spans(text)
    spans = [(a, b, k) for a, k, b in base]
    if _ANY.search(text):
        spans += [(a, b, -1) for a, b in _candidates(text, [(a, b) for a, b, _ in spans])]
    spans.sort()
    found = zip(spans, _contexts(text, [s[:2] for s in spans]) if spans else [], strict=True)
    # its shape alone tells something of a string only if a rule would take it by itself
    lone = lambda a, b, k: k >= 0 or any(x == 0 and y == b - a for x, _, y in base_spans(text[a:b]))
    instance = lambda a, b: re.sub(r"[\s().-]", "", text[a:b]).lower()
    return [{"kind": k, "start": a, "end": b, "instance": instance(a, b), "patterns": p if lone(a, b, k) else [p[0], p[1], p[3]], "wide": w} for (a, b, k), (p, w) in found]


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, h, g (hashes of the text), mentions."""

    def f(batch: pa.RecordBatch, texts: list[bytes]) -> pa.RecordBatch:
        rows = [mentions_of(t.decode()) for t in texts]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(rows, _ARROW)], ["doc_id", "h", "g", "mentions"])

    keep = [F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), "text").alias("g")]
    return common.map_texts(docs, keep, f"doc_id long, h long, g long, mentions array<{MENTION}>", f)


def _place(first, second, flag):
    """The bit of a pattern of two words, from the words' hashes: the same on columns and on arrays."""
    if isinstance(first, Column):
        mixed = first.bitwiseXOR(F.shiftleft(second, 1)).bitwiseXOR(F.shiftrightunsigned(second, 63))
        return F.shiftrightunsigned(mixed, 64 - BITS).bitwiseXOR(flag)
    return ((first ^ (second << np.uint64(1)) ^ (second >> np.uint64(63))) >> np.uint64(64 - BITS)).astype(np.int64) ^ flag


def _occurrences(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """pattern, n: around how many words of the corpus each wanted pattern of words stands."""
    spark = docs.sparkSession
    words = F.split("pattern", " ")
    before = words[2] == "_"
    place = _place(F.xxhash64(words[0]), F.xxhash64(words[1]), before.cast("long"))
    placed = wanted.select((place + 1).alias("at"))  # the functions count buckets and bits from one
    bits = placed.groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    bitmap = np.zeros(1 << (BITS - 3), np.uint8)
    for r in bits.collect():  # at most 2 ** (BITS - 15) rows of 4 KB
        part = np.frombuffer(r.bits, np.uint8)
        bitmap[(r.bucket - 1) * 4096 : (r.bucket - 1) * 4096 + len(part)] = part
    shared = spark.sparkContext.broadcast(bitmap)

    def run(batches):
        import xxhash

        index, hashes, seen = common._Index(), np.zeros(0, np.uint64), Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["pattern", "n"])
            seen.clear()
            return out

        for batch in batches:
            column = batch.column(0)
            for a, b in common.grouped(pa.compute.fill_null(pa.compute.binary_length(column), 0).to_pylist()):
                if len(index) > 400_000:
                    index.clear()
                    hashes = np.zeros(0, np.uint64)
                flat: list[str] = []
                for text in common.text_bytes(column.slice(a, b - a)):
                    flat += ["", "", *text.decode().lower().split(), ""]
                at = np.fromiter(map(index.__getitem__, flat), np.int64, len(flat))
                fresh = list(index)[len(hashes) :]
                hashes = np.r_[hashes, np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in fresh), np.uint64, len(fresh))]
                h, none = hashes[at], index[""]
                if len(hashes) < len(index):
                    continue  # nothing but empty texts
                inner = at[1:-1] != none
                for flag, x, y in ((1, -2, -1), (0, -1, 1)):
                    mid = np.nonzero(inner)[0] + 1
                    bit = _place(h[mid + x], h[mid + y], flag)
                    hit = mid[(shared.value[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1]
                    for i in hit.tolist():
                        seen[f"{flat[i - 2]} {flat[i - 1]} _" if flag else f"{flat[i - 1]} {flat[i + 1]} |"] += 1
                if len(seen) > 400_000:
                    yield flush()
        if seen:
            yield flush()

    found = docs.select("text").mapInArrow(run, "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n"))
    return common.written(found.join(wanted, "pattern", "left_semi"), "occurrences")


def patterns(docs: DataFrame, mentions: DataFrame, support: int = 5, confidence: float = 0.75, rounds: int | None = None) -> DataFrame:
    """pattern, kind, conf of the confident patterns; mentions: one row each, as scan gives them."""
    sides = mentions.select("instance", "kind", "wide", F.posexplode("patterns").alias("which", "pattern"))
    edges = sides.groupBy("pattern", "instance").agg(F.count(F.lit(1)).alias("m"), F.max("kind").alias("kind"), F.sum(((F.col("which") == 1) & F.col("wide")).cast("long")).alias("wide"))
    edges = common.written(edges, "edges")
    # a pattern can only become confident around enough different strings; later rounds may know them if no seed is there
    wanted = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("strings")).filter(F.col("strings") >= support).select("pattern")
    wanted = common.written(wanted, "wanted")
    edges = common.written(edges.join(wanted, "pattern", "left_semi"), "edges")
    shaped = F.col("pattern").contains("\t")
    # a shape stands for mentions; words on both sides stand around mentions of several words too, which are no single word's occurrences
    counted = edges.groupBy("pattern").agg(F.sum(F.when(shaped, F.col("m")).otherwise(F.col("wide"))).alias("n")).filter("n > 0")
    totals = _occurrences(docs, wanted.filter(~shaped)).union(counted).groupBy("pattern").agg(F.sum("n").alias("n"))
    totals = common.written(totals, "totals")
    seeds = edges.filter("kind >= 0").select("instance", "kind", F.lit(1.0).alias("s")).distinct()
    known, size, confident = seeds, -1, edges.limit(0)
    for _ in count() if rounds is None else range(rounds):
        hits = edges.select("pattern", "instance", "m").join(known, "instance").groupBy("pattern", "kind").agg(F.sum(F.col("m") * F.col("s")).alias("hits"), F.count(F.lit(1)).alias("different"))
        scored = hits.join(totals, "pattern").withColumn("conf", F.least(F.lit(1.0), F.col("hits") / F.greatest("n", "hits")))
        confident = common.written(scored.filter((F.col("different") >= support) & (F.col("conf") >= confidence)).select("pattern", "kind", "conf"), "patterns", instead=[confident])
        found = edges.filter("kind < 0").select("pattern", "instance").join(confident, "pattern").groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.least("conf", F.lit(0.999)))))).alias("s"))
        both = seeds.union(found.filter(F.col("s") >= confidence).select("instance", "kind", "s"))
        known = common.written(both.groupBy("instance", "kind").agg(F.max("s").alias("s")), "known", instead=[known])
        before, size = size, confident.count() + known.count()
        if size <= before:  # both only grow: nothing was added
            break
    return confident


def extract(docs: DataFrame, support: int = 5, confidence: float = 0.75, rounds: int | None = None) -> DataFrame:
    """doc_id, spans: array of struct(start, kind, end, base) in order, kind by its place in KINDS."""
    found = common.written(scan(docs), "mentions")
    mentions = found.select("h", "g", F.explode("mentions").alias("x")).select("h", "g", "x.*")
    good = patterns(docs, mentions, support, confidence, rounds)
    new = (
        mentions.filter("kind < 0")
        .select("h", "g", "start", "end", F.explode("patterns").alias("pattern"))
        .join(good, "pattern")
        .groupBy("h", "g", "start", "end")
        .agg(F.max_by("kind", F.struct("conf", -F.col("kind"))).alias("kind"))
    )
    new = new.groupBy("h", "g").agg(F.collect_list(F.struct("start", "kind", "end", F.lit(False).alias("base"))).alias("new"))
    new = common.written(new, "new")  # the join's other side can then be split where many copies share a text
    base = F.transform(F.filter("mentions", lambda x: x["kind"] >= 0), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), F.lit(True).alias("base")))
    spans = F.array_sort(F.when(F.col("new").isNull(), F.col("all")).otherwise(F.concat("all", "new")))
    return found.select("doc_id", "h", "g", base.alias("all")).join(new, ["h", "g"], "left").select("doc_id", spans.alias("spans"))
