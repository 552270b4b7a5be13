"""Readers of the text formats as Python data sources.

``register(spark)`` adds the formats points, node, grid, bcmap, mapbc, graph and iperm. A file is one
partition: a header announces counts that only the whole file can confirm, and the order of its lines is the
numbering. A directory or a glob of files reads as many partitions, with their path as a column if the option
``with_path`` is set. All faults of a file are reported together. Points, nodes and graphs are handed on line by
line; the other formats are small, or can only be told when they are whole, and are read at once.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessera.sources import files


class FormatError(ValueError):
    """All problems of one file, each with the file's name in front."""

    def __init__(self, path: str, problems: list[str]) -> None:
        self.path, self.problems = path, [f"{path}: {p}" for p in problems]
        super().__init__("\n".join(self.problems))


class _Faults(list):
    """Collects problems; beyond a hundred only their number."""

    def __init__(self, path: str) -> None:
        super().__init__()
        self.path, self.more = path, 0

    def add(self, what: str) -> None:
        if len(self) < 100:
            self.append(what)
        else:
            self.more += 1

    def check(self) -> None:
        if self:
            raise FormatError(self.path, [*self, *([f"and {self.more} more"] if self.more else [])])


def _int(token: str) -> int:
    if not (token.lstrip("-").isascii() and token.lstrip("-").isdigit()):
        raise ValueError
    return int(token)


def _real(token: str) -> float:
    if "_" in token or token != token.strip():
        raise ValueError
    return float(token)


def _numbers(tokens: list[str], kinds: str, where: str, faults: _Faults) -> list | None:
    """The tokens as integers (i) and reals (r), or None with a fault."""
    if len(tokens) != len(kinds):
        faults.add(f"{where}: {len(tokens)} values instead of {len(kinds)}")
        return None
    try:
        return [_int(t) if k == "i" else _real(t) for t, k in zip(tokens, kinds, strict=True)]
    except ValueError:
        faults.add(f"{where}: not a number")
        return None


def _finite(values: list[float], where: str, faults: _Faults) -> None:
    if not all(map(math.isfinite, values)):
        faults.add(f"{where}: a coordinate is not finite")


def _lines(source: str | Iterable[str]) -> Iterator[str]:
    """The lines of a text, or of a file that is read as it goes."""
    return iter(source.split("\n") if isinstance(source, str) else source)


def _content(source: str | Iterable[str], comment: str | None) -> Iterator[tuple[int, list[str]]]:
    """(line number, tokens) of all lines that hold something."""
    for no, line in enumerate(_lines(source), 1):
        tokens = (line.split(comment, 1)[0] if comment else line).split()
        if tokens:
            yield no, tokens


def points(source: str | Iterable[str], path: str, options: dict) -> Iterator[tuple]:
    """A count, then that many lines of two coordinates; what follows is ignored. With the option ``point``, one column of both."""
    faults, lines = _Faults(path), _lines(source)
    head = _numbers(next(lines, "").split(), "i", "line 1", faults)
    faults.check()
    if head[0] < 0:
        raise FormatError(path, ["line 1: a negative count"])
    found = 0
    for i, line in enumerate(islice(lines, head[0])):
        found += bool(line.strip())
        xy = _numbers(line.split(), "rr", f"line {i + 2}", faults)
        if xy:
            _finite(xy, f"line {i + 2}", faults)
            yield (i, tuple(xy)) if options.get("point") else (i, *xy)
    if found < head[0]:
        faults.add(f"{head[0]} points announced, {found} found")
    faults.check()


def node(source: str | Iterable[str], path: str, options: dict) -> Iterator[tuple]:
    """Triangle's .node dialect: comments, blank lines, numbering from 0 or 1, attributes, an optional marker."""
    faults, lines = _Faults(path), _content(source, "#")
    no, tokens = next(lines, (0, None))
    if tokens is None:
        raise FormatError(path, ["no header"])
    head = _numbers(tokens, "iiii", f"line {no}", faults)
    faults.check()
    n, dim, nattr, nmark = head
    if n < 0 or dim != 2 or nattr < 0 or nmark not in (0, 1):
        raise FormatError(path, [f"line {no}: header must be a count, dimension 2, attributes, and 0 or 1 markers"])
    found, base = 0, None
    for no, tokens in lines:
        found += 1
        got = _numbers(tokens, "irr" + "r" * nattr + "i" * nmark, f"line {no}", faults) if found <= n else None
        if got:
            i = found - 1
            base = got[0] - i if base is None else base
            if base not in (0, 1) or got[0] - i != base:
                faults.add(f"line {no}: nodes are not numbered consecutively from 0 or 1")
            _finite(got[1:3], f"line {no}", faults)
            yield i, got[1], got[2], got[-1] if nmark else 0, got[3 : 3 + nattr]
    if found != n:
        faults.add(f"{n} nodes announced, {found} lines found")
    faults.check()


def graph(source: str | Iterable[str], path: str, options: dict) -> Iterator[tuple]:
    """Rows of column numbers; the option k fixes their length. Blank lines may only stand at the end."""
    faults, lines = _Faults(path), _lines(source)
    head = _numbers(next(lines, "").split(), "ii", "line 1", faults)
    faults.check()
    n, nnz = head
    k = int(options.get("k", 0))
    if k and nnz != n * k:
        faults.add(f"{nnz} entries announced, but {n} rows of {k}")
    found = total = 0
    low, high = n, -1
    for i, line in enumerate(lines):
        tokens = line.split()
        if not tokens:
            continue
        for empty in range(found, min(i, n)):
            faults.add(f"row {empty} has no entries")
        found = i + 1
        got = _numbers(tokens, "i" * len(tokens), f"row {i}", faults) if i < n else None
        if got is None:
            continue
        if k and len(got) != k:
            faults.add(f"row {i} has {len(got)} entries instead of {k}")
        low, high = min(low, *got), max(high, *got)
        out = [j for j in got if not 0 <= j < n]
        if out:
            faults.add(f"row {i}: {out[0]} is out of range")
        if len(set(got)) < len(got):
            faults.add(f"row {i}: {Counter(got).most_common(1)[0][0]} is listed twice")
        total += len(got)
        yield from ((i, p, j) for p, j in enumerate(got, 1))
    if found != n:
        faults.add(f"{n} rows announced, {found} found")
    if n and low >= 1 and high == n:
        faults.add("the numbering looks 1-based")
    if total != nnz:
        faults.add(f"{nnz} entries announced, {total} found")
    faults.check()


def iperm(text: str, path: str, options: dict) -> Iterator[tuple]:
    """One number after another: the new id of each node."""
    faults = _Faults(path)
    values = _numbers(tokens := text.split(), "i" * len(tokens), "the file", faults)
    faults.check()
    if sorted(values) != list(range(len(values))):
        one = sorted(values) == list(range(1, len(values) + 1))
        raise FormatError(path, ["the numbering looks 1-based" if one else f"not a permutation of 0..{len(values) - 1}"])
    return iter(enumerate(values))


def bcmap(text: str, path: str, options: dict) -> Iterator[tuple]:
    """tag name on each line, ! for comments."""
    faults, rows = _Faults(path), []
    for no, tokens in _content(text, "!"):
        got = _numbers(tokens[:1], "i", f"line {no}", faults) if len(tokens) == 2 else faults.add(f"line {no}: a tag and a name expected")
        if got:
            rows.append((len(rows), got[0], 0, tokens[1]))
    return _unique_tags(rows, faults)


def mapbc(text: str, path: str, options: dict) -> Iterator[tuple]:
    """A count, then tag, condition and an optional family."""
    faults, rows, lines = _Faults(path), [], list(_content(text, "!"))
    head = _numbers(lines[0][1], "i", f"line {lines[0][0]}", faults) if lines else faults.add("no count")
    faults.check()
    if len(lines) - 1 != head[0]:
        faults.add(f"{head[0]} groups announced, {len(lines) - 1} found")
    for no, tokens in lines[1:]:
        got = _numbers(tokens[:2], "ii", f"line {no}", faults) if 2 <= len(tokens) <= 3 else faults.add(f"line {no}: a tag, a condition and at most a name expected")
        if got:
            rows.append((len(rows), *got, tokens[2] if len(tokens) == 3 else ""))
    return _unique_tags(rows, faults)


def _unique_tags(rows: list[tuple], faults: _Faults) -> Iterator[tuple]:
    for tag, n in Counter(r[1] for r in rows).items():
        if n > 1:
            faults.add(f"tag {tag} occurs {n} times")
    faults.check()
    return iter(rows)


def grid(text: str, path: str, options: dict) -> Iterator[tuple]:
    """Nodes, triangles, quadrilaterals and boundary parts; the option section picks nodes, elements or bound."""
    faults = _Faults(path)
    lines = iter(_content(text, None))

    def line(kinds: str, what: str) -> list:
        no, tokens = next(lines, (0, None))
        if tokens is None:
            faults.add(f"the file ends before {what}")
            faults.check()
        got = _numbers(tokens, kinds, f"line {no}, {what}", faults)
        faults.check()
        return got

    n, nt, nq = line("iii", "the counts")
    xy = [line("rr", f"node {i + 1}") for i in range(n)]
    for i, p in enumerate(xy):
        _finite(p, f"node {i + 1}", faults)
    elements = []
    for kind, count, size in (("triangle", nt, 3), ("quadrilateral", nq, 4)):
        for e in range(count):
            v = line("i" * size, f"{kind} {e + 1}")
            if any(not 1 <= i <= n for i in v):
                faults.add(f"{kind} {e + 1} names a node out of range")
            if len(set(v)) < size:
                faults.add(f"{kind} {e + 1} names a node twice")
            elements.append((kind, e, [i - 1 for i in v]))
    lengths = [line("i", f"the length of boundary part {b + 1}")[0] for b in range(line("i", "the number of boundary parts")[0])]
    bound = []
    for b, size in enumerate(lengths):
        if size < 2:
            faults.add(f"boundary part {b + 1} has fewer than two nodes")
        v = [line("i", f"boundary part {b + 1}")[0] for _ in range(size)]
        if any(not 1 <= i <= n for i in v):
            faults.add(f"boundary part {b + 1} names a node out of range")
        if any(i == j for i, j in zip(v, v[1:], strict=False)):
            faults.add(f"boundary part {b + 1} repeats a node")
        bound += [(b, s, i - 1) for s, i in enumerate(v)]
    if next(lines, None):
        faults.add("data behind the last boundary part")
    faults.check()
    section = options.get("section", "nodes")
    return iter({"nodes": [(i, *p) for i, p in enumerate(xy)], "elements": elements, "bound": bound}[section])


NODES = "id long, x double, y double"
#: Reader and schema of each format; the grid's schema depends on the section.
FORMATS: dict[str, tuple[Callable, str]] = {
    "points": (points, NODES),
    "node": (node, f"{NODES}, marker int, attrs array<double>"),
    "graph": (graph, "row long, k int, col long"),
    "iperm": (iperm, "old_id long, new_id long"),
    "bcmap": (bcmap, "seq int, tag int, bc int, name string"),
    "mapbc": (mapbc, "seq int, tag int, bc int, name string"),
    "grid": (grid, NODES),
}
#: Formats whose rows go out as their lines come in; a fault fails the read when the file is through.
STREAMED = ("points", "node", "graph")
SECTIONS = {"nodes": NODES, "elements": "kind string, elem long, verts array<long>", "bound": "part int, seq int, node long"}


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, kind: str, options: dict) -> None:
        self.kind, self.options = kind, options

    def partitions(self) -> list[InputPartition]:
        return [_File(f) for f in files.listed(self.options["path"])]

    def read(self, partition: _File) -> Iterator[tuple]:
        whole = files.read_text if self.kind not in STREAMED else files.read_lines
        rows = FORMATS[self.kind][0](whole(partition.path), partition.path, self.options)
        return ((*r, partition.path) for r in rows) if self.options.get("with_path") else rows


def _source(kind: str) -> type[DataSource]:
    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return kind

        def schema(self) -> str:
            own = SECTIONS[self.options.get("section", "nodes")] if kind == "grid" else FORMATS[kind][1]
            if kind == "points" and self.options.get("point"):
                own = "id long, point struct<x: double, y: double>"
            return own + (", path string" if self.options.get("with_path") else "")

        def reader(self, schema) -> DataSourceReader:
            return _Reader(kind, dict(self.options))

    Source.__name__ = Source.__qualname__ = f"{kind.title()}Source"
    return Source


def register(spark: SparkSession) -> None:
    for kind in FORMATS:
        spark.dataSource.register(_source(kind))
