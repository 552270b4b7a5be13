"""Writers of the text formats.

A file is made of headers and sections. The rows of a section are sorted by ranges; each task turns its own into lines
and writes them as a piece, through Spark's text writer, so that a task that fails or runs twice leaves nothing behind. The
pieces stand in a folder beside the file, and are joined (``joins``) when all are there: by the file system, where it can
do so, by tasks that copy each piece to its place, where the file is one of a mounted disk. A file appears when it is whole; if
a writer fails, the one that was there before stays.

Paths are read as Spark reads them. Numbers are the shortest text that reads back to the same value.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources import joins


def number(v: float | int) -> str:
    """Shortest round-trip text; whole reals without a fraction."""
    text = repr(v)
    return text.removesuffix(".0")


def _lines(df: DataFrame, keys: Sequence[str], cols: Sequence[str], line: Callable[..., str]) -> DataFrame:
    """A line for each row, made of the columns cols by a function, in the order of keys."""

    def run(batches):
        for b in batches:
            made = [line(*row) for row in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.string())], ["value"])

    return df.orderBy(*keys).select(*cols).mapInArrow(run, "value string")


def _plain(df: DataFrame, keys: Sequence[str], line: Column) -> DataFrame:
    """The same for a line that is a column expression."""
    return df.orderBy(*keys).select(line.alias("value"))


def _write(spark: SparkSession, path: str, extension: str, sections: Iterable[str | DataFrame]) -> None:
    """Headers (texts) and sections one after another, to the file (with its extension, unless the path has it); "-" is standard output."""
    if path == "-":
        for s in sections:
            sys.stdout.writelines([s] if isinstance(s, str) else (f"{r.value}\n" for r in s.toLocalIterator(prefetchPartitions=True)))
        return
    joins.write(spark, sections, path if path.endswith(extension) else path + extension)


def write_points(points: DataFrame, path: str, text=repr) -> None:
    lines = _lines(points, ["id"], ["x", "y"], lambda x, y: f"{text(x)} {text(y)}")
    _write(points.sparkSession, path, ".points", [f"{points.count()}\n", lines])


def write_nodes(nodes: DataFrame, path: str, marker: str | None = "marker", attrs: str | None = None, title: str | None = None, text=number) -> None:
    cols = ["id", "x", "y", *([attrs] if attrs else []), *([marker] if marker else [])]
    nattr = len((nodes.select(attrs).first() or [[]])[0]) if attrs else 0

    def line(i, x, y, *more):
        values, flags = (more[0], more[1:]) if attrs else ((), more)
        return " ".join([str(i), text(x), text(y), *map(text, values), *map(str, flags)])

    head = "" if title is None else f"# {title}\n"
    _write(nodes.sparkSession, path, ".node", [f"{head}{nodes.count()} 2 {nattr} {int(bool(marker))}\n", _lines(nodes, ["id"], cols, line)])


def write_graph(edges: DataFrame, path: str) -> None:
    """One line for each row's columns. The format has no empty rows: a node without any is a ValueError."""
    rows = edges.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "col"))), lambda s: s["col"].cast("string")).alias("cols"))
    n = edges.agg(F.count_distinct("row").alias("n"), F.count(F.lit(1)).alias("nnz"), (F.max(F.greatest("row", "col")) + 1).alias("nodes")).first()
    if n.n and n.n != n.nodes:
        raise ValueError(f"{n.nodes - n.n} of {n.nodes} nodes have no row")
    _write(edges.sparkSession, path, ".graph", [f"{n.n} {n.nnz}\n", _plain(rows, ["row"], F.array_join("cols", " "))])


def write_ordering(p: DataFrame, path: str) -> None:
    _write(p.sparkSession, path, ".iperm", [_plain(p, ["old_id"], F.col("new_id").cast("string"))])


def write_grid(nodes: DataFrame, elements: DataFrame, bound: DataFrame, path: str) -> None:
    kinds = {r.kind: r["count"] for r in elements.groupBy("kind").count().collect()}
    parts = bound.groupBy("part").count().orderBy("part").collect()
    verts = F.array_join(F.transform("verts", lambda v: (v + 1).cast("string")), " ")
    sections = [
        f"{nodes.count()} {kinds.get('triangle', 0)} {kinds.get('quadrilateral', 0)}\n",
        _lines(nodes, ["id"], ["x", "y"], lambda x, y: f"{number(x)} {number(y)}"),
        *[_plain(elements.filter(F.col("kind") == kind), ["elem"], verts) for kind in ("triangle", "quadrilateral")],
        "".join(f"{v}\n" for v in [len(parts), *(r["count"] for r in parts)]),
        _plain(bound, ["part", "seq"], (F.col("node") + 1).cast("string")),
    ]
    _write(nodes.sparkSession, path, ".grid", sections)


def write_matrix_market(entries: DataFrame, path: str, rows: int, cols: int, value: str | None = "value", base: int = 0, order: Sequence[str] = ("row", "k")) -> None:
    """Triplets (row, col[, value]) in the order given; without a value column only the pattern."""
    keys = [c for c in order if c in entries.columns] or ["row", "col"]
    head = f"%%MatrixMarket matrix coordinate {'real' if value else 'pattern'} general\n{rows} {cols} {entries.count()}\n"
    lines = _lines(entries, keys, ["row", "col", *([value] if value else [])], lambda i, j, *v: " ".join([str(i + 1 - base), str(j + 1 - base), *map(number, v)]))
    _write(entries.sparkSession, path, ".mtx", [head, lines])


def _name(name: str) -> str:
    if not name or len(name.split()) != 1 or name != name.strip():
        raise ValueError(f"a name must be one word, not {name!r}")
    return name


def write_vtk(points: DataFrame, path: str, scalars: Iterable[str] = (), vectors: Iterable[tuple[str, str, str]] = (), title: str = "point cloud", kind: str = "double") -> None:
    """Legacy VTK poly data; vectors as (name, x column, y column)."""
    if len(title) > 255 or "\n" in title or "\r" in title:
        raise ValueError("the title must be one line of at most 255 characters")
    if kind not in ("double", "float"):
        raise ValueError("kind must be double or float")
    scalars, vectors, n = [_name(s) for s in scalars], [(_name(v), x, y) for v, x, y in vectors], points.count()
    plane = lambda x, y: f"{number(x)} {number(y)} 0"
    points = points.orderBy("id").persist()
    sections = [f"# vtk DataFile Version 2.0\n{title}\nASCII\nDATASET POLYDATA\nPOINTS {n} {kind}\n", _lines(points, ["id"], ["x", "y"], plane), f"VERTICES {n} {2 * n}\n"]
    sections.append(points.sparkSession.range(n).select(F.concat(F.lit("1 "), F.col("id").cast("string")).alias("value")))
    if scalars or vectors:
        sections.append(f"POINT_DATA {n}\n")
    for s in scalars:
        sections += [f"SCALARS {s} {kind} 1\nLOOKUP_TABLE default\n", _lines(points, ["id"], [s], number)]
    for name, x, y in vectors:
        sections += [f"VECTORS {name} {kind}\n", _lines(points, ["id"], [x, y], plane)]
    try:
        _write(points.sparkSession, path, ".vtk", sections)
    finally:
        points.unpersist()


def write_columns(points: DataFrame, path: str, columns: Sequence[str] = ()) -> None:
    head = " ".join(["# x y", *map(_name, columns)]) + "\n"
    _write(points.sparkSession, path, ".dat", [head, _lines(points, ["id"], ["x", "y", *columns], lambda *v: " ".join(map(number, v)))])
