"""Readers of large text files, points, nodes, graphs, orderings and grids, by as many tasks as the file has splits.

Spark's text source cuts a file into byte ranges and hands each range's lines on in order. A first pass writes the lines
with the range they come from and counts them there; sums over the ranges before give every line its number, and with
it every row its id. Headers are compared with aggregates. All faults are found before a row is handed on: the first
hundred are named with their line, of the others the number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import lines
from tessera.operators.lineage import cut
from tessera.operators.ordering import dense_number
from tessera.sources.text import FormatError

NAMED = 100


def numbered_lines(spark: SparkSession, path: str, comment: str | None = None) -> DataFrame:
    """line (from 1), data (from 0, counting lines that hold something; null for others), tokens of every line of a file.

    The ranges of a file are the source's own splits (spark.sql.files.maxPartitionBytes); no task sees more than one
    of them at a time.
    """
    raw = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    found = lines.tokens(lines.content(F.col("value"), comment))
    # numbers and counts must come from one pass, whatever executors are lost: the lines are a table
    rows = cut(raw.select("start", "at", found.alias("tokens")), "lines")
    some = F.size("tokens") > 0
    sizes = rows.groupBy("start").agg(F.count(F.lit(1)).alias("n"), F.count_if(some).alias("m"), F.min("at").alias("first"))
    earlier = Window.orderBy("start").rowsBetween(Window.unboundedPreceding, -1)  # one row for each split
    before = sizes.select("start", "first", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in ("n", "m")])
    inside = Window.partitionBy("start").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    counted = rows.withColumn("ahead", F.coalesce(F.sum(some.cast("long")).over(inside), F.lit(0))).join(before, "start")
    return counted.select((F.col("n_before") + F.col("at") - F.col("first") + 1).alias("line"), F.when(some, F.col("m_before") + F.col("ahead")).alias("data"), "tokens")


def _refuse(path: str, faults: DataFrame | None, more: list[str]) -> None:
    """A FormatError with all problems, in the order of their lines; nothing if there is none."""
    named, rest = [], 0
    if faults is not None:
        named = [r.what for r in faults.orderBy("line", "what").limit(NAMED + 1).collect()]
        if len(named) > NAMED:
            rest = faults.count() - NAMED
            named = named[:NAMED]
    problems = [*named, *([f"and {rest} more"] if rest else []), *more]
    if problems:
        raise FormatError(path, problems)


def _fault(rows: DataFrame, when: Column, what: Column) -> DataFrame:
    return rows.filter(when).select("line", what.alias("what"))


def _at(name: str, number: Column, text: str) -> Column:
    return F.concat(F.lit(f"{name} "), number.cast("string"), F.lit(f": {text}"))


def _header(path: str, rows: DataFrame, where: Column, size: int) -> list[int]:
    """The integers of the header, the one row for which ``where`` holds."""
    head = rows.filter(where).select("line", F.transform("tokens", lines.integer).alias("numbers"), F.size("tokens").alias("n")).first()
    if head is None:
        raise FormatError(path, ["no header"])
    if head.n != size:
        raise FormatError(path, [f"line {head.line}: {head.n} values instead of {size}"])
    if any(v is None for v in head.numbers):
        raise FormatError(path, [f"line {head.line}: not a number"])
    return head.numbers


def _number_faults(rows: DataFrame, name: str, number: Column, kinds: list[str]) -> DataFrame:
    """Rows whose tokens are not as many numbers of the kinds i and r as they should be, or have a coordinate that is not finite (r; attributes, a, may be so)."""
    token = [F.get("tokens", F.lit(i)) for i in range(len(kinds))]
    wrong, infinite = F.lit(False), F.lit(False)
    for t, kind in zip(token, kinds, strict=True):
        odd = lines.not_finite(t) if kind != "i" else F.lit(False)
        wrong = wrong | F.coalesce((lines.integer(t) if kind == "i" else lines.real(t)).isNull() & ~odd, F.lit(True))
        infinite = infinite | (F.coalesce(odd, F.lit(False)) if kind == "r" else F.lit(False))
    sized = F.size("tokens") == len(kinds)
    count = F.concat(F.lit(f"{name} "), number.cast("string"), F.lit(": "), F.size("tokens").cast("string"), F.lit(f" values instead of {len(kinds)}"))
    return _fault(rows, ~sized, count).union(_fault(rows, sized & wrong, _at(name, number, "not a number"))).union(_fault(rows, sized & ~wrong & infinite, _at(name, number, "a coordinate is not finite")))


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """id, x, y: a count on line 1, then that many lines of two coordinates; what follows is ignored."""
    rows = numbered_lines(spark, path)
    (n,) = _header(path, rows, F.col("line") == 1, 1)
    if n < 0:
        raise FormatError(path, ["line 1: a negative count"])
    body = rows.filter((F.col("line") > 1) & (F.col("line") <= n + 1))
    found = body.filter(F.size("tokens") > 0).count()
    _refuse(path, _number_faults(body.filter((F.size("tokens") > 0) | (F.lit(found) < n)), "line", F.col("line"), ["r", "r"]), [f"{n} points announced, {found} found"] if found < n else [])
    number = lambda i: lines.real(F.get("tokens", F.lit(i)))
    return body.select((F.col("line") - 2).alias("id"), number(0).alias("x"), number(1).alias("y"))


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    """id, x, y, marker, attrs: comments, blank lines, numbering from 0 or 1, attributes and an optional marker."""
    rows = numbered_lines(spark, path, "#")
    n, dim, nattr, nmark = _header(path, rows, F.col("data") == 0, 4)
    if n < 0 or dim != 2 or nattr < 0 or nmark not in (0, 1):
        raise FormatError(path, ["the header must be a count, dimension 2, attributes, and 0 or 1 markers"])
    body = rows.filter(F.col("data") > 0).withColumn("i", F.col("data") - 1)
    found, kept = body.count(), body.filter(F.col("i") < n)
    kinds = ["i", "r", "r", *["a"] * nattr, *["i"] * nmark]
    index = lines.integer(F.get("tokens", F.lit(0)))
    base = kept.filter("i = 0").select(index.alias("base")).first()
    base = base.base if base and base.base in (0, 1) else 0
    order = _fault(kept, (F.size("tokens") == len(kinds)) & index.isNotNull() & (index - F.col("i") != base), _at("line", F.col("line"), "nodes are not numbered consecutively from 0 or 1"))
    _refuse(path, _number_faults(kept, "line", F.col("line"), kinds).union(order), [f"{n} nodes announced, {found} lines found"] if found != n else [])
    token = lambda i: F.get("tokens", F.lit(i))
    value = lambda t: t.try_cast("double")  # noqa: E731  attributes may be infinite
    marker = lines.integer(token(3 + nattr)).cast("int") if nmark else F.lit(0)
    attrs = F.transform(F.slice("tokens", 4, nattr), value) if nattr else F.array().cast("array<double>")
    return kept.select(F.col("i").alias("id"), lines.real(token(1)).alias("x"), lines.real(token(2)).alias("y"), marker.alias("marker"), attrs.alias("attrs"))


def read_graph(spark: SparkSession, path: str, k: int = 0) -> DataFrame:
    """row, k, col: rows of column numbers; with k, all rows have that length. Blank lines may only stand at the end."""
    rows = numbered_lines(spark, path)
    n, nnz = _header(path, rows, F.col("line") == 1, 2)
    body = rows.filter("line > 1").withColumn("row", F.col("line") - 2)
    entries = F.transform("tokens", lines.integer)
    whole = ~F.exists(entries, lambda v: v.isNull())
    full = body.filter(F.size("tokens") > 0).withColumn("cols", entries)
    good = full.filter(whole & (F.col("row") < n))
    told = good.agg(F.sum(F.size("cols")).alias("nnz"), F.min(F.array_min("cols")).alias("low"), F.max(F.array_max("cols")).alias("high")).first()
    last = full.agg(F.max("row")).first()[0]
    found = 0 if last is None else last + 1
    faults = _fault(body.filter(F.col("row") < min(found, n)), F.size("tokens") == 0, F.concat(F.lit("row "), F.col("row").cast("string"), F.lit(" has no entries")))
    faults = faults.union(_fault(full, ~whole & (F.col("row") < n), _at("row", F.col("row"), "not a number")))
    if k:
        size = F.concat(F.lit("row "), F.col("row").cast("string"), F.lit(" has "), F.size("cols").cast("string"), F.lit(f" entries instead of {k}"))
        faults = faults.union(_fault(good, F.size("cols") != k, size))
    outside = F.filter("cols", lambda v: (v < 0) | (v >= n))
    faults = faults.union(_fault(good, F.size(outside) > 0, F.concat(F.lit("row "), F.col("row").cast("string"), F.lit(": "), F.get(outside, F.lit(0)).cast("string"), F.lit(" is out of range"))))
    faults = faults.union(_fault(good, F.size(F.array_distinct("cols")) < F.size("cols"), _at("row", F.col("row"), "a number is listed twice")))
    more = [f"{nnz} entries announced, but {n} rows of {k}"] if k and nnz != n * k else []
    more += [f"{n} rows announced, {found} found"] if found != n else []
    more += ["the numbering looks 1-based"] if n and told.low is not None and told.low >= 1 and told.high == n else []
    more += [f"{nnz} entries announced, {told.nnz or 0} found"] if (told.nnz or 0) != nnz else []
    _refuse(path, faults, more)
    return good.select("row", F.posexplode("cols").alias("k", "col")).select("row", (F.col("k") + 1).cast("int").alias("k"), "col")


def read_ordering(spark: SparkSession, path: str) -> DataFrame:
    """old_id, new_id: one number after another, the new id of each node."""
    rows = numbered_lines(spark, path)
    values = rows.select("line", F.posexplode(F.transform("tokens", lines.integer)).alias("pos", "new_id"))
    told = values.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("new_id").isNull()).alias("odd"), F.min("new_id").alias("low"), F.max("new_id").alias("high")).first()
    if told.odd:
        raise FormatError(path, ["the file: not a number"])
    if told.n:
        distinct = values.select("new_id").distinct().count()
        if distinct != told.n or told.low != 0 or told.high != told.n - 1:
            one = distinct == told.n and told.low == 1 and told.high == told.n
            raise FormatError(path, ["the numbering looks 1-based" if one else f"not a permutation of 0..{told.n - 1}"])
    return dense_number(values, ["line", "pos"], "old_id").select("old_id", "new_id")


def read_grid(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes (id, x, y), elements (kind, elem, verts) and boundary parts (part, seq, node) of a grid; blank lines count for nothing.

    Where a section begins follows from the header and, for boundary parts, from the lengths before them, of which there is one for each part.
    """
    rows = cut(numbered_lines(spark, path).filter("data is not null"), "lines")
    n, nt, nq = _header(path, rows, F.col("data") == 0, 3)
    if min(n, nt, nq) < 0:
        raise FormatError(path, ["a negative count in the header"])
    total, at = rows.count(), n + nt + nq + 1
    if total <= at:
        raise FormatError(path, ["the file ends before the number of boundary parts"])
    (nb,) = _header(path, rows, F.col("data") == at, 1)
    if nb < 0 or total <= at + nb:
        raise FormatError(path, ["the file ends before the lengths of the boundary parts" if nb >= 0 else "a negative number of boundary parts"])
    section = lambda first, size: rows.filter((F.col("data") >= first) & (F.col("data") < first + size))
    numbers = lambda table, kinds: _number_faults(table, "line", F.col("line"), kinds)
    told = lambda text: _at("line", F.col("line"), text)
    whole = F.transform("tokens", lines.integer)
    single = lines.integer(F.get("tokens", F.lit(0)))

    lengths = section(at + 1, nb)
    _refuse(path, numbers(lengths, ["i"]).union(_fault(lengths, (F.size("tokens") == 1) & (single < 2), told("a boundary part has fewer than two nodes"))), [])
    earlier = Window.orderBy("data").rowsBetween(Window.unboundedPreceding, -1)  # one row for each boundary part
    parts = lengths.select((F.col("data") - at - 1).cast("int").alias("part"), single.alias("size"), F.coalesce(F.sum(single).over(earlier), F.lit(0)).alias("start"))
    announced, found = parts.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0], total - at - nb - 1
    if announced != found:
        raise FormatError(path, ["data behind the last boundary part" if found > announced else f"{announced} boundary nodes announced, {found} found"])
    places = parts.select("part", "start", F.explode(F.expr("sequence(0L, size - 1)")).alias("seq")).select((F.col("start") + F.col("seq") + at + nb + 1).alias("data"), "part", F.col("seq").cast("int").alias("seq"))
    bound = section(at + nb + 1, announced).join(places, "data").withColumn("v", single)

    xy, faults, shapes = section(1, n), numbers(bound, ["i"]), []
    faults = faults.union(numbers(xy, ["r", "r"])).union(_fault(bound, (F.col("v") < 1) | (F.col("v") > n), told("a boundary node is out of range")))
    ahead = bound.select((F.col("data") + 1).alias("data"), F.col("part").alias("of"), F.col("v").alias("w"))
    faults = faults.union(_fault(bound.join(ahead, "data"), (F.col("part") == F.col("of")) & (F.col("v") == F.col("w")), told("a boundary part repeats a node")))
    for kind, first, count, size in (("triangle", n + 1, nt, 3), ("quadrilateral", n + nt + 1, nq, 4)):
        table = section(first, count).withColumn("v", whole)
        faults = faults.union(numbers(table, ["i"] * size))
        faults = faults.union(_fault(table, F.exists("v", lambda v: (v < 1) | (v > n)), told(f"a {kind} names a node out of range")))
        faults = faults.union(_fault(table, F.size(F.array_distinct("v")) < F.size("v"), told(f"a {kind} names a node twice")))
        shapes.append(table.select(F.lit(kind).alias("kind"), (F.col("data") - first).alias("elem"), F.transform("v", lambda v: v - 1).alias("verts")))
    _refuse(path, faults, [])
    number = lambda i: lines.real(F.get("tokens", F.lit(i)))
    nodes = xy.select((F.col("data") - 1).alias("id"), number(0).alias("x"), number(1).alias("y"))
    return nodes, shapes[0].union(shapes[1]), bound.select("part", "seq", (F.col("v") - 1).alias("node"))
