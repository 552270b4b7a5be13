"""Whole flows over files: inspecting a case, reordering a graph, writing a generated cloud with its stencils."""

from __future__ import annotations

import math
from functools import reduce
from itertools import takewhile

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.metric import OPEN, Box
from tessera.operators import dissection, factor, neighbours, ordering, stats
from tessera.operators.lineage import cut
from tessera.sources import generators, regions, sinks, split
from tessera.sources.text import FormatError

SCHEMA = "file string, metric string, value double, fault string"


def _cloud(df: DataFrame, box: Box) -> list[DataFrame]:
    """Tables of a cloud's numbers (one row each), then one of its faults."""
    nodes = df.withColumn("flag", F.col("marker") if "marker" in df.columns else F.lit(0))
    names = F.concat(F.lit("marker "), F.col("flag").cast("string"))
    markers = stats.marker_histogram(nodes).select(names.alias("metric"), F.col("nodes").cast("double").alias("value"))
    twins = neighbours.coincident(neighbours.wrapped(nodes, box)).select(F.concat(F.lit("coincident nodes: "), F.col("nodes").cast("string"), F.lit(" stand where node "), F.col("first_id").cast("string"), F.lit(" is")).alias("fault"))
    tables = [stats.node_counts(nodes), stats.bounding_box(nodes), stats.outside(nodes, box)]
    if len(nodes.head(2)) == 2:
        tables.append(stats.cloud_stats(nodes, box))
    return [*map(_tall, tables), markers, twins]


def _tall(one_row: DataFrame) -> DataFrame:
    """A row for each column of a table of one row."""
    values = one_row.select(*[F.col(c).cast("double").alias(c) for c in one_row.columns])
    return values.unpivot([], values.columns, "metric", "value").filter("value is not null")


#: Files are read by as many tasks as they have splits.
READERS = {".points": split.read_points, ".node": split.read_nodes, ".graph": split.read_graph, ".iperm": split.read_ordering}

#: What is told of each kind of file, by the extension of its name.
MEASURES = {
    ".points": _cloud,
    ".node": _cloud,
    ".graph": lambda df, box: [_tall(stats.graph_stats(df))],
    ".iperm": lambda df, box: [_tall(df.agg(F.count(F.lit(1)).alias("n")))],
}


def _told(spark: SparkSession, path: str, error: Exception) -> DataFrame:
    """The faults that a reader reported, from the driver or, as text, from a task."""
    if isinstance(error, FormatError):
        faults = error.problems
    else:  # behind the name of the error its problems, a line each, and then the stack
        lines = str(error).rpartition("FormatError: ")[2].split("\n")
        faults = [x.strip() for x in takewhile(lambda x: x.strip() and not x.startswith("\t"), lines)] or [type(error).__name__]
    return spark.createDataFrame([(path, None, None, x) for x in faults], SCHEMA)


def inspect(spark: SparkSession, paths: list[str], box: Box = OPEN) -> DataFrame:
    """file, metric, value, fault: the numbers of each file of a case, and a row for each fault.

    Files that cannot be read tell their faults only. The files' numbers of nodes have to agree: if not, one fault
    without a file says which has how many.
    """
    found = []
    for path in paths:
        extension = "." + path.rpartition(".")[2]
        try:
            df = cut(READERS[extension](spark, path))
        except (FormatError, PySparkException, Py4JError) as e:
            found.append(_told(spark, path, e))
            continue
        for table in MEASURES[extension](df, box):
            has = set(table.columns)
            found.append(table.select(F.lit(path).alias("file"), *[(F.col(c) if c in has else F.lit(None)).cast(t).alias(c) for c, t in (("metric", "string"), ("value", "double"), ("fault", "string"))]))
    table = cut(reduce(DataFrame.unionAll, found, spark.createDataFrame([], SCHEMA)))
    told = F.concat_ws(": ", "file", F.col("value").cast("long").cast("string"))
    sizes = table.filter("metric = 'n'").agg(F.count_distinct("value").alias("sizes"), F.array_join(F.array_sort(F.collect_list(told)), ", ").alias("told")).filter("sizes > 1")
    clash = sizes.select(F.lit(None).cast("string"), F.lit("n"), F.lit(None).cast("double"), F.concat(F.lit("the files disagree about the number of nodes: "), "told"))
    return table.unionAll(clash)


#: Orders of a graph by the names of their methods.
ORDERS = {"rcm": ordering.reverse_cuthill_mckee, "nd": dissection.graph_dissection, "amd": factor.minimum_degree}


def reorder(spark: SparkSession, graph: str, out: str, method: str = "rcm", fill: bool = False) -> DataFrame:
    """Writes the order of a graph file by a method (rcm, nd or amd); one row: bandwidth before and after, and, with fill, the entries of the factor.

    Nodes keep their numbers from 0 to the last row of the file.
    """
    if method not in ORDERS:
        raise ValueError(f"the method is one of {', '.join(ORDERS)}")
    edges = cut(split.read_graph(spark, graph), "graph")
    p = cut(ORDERS[method](edges), "order")
    sinks.write_ordering(p, out)
    after = stats.bandwidth(ordering.renumber_edges(edges, p)).withColumnRenamed("bandwidth", "after")
    report = stats.bandwidth(edges).withColumnRenamed("bandwidth", "before").join(after)
    if fill:
        same = p.select("old_id", F.col("old_id").alias("new_id"))
        for name, order in (("fill_before", same), ("fill_after", p)):
            report = report.join(factor.factor_nonzeros(edges, order).withColumnRenamed("nonzeros", name))
    return report


def finish(nodes: DataFrame, stem: str, extent: tuple[float, float], box: Box = OPEN, method: str = "knn", value: float = 18, kind: str = "node", title: str | None = None) -> DataFrame:
    """Writes a cloud and its stencils (knn by number, radius or range by reach); one row of summary."""
    if method == "knn":
        edges = neighbours.knn_stencils(nodes, int(value), box, on_duplicate="error")
    else:
        edges = neighbours.within(nodes, value, box, norm={"radius": "euclid", "range": "chebyshev"}[method], on_duplicate="error")
    edges = cut(edges)
    if kind == "node":
        sinks.write_nodes(nodes.withColumnRenamed("flag", "marker"), stem, title=title)
    else:
        sinks.write_points(nodes, stem)
    sinks.write_graph(edges, stem)
    return stats.summary(nodes, edges, extent)


#: Clouds by the name of their generator; each takes a session and its own options, and refuses bad ones.
GENERATORS = {
    "disk": generators.disk,
    "eccentric_annulus": regions.eccentric_annulus,
    "multilobe": regions.multilobe,
    "perturbed_grid": generators.grid,
    "poisson_box": regions.poisson_box,
    "polar_region": regions.polar_region,
    "reentrant_corner": lambda spark, **options: generators.ReentrantCorner(**options).nodes(spark),
    "refined_cavity": generators.cavity,
    "triangle": generators.triangle,
}


def generate(spark: SparkSession, name: str, stem: str, box: Box = OPEN, method: str = "knn", value: float = 18, **options) -> DataFrame:
    """Draws a cloud, writes it with its stencils (the 18 nearest nodes unless told otherwise), and sums it up in one row."""
    if method not in ("knn", "radius", "range"):
        raise ValueError("the method is knn, radius or range")
    if not (value >= 2 and float(value).is_integer() if method == "knn" else 0 < value < math.inf):
        raise ValueError("knn takes a whole number from 2 on, radius and range a positive reach")
    nodes = cut(GENERATORS[name](spark, **options))
    r = stats.bounding_box(nodes).first()
    extent = tuple(box.side(i) or high - low for i, (low, high) in enumerate(((r.xmin, r.xmax), (r.ymin, r.ymax))))
    stem = stem.removesuffix(".node").removesuffix(".points")
    return finish(nodes, stem, extent, box, method, value, title=f"{name} {', '.join(f'{k}={v}' for k, v in options.items())}")
