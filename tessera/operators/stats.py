"""Statistics of graphs and clouds."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.metric import OPEN, Box
from tessera.operators.lineage import cut, drop
from tessera.operators.neighbours import nearest

LINE = 8
#: Pairs of which one task merges the nodes that hang together, about 100 bytes each.
MERGED = 2_000_000


def bandwidth(edges: DataFrame) -> DataFrame:
    return edges.agg(F.coalesce(F.max(F.abs(F.col("row") - F.col("col"))), F.lit(0)).cast("long").alias("bandwidth"))


def graph_stats(edges: DataFrame) -> DataFrame:
    """One row: n, nnz, row lengths, rows not self-first, rows without diagonal, transposed entries, bandwidth."""
    first = F.max(F.when(F.col("k") == F.lit(1), F.col("col")))
    rows = edges.groupBy("row").agg(F.count(F.lit(1)).alias("size"), (F.coalesce(first, F.lit(-1)) != F.col("row")).cast("long").alias("other_first"), (1 - F.max((F.col("col") == F.col("row")).cast("long"))).alias("no_diagonal"), F.max(F.abs(F.col("row") - F.col("col"))).alias("reach"))
    total = rows.agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("nnz"), F.min("size").alias("row_min"), F.max("size").alias("row_max"), F.avg("size").alias("row_mean"),
        F.sum("other_first").alias("not_self_first"), F.sum("no_diagonal").alias("no_diagonal"), F.max("reach").alias("bandwidth"),
    )
    turned = edges.select(F.col("col").alias("row"), F.col("row").alias("col")).distinct()
    symmetric = edges.select("row", "col").join(turned, ["row", "col"], "left_semi").agg(F.count(F.lit(1)).alias("transposed"))
    return total.join(symmetric).withColumn("transposed_percent", 100 * F.col("transposed") / F.col("nnz"))


def cache_lines(edges: DataFrame, line: int = LINE) -> DataFrame:
    """row, reach, lines, line_reach: how far apart a row's columns lie in memory."""
    at = lambda c: F.floor(F.col(c) / line)
    return edges.groupBy("row").agg(F.max(F.abs(F.col("col") - F.col("row"))).alias("reach"), F.count_distinct(at("col")).alias("lines"), F.max(F.abs(at("col") - at("row"))).alias("line_reach"))


def count_unique(table: DataFrame, column: str) -> DataFrame:
    """How many different values a column has; null is none."""
    return table.agg(F.count_distinct(column).alias("values"))


def marker_histogram(points: DataFrame) -> DataFrame:
    return points.groupBy("flag").agg(F.count(F.lit(1)).alias("nodes"))


def node_counts(points: DataFrame) -> DataFrame:
    return points.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("flag") != 0).alias("boundary"), F.count_if(F.col("flag") == 0).alias("interior"))


def bounding_box(points: DataFrame) -> DataFrame:
    return points.agg(F.min("x").alias("xmin"), F.min("y").alias("ymin"), F.max("x").alias("xmax"), F.max("y").alias("ymax"))


def outside(points: DataFrame, box: Box) -> DataFrame:
    """How many nodes lie outside the periodic box [0, L)."""
    off = F.lit(False)
    for c, s in zip(("x", "y"), box.sides, strict=False):
        if s:
            off = off | (F.col(c) < 0) | (F.col(c) >= s)
    return points.agg(F.count_if(off).alias("outside"))


def nth(values: DataFrame, column: str, rank: int, buckets: int = 4096, few: int = 10_000) -> float:
    """The value that has ``rank`` values before it in order (from 0), by selection; no task and no buffer holds all values.

    Each pass counts the values that are left in buckets of equal width, from partial aggregates, and goes on with the bucket
    that holds the rank, until all its values are equal or few enough to sort. Values must be finite and not null.
    """
    left = values.select(F.col(column).cast("double").alias("v"))
    low, high, n = left.agg(F.min("v"), F.max("v"), F.count("v")).first()
    if not 0 <= rank < n:
        raise ValueError(f"there is no rank {rank} among {n} values")
    while low < high and n > few:
        # values near the ends of the range of doubles: half the difference does not overflow
        at = F.floor(F.least((F.col("v") / 2 - low / 2) / (high / 2 - low / 2), F.lit(1.0)) * (buckets - 1)).cast("int")
        for bucket in sorted(left.groupBy(at.alias("at")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()):
            if rank < bucket.n:
                break
            rank -= bucket.n
        low, high, n = bucket.low, bucket.high, bucket.n
        left = left.filter((F.col("v") >= low) & (F.col("v") <= high))
    if low == high:
        return low
    return sorted(r.v for r in left.collect())[rank]  # at most ``few`` values


def median(values: DataFrame, column: str, n: int) -> float:
    """The exact median of n values: the mean of the two in the middle if their number is even."""
    upper = nth(values, column, n // 2)
    return upper if n % 2 else (nth(values, column, n // 2 - 1) + upper) / 2


def cloud_stats(points: DataFrame, box: Box = OPEN) -> DataFrame:
    """One row: nearest-neighbour distance min, max, mean, median and population deviation, coincident nodes."""
    d = cut(nearest(points, box).select("dist"), "distances")
    middle = median(d, "dist", d.count())
    return d.agg(F.min("dist").alias("nn_min"), F.max("dist").alias("nn_max"), F.avg("dist").alias("nn_mean"), F.lit(middle).alias("nn_median"), F.stddev_pop("dist").alias("nn_std"), F.count_if(F.col("dist") == 0).alias("coincident"))


def summary(points: DataFrame, edges: DataFrame, extent: tuple[float, float]) -> DataFrame:
    """One row: counts, nodes per unit area, and the range of stencil sizes."""
    area = extent[0] * extent[1]
    if not (area > 0 and math.isfinite(area)):
        raise ValueError("the extent must be positive")
    rows = edges.groupBy("row").agg(F.count(F.lit(1)).alias("size")).agg(F.sum("size").alias("nnz"), F.min("size").alias("stencil_min"), F.max("size").alias("stencil_max"))
    return node_counts(points).withColumn("density", F.col("n") / area).join(rows)


def same_size(*tables: DataFrame) -> None:
    """A ValueError unless all tables of a case have equally many nodes."""
    sizes = [t.count() for t in tables]
    if len(set(sizes)) > 1:
        raise ValueError(f"the tables have different numbers of nodes: {sizes}")


def _merged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, root (the least id that it hangs together with) of the nodes of all pairs (row, col)."""
    pairs = [[c.to_numpy() for c in b.columns] for b in batches]
    if not pairs:
        return
    ids, code = np.unique(np.concatenate([c for pair in zip(*pairs, strict=True) for c in pair]), return_inverse=True)
    a, b = code[: len(code) // 2], code[len(code) // 2 :]
    root = np.arange(len(ids))
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while ((up := root[root]) != root).any():
            root = up
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    for i in range(0, len(ids), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(ids[i : i + 100_000]), pa.array(ids[root[i : i + 100_000]])], names=["id", "root"])


def connected(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """id, component (its least id), for symmetric pairs (row, col).

    While the pairs are many, every node joins the least one beside it, pointers are followed to their ends, and the graph of the groups
    goes on, with at most half as many nodes; one task merges what is left.
    """
    label = cut(nodes.select("id", F.col("id").alias("component")))
    edges = cut(pairs.filter("row < col").select(F.col("row").cast("long"), F.col("col").cast("long")).distinct())
    while True:
        last = edges.count() <= MERGED
        if last:
            to = cut(edges.repartition(1).mapInArrow(_merged, "id long, root long"))
        else:
            both = edges.union(edges.select("col", "row"))
            to = cut(both.groupBy(F.col("row").alias("id")).agg(F.min("col").alias("near")).select("id", F.least("id", "near").alias("root")))
            while True:
                up = to.select(F.col("id").alias("root"), F.col("root").alias("up"))
                to = cut(to.join(up, "root").select("id", F.col("up").alias("root"), (F.col("up") < F.col("root")).alias("moved")), instead=[to])
                if to.filter("moved").isEmpty():
                    break
        root = to.select(F.col("id").alias("component"), "root")
        label = cut(label.join(root, "component", "left").select("id", F.coalesce("root", "component").alias("component")), instead=[label])
        if last:
            drop(edges)
            drop(to)
            return label
        at = lambda c: to.select(F.col("id").alias(c), F.col("root").alias(f"{c}_root"))  # noqa: B023, E731
        ends = F.least("row_root", "col_root").alias("row"), F.greatest("row_root", "col_root").alias("col")
        edges = cut(edges.join(at("row"), "row").join(at("col"), "col").filter("row_root <> col_root").select(*ends).distinct(), instead=[edges])
        drop(to)
