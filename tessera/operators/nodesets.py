"""Node sets: tables (id, x, y, flag, file_id) made from files, grids or points of a periodic box."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.metric import Box
from tessera.operators import grid, neighbours
from tessera.sources import split


def _of(nodes: DataFrame) -> DataFrame:
    return nodes.select("id", "x", "y", F.col("flag").cast("int").alias("flag"), F.col("id").alias("file_id"))


def from_file(spark: SparkSession, path: str) -> DataFrame:
    """The nodes of a points or node file, read split by split; attributes are left out, a file without markers has flag 0."""
    nodes = split.read_nodes(spark, path) if path.endswith(".node") else split.read_points(spark, path)
    return _of(nodes.withColumn("flag", F.col("marker") if "marker" in nodes.columns else F.lit(0)))


def from_grid(nodes: DataFrame, bound: DataFrame) -> DataFrame:
    """The nodes of a grid, flagged with the first boundary part (from 1) that lists them."""
    return _of(nodes.join(grid.markers(nodes, bound).withColumnRenamed("marker", "flag"), "id"))


def from_points(points: DataFrame, box: Box | None = None, periodic: tuple[bool, bool] = (False, False)) -> DataFrame:
    """Points (id, x, y[, flag]) as nodes; along periodic axes they are moved into the box."""
    if any(periodic) and box is None:
        raise ValueError("a periodic node set needs a box")
    flagged = points if "flag" in points.columns else points.withColumn("flag", F.lit(0))
    around = Box(tuple(s if p else 0.0 for s, p in zip(box.sides, periodic, strict=True))) if any(periodic) else Box(())
    return _of(neighbours.wrapped(neighbours.validated(flagged), around))
