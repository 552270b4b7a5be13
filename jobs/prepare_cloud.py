"""Prepares a cloud for the assembly of stencil operators: numbering, boundary last, stencils, blocks of rows.

    python -m jobs.prepare_cloud --tables DIR --output DIR [--config FILE]

Reads a table of scattered nodes, folds them into the (periodic) box, numbers them along a space-filling curve with the
boundary behind the interior, finds the k nearest neighbours of every node and writes one row for each node: its number
in the table, place, flag, stencil in order of distance, and the stencil's reach. The output is partitioned into
blocks of consecutive rows, so that an assembly reads the rows it solves and nothing else. A second output, ``summary``,
holds one row: nodes, boundary nodes, and the bandwidth before and after.

A rerun replaces both outputs as a whole, with the same result. An incomplete run leaves no ``_SUCCESS`` file and is
mended by running again.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import common
from tessera.functions.metric import Box
from tessera.operators import neighbours, ordering, stats
from tessera.operators.lineage import cut, drop

log = logging.getLogger("prepare_cloud")
ROWS = "row long, file_id long, x double, y double, flag int, stencil array<long>, reach double, block long"


def read_cloud(spark: SparkSession, tables: str, config: dict) -> DataFrame:
    table = spark.read.parquet(f"{tables.rstrip('/')}/{config['table']}")
    columns = {"id": "long", "x": "double", "y": "double", "flag": "int"}
    return table.select(*[F.expr(config[c]).cast(kind).alias(c) for c, kind in columns.items()])


def numbered(cloud: DataFrame, curve: str) -> DataFrame:
    """The nodes under new ids: along the curve, and the boundary behind the interior."""
    along = ordering.curve_order(cloud, curve)
    sorted_out = ordering.renumber_nodes(cloud, along)
    return ordering.renumber_nodes(sorted_out, ordering.boundary_last(sorted_out))


def run(spark: SparkSession, tables: str, output: str, config: dict) -> dict:
    """Reads the table, writes ``output/rows`` and ``output/summary``; returns the summary."""
    box = Box(tuple(config["sides"]))
    cloud = read_cloud(spark, tables, config)
    n = cloud.count()
    log.info("read %d nodes of %s", n, config["table"])
    nodes = cut(numbered(neighbours.wrapped(cloud, box), config["curve"]), "nodes")
    edges = cut(neighbours.knn_stencils(nodes, config["k"], box), "edges")
    found = edges.groupBy(F.col("row").alias("id")).agg(F.sort_array(F.collect_list(F.struct("k", "col"))).alias("found"), F.max("dist").alias("reach"))
    block = F.floor(F.col("id") / config["block_rows"]).cast("long")
    rows = nodes.join(found, "id").select(F.col("id").alias("row"), "file_id", "x", "y", "flag", F.col("found.col").alias("stencil"), "reach", block.alias("block"))
    # a block is written by one task, and its rows stand in order
    rows.repartition("block").sortWithinPartitions("block", "row").write.mode("overwrite").partitionBy("block").parquet(f"{output}/rows")
    back = nodes.select(F.col("id").alias("old_id"), F.col("file_id").alias("new_id"))
    counts = stats.node_counts(nodes).first()
    told = {
        "nodes": counts.n,
        "boundary": counts.boundary,
        "bandwidth_before": stats.bandwidth(ordering.renumber_edges(edges, back)).first().bandwidth,
        "bandwidth": stats.bandwidth(edges).first().bandwidth,
    }
    summary = spark.createDataFrame([tuple(told.values())], ", ".join(f"{name} long" for name in told))
    summary.coalesce(1).write.mode("overwrite").parquet(f"{output}/summary")
    written = read(spark, output).agg(F.count(F.lit(1)), F.count_distinct("block")).first()
    log.info("wrote %d rows in %d blocks to %s; %s", written[0], written[1], output, told)
    for table in (nodes, edges):
        drop(table)
    return told


def read(spark: SparkSession, output: str) -> DataFrame:
    """The rows that a run has written."""
    return spark.read.schema(ROWS).parquet(f"{output}/rows")


if __name__ == "__main__":
    common.main("prepare_cloud", "Numbers a cloud and finds its stencils, in blocks of rows.", {"tables": "folder of the tables", "output": "folder to write to"}, run)
