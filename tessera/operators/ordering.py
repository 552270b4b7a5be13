"""Numberings: curve orders, stable partitions, permutation tables and the renumbering of nodes and graphs.

A permutation is a table (old_id, new_id). Dense ranks over a whole table are computed from range
partitions: each partition is ranked by itself and shifted by the sizes of those before it.
"""

from __future__ import annotations

import base64
import math
import uuid
from collections.abc import Iterable, Iterator, Sequence
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import curves
from tessera.operators.lineage import cut, shared_dir
from tessera.operators.names import fresh
from tessera.operators.neighbours import validated

#: Entries of a graph that a task of a walk holds at most, about 50 bytes each at its peak.
HELD = 10_000_000
#: Nodes of a level that the tasks of a walk tell each other at most.
WIDE = 100_000


def dense_number(df: DataFrame, keys: Sequence[Column | str], name: str) -> DataFrame:
    """Numbers all rows from 0 in the order of keys, which must tell all rows apart; no single task sees all of them."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part, size, before, place, *cols = fresh(df, "__part", "__size", "__before", "__n", *[f"__k{i}" for i in range(len(keys))])
    dealt = df.withColumns({c: F.col(k) if isinstance(k, str) else k for c, k in zip(cols, keys, strict=True)})
    # ranges and counts must come from one pass, whatever executors are lost: the dealt rows are a table
    dealt = cut(dealt.repartitionByRange(n, *cols).withColumn(part, F.spark_partition_id()))
    sizes = dealt.groupBy(part).agg(F.count(F.lit(1)).alias(size))
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    shifts = sizes.select(part, F.coalesce(F.sum(size).over(earlier), F.lit(0)).alias(before))
    inside = F.row_number().over(Window.partitionBy(part).orderBy(*cols))
    numbered = dealt.withColumn(place, inside).join(F.broadcast(shifts), part)
    return numbered.withColumn(name, (F.col(before) + F.col(place) - 1).cast("long")).drop(part, place, before, *cols)


def bbox(points: DataFrame) -> tuple[float, float, float, float]:
    r = points.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    if r[0] is None:
        raise ValueError("the cloud is empty")
    return tuple(r)


def curve_keys(points: DataFrame, curve: str = "morton", ndiv: int = 16, box: tuple | None = None) -> DataFrame:
    """id, key along a Morton or Hilbert curve over the cloud's bounding box (or a given one)."""
    make = {"morton": curves.morton_key, "hilbert": curves.hilbert_key}[curve]
    validated(points)
    return points.select("id", make(F.col("x"), F.col("y"), box or bbox(points), ndiv).alias("key"))


def order_by(rows: DataFrame, *keys: Column | str) -> DataFrame:
    """The permutation that sorts rows (id, ...) by keys, stably by id."""
    return dense_number(rows.withColumnRenamed("id", "old_id"), [*keys, "old_id"], "new_id").select("old_id", "new_id")


def curve_order(points: DataFrame, curve: str = "morton", ndiv: int = 16, box: tuple | None = None) -> DataFrame:
    return order_by(curve_keys(points, curve, ndiv, box), "key")


def partition_last(points: DataFrame, is_last: Column) -> DataFrame:
    """Rows for which is_last holds go behind the others; both keep their order."""
    mark = fresh(points, "__last")[0]
    return order_by(points.withColumn(mark, is_last.cast("int")), mark)


def boundary_last(points: DataFrame) -> DataFrame:
    return partition_last(points, F.col("flag") != 0)


def boundary_last_by_index(points: DataFrame, listed: DataFrame) -> DataFrame:
    """As boundary_last, for the ids of a table; an id that no point has is an error."""
    unknown = listed.select("id").join(points.select("id"), "id", "left_anti").count()
    if unknown:
        raise ValueError(f"{unknown} listed ids are not in the cloud")
    mark = fresh(points, "__in")[0]
    marked = points.join(listed.select("id").distinct().withColumn(mark, F.lit(1)), "id", "left")
    return partition_last(marked, F.col(mark).isNotNull())


def boundary_first(points: DataFrame) -> DataFrame:
    return partition_last(points, F.col("flag") == 0)


def identity(df: DataFrame) -> DataFrame:
    return df.select(F.col("id").alias("old_id"), F.col("id").alias("new_id"))


def inverse(p: DataFrame) -> DataFrame:
    return p.select(F.col("new_id").alias("old_id"), F.col("old_id").alias("new_id"))


def then(p: DataFrame, q: DataFrame) -> DataFrame:
    """First p, then q."""
    second = q.select(F.col("old_id").alias("new_id"), F.col("new_id").alias("__to"))
    return p.join(second, "new_id").select("old_id", F.col("__to").alias("new_id"))


def permute(rows: DataFrame, p: DataFrame, key: str = "id") -> DataFrame:
    """Rows renumbered from old to new ids."""
    moved = rows.join(p.select(F.col("old_id").alias(key), "new_id"), key)
    return moved.select(*[F.col("new_id").alias(c) if c == key else F.col(c) for c in rows.columns])


def unpermute(rows: DataFrame, p: DataFrame, key: str = "id") -> DataFrame:
    return permute(rows, inverse(p), key)


def check_permutation(p: DataFrame) -> DataFrame:
    """The table, or a ValueError if it is no permutation of 0..n-1."""
    r = p.agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{c}_{f.__name__}") for c in ("old_id", "new_id") for f in (F.min, F.max, F.count_distinct)]).first()
    if r.n and any(r[f"{c}_min"] != 0 or r[f"{c}_max"] != r.n - 1 or r[f"{c}_count_distinct"] != r.n for c in ("old_id", "new_id")):
        raise ValueError("not a permutation of 0..n-1")
    return p


def renumber_nodes(nodes: DataFrame, p: DataFrame) -> DataFrame:
    """Nodes under their new ids; file_id keeps the number in the file through any chain of renumberings."""
    if "file_id" not in nodes.columns:
        nodes = nodes.withColumn("file_id", F.col("id"))
    return permute(nodes, p)


def renumber_edges(edges: DataFrame, p: DataFrame) -> DataFrame:
    """Rows and columns of a stencil graph (row, k, col) under new ids; the order within a row stays."""
    return permute(permute(edges, p, "row"), p, "col")


def row_pointer(edges: DataFrame, nodes: int | None = None) -> DataFrame:
    """row, ia: where each row's entries begin, and one row more for the end; a row without entries begins where the next one does.

    Rows go from 0 to the given number of nodes, by default to the greatest number in the graph. The running sum
    goes over range partitions, as in dense_number.
    """
    most = edges.agg(F.max(F.greatest("row", "col"))).first()[0]
    rows = (0 if most is None else most + 1) if nodes is None else nodes
    if most is not None and most >= rows:
        raise ValueError(f"the graph has a node {most}, beyond {rows} nodes")
    counts = edges.groupBy("row").agg(F.count(F.lit(1)).alias("size"))
    sizes = edges.sparkSession.range(rows).select(F.col("id").alias("row")).join(counts, "row", "left").fillna(0, ["size"])
    n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(sizes.repartitionByRange(n, "row").withColumn("__part", F.spark_partition_id()))
    order = Window.partitionBy("__part").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    per = dealt.groupBy("__part").agg(F.sum("size").alias("__size"))
    before = per.select("__part", F.coalesce(F.sum("__size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    ends = dealt.withColumn("__to", F.sum("size").over(order)).join(F.broadcast(before), "__part")
    starts = ends.select((F.col("row") + 1).alias("row"), (F.col("__before") + F.col("__to")).cast("long").alias("ia"))
    return edges.sparkSession.createDataFrame([(0, 0)], "row long, ia long").union(starts)


def adjacency(edges: DataFrame) -> DataFrame:
    """The pattern of A + A^T without its diagonal."""
    both = edges.select("row", "col").union(edges.select(F.col("col").alias("row"), F.col("row").alias("col")))
    return both.filter("row <> col").distinct()


def _slots(spark: SparkSession) -> int:
    """How many tasks run at the same time, or 0 if Spark can't start tasks together."""
    if spark.conf.get("spark.dynamicAllocation.enabled", "false") == "true":
        return 0
    sc = spark.sparkContext._jsc.sc()
    return sc.maxNumConcurrentTasks(sc.resourceProfileManager().defaultResourceProfile())


def _walked(batches: Iterable[pa.RecordBatch], front: np.ndarray, seen: np.ndarray, depth: int, tasks: int) -> Iterator[pa.RecordBatch]:
    """id, rank, level of the levels that follow front (ids by rank), until there is none or one with more nodes than ``WIDE``.

    The entries (row, col, degree) come sorted by row. One task holds them all, or several that run at the same time hold them between them: these tell
    each other for each level which nodes their entries lead to, all of them put the level together, and each gives a share of it back.
    """
    context = BarrierTaskContext.get() if tasks > 1 else None
    me = context.partitionId() if context else 0
    none = np.zeros(0, np.int64)
    rows, first, col, degree, held = [none], [none], [none], [none.astype(np.int32)], 0
    for batch in batches:
        row = batch.column(0).to_numpy()
        begin = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else none
        rows.append(row[begin])
        first.append(begin + held)
        col.append(batch.column(1).to_numpy().copy())
        degree.append(batch.column(2).to_numpy().astype(np.int32))
        held += len(row)
    rows, first, col, degree = map(np.concatenate, (rows, first, col, degree))
    whole = np.append(True, rows[1:] != rows[:-1])[: len(rows)]  # a row may go on in the next batch
    rows, first = rows[whole], first[whole]
    ends = np.append(first[1:], held)[: len(rows)]
    cols, at, code = np.unique(col, return_index=True, return_inverse=True)
    degrees, met = degree[at], np.zeros(len(cols), bool)
    del col, degree

    def places(of: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the ids are there, and where."""
        place = np.searchsorted(of, ids)
        there = np.flatnonzero(place < len(of))
        there = there[of[place[there]] == ids[there]]
        return there, place[there]

    met[places(cols, seen)[1]] = True
    kept, waiting = [], 0
    while True:
        parent, place = places(rows, front)
        size = ends[place] - first[place]
        entry = np.repeat(first[place] - np.cumsum(size) + size, size) + np.arange(size.sum())
        reached, parent = code[entry], np.repeat(parent, size)
        new = ~met[reached]
        reached, at = np.unique(reached[new], return_index=True)  # the first parent of each, as parents go by rank
        found = np.column_stack([parent[new][at], degrees[reached], cols[reached]]).astype(np.int64)
        if context:
            said = context.allGather(base64.b64encode(found.tobytes()).decode() if len(found) <= WIDE // tasks else "wide")
            if "wide" in said:
                break
            found = np.frombuffer(b"".join(map(base64.b64decode, said)), np.int64).reshape(-1, 3)
        if not len(found):
            break
        found = found[np.lexsort((found[:, 0], found[:, 2]))]  # of each node the first parent in any task
        found = found[np.append(True, found[1:, 2] != found[:-1, 2])]
        front = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0])), 2]
        met[places(cols, front)[1]] = True
        depth += 1
        rank = np.arange(me, len(front), tasks)
        kept.append(pa.RecordBatch.from_arrays([pa.array(front[rank]), pa.array(rank), pa.array(np.full(len(rank), depth, np.int32))], names=["id", "rank", "level"]))
        waiting += len(rank)
        if waiting > WIDE:
            yield pa.concat_batches(kept)
            kept, waiting = [], 0
    if kept:
        yield pa.concat_batches(kept)


def reverse_cuthill_mckee(edges: DataFrame) -> DataFrame:
    """The reverse Cuthill-McKee order of a symmetrised graph.

    Each component is searched breadth first from a node of least degree. The nodes of a level stand in the order of
    their first neighbours in the level before, then by degree and id; components go by their least ids, and the whole is reversed.

    All components go level by level together. A neighbour of a level lies in it, in the one before or in the next one, so
    a level is met with two others only. Narrow levels are walked in memory, by one task or, if the graph has more than ``HELD`` entries, by some
    that hold it between them and meet for each level, so that very many levels take one job. A level of more than ``WIDE`` nodes, or any of a
    graph that as many tasks as run at once can't hold, is found by joins and written once; numbers within it only have to tell its order: they
    come from sorted ranges.
    """
    from tessera.operators.stats import connected

    spark = edges.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    edges = cut(edges.select("row", "col"))  # stencils that are still to be found are found once
    plain = cut(adjacency(edges))
    nodes = edges.select(F.col("row").alias("id")).union(edges.select(F.col("col").alias("id"))).distinct()
    degree = plain.groupBy(F.col("row").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    pairs = cut(plain.join(degree.withColumnRenamed("id", "col"), "col").select("row", "col", "degree"))
    known = cut(nodes.join(degree, "id", "left").fillna(0, ["degree"]).join(connected(nodes, pairs), "id"))
    start = known.groupBy("component").agg(F.min(F.struct("degree", "id")).alias("s")).select("s.id", F.col("component").alias("rank"))
    levels, schema = f"{shared_dir(spark)}/levels-{uuid.uuid4().hex}", "id long, rank long"

    def put(rows: DataFrame, depth: int) -> DataFrame:
        rows.write.parquet(f"{levels}/level={depth}")
        return spark.read.schema(schema).parquet(f"{levels}/level={depth}")

    depth, walks = 0, []
    level = before = put(start, 0)
    entries = pairs.count()
    tasks = max(1, math.ceil(entries / HELD))
    walks_fit = tasks == 1 or tasks <= _slots(spark)
    while not level.isEmpty():
        met = level.select("id").union(before.select("id")).distinct()
        if walks_fit and met.count() <= WIDE:
            front = np.array([r.id for r in level.orderBy("rank").collect()], np.int64)
            seen = np.array([r.id for r in met.collect()], np.int64)
            walk = partial(_walked, front=front, seen=seen, depth=depth, tasks=tasks)
            dealt = pairs.select("row", "col", "degree").repartition(tasks).sortWithinPartitions("row")
            walks.append(cut(dealt.mapInArrow(walk, f"{schema}, level int", barrier=tasks > 1)))
            last = walks[-1].agg(F.max("level")).first()[0]
            if last is not None:
                at = lambda k: walks[-1].filter(F.col("level") == k).select("id", "rank")
                before, level = at(last - 1) if last - 1 > depth else level, at(last)
                depth, met = last, level.select("id").union(before.select("id"))
        # what follows a walk is a wide level or none
        depth += 1
        reached = pairs.join(level.withColumnRenamed("id", "row"), "row").groupBy(F.col("col").alias("id"), "degree").agg(F.min("rank").alias("parent"))
        found = reached.join(met, "id", "left_anti").repartitionByRange(n, "parent", "degree", "id").sortWithinPartitions("parent", "degree", "id")
        before, level = level, put(found.select("id", F.monotonically_increasing_id().alias("rank")), depth)
    placed = reduce(DataFrame.unionByName, walks, spark.read.schema(f"{schema}, level int").parquet(levels))
    return order_by(known.join(placed, "id"), -F.col("component"), -F.col("level"), -F.col("rank"))
