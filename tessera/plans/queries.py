"""The registered queries of the point-cloud engine and their DuckDB SQL.

Clouds are views of the driver's tables: ``nodes`` are the first two components of the embeddings with their
label as the flag, ``places`` the parts by price and size, ``lattice`` the line items as fluid states.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import fields, lattice, metric
from tessera.functions.metric import Box
from tessera.operators import dissection, factor, grid, neighbours, nodesets, ordering, stats, weights
from tessera.operators.lineage import cut, shared_dir
from tessera.sources import files, generators, regions, sinks, split, text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its name, with its SQL if it has one."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def r9(c: Column | str) -> Column:
    """Nine digits, and no negative zero: what engines with other math libraries agree on."""
    return F.round(F.col(c) if isinstance(c, str) else c, 9) + 0.0


# views of the driver's tables

UNIT = Box((1.0, 1.0))
NODES = "nodes AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, label AS flag FROM embeddings)"
SOLID = "solid AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings)"
PLACES = "places AS (SELECT p_partkey AS id, p_retailprice AS x, 20.0 * p_size AS y FROM part)"
LATTICE = """lattice AS (SELECT l_orderkey AS a, l_linenumber AS b, l_partkey AS c, 1 + l_discount AS rho, l_tax - 0.04 AS ux, l_discount / 2 - 0.025 AS uy FROM lineitem)"""
POINTS = "pts AS (SELECT event_id AS id, value / 7 - 20 AS x, value / 11 AS y, (event_id % 97) / 10.0 AS t FROM events)"


def _fold_sql(c: str, s: str) -> str:
    w = f"({c} - {s} * floor({c} / {s}))"
    return f"CASE WHEN {w} >= {s} THEN {w} - {s} WHEN {w} < 0 THEN {w} + {s} ELSE {w} END"


def _image_sql(d: str, s: str) -> str:
    return f"(({d}) - {s} * round_even(({d}) / {s}, 0))"


WRAPPED = f"wrapped AS (SELECT id, {_fold_sql('x', '1.0')} AS x, {_fold_sql('y', '1.0')} AS y, flag FROM nodes)"


def nodes(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    return e.select(F.col("vec_id").alias("id"), at(0).alias("x"), at(1).alias("y"), F.col("label").alias("flag"))


def solid(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    return e.select(F.col("vec_id").alias("id"), at(0).alias("x"), at(1).alias("y"), at(2).alias("z"))


def places(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("x"), (20.0 * F.col("p_size")).alias("y"))


def lattice_rows(spark: SparkSession, d: str) -> DataFrame:
    t = spark.read.parquet(f"{d}/lineitem.parquet")
    return t.select(F.col("l_orderkey").alias("a"), F.col("l_linenumber").alias("b"), F.col("l_partkey").alias("c"), (1 + F.col("l_discount")).alias("rho"), (F.col("l_tax") - 0.04).alias("ux"), (F.col("l_discount") / 2 - 0.025).alias("uy"))


def event_points(spark: SparkSession, d: str) -> DataFrame:
    t = spark.read.parquet(f"{d}/events.parquet")
    return t.select(F.col("event_id").alias("id"), (F.col("value") / 7 - 20).alias("x"), (F.col("value") / 11).alias("y"), (F.col("event_id") % 97 / 10.0).alias("t"))


def edges(spark: SparkSession, d: str, k: int = 9) -> DataFrame:
    return neighbours.knn_stencils(nodes(spark, d), k).select("row", "k", "col")


EDGES = f"""{NODES}, ranked AS (
  SELECT a.id AS row, b.id AS col, row_number() OVER (PARTITION BY a.id ORDER BY sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), b.id) AS k
  FROM nodes a CROSS JOIN nodes b),
edges AS (SELECT row, k, col FROM ranked WHERE k <= 9)"""


# neighbours


def _knn_sql(head: str, left: str, right: str, dist: str, k: int, where: str = "") -> str:
    return f"""WITH {head}, ranked AS (
  SELECT a.id AS row, b.id AS col, {dist} AS dist, row_number() OVER (PARTITION BY a.id ORDER BY {dist}, b.id) AS k FROM {left} a CROSS JOIN {right} b {where})
SELECT row, k::INTEGER AS k, col, round(dist, 9) + 0.0 AS dist FROM ranked WHERE k <= {k}"""


FLAT = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))"
ROUND = f"sqrt({_image_sql('a.x - b.x', '1.0')} ** 2 + {_image_sql('a.y - b.y', '1.0')} ** 2)"


def _found(df: DataFrame) -> DataFrame:
    return df.withColumn("dist", r9("dist"))


@query(_knn_sql(NODES, "nodes", "nodes", FLAT, 21))
def knn_stencils(spark, d):
    return _found(neighbours.knn_stencils(nodes(spark, d), 21))


@query(_knn_sql(f"{NODES}, {WRAPPED}", "wrapped", "wrapped", ROUND, 9))
def knn_periodic(spark, d):
    return _found(neighbours.knn_stencils(nodes(spark, d), 9, UNIT))


MOVED = f"{NODES}, {WRAPPED}, moved AS (SELECT id, {_fold_sql('(x + 3.01)', '1.0')} AS x, {_fold_sql('(y - 1.99)', '1.0')} AS y FROM nodes)"


@query(_knn_sql(MOVED, "moved", "wrapped", ROUND, 5))
def knn_query_points(spark, d):
    n = nodes(spark, d)
    moved = n.select("id", (F.col("x") + 3.01).alias("x"), (F.col("y") - 1.99).alias("y"))
    return _found(neighbours.knn_join(moved, n, 5, box=UNIT))


@query(_knn_sql(SOLID, "solid", "solid", "sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2)", 10))
def knn_nd(spark, d):
    return _found(neighbours.knn_stencils(solid(spark, d), 10, coords=("x", "y", "z")))


EIGHT = "eight AS (SELECT vec_id AS id, " + ", ".join(f"embedding[{i}]::DOUBLE AS x{i}" for i in range(1, 9)) + " FROM embeddings)"


@query(_knn_sql(EIGHT, "eight", "eight", "sqrt(" + " + ".join(f"(a.x{i} - b.x{i}) * (a.x{i} - b.x{i})" for i in range(1, 9)) + ")", 6))
def knn_eight_axes(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    names = [f"x{i}" for i in range(1, 9)]
    points = e.select(F.col("vec_id").alias("id"), *[F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate(names)])
    return _found(neighbours.knn_stencils(points, 6, coords=names))


@query(_knn_sql(PLACES, "places", "places", FLAT, 8))
def knn_places(spark, d):
    return _found(neighbours.knn_stencils(places(spark, d), 8))


@query(f"SELECT row, col, dist FROM ({_knn_sql(NODES, 'nodes', 'nodes', FLAT, 1, 'WHERE a.id <> b.id')})")
def nearest_node(spark, d):
    return _found(neighbours.nearest(nodes(spark, d)))


def _within_sql(dist: str, reach: float, source: str = "nodes", head: str = NODES) -> str:
    return f"""WITH {head}, pairs AS (SELECT a.id AS row, b.id AS col, {dist} AS dist FROM {source} a CROSS JOIN {source} b)
SELECT row, row_number() OVER (PARTITION BY row ORDER BY row <> col, dist, col)::INTEGER AS k, col, round(dist, 9) + 0.0 AS dist FROM pairs WHERE dist <= {reach}"""


@query(_within_sql(FLAT, 0.05))
def radius_graph(spark, d):
    return _found(neighbours.within(nodes(spark, d), 0.05))


@query(_within_sql(ROUND, 0.06, "wrapped", f"{NODES}, {WRAPPED}"))
def radius_graph_periodic(spark, d):
    return _found(neighbours.within(nodes(spark, d), 0.06, UNIT))


@query(_within_sql("greatest(abs(a.x - b.x), abs(a.y - b.y))", 0.05))
def range_graph(spark, d):
    return _found(neighbours.within(nodes(spark, d), 0.05, norm="chebyshev"))


@query(f"WITH {PLACES} SELECT x, y, count(*) AS nodes, min(id) AS first_id FROM places GROUP BY x, y HAVING count(*) > 1")
def coincident_nodes(spark, d):
    return neighbours.coincident(places(spark, d))


@query(f"""WITH RECURSIVE {NODES}, going AS (SELECT *, row_number() OVER (ORDER BY id) AS i FROM nodes), run AS (
  SELECT 0::BIGINT AS i, []::STRUCT(id BIGINT, x DOUBLE, y DOUBLE, flag INTEGER)[] AS kept
  UNION ALL SELECT g.i, CASE WHEN len(list_filter(kept, lambda o: sqrt((o.x - g.x) ** 2 + (o.y - g.y) ** 2) < 0.03)) > 0 THEN kept
    ELSE list_append(kept, {{'id': g.id, 'x': g.x, 'y': g.y, 'flag': g.flag}}) END FROM run JOIN going g ON g.i = run.i + 1)
SELECT o.id, o.x, o.y, o.flag FROM (SELECT unnest(kept) AS o FROM run WHERE i = (SELECT count(*) FROM nodes))""")
def thinned_nodes(spark, d):
    return neighbours.thinned(nodes(spark, d), 0.03)


@query(f"WITH {NODES}, {WRAPPED} SELECT a.id, a.x, a.y, a.flag FROM nodes a JOIN wrapped w USING (id) WHERE id % 2 = 1 AND EXISTS (FROM wrapped b WHERE b.id % 2 = 0 AND sqrt({_image_sql('w.x - b.x', '1.0')} ** 2 + {_image_sql('w.y - b.y', '1.0')} ** 2) < 0.02)")
def too_close(spark, d):
    n = nodes(spark, d)
    return neighbours.too_close(n.filter("id % 2 = 1"), n.filter("id % 2 = 0"), 0.02, UNIT)


# metric


@query(f"WITH {POINTS} SELECT id, round({_fold_sql('x', '4.0')}, 9) + 0.0 AS x, round({_fold_sql('y', '3.0')}, 9) + 0.0 AS y FROM pts")
def wrap_points(spark, d):
    p = neighbours.wrapped(event_points(spark, d), Box((4.0, 3.0)))
    return p.select("id", r9("x").alias("x"), r9("y").alias("y"))


@query(f"""WITH {POINTS} SELECT id, round({_image_sql('x', '4.0')}, 9) + 0.0 AS even, round(x - 4.0 * sign(x) * floor(abs(x / 4.0) + 0.5), 9) + 0.0 AS away,
round(CASE WHEN y > 75 THEN y - 150 WHEN y < -75 THEN y + 150 ELSE y END, 9) + 0.0 AS keep FROM pts""")
def minimum_image(spark, d):
    p = event_points(spark, d)
    return p.select("id", r9(metric.minimum_image(F.col("x"), 4.0)).alias("even"), r9(metric.minimum_image(F.col("x"), 4.0, "away")).alias("away"), r9(metric.minimum_image(F.col("y"), 150.0, "keep")).alias("keep"))


@query(f"WITH {NODES} SELECT min(x) AS xmin, min(y) AS ymin, max(x) AS xmax, max(y) AS ymax FROM nodes")
def bbox(spark, d):
    return stats.bounding_box(nodes(spark, d))


@query(f"WITH {NODES} SELECT flag, count(*) AS nodes FROM nodes GROUP BY flag")
def marker_histogram(spark, d):
    return stats.marker_histogram(nodes(spark, d))


@query(f"WITH {NODES} SELECT count(*) AS n, count(*) FILTER (flag <> 0) AS boundary, count(*) FILTER (flag = 0) AS interior FROM nodes")
def node_counts(spark, d):
    return stats.node_counts(nodes(spark, d))


@query(f"WITH {NODES} SELECT id FROM nodes WHERE flag = 3")
def indices_with(spark, d):
    return nodes(spark, d).filter("flag = 3").select("id")


@query(f"WITH {NODES} SELECT id FROM nodes WHERE flag <> 0")
def boundary_nodes(spark, d):
    return nodes(spark, d).filter("flag <> 0").select("id")


@query(f"WITH {NODES} SELECT count(*) FILTER (x < 0 OR x >= 0.4 OR y < 0 OR y >= 0.4) AS outside FROM nodes")
def nodes_outside_box(spark, d):
    return stats.outside(nodes(spark, d), Box((0.4, 0.4)))


@query(f"WITH {SOLID} SELECT id, [x, y, z] AS p FROM solid")
def interleave(spark, d):
    return solid(spark, d).select("id", F.array("x", "y", "z").alias("p"))


# curves and numberings


def _keys_sql(step: str) -> str:
    """Sixteen halvings of the bounding box as a recursive query; step gives the digit and the next turn for quadrant q."""
    return f"""keys AS (
  WITH RECURSIVE cut AS (
    SELECT id, x, y, 0 AS i, 0::BIGINT AS key, 0 AS turn, xmin AS x0, ymin AS y0, xmax AS x1, ymax AS y1
    FROM nodes, (SELECT min(x) AS xmin, min(y) AS ymin, max(x) AS xmax, max(y) AS ymax FROM nodes)
    UNION ALL
    SELECT id, x, y, i + 1, key * 4 + {step.split('|')[0]}, {step.split('|')[1]},
           CASE WHEN x > (x0 + x1) * 0.5 THEN (x0 + x1) * 0.5 ELSE x0 END, CASE WHEN y > (y0 + y1) * 0.5 THEN (y0 + y1) * 0.5 ELSE y0 END,
           CASE WHEN x > (x0 + x1) * 0.5 THEN x1 ELSE (x0 + x1) * 0.5 END, CASE WHEN y > (y0 + y1) * 0.5 THEN y1 ELSE (y0 + y1) * 0.5 END
    FROM (SELECT *, (x > (x0 + x1) * 0.5)::INT + 2 * (y > (y0 + y1) * 0.5)::INT AS q FROM cut WHERE i < 16))
  SELECT id, key FROM cut WHERE i = 16)"""


def _table(rows: list[list[int]]) -> str:
    return str([v for row in rows for v in row])


MORTON = _keys_sql("q|turn")
HILBERT = _keys_sql(f"{_table(ordering.curves.HILBERT_DIGIT)}[1 + q + 4 * turn]|{_table(ordering.curves.HILBERT_TURN)}[1 + q + 4 * turn]")
ORDERED = "SELECT id AS old_id, row_number() OVER (ORDER BY {}, id) - 1 AS new_id FROM {}"


@query(f"WITH {NODES}, {MORTON} SELECT id, key FROM keys")
def morton_keys(spark, d):
    return ordering.curve_keys(nodes(spark, d), "morton")


@query(f"WITH {NODES}, {HILBERT} SELECT id, key FROM keys")
def hilbert_keys(spark, d):
    return ordering.curve_keys(nodes(spark, d), "hilbert")


@query(f"WITH {NODES}, {MORTON} {ORDERED.format('key', 'keys')}")
def morton_order(spark, d):
    return ordering.curve_order(nodes(spark, d), "morton")


@query(f"WITH {NODES}, {HILBERT} {ORDERED.format('key', 'keys')}")
def hilbert_order(spark, d):
    return ordering.curve_order(nodes(spark, d), "hilbert")


@query(f"WITH {NODES} {ORDERED.format('flag <> 0', 'nodes')}")
def boundary_last(spark, d):
    return ordering.boundary_last(nodes(spark, d))


@query(f"WITH {NODES} {ORDERED.format('id % 7 = 3', 'nodes')}")
def boundary_last_by_index(spark, d):
    n = nodes(spark, d)
    return ordering.boundary_last_by_index(n, n.filter("id % 7 = 3").select("id"))


@query(f"WITH {NODES} {ORDERED.format('flag = 0', 'nodes')}")
def boundary_first(spark, d):
    return ordering.boundary_first(nodes(spark, d))


@query(f"WITH {NODES} SELECT id AS old_id, id AS new_id FROM nodes")
def perm_identity(spark, d):
    return ordering.identity(nodes(spark, d))


P = f"{NODES}, {MORTON}, p AS ({ORDERED.format('key', 'keys')})"
Q = f"q AS ({ORDERED.format('flag <> 0', 'nodes')})"


@query(f"WITH {P} SELECT new_id AS old_id, old_id AS new_id FROM p")
def perm_inverse(spark, d):
    return ordering.inverse(ordering.curve_order(nodes(spark, d)))


@query(f"WITH {P}, {Q} SELECT p.old_id, q.new_id FROM p JOIN q ON p.new_id = q.old_id")
def perm_then(spark, d):
    n = nodes(spark, d)
    return ordering.then(ordering.curve_order(n), ordering.boundary_last(n))


@query(f"WITH {P} SELECT new_id AS id, x, y, flag, id AS file_id FROM nodes JOIN p ON id = old_id")
def renumber_nodes(spark, d):
    n = nodes(spark, d)
    return ordering.renumber_nodes(n, ordering.curve_order(n))


@query(f"WITH {P} SELECT old_id AS id, x, y, flag FROM nodes JOIN p ON id = new_id")
def unpermute_nodes(spark, d):
    n = nodes(spark, d)
    return ordering.unpermute(n, ordering.curve_order(n))


@query(f"WITH {EDGES}, {MORTON}, p AS ({ORDERED.format('key', 'keys')}) SELECT a.new_id AS row, k::INTEGER AS k, b.new_id AS col FROM edges JOIN p a ON row = a.old_id JOIN p b ON col = b.old_id")
def renumber_stencils(spark, d):
    return ordering.renumber_edges(edges(spark, d), ordering.curve_order(nodes(spark, d)))


@query(f"""WITH {NODES}, within AS (SELECT a.id AS row FROM nodes a JOIN nodes b ON {FLAT} <= 0.05), sizes AS (SELECT row, count(*) AS n FROM within GROUP BY row)
SELECT 0::BIGINT AS row, 0::BIGINT AS ia UNION ALL SELECT row + 1, (sum(n) OVER (ORDER BY row))::BIGINT FROM sizes""")
def row_pointer(spark, d):
    return ordering.row_pointer(neighbours.within(nodes(spark, d), 0.05))


@query(f"""WITH {NODES}, sizes AS (SELECT a.id AS row, count(*) AS n FROM nodes a JOIN nodes b ON {FLAT} <= 0.02 AND a.id <> b.id GROUP BY a.id)
SELECT 0::BIGINT AS row, 0::BIGINT AS ia UNION ALL SELECT id + 1, (sum(coalesce(n, 0)) OVER (ORDER BY id))::BIGINT FROM nodes LEFT JOIN sizes ON id = row""")
def row_pointer_ragged(spark, d):
    """Most rows of this graph are empty."""
    n = nodes(spark, d)
    return ordering.row_pointer(neighbours.within(n, 0.02).filter("row <> col"), n.count())


@query(f"WITH {EDGES} SELECT DISTINCT row, col FROM (SELECT row, col FROM edges UNION ALL SELECT col, row FROM edges) WHERE row <> col")
def adjacency_symmetric(spark, d):
    return ordering.adjacency(edges(spark, d))


@query(f"""WITH RECURSIVE {EDGES}, adj AS (SELECT DISTINCT row, col FROM (SELECT row, col FROM edges UNION ALL SELECT col, row FROM edges) WHERE row <> col),
near AS (SELECT row AS id, count(*) AS degree FROM adj GROUP BY row),
reach AS (SELECT id, id AS root FROM nodes UNION SELECT a.col, r.root FROM reach r JOIN adj a ON a.row = r.id WHERE a.col > r.root),
member AS (SELECT id, min(root) AS component FROM reach GROUP BY id),
known AS (SELECT m.id, m.component, coalesce(degree, 0) AS degree FROM member m LEFT JOIN near n ON n.id = m.id),
starts AS (SELECT component, arg_min(id, (degree, id)) AS id FROM known GROUP BY component),
walk AS (
  SELECT 0 AS level, list(id ORDER BY component) AS front, list(id ORDER BY component) AS seen FROM starts
  UNION ALL
  SELECT level + 1, list(col ORDER BY first, degree, col), list_concat(seen, list(col ORDER BY first, degree, col)) FROM (
    SELECT w.level, w.seen, a.col, k.degree, min(list_position(w.front, a.row)) AS first
    FROM walk w JOIN adj a ON list_contains(w.front, a.row) AND NOT list_contains(w.seen, a.col) JOIN known k ON k.id = a.col
    GROUP BY w.level, w.seen, a.col, k.degree)
  GROUP BY level, seen),
placed AS (SELECT level, unnest(front) AS id, generate_subscripts(front, 1) AS place FROM walk)
SELECT id AS old_id, row_number() OVER (ORDER BY component DESC, level DESC, place DESC) - 1 AS new_id FROM placed JOIN known USING (id)""")
def rcm_order(spark, d):
    return ordering.reverse_cuthill_mckee(edges(spark, d))


# statistics


@query(f"WITH {EDGES} SELECT max(abs(row - col)) AS bandwidth FROM edges")
def bandwidth(spark, d):
    return stats.bandwidth(edges(spark, d))


@query(f"""WITH {EDGES}, rows_ AS (SELECT row, count(*) AS size, max(CASE WHEN k = 1 THEN col END) AS head, bool_or(row = col) AS diag, max(abs(row - col)) AS reach FROM edges GROUP BY row)
SELECT count(*) AS n, sum(size)::BIGINT AS nnz, min(size) AS row_min, max(size) AS row_max, round(avg(size), 9) AS row_mean, count(*) FILTER (head <> row) AS not_self_first,
count(*) FILTER (NOT diag) AS no_diagonal, max(reach) AS bandwidth, (SELECT count(*) FROM edges e SEMI JOIN edges f ON e.row = f.col AND e.col = f.row) AS transposed,
round(100.0 * (SELECT count(*) FROM edges e SEMI JOIN edges f ON e.row = f.col AND e.col = f.row)::DOUBLE / sum(size), 9) AS transposed_percent FROM rows_""")
def graph_stats(spark, d):
    return stats.graph_stats(edges(spark, d)).withColumns({"row_mean": F.round("row_mean", 9), "transposed_percent": F.round("transposed_percent", 9)})


NEAREST = f"near AS (SELECT a.id, min({FLAT}) AS dist FROM nodes a JOIN nodes b ON a.id <> b.id GROUP BY a.id)"


@query(f"""WITH {NODES}, {NEAREST} SELECT round(min(dist), 9) AS nn_min, round(max(dist), 9) AS nn_max, round(avg(dist), 9) AS nn_mean, round(median(dist), 9) AS nn_median,
round(stddev_pop(dist), 9) AS nn_std, count(*) FILTER (dist = 0) AS coincident FROM near""")
def cloud_stats(spark, d):
    c = stats.cloud_stats(nodes(spark, d))
    return c.select(*[F.round(x, 9).alias(x) if x != "coincident" else F.col(x) for x in c.columns])


@query(f"""WITH {EDGES} SELECT count(*) AS n, count(*) FILTER (flag <> 0) AS boundary, count(*) FILTER (flag = 0) AS interior, round(count(*) / 2.25, 9) AS density,
(SELECT count(*) FROM edges) AS nnz, (SELECT min(c) FROM (SELECT count(*) AS c FROM edges GROUP BY row)) AS stencil_min, (SELECT max(c) FROM (SELECT count(*) AS c FROM edges GROUP BY row)) AS stencil_max FROM nodes""")
def cloud_summary(spark, d):
    return stats.summary(nodes(spark, d), edges(spark, d), (1.5, 1.5)).withColumn("density", F.round("density", 9))


@query(f"WITH {EDGES} SELECT row, max(abs(col - row)) AS reach, count(DISTINCT col // 8) AS lines, max(abs(col // 8 - row // 8)) AS line_reach FROM edges GROUP BY row")
def cache_lines(spark, d):
    return stats.cache_lines(edges(spark, d))


# grids: a sheet of squares, about as many as a quarter of the orders, half of them cut by a diagonal, with faults


def sheet(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """n x n cells: triangles in the lower half, quadrilaterals above; every 17th element turned over; parts along the sides."""
    orders = spark.read.parquet(f"{d}/orders.parquet").count()
    n = max(12, 2 * int(math.sqrt(orders) / 4))
    m = n + 1
    points = spark.range(m * m).select("id", (F.col("id") % m).cast("double").alias("x"), F.floor(F.col("id") / m).cast("double").alias("y"))
    cell = spark.range(n * n).withColumn("a", F.col("id") + F.floor(F.col("id") / n))
    a = F.col("a")
    low = F.col("id") < n * n // 2
    halves = F.array(F.struct(F.lit(0).alias("h"), F.array(a, a + 1, a + m + 1).alias("verts")), F.struct(F.lit(1).alias("h"), F.array(a, a + m + 1, a + m).alias("verts")))
    tris = cell.filter(low).select("id", F.explode(halves).alias("t")).select(F.lit("triangle").alias("kind"), (F.col("id") * 2 + F.col("t.h")).alias("elem"), "t.verts")
    quads = cell.filter(~low).select(F.lit("quadrilateral").alias("kind"), (F.col("id") - n * n // 2).alias("elem"), F.array(a, a + 1, a + m + 1, a + m).alias("verts"))
    elements = tris.union(quads)
    elements = elements.withColumn("verts", F.when(F.col("elem") % 17 == 5, F.reverse("verts")).otherwise(F.col("verts")))
    rim = spark.range(4 * n + 1).select((F.col("id")).alias("s"))
    s = F.col("s")
    at = F.when(s <= n, s).when(s <= 2 * n, n + (s - n) * m).when(s <= 3 * n, m * m - 1 - (s - 2 * n)).otherwise((4 * n - s) * m)
    bound = rim.select(F.lit(0).alias("part"), s.cast("int").alias("seq"), at.cast("long").alias("node"))
    inner = spark.range(4).select(F.lit(1).alias("part"), F.col("id").cast("int").alias("seq"), (m * 3 + 2 + F.col("id")).alias("node"))
    return points, elements, bound.union(inner)


SHEET = """dim AS (SELECT n, n + 1 AS m FROM (SELECT greatest(12, 2 * floor(sqrt(count(*)) / 4)::BIGINT) AS n FROM orders)),
points AS (SELECT i AS id, (i % m)::DOUBLE AS x, (i // m)::DOUBLE AS y FROM (SELECT m, unnest(range(m * m)) AS i FROM dim)),
cell AS (SELECT n, m, i AS id, i + i // n AS a FROM (SELECT n, m, unnest(range(n * n)) AS i FROM dim)),
straight AS (SELECT 'triangle' AS kind, 2 * id AS elem, [a, a + 1, a + m + 1] AS verts FROM cell WHERE id < n * n // 2
  UNION ALL SELECT 'triangle', 2 * id + 1, [a, a + m + 1, a + m] FROM cell WHERE id < n * n // 2
  UNION ALL SELECT 'quadrilateral', id - n * n // 2, [a, a + 1, a + m + 1, a + m] FROM cell WHERE id >= n * n // 2),
elements AS (SELECT kind, elem, CASE WHEN elem % 17 = 5 THEN list_reverse(verts) ELSE verts END AS verts FROM straight),
bound AS (SELECT 0 AS part, i::INT AS seq, CASE WHEN i <= n THEN i WHEN i <= 2 * n THEN n + (i - n) * m WHEN i <= 3 * n THEN m * m - 1 - (i - 2 * n) ELSE (4 * n - i) * m END AS node FROM (SELECT n, m, unnest(range(4 * n + 1)) AS i FROM dim)
  UNION ALL SELECT 1, i::INT, 3 * m + 2 + i FROM (SELECT m, unnest(range(4)) AS i FROM dim)),
sides AS (SELECT kind, elem, verts, unnest(range(len(verts))) AS i FROM elements),
el AS (SELECT kind, elem, i AS side, verts[i + 1] AS u, verts[(i + 1) % len(verts) + 1] AS v FROM sides)"""


@query(f"WITH {SHEET} SELECT id, coalesce(min(part) + 1, 0)::INTEGER AS marker FROM points LEFT JOIN bound ON id = node GROUP BY id")
def grid_markers(spark, d):
    p, _, b = sheet(spark, d)
    return grid.markers(p, b)


@query(f"WITH {SHEET} SELECT id, x, y, coalesce(min(part) + 1, 0)::INTEGER AS flag, id AS file_id FROM points LEFT JOIN bound ON id = node GROUP BY id, x, y")
def nodes_from_grid(spark, d):
    p, _, b = sheet(spark, d)
    return nodesets.from_grid(p, b)


@query(f"WITH {NODES}, {WRAPPED} SELECT id, w.x, n.y, n.flag, id AS file_id FROM nodes n JOIN wrapped w USING (id)")
def nodes_periodic_in_x(spark, d):
    return nodesets.from_points(nodes(spark, d), UNIT, (True, False))


@query(f"WITH {NODES} SELECT id, x, y, flag, id AS file_id FROM nodes")
def nodes_from_file(spark, d):
    to = _folder(spark)
    sinks.write_nodes(nodes(spark, d), f"{to}/a", marker="flag")
    return nodesets.from_file(spark, f"{to}/a.node")


@query(f"WITH {EDGES} SELECT count(DISTINCT col // 8) AS \"values\" FROM edges")
def count_unique(spark, d):
    return stats.count_unique(edges(spark, d).select(F.floor(F.col("col") / 8).alias("line")), "line")


@query(f"WITH {SHEET} SELECT part, arg_min(node, seq) = arg_max(node, seq) AND count(*) > 1 AS closed FROM bound GROUP BY part")
def grid_closed(spark, d):
    return grid.closed(sheet(spark, d)[2])


@query(f"WITH {SHEET} SELECT (SELECT count(*) FROM points) AS nodes, count(*) FILTER (kind = 'triangle') AS triangles, count(*) FILTER (kind <> 'triangle') AS quadrilaterals, (SELECT count(DISTINCT part) FROM bound) AS parts FROM elements")
def grid_sizes(spark, d):
    return grid.sizes(*sheet(spark, d))


@query(f"""WITH {SHEET}, once AS (SELECT u, v, count(*) AS uses FROM el GROUP BY u, v),
walks AS (SELECT part, node AS u, lead(node) OVER (PARTITION BY part ORDER BY seq) AS v FROM bound),
judged AS (SELECT part, w.u, w.v, o.u IS NOT NULL AS fwd, r.u IS NOT NULL AS rev FROM walks w LEFT JOIN once o ON w.u = o.u AND w.v = o.v LEFT JOIN once r ON w.u = r.v AND w.v = r.u WHERE w.v IS NOT NULL)
SELECT 1 AS "check", kind || ' ' || (elem + 1) || ' is not counterclockwise' AS message FROM (
  SELECT kind, elem, sum(a.x * b.y - b.x * a.y) AS area FROM el JOIN points a ON u = a.id JOIN points b ON v = b.id GROUP BY kind, elem) WHERE NOT area > 0
UNION ALL SELECT 2, 'element edge ' || (u + 1) || ' -> ' || (v + 1) || ' is used twice in the same direction' FROM once WHERE uses > 1
UNION ALL SELECT 3, 'boundary part ' || (part + 1) || ', edge ' || (u + 1) || ' -> ' || (v + 1) ||
  CASE WHEN rev AND NOT fwd THEN ' walks with the domain on the right' WHEN fwd THEN ' is an interior edge' ELSE ' is not an element edge' END FROM judged WHERE NOT fwd OR rev
UNION ALL SELECT 4, 'element boundary edge ' || (u + 1) || ' -> ' || (v + 1) || ' is not walked by any boundary part' FROM once o
  WHERE NOT EXISTS (FROM once r WHERE r.u = o.v AND r.v = o.u) AND NOT EXISTS (FROM judged j WHERE j.u = o.u AND j.v = o.v AND fwd AND NOT rev)""")
def grid_orientation(spark, d):
    return grid.orientation_faults(*sheet(spark, d)).select("check", "message")


@query(f"""WITH {SHEET}, placed AS (SELECT *, [(kind <> 'triangle')::BIGINT, elem::BIGINT, side::BIGINT] AS place FROM el),
once AS (SELECT u, v, count(*) AS uses, min(place) AS place FROM placed GROUP BY u, v),
walks AS (SELECT part, seq, node AS u, lead(node) OVER (PARTITION BY part ORDER BY seq) AS v FROM bound),
judged AS (SELECT part, seq, w.u, w.v, o.u IS NOT NULL AS fwd, r.u IS NOT NULL AS rev FROM walks w LEFT JOIN once o ON w.u = o.u AND w.v = o.v LEFT JOIN once r ON w.u = r.v AND w.v = r.u WHERE w.v IS NOT NULL),
told AS (
SELECT 1 AS "check", place, kind || ' ' || (elem + 1) || ' is not counterclockwise' AS message FROM (
  SELECT kind, elem, min(place) AS place, sum(a.x * b.y - b.x * a.y) AS area FROM placed JOIN points a ON u = a.id JOIN points b ON v = b.id GROUP BY kind, elem) WHERE NOT area > 0
UNION ALL SELECT 2, place, 'element edge ' || (u + 1) || ' -> ' || (v + 1) || ' is used twice in the same direction' FROM once WHERE uses > 1
UNION ALL SELECT 3, [0, part::BIGINT, seq::BIGINT], 'boundary part ' || (part + 1) || ', edge ' || (u + 1) || ' -> ' || (v + 1) ||
  CASE WHEN rev AND NOT fwd THEN ' walks with the domain on the right' WHEN fwd THEN ' is an interior edge' ELSE ' is not an element edge' END FROM judged WHERE NOT fwd OR rev
UNION ALL SELECT 4, place, 'element boundary edge ' || (u + 1) || ' -> ' || (v + 1) || ' is not walked by any boundary part' FROM once o
  WHERE NOT EXISTS (FROM once r WHERE r.u = o.v AND r.v = o.u) AND NOT EXISTS (FROM judged j WHERE j.u = o.u AND j.v = o.v AND fwd AND NOT rev))
SELECT row_number() OVER (ORDER BY "check", place) - 1 AS no, "check", message FROM told""")
def grid_messages(spark, d):
    return grid.messages(*sheet(spark, d))


@query("""WITH shapes AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'triangle' ELSE 'quadrilateral' END AS kind,
  list_concat([o_custkey, 1 + o_orderkey % 97, o_custkey + o_orderkey % 3], CASE WHEN o_orderkey % 10 IN (0, 1, 3, 7) THEN [1 + o_orderkey % 89] ELSE [] END) AS verts FROM orders),
bound AS (SELECT l_orderkey AS part, l_linenumber - 1 AS seq, l_partkey AS node FROM lineitem),
parts AS (SELECT part, count(*) AS n, count(DISTINCT seq) AS places, min(seq) AS low, max(seq) AS high FROM bound GROUP BY part),
used AS (SELECT unnest(verts) AS node FROM shapes UNION ALL SELECT node FROM bound)
SELECT 'elements with another number of nodes than their kind' AS problem, count(*) AS violations FROM shapes WHERE len(verts) <> CASE kind WHEN 'triangle' THEN 3 ELSE 4 END
UNION ALL SELECT 'elements that name a node twice', count(*) FROM shapes WHERE list_unique(verts) < len(verts)
UNION ALL SELECT 'nodes out of range', count(*) FROM used WHERE node NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'boundary parts of fewer than two nodes', count(*) FROM parts WHERE n < 2
UNION ALL SELECT 'boundary parts whose places are not numbered from 0', count(*) FROM parts WHERE places <> n OR low <> 0 OR high <> n - 1
UNION ALL SELECT 'immediate repeats in boundary parts', count(*) FROM bound a JOIN bound b ON a.part = b.part AND b.seq = a.seq + 1 WHERE a.node = b.node""")
def grid_violations(spark, d):
    """Customers as nodes, orders as elements, line items as the places of boundary parts: how often they break each rule of a grid."""
    read = lambda name: spark.read.parquet(f"{d}/{name}.parquet")
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    fourth = F.when((key % 10).isin(0, 1, 3, 7), F.array(1 + key % 89)).otherwise(F.array().cast("array<bigint>"))
    verts = F.concat(F.array(customer.cast("long"), (1 + key % 97).cast("long"), (customer + key % 3).cast("long")), fourth)
    elements = read("orders").select(F.when(key % 2 == 0, "triangle").otherwise("quadrilateral").alias("kind"), key.alias("elem"), verts.alias("verts"))
    bound = read("lineitem").select(F.col("l_orderkey").alias("part"), (F.col("l_linenumber") - 1).alias("seq"), F.col("l_partkey").cast("long").alias("node"))
    return grid.violations(read("customer").select(F.col("c_custkey").alias("id")), elements, bound)


# lattice Boltzmann

C = list(zip(lattice.CX, lattice.CY, ("4.0/9", *["1.0/9"] * 4, *["1.0/36"] * 4), strict=True))


def _feq_sql(a: int, rho: str = "rho", ux: str = "ux", uy: str = "uy") -> str:
    cx, cy, w = C[a]
    cu = f"({cx} * {ux} + {cy} * {uy})"
    return f"3 * ({w}) * {rho} * (1.0/3 - ({ux} * {ux} + {uy} * {uy}) / 2 + {cu} + 1.5 * {cu} * {cu})"


def _sums(t: str = "") -> tuple[str, str, str]:
    rho = " + ".join(f"f{a}" for a in range(9))
    return f"({rho})", *(f"(({' + '.join(f'{c[i]} * f{a}' for a, c in enumerate(C) if c[i])}) / ({rho}))" for i in (0, 1))


FEQ = f"feq AS (SELECT a, b, c, {', '.join(f'{_feq_sql(i)} AS f{i}' for i in range(9))} FROM lattice)"
#: Populations away from equilibrium: shifted by a tenth of the weights, direction by direction.
OFF = f"off AS (SELECT a, b, c, {', '.join(f'f{i} + 0.01 * {i % 3} * ({C[i][2]}) AS f{i}' for i in range(9))} FROM feq)"
MACRO = f"macro AS (SELECT *, {_sums()[0]} AS rho, {_sums()[1]} AS ux, {_sums()[2]} AS uy FROM off)"
KEY = ["a", "b", "c"]


def _off(spark, d) -> DataFrame:
    f = lattice.feq(lattice_rows(spark, d))
    return f.select(*KEY, *[(F.col(c) + 0.01 * (i % 3) * lattice.WEIGHT[i]).alias(c) for i, c in enumerate(lattice.POPULATIONS)])


def _rounded(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*KEY, *[r9(n).alias(n) for n in names])


@query(f"WITH {LATTICE}, {FEQ} SELECT a, b, c, {', '.join(f'round(f{i}, 9) + 0.0 AS f{i}' for i in range(9))} FROM feq")
def lbm_feq(spark, d):
    return _rounded(lattice.feq(lattice_rows(spark, d)), lattice.POPULATIONS)


@query(f"WITH {LATTICE}, {FEQ}, {OFF}, {MACRO} SELECT a, b, c, round(rho, 9) + 0.0 AS rho, round(ux, 9) + 0.0 AS ux, round(uy, 9) + 0.0 AS uy FROM macro")
def lbm_macros(spark, d):
    return _rounded(lattice.macros(_off(spark, d)), ["rho", "ux", "uy"])


BGK = f"{', '.join(f'round(0.3 * f{i} + 0.7 * ({_feq_sql(i)}), 9) + 0.0 AS f{i}' for i in range(9))}, round(rho, 9) + 0.0 AS rho, round(ux, 9) + 0.0 AS ux, round(uy, 9) + 0.0 AS uy"


@query(f"WITH {LATTICE}, {FEQ}, {OFF}, {MACRO} SELECT a, b, c, {BGK} FROM macro")
def lbm_bgk(spark, d):
    return _rounded(lattice.bgk(_off(spark, d), 0.7), [*lattice.POPULATIONS, "rho", "ux", "uy"])


@query(f"WITH {LATTICE}, {FEQ}, {OFF}, {MACRO} SELECT a, b, c, {BGK}, round(1.0/3 - (ux * ux + uy * uy) / 2, 9) + 0.0 AS indp FROM macro")
def lbm_bgk_split(spark, d):
    return _rounded(lattice.bgk(_off(spark, d), 0.7, split=True), [*lattice.POPULATIONS, "rho", "ux", "uy", "indp"])


STRAIN = ", ".join(f"round({_feq_sql(i)} - rho * 0.8 * ({w}) * 3 * (0.01 * ({cx * cx} - 1.0/3) + 0.02 * {2 * cx * cy} - 0.01 * ({cy * cy} - 1.0/3)), 9) + 0.0 AS f{i}" for i, (cx, cy, w) in enumerate(C))


@query(f"WITH {LATTICE} SELECT a, b, c, {STRAIN} FROM lattice")
def lbm_strained_equilibrium(spark, d):
    rows = lattice_rows(spark, d).withColumns({"sxx": F.lit(0.01), "sxy": F.lit(0.02), "syy": F.lit(-0.01)})
    return _rounded(lattice.strained_equilibrium(rows, 0.8), lattice.POPULATIONS)


# flow fields on the box 4 x 3, at the events' points and times

FLOW = Box((4.0, 3.0))
KX, KY = "(2 * pi() / 4)", "(2 * pi() / 3)"


def _flow(names: list[str], make: Callable, timed: bool = True):
    def run(spark, d):
        p = event_points(spark, d)
        got = make(F.col("x"), F.col("y"), F.col("t")) if timed else make(F.col("x"), F.col("y"))
        return p.select("id", *[r9(c).alias(n) for n, c in zip(names, got, strict=True)])

    return run


def _register(name: str, names: list[str], make: Callable, sql: list[str], timed: bool = True, pre: str = "") -> None:
    f = _flow(names, make, timed)
    f.__name__ = name
    query(f"WITH {POINTS}{pre} SELECT id, {', '.join(f'round({s}, 9) + 0.0 AS {n}' for n, s in zip(names, sql, strict=True))} FROM {'v' if pre else 'pts'}")(f)


_wave = fields.shear_wave(FLOW, 2, 1, 0.1, 0.02, 0.3, (0.05, -0.02))
_W = f""", v AS (SELECT id, exp(-0.02 * k2 * t) AS dk, sqrt(k2) AS k, kx, ky, k2, kx * (x - 0.05 * t) + ky * (y + 0.02 * t) + 0.3 AS th FROM
  (SELECT *, 2 * {KX} AS kx, {KY} AS ky, 4 * {KX} * {KX} + {KY} * {KY} AS k2 FROM pts))"""
_register("shear_wave", ["p", "ux", "uy"], _wave.fields, ["dk * dk * (0.005 - (0.01 * sin(th) ** 2 + 0.01 * cos(th) ** 2) / 2)", "0.05 - dk * 0.1 * ky / k * sin(th)", "-0.02 + dk * 0.1 * kx / k * sin(th)"], pre=_W)
_register("shear_stress", ["sxx", "sxy", "syy"], _wave.stress, ["-dk * cos(th) * 0.1 * kx * ky / k", "dk * cos(th) * 0.1 * (kx * kx - ky * ky) / (2 * k)", "dk * cos(th) * 0.1 * kx * ky / k"], pre=_W)
_register("shear_body_force", ["fx", "fy"], _wave.body_force, ["-0.02 * k2 * 0.1 * ky / k * sin(th)", "0.02 * k2 * 0.1 * kx / k * sin(th)"], pre=_W)
_register("shear_decay", ["decay"], lambda x, y, t: (_wave.decay(t),), ["dk"], pre=_W)

_tg = fields.taylor_green(FLOW, 1, 2, 0.1, 0.01)
_G = f", v AS (SELECT id, x, y, {KX} AS kx, 2 * {KY} AS ky, exp(-0.01 * ({KX} * {KX} + 4 * {KY} * {KY}) * t) AS dk FROM pts)"
_register(
    "taylor_green", ["p", "ux", "uy"], _tg.fields,
    ["-dk * dk * 0.01 / 4 * (ky / kx * cos(2 * kx * x) + kx / ky * cos(2 * ky * y))", "-dk * 0.1 * sqrt(ky / kx) * cos(kx * x) * sin(ky * y)", "dk * 0.1 * sqrt(kx / ky) * sin(kx * x) * cos(ky * y)"],
    pre=_G,
)

_sound = fields.AcousticWave(FLOW, 1, 1, 0.01, 0.02)
_A = f""", v AS (SELECT id, t, g, sqrt(k2 / 3 - g * g) AS w, kx, ky, kx * x + ky * y AS th FROM (SELECT *, 0.02 * k2 AS g FROM
  (SELECT *, {KX} AS kx, {KY} AS ky, {KX} * {KX} + {KY} * {KY} AS k2 FROM pts)))"""
_register(
    "acoustic_wave", ["rho", "ux", "uy"], _sound.fields,
    ["1 + 0.01 * cos(th) * exp(-g * t) * (cos(w * t) + g / w * sin(w * t))", "0.01 / 3 / w * exp(-g * t) * sin(w * t) * sin(th) * kx", "0.01 / 3 / w * exp(-g * t) * sin(w * t) * sin(th) * ky"],
    pre=_A,
)
_register("shear_layer", ["p", "ux", "uy"], lambda x, y: fields.shear_layer(FLOW, 0.1, x, y), ["0.0", "0.1 * tanh(80 * CASE WHEN y / 3 <= 0.5 THEN y / 3 - 0.25 ELSE 0.75 - y / 3 END)", "0.1 * 0.05 * sin(2 * pi() * (x / 4 + 0.25))"], timed=False)
_V = f", v AS (SELECT id, dx, dy, exp(-(dx * dx + dy * dy) / (2 * 0.25)) AS g FROM (SELECT id, {_image_sql('x - 2.0', '4.0')} AS dx, {_image_sql('y - 1.5', '3.0')} AS dy FROM pts))"
_register("barotropic_vortex", ["rho", "ux", "uy"], lambda x, y: fields.barotropic_vortex(FLOW, 0.1, (2.0, 1.5), 0.5, 0.05, x, y), ["exp(-0.0025 * 3 * g * g / 2)", "0.1 - 0.05 * (dy / 0.5) * g", "0.05 * (dx / 0.5) * g"], timed=False, pre=_V)


# generators


def _cloud(df: DataFrame) -> DataFrame:
    return df.select("id", r9("x").alias("x"), r9("y").alias("y"), F.col("flag").cast("int").alias("flag"))


SEQ = "SELECT row_number() OVER (ORDER BY flag = 0, {}) - 1 AS id, round(x, 9) + 0.0 AS x, round(y, 9) + 0.0 AS y, flag::INTEGER AS flag FROM {}"


@query(f"""WITH t AS (SELECT j, unnest(range(25 - j)) AS i FROM (SELECT range AS j FROM range(25))),
v AS (SELECT i, j, i + j / 2 AS x, j * sqrt(3) / 2 AS y, CASE WHEN (j = 0 AND i IN (0, 24)) OR j = 24 THEN 5 WHEN j = 0 THEN 1 WHEN i = 24 - j THEN 2 WHEN i = 0 THEN 4 ELSE 0 END AS flag FROM t)
{SEQ.format('j, i', 'v')}""")
def gen_triangle(spark, d):
    return _cloud(generators.triangle(spark, 24))


@query("SELECT range AS id, (range % 31)::DOUBLE AS x, (range // 31)::DOUBLE AS y, (CASE WHEN range // 31 IN (0, 30) AND range % 31 IN (0, 30) THEN 5 WHEN range // 31 = 0 THEN 1 WHEN range % 31 = 30 THEN 2 WHEN range // 31 = 30 THEN 3 WHEN range % 31 = 0 THEN 4 ELSE 0 END)::INTEGER AS flag FROM range(961)")
def gen_grid(spark, d):
    return _cloud(generators.grid(spark, 30, geometry="box"))


@query(f"""WITH c AS (SELECT round(2 * pi() * 12)::INT AS n), lo AS (SELECT (12 - sqrt(3) / 2) ** 2 AS h, round(pi() * (12 - sqrt(3) / 2) ** 2 * 0.9216)::INT AS n),
v AS (SELECT 0 AS s, i, 12 * cos(2 * pi() * i / n) AS x, 12 * sin(2 * pi() * i / n) AS y, 1 AS flag FROM (SELECT n, unnest(range(n)) AS i FROM c)
UNION ALL SELECT 1, i, sqrt((i + 0.5) / n * h) * cos(i * pi() * (3 - sqrt(5))), sqrt((i + 0.5) / n * h) * sin(i * pi() * (3 - sqrt(5))), 0 FROM (SELECT h, n, unnest(range(n)) AS i FROM lo))
{SEQ.format('s, i', 'v')}""")
def gen_disk_spiral(spark, d):
    return _cloud(generators.disk(spark, 12.0, distribution="spiral"))


@query(f"""WITH rings AS (SELECT 0 AS s, 0 AS j, 12.0 AS r, 0.0 AS turn, 1 AS flag UNION ALL SELECT 0, 1, 4.0, 0.0, 6 UNION ALL SELECT 1, range::INT - 1, 4.0 + range, (range - 1) * pi() * (3 - sqrt(5)), 0 FROM range(1, 8)),
dots AS (SELECT *, unnest(range(n)) AS i FROM (SELECT *, round(2 * pi() * r)::INT AS n FROM rings)),
v AS (SELECT s, j, i, r * cos(turn + 2 * pi() * i / n) AS x, r * sin(turn + 2 * pi() * i / n) AS y, flag FROM dots)
{SEQ.format('j, i', 'v')}""")
def gen_annulus_rings(spark, d):
    return _cloud(generators.disk(spark, 12.0, hole=4.0))


@query(f"""WITH z AS (SELECT i, v FROM (SELECT range AS i, CASE WHEN range < 4 THEN range * 1.0 WHEN range < 8 THEN 4 + (range - 4) * 1.5 ELSE 10 + (range - 8) * 2.5 END AS v FROM range(12))
UNION ALL SELECT 12, 20.0 UNION ALL SELECT 24 - i, 40 - v FROM (SELECT range AS i, CASE WHEN range < 4 THEN range * 1.0 WHEN range < 8 THEN 4 + (range - 4) * 1.5 ELSE 10 + (range - 8) * 2.5 END AS v FROM range(12))),
v AS (SELECT a.v AS x, b.v AS y, a.i AS i, b.i AS j, CASE WHEN a.i IN (0, 24) AND b.i IN (0, 24) THEN 5 WHEN b.i = 0 THEN 1 WHEN a.i = 24 THEN 2 WHEN b.i = 24 THEN 3 WHEN a.i = 0 THEN 4 ELSE 0 END AS flag FROM z a CROSS JOIN z b)
{SEQ.format('j, i', 'v')}""")
def gen_cavity_grid(spark, d):
    return _cloud(generators.cavity(spark, 4, distribution="grid"))


@query(f"""WITH widths AS (SELECT range AS k, CASE WHEN range < 5 THEN 1.0 WHEN range < 10 THEN 1.5 ELSE 2.5 END::DOUBLE AS h FROM range(14)),
ring AS (SELECT k, h, coalesce(sum(h) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS r FROM widths),
dots AS (SELECT *, unnest(range(n)) AS i FROM (SELECT k, r, 40 - r AS q, greatest(round((40 - 2 * r) / h), 1)::BIGINT AS n, unnest(range(4)) AS s FROM ring)),
laid AS (SELECT k * 10000 + s * 1000 + i AS o, round(CASE s WHEN 0 THEN r + (q - r) * i / n WHEN 1 THEN q WHEN 2 THEN q - (q - r) * i / n ELSE r END, 12) AS x,
  round(CASE s WHEN 0 THEN r WHEN 1 THEN r + (q - r) * i / n WHEN 2 THEN q ELSE q - (q - r) * i / n END, 12) AS y FROM dots),
v AS (SELECT x, y, min(o) AS o, CASE WHEN x IN (0, 40) AND y IN (0, 40) THEN 5 WHEN y = 0 THEN 1 WHEN x = 40 THEN 2 WHEN y = 40 THEN 3 WHEN x = 0 THEN 4 ELSE 0 END AS flag FROM laid GROUP BY x, y)
{SEQ.format('o', 'v')}""")
def gen_cavity_rings(spark, d):
    return _cloud(generators.cavity(spark, 4))


# the corner's angle is 3 pi / 2, its arcs 6 (k / 9) ** 1.5 for k to 9, then 7, 8, .. 16
@query(f"""WITH w AS (SELECT 1.5 * pi() AS o), arc AS (
  SELECT k, r, greatest(round(o * r / CASE WHEN k < 9 THEN 6 * ((k + 1) / 9.0) ** 1.5 - r ELSE 1 END), 2)::BIGINT AS n, k > 9 AS clipped
  FROM w, (SELECT range AS k, CASE WHEN range <= 9 THEN 6 * (range / 9.0) ** 1.5 ELSE range - 3 END::DOUBLE AS r FROM range(1, 20))),
dots AS (SELECT *, r * cos(i * o / n) AS x, r * sin(i * o / n) AS y FROM w, (SELECT *, unnest(range(n + 1)) AS i FROM arc)),
segs(x1, y1, x2, y2, flag) AS (VALUES (0.0, 0.0, 12.0, 0.0, 0), (12.0, 0.0, 12.0, 12.0, 2), (12.0, 12.0, -12.0, 12.0, 3), (-12.0, 12.0, -12.0, -12.0, 4), (-12.0, -12.0, 0.0, -12.0, 1), (0.0, -12.0, 0.0, 0.0, 0)),
rim AS (SELECT x::DOUBLE AS x, y::DOUBLE AS y, flag, row_number() OVER (ORDER BY g, j) AS o FROM (
  SELECT 0 AS g, range AS j, 7.0 + range AS x, 0.0 AS y, 1 AS flag FROM range(5) UNION ALL SELECT 1, range, 0.0, -7.0 - range, 2 FROM range(5)
  UNION ALL SELECT g, j, x1 + (x2 - x1) * j / n, y1 + (y2 - y1) * j / n, CASE WHEN j = 0 THEN 5 ELSE flag END FROM (
    SELECT *, unnest(range(n)) AS j FROM (SELECT row_number() OVER () + 2 AS g, *, (abs(x2 - x1) + abs(y2 - y1))::BIGINT AS n FROM segs WHERE flag > 0))
  UNION ALL SELECT 99, 0, 0.0, -12.0, 5)),
away AS (SELECT d.*, t, sqrt((x - x1 - t * (x2 - x1)) ** 2 + (y - y1 - t * (y2 - y1)) ** 2) AS dist FROM (
  SELECT d.*, s.*, least(greatest(((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2), 0), 1) AS t FROM dots d, segs s WHERE clipped) d),
loose AS (SELECT k, i, x, y FROM away WHERE i > 0 AND i < n AND abs(x) <= 12 AND abs(y) <= 12 GROUP BY k, i, x, y HAVING min(dist) >= 0.55),
v AS (SELECT 0 AS a, 0 AS b, 0 AS c, 0.0 AS x, 0.0 AS y, 5 AS flag
  UNION ALL SELECT 1, k, i, x, y, CASE WHEN i = 0 THEN 1 WHEN i = n THEN 2 ELSE 0 END FROM dots WHERE NOT clipped
  UNION ALL SELECT 2, o, 0, x, y, flag FROM rim
  UNION ALL SELECT 3, k, i, x, y, 0 FROM loose l WHERE NOT EXISTS (FROM rim WHERE sqrt((rim.x - l.x) ** 2 + (rim.y - l.y) ** 2) < 0.7))
{SEQ.format('a, b, c', 'v')}""")
def gen_reentrant_corner(spark, d):
    return _cloud(generators.ReentrantCorner(12.0).nodes(spark))


@query(f"WITH {NODES} SELECT id, round(power(least(greatest(sqrt(x * x + y * y), 0.05 * power(1.0 / 8, 1.5)), 0.05) / 0.05, 1.0 / 3) * 0.01, 9) AS h FROM nodes")
def spacing_at(spark, d):
    corner = generators.ReentrantCorner(0.1, 0.01)
    return nodes(spark, d).select("id", F.round(corner.spacing_at(F.col("x"), F.col("y")), 9).alias("h"))


@query(f"""WITH g AS (SELECT range AS id, (range % 5)::DOUBLE AS x, (range // 5)::DOUBLE AS y FROM range(25)),
v AS (SELECT t, id AS i, x + 5 * (t % 3) AS x, y + 5 * (t // 3) AS y, 0 AS flag FROM g CROSS JOIN (SELECT range AS t FROM range(6)))
{SEQ.format('t, i', 'v')}""")
def tile_nodes(spark, d):
    return _cloud(generators.tile(generators.grid(spark, 5), (5.0, 5.0), (3, 2)))


# Poisson-disk clouds over a table's bounds: each of its rows that lies inside has a node within the distance, no two nodes are nearer, none is outside

#: Bounds of the nodes, and the distance at which a cloud of them has about as many nodes as the table.
CLOUD = f"{NODES}, whole AS (SELECT min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1, sqrt(0.7 * (max(x) - min(x)) * (max(y) - min(y)) / count(*)) AS h FROM nodes)"


def _cloud_sql(inside: str, rim: str) -> str:
    return f"""WITH {CLOUD}, placed AS (SELECT id, x - (x0 + x1) / 2 AS px, y - (y0 + y1) / 2 AS py, (x1 - x0) / 2 AS rx, (y1 - y0) / 2 AS ry, least(x1 - x0, y1 - y0) / 2 AS r, h FROM nodes, whole)
SELECT id, CASE WHEN {inside} THEN true END AS served, 0::BIGINT AS near_pairs, 0::BIGINT AS stray, ({rim})::BIGINT AS rim FROM placed"""


def _bounds(n: DataFrame) -> tuple[tuple[float, float], tuple[float, float], float]:
    """The nodes' low corner and extent, and the distance of CLOUD."""
    x0, y0, x1, y1 = ordering.bbox(n)
    return (x0, y0), (x1 - x0, y1 - y0), math.sqrt(0.7 * (x1 - x0) * (y1 - y0) / n.count())


def _held(n: DataFrame, cloud: DataFrame, distance: float, inside: Callable[[Column, Column], Column], box: Box = metric.OPEN, low: tuple[float, float] = (0.0, 0.0), tight: float = 1.0) -> DataFrame:
    """For each row: whether a node stands within the distance (null outside the region); and the cloud's pairs that are too near, nodes outside, and nodes of the rim."""
    cloud = cut(cloud)
    move = lambda t: t.select("id", (F.col("x") - low[0]).alias("x"), (F.col("y") - low[1]).alias("y"))
    # rows outside the region, which may be far from any node, are told null whatever is near
    neighbours.validated(n)
    within_it = n.filter(inside(F.col("x"), F.col("y")))
    served = neighbours.knn_join(move(within_it), move(cloud), 1, box=box).select(F.col("row").alias("id"), (F.col("dist") <= distance * 1.001).alias("near"))
    near = neighbours.within(move(cloud), distance * tight * (1 - 1e-8), box).filter("row < col").count()
    told = cloud.agg(F.count_if(~inside(F.col("x"), F.col("y")) & (F.col("flag") == 0)).alias("stray"), F.count_if(F.col("flag") != 0).alias("rim")).first()
    rows = n.join(served.hint("merge"), "id", "left").withColumn("served", F.when(inside(F.col("x"), F.col("y")), F.col("near")))
    return rows.select("id", "served", F.lit(near).cast("long").alias("near_pairs"), F.lit(told.stray).cast("long").alias("stray"), F.lit(told.rim).cast("long").alias("rim"))


@query(_cloud_sql("true", "0"))
def gen_poisson_box(spark, d):
    n = nodes(spark, d)
    low, extent, h = _bounds(n)
    # the far sides of the period are its near sides
    cloud = regions.poisson_box(spark, extent, h, "periodic", seed=1, low=low)
    return _held(n, cloud, h, lambda x, y: F.lit(True), Box(extent), low)


@query(_cloud_sql("sqrt(px * px + py * py) >= r / 3", "4 + 2 * (floor(2 * rx / h + 1e-12) - 1) + 2 * (floor(2 * ry / h + 1e-12) - 1) + floor(pi() / asin(h / (2 * r / 3)) + 1e-12)"))
def gen_poisson_walls(spark, d):
    n = nodes(spark, d)
    low, extent, h = _bounds(n)
    cx, cy, hole = low[0] + extent[0] / 2, low[1] + extent[1] / 2, min(extent) / 6
    cloud = regions.poisson_box(spark, extent, h, "walls", hole=hole, seed=1, low=low)
    return _held(n, cloud, h, lambda x, y: F.hypot(x - cx, y - cy) >= hole)


@query(_cloud_sql("sqrt(px * px + py * py) < r AND sqrt((px - 0.2 * r) * (px - 0.2 * r) + py * py) > 0.4 * r", "floor(pi() / asin(h / (2 * r)) + 1e-12) + floor(pi() / asin(h / (0.8 * r)) + 1e-12)"))
def gen_eccentric_annulus(spark, d):
    n = nodes(spark, d)
    low, extent, h = _bounds(n)
    cx, cy, r = low[0] + extent[0] / 2, low[1] + extent[1] / 2, min(extent) / 2
    cloud = regions.eccentric_annulus(spark, r, 0.4 * r, 0.2 * r, h, seed=1, centre=(cx, cy))
    return _held(n, cloud, h, lambda x, y: (F.hypot(x - cx, y - cy) < r) & (F.hypot(x - cx - 0.2 * r, y - cy) > 0.4 * r))


@query(_cloud_sql("sqrt(px * px + py * py) < r * (0.7 + 0.15 * cos(3 * atan2(py, px)) + 0.05 * sin(2 * atan2(py, px)))", "0"))
def gen_polar_region(spark, d):
    n = nodes(spark, d)
    low, extent, h = _bounds(n)
    cx, cy, r = low[0] + extent[0] / 2, low[1] + extent[1] / 2, min(extent) / 2
    cloud = regions.polar_region(spark, [(0, 0.7 * r, 0.0), (3, 0.15 * r, 0.0), (2, 0.0, 0.05 * r)], h, seed=1, centre=(cx, cy))
    t = lambda x, y: F.atan2(y - cy, x - cx)
    held = _held(n, cloud, h, lambda x, y: F.hypot(x - cx, y - cy) < r * (0.7 + 0.15 * F.cos(3 * t(x, y)) + 0.05 * F.sin(2 * t(x, y))))
    return held.withColumn("rim", F.lit(0).cast("long"))  # the march along the curve has no closed form


@query(_cloud_sql("sqrt(px * px + (py - 0.45 * r) * (py - 0.45 * r)) < 0.5 * r OR sqrt((px + 0.45 * r * sqrt(3) / 2) ** 2 + (py + 0.225 * r) ** 2) < 0.5 * r OR sqrt((px - 0.45 * r * sqrt(3) / 2) ** 2 + (py + 0.225 * r) ** 2) < 0.5 * r", "0"))
def gen_multilobe(spark, d):
    n = nodes(spark, d)
    low, extent, h = _bounds(n)
    cx, cy, r = low[0] + extent[0] / 2, low[1] + extent[1] / 2, min(extent) / 2
    cloud = regions.multilobe(spark, 0.5 * r, h, 3, 0.45 * r, seed=1, centre=(cx, cy))

    def inside(x, y):
        at = [(cx + 0.45 * r * math.cos(t), cy + 0.45 * r * math.sin(t)) for t in (math.pi / 2 + 2 * math.pi * k / 3 for k in range(3))]
        return (F.hypot(x - at[0][0], y - at[0][1]) < 0.5 * r) | (F.hypot(x - at[1][0], y - at[1][1]) < 0.5 * r) | (F.hypot(x - at[2][0], y - at[2][1]) < 0.5 * r)

    # no two are nearer than the distance, but for nodes of the rim beside a notch
    return _held(n, cloud, h, inside, tight=0.95).withColumn("rim", F.lit(0).cast("long"))


# stencil weights and sparse operators

CENTRES = [(0.0, 0.0), (0.004, 0.0), (0.0, -0.004)]


def _weights(spark, d) -> DataFrame:
    return weights.interpolation_weights(nodes(spark, d), edges(spark, d, 15), weights.Interpolation(15), CENTRES)


def _moments(w: DataFrame, n: DataFrame, local: bool = True) -> DataFrame:
    """Sums of the weights times 1, x, y, x^2, xy, y^2 (from each stencil's node, or from the origin), of each row and operator."""
    here, there = n.select(F.col("id").alias("row"), F.col("x").alias("x0"), F.col("y").alias("y0")), n.select(F.col("id").alias("col"), "x", "y")
    w = w.join(there, "col").join(here, "row")
    x, y = (F.col(c) - F.col(f"{c}0") if local else F.col(c) for c in "xy")
    terms = {"s0": F.lit(1.0), "sx": x, "sy": y, "sxx": x * x, "sxy": x * y, "syy": y * y}
    return w.groupBy("row", "op").agg(*[(F.round(F.sum(F.col("weight") * t), 6) + 0.0).alias(name) for name, t in terms.items()])


@query()
def rbf_interp_weights(spark, d):
    return _weights(spark, d)


MOMENTS = "1.0::DOUBLE AS s0, cx::DOUBLE AS sx, cy::DOUBLE AS sy, round(cx * cx, 6)::DOUBLE AS sxx, round(cx * cy, 6)::DOUBLE AS sxy, round(cy * cy, 6)::DOUBLE AS syy"


@query(f"WITH {NODES} SELECT id AS row, op, {MOMENTS} FROM nodes CROSS JOIN (VALUES (0, 0.0::DOUBLE, 0.0::DOUBLE), (1, 0.004, 0.0), (2, 0.0, -0.004)) c(op, cx, cy)")
def rbf_weight_moments(spark, d):
    """The weights reproduce all functions of degree two: their moments are those of the centre."""
    return _moments(_weights(spark, d), nodes(spark, d))


@query(f"WITH {NODES} SELECT id AS row, op, {MOMENTS} FROM nodes CROSS JOIN (VALUES (0, 0.01::DOUBLE, 0.02::DOUBLE), (1, -0.03, 0.0)) c(op, cx, cy)")
def rbf_ragged_moments(spark, d):
    """Stencils of 12 to 16 nodes, set up without a local frame: the moments are those of the places asked for."""
    n = nodes(spark, d)
    e = edges(spark, d, 16).filter("k <= 12 + row % 5")
    return _moments(weights.interpolation_weights(n, e, weights.Interpolation(12), [(0.01, 0.02), (-0.03, 0.0)], local=False, ragged=True), n, local=False)


@query(f"WITH {NODES} SELECT count(*) FILTER (id % 37 = 0) AS singular FROM nodes")
def singular_stencils(spark, d):
    """Every 37th stencil holds its own node only, again and again."""
    e = edges(spark, d, 15).withColumn("col", F.when(F.col("row") % 37 == 0, F.col("row")).otherwise(F.col("col")))
    return weights.singular(weights.interpolation_weights(nodes(spark, d), e, weights.Interpolation(15), CENTRES))


@query(f"""WITH {EDGES}, w AS (SELECT row, col, 1.0 / (k + 1) AS weight FROM edges), y AS (SELECT row, sum(weight * (x + 2 * y)) AS value FROM w JOIN nodes ON col = id GROUP BY row)
SELECT row, round(CASE WHEN flag <> 0 THEN x + 2 * y ELSE value END, 9) + 0.0 AS value FROM y JOIN nodes ON row = id""")
def spmv(spark, d):
    n = nodes(spark, d)
    w = edges(spark, d).select("row", "col", (1.0 / (F.col("k") + 1)).alias("weight"))
    field = n.select("id", (F.col("x") + 2 * F.col("y")).alias("value"))
    return weights.apply(w, field, n).withColumn("value", r9("value"))


@query()
def nested_dissection_order(spark, d):
    return factor.nested_dissection(nodes(spark, d), edges(spark, d))


@query()
def graph_dissection_order(spark, d):
    return dissection.graph_dissection(edges(spark, d))


@query(f"""WITH {EDGES}, adj AS (SELECT least(row, col) AS row, greatest(row, col) AS col FROM edges WHERE row <> col)
SELECT DISTINCT row, col, true AS kept FROM adj""")
def dissected_edges(spark, d):
    """For each edge, whether the order keeps it: inside a part, or from a separator to a node of its two sides with a lower number."""
    e = edges(spark, d)
    tree = cut(dissection.dissected(e))
    ends = ordering.adjacency(e).filter("row < col")
    for c in ("row", "col"):
        ends = ends.join(tree.select(F.col("old_id").alias(c), F.col("new_id").alias(f"{c}_at"), F.col("part").alias(f"{c}_part"), F.col("separator").alias(f"{c}_between")), c)
    above = "{0}_between and {0}_at > {1}_at and startswith({1}_part, left({0}_part, length({0}_part) - 1))"
    kept = F.expr(f"row_part = col_part or ({above.format('row', 'col')}) or ({above.format('col', 'row')})")
    return ends.select("row", "col", kept.alias("kept"))


@query()
def minimum_degree_order(spark, d):
    return factor.minimum_degree(edges(spark, d))


@query()
def factor_nonzeros(spark, d):
    e = edges(spark, d)
    return factor.factor_nonzeros(e, factor.minimum_degree(e))


@query(f"""WITH RECURSIVE {EDGES}, {MORTON}, p AS ({ORDERED.format('key', 'keys')}),
pairs AS (SELECT a.new_id AS row, b.new_id AS col FROM edges JOIN p a ON a.old_id = row JOIN p b ON b.old_id = col WHERE row <> col),
adj AS (SELECT row, col FROM pairs UNION SELECT col, row FROM pairs),
reach AS (SELECT row AS j, col AS v FROM adj UNION SELECT r.j, a.col FROM reach r JOIN adj a ON a.row = r.v WHERE r.v < r.j)
SELECT new_id AS row, 1 + count(j) AS nonzeros FROM p LEFT JOIN reach ON v = new_id AND j < v GROUP BY new_id""")
def factor_rows(spark, d):
    """The rows of the factor in the order of a curve; SQL goes over paths through nodes that are eliminated before."""
    return factor.factor_rows(edges(spark, d), ordering.curve_order(nodes(spark, d)))


# files: a table goes out in a text format and comes back


def _folder(spark: SparkSession) -> str:
    """A new folder below the one that driver and executors share."""
    path = f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"
    system, place = files.filesystem(path)
    system.create_dir(place, recursive=True)
    text.register(spark)
    return path


def _put(path: str, content: str) -> None:
    system, place = files.filesystem(path)
    with system.open_output_stream(place) as f:
        f.write(content.encode())


@query(f"WITH {NODES} SELECT id, x, y FROM nodes")
def source_points(spark, d):
    to = _folder(spark)
    sinks.write_points(nodes(spark, d), f"{to}/a")
    return split.read_points(spark, f"{to}/a.points")


@query(f"WITH {NODES} SELECT id, x, y FROM nodes")
def source_points_struct(spark, d):
    to = _folder(spark)
    sinks.write_points(nodes(spark, d), f"{to}/a")
    return spark.read.format("points").option("point", True).load(f"{to}/a.points").select("id", "point.x", "point.y")


@query(f"WITH {NODES} SELECT id, x, y, flag AS marker, [x, 1.0] AS attrs FROM nodes")
def source_node(spark, d):
    to = _folder(spark)
    sinks.write_nodes(nodes(spark, d).withColumn("attrs", F.array("x", F.lit(1.0))), f"{to}/a", marker="flag", attrs="attrs")
    return split.read_nodes(spark, f"{to}/a.node")


@query(f"WITH {EDGES} SELECT row, k::INTEGER AS k, col FROM edges")
def source_graph(spark, d):
    to = _folder(spark)
    sinks.write_graph(edges(spark, d), f"{to}/a")
    return split.read_graph(spark, f"{to}/a.graph", k=9)


@query(f"WITH {P} SELECT old_id, new_id FROM p")
def source_iperm(spark, d):
    to = _folder(spark)
    sinks.write_ordering(ordering.curve_order(nodes(spark, d)), f"{to}/a")
    return split.read_ordering(spark, f"{to}/a.iperm")


@query(f"WITH {SHEET} SELECT part::INTEGER AS part, seq, node FROM bound")
def source_grid_bound(spark, d):
    to = _folder(spark)
    sinks.write_grid(*sheet(spark, d), f"{to}/a")
    return split.read_grid(spark, f"{to}/a.grid")[2]


@query(f"WITH {SHEET} SELECT kind, elem, verts FROM elements")
def source_grid(spark, d):
    to = _folder(spark)
    sinks.write_grid(*sheet(spark, d), f"{to}/a")
    return split.read_grid(spark, f"{to}/a.grid")[1]


@query(f"WITH {EDGES} SELECT (row + 1) || ' ' || (col + 1) AS line FROM edges UNION ALL SELECT '%%MatrixMarket matrix coordinate pattern general' UNION ALL SELECT n || ' ' || n || ' ' || 9 * n FROM (SELECT count(*) AS n FROM nodes)")
def sink_matrix_market(spark, d):
    to, n = _folder(spark), nodes(spark, d).count()
    sinks.write_matrix_market(edges(spark, d), f"{to}/a", n, n, value=None)
    return spark.read.text(f"{to}/a.mtx").withColumnRenamed("value", "line")


@query("SELECT seq::INTEGER AS seq, tag::INTEGER AS tag, bc::INTEGER AS bc, name FROM (VALUES (0, 1, 0, 'freestream'), (1, 2, 0, 'subsonic_outflow'), (2, 3, 0, 'viscous_wall')) t(seq, tag, bc, name)")
def source_bcmap(spark, d):
    to = _folder(spark)
    _put(f"{to}/a.bcmap", "! tags\n1 freestream\n2 subsonic_outflow\n3 viscous_wall\n")
    return spark.read.format("bcmap").load(f"{to}/a.bcmap")


@query("SELECT seq::INTEGER AS seq, tag::INTEGER AS tag, bc::INTEGER AS bc, name FROM (VALUES (0, 1, 5050, ''), (1, 2, 5051, 'outflow'), (2, 3, 4000, '')) t(seq, tag, bc, name)")
def source_mapbc(spark, d):
    to = _folder(spark)
    _put(f"{to}/a.mapbc", "3\n1 5050\n2 5051 outflow\n3 4000\n")
    return spark.read.format("mapbc").load(f"{to}/a.mapbc")


def _numbers(spark: SparkSession, path: str, names: str) -> DataFrame:
    """The lines of a text file that consist of as many numbers as there are names."""
    parts = F.split("value", " ")
    lines = spark.read.text(path).filter(F.col("value").rlike(r"^[-+0-9.e]+( [-+0-9.e]+)*$") & (F.size(parts) == len(names.split())))
    return lines.select(*[parts[i].cast("double").alias(n) for i, n in enumerate(names.split())])


@query(f"WITH {EDGES} SELECT (row + 1)::DOUBLE AS i, (col + 1)::DOUBLE AS j, x / (k + 1) AS a FROM edges JOIN nodes ON col = id UNION ALL SELECT n, n, 9 * n FROM (SELECT count(*)::DOUBLE AS n FROM nodes)")
def sink_matrix_values(spark, d):
    to, n = _folder(spark), nodes(spark, d)
    w = edges(spark, d).join(n.select(F.col("id").alias("col"), "x"), "col").select("row", "k", "col", (F.col("x") / (F.col("k") + 1)).alias("value"))
    sinks.write_matrix_market(w, f"{to}/a", n.count(), n.count())
    return _numbers(spark, f"{to}/a.mtx", "i j a")


@query(f"WITH {NODES} SELECT x, y, flag::DOUBLE AS s, x - y AS u FROM nodes")
def sink_columns(spark, d):
    to = _folder(spark)
    sinks.write_columns(nodes(spark, d).select("id", "x", "y", F.col("flag").cast("double").alias("s"), (F.col("x") - F.col("y")).alias("u")), f"{to}/a", ["s", "u"])
    return _numbers(spark, f"{to}/a.dat", "x y s u")


@query(f"WITH {NODES} SELECT x AS a, y AS b, 0.0::DOUBLE AS c FROM nodes UNION ALL SELECT -y, 2 * x, 0.0 FROM nodes")
def sink_vtk(spark, d):
    """The points of the file, and its vectors; the scalars and vertices have lines of fewer numbers."""
    to = _folder(spark)
    n = nodes(spark, d).select("id", "x", "y", F.col("flag").cast("double").alias("s"), (-F.col("y")).alias("vx"), (2 * F.col("x")).alias("vy"))
    sinks.write_vtk(n, f"{to}/a", ["s"], [("v", "vx", "vy")])
    return _numbers(spark, f"{to}/a.vtk", "a b c")
