"""Nested dissection on the graph alone: coarsening by matchings, parts that are halved on the way back, separators.

No coordinates are needed. A hierarchy of coarser graphs is built once; on the way back a part is halved as soon as it has
more than a bounded number of nodes, so halves of the whole graph are found where it is small, and all parts of all depths go on together.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.lineage import cut, drop, shared_dir
from tessera.operators.ordering import adjacency, dense_number

#: Nodes of a part of a coarse graph. A part doubles at most from a graph to the next finer one, and refinement
#: fills it up to two and a half times this, so this bounds what one task halves at a time.
MOST = 256

#: Nodes that want the same neighbour are paired inside groups of about this size, however many there are.
CROWD = 64


def _matched(nodes: DataFrame, edges: DataFrame, turn: int) -> DataFrame:
    """id, c, weight: each node's node in the next coarser graph, of one or two nodes, and that node's weight.

    Every node proposes along its best edge (heavy between light nodes; ties by a hash that both ends share). Edges that both ends
    propose are contracted; of the nodes whose proposal is not returned, those that want the same neighbour are paired.
    """
    low, high = F.least("u", "w"), F.greatest("u", "w")
    rating = F.col("weight").cast("double") * F.col("weight") / (F.col("u_weight").cast("double") * F.col("w_weight"))
    key = F.struct(rating.alias("rating"), F.xxhash64(low, high, F.lit(turn)).alias("h"), low.alias("low"), high.alias("high"))
    best = edges.groupBy("u").agg(F.max(key).alias("e"), F.min("u_weight").alias("own"))
    wanted = best.groupBy("e.low", "e.high").agg(F.count(F.lit(1)).alias("n"), F.min("u").alias("u"), F.sum("own").alias("weight"))
    wanted = cut(wanted)
    mutual = wanted.filter("n = 2").select(F.explode(F.array("low", "high")).alias("id"), F.col("low").alias("c"), "weight")
    lone = wanted.filter("n = 1").select("u", F.when(F.col("u") == F.col("low"), F.col("high")).otherwise(F.col("low")).alias("want"), "weight")
    crowds = lone.groupBy("want").agg(F.ceil(F.count(F.lit(1)) / CROWD).alias("groups")).filter("groups > 1")
    dealt = lone.join(crowds, "want", "left").withColumn("group", F.pmod(F.xxhash64("u", F.lit(turn)), F.coalesce("groups", F.lit(1))))
    inside = Window.partitionBy("want", "group").orderBy("u")
    second = F.row_number().over(inside) % 2 == 0
    other = lambda c: F.when(second, F.lag(c).over(inside)).otherwise(F.lead(c).over(inside))
    paired = dealt.select(F.col("u").alias("id"), F.when(second, F.lag("u").over(inside)).otherwise(F.col("u")).alias("c"), (F.col("weight") + F.coalesce(other("weight"), F.lit(0))).alias("weight"))
    found = mutual.union(paired).withColumnRenamed("weight", "joint")
    return cut(nodes.join(found, "id", "left").select("id", F.coalesce("c", "id").alias("c"), F.coalesce("joint", "weight").alias("weight")), instead=[wanted])


def _contracted(edges: DataFrame, match: DataFrame) -> DataFrame:
    """The edges of the coarser graph: weights are sums, edges inside its nodes are gone."""
    to = lambda c: match.select(F.col("id").alias(c), F.col("c").alias(f"{c}_c"), F.col("weight").alias(f"{c}_m"))
    ends = edges.select("u", "w", "weight").join(to("u"), "u").join(to("w"), "w").filter("u_c <> w_c")
    sums = ends.groupBy(F.col("u_c").alias("u"), F.col("w_c").alias("w")).agg(F.sum("weight").alias("weight"), F.min("u_m").alias("u_weight"), F.min("w_m").alias("w_weight"))
    return cut(sums)


def _along(laplacian: np.ndarray) -> list[np.ndarray]:
    """Directions to sort the nodes of a piece along: the second eigenvector, or where several have its eigenvalue (a square has two), eight ways through a plane of them.

    The plane is laid through the nodes that the eigenvectors' space holds most of, so it does not depend on which of them LAPACK returns.
    """
    values, vectors = np.linalg.eigh(laplacian)
    same = np.abs(values - values[1]) <= 1e-9 * max(1.0, values[-1])
    space = vectors[:, same] @ vectors[:, same].T - same[0] / len(values)  # the constant is no direction
    plane = []
    for _ in range(min(2, same.sum() - same[0])):
        node = int(np.argmax(np.round(np.diag(space), 9)))
        plane.append(space[node] / np.sqrt(space[node, node]))
        space = space - np.outer(plane[-1], plane[-1])
    if len(plane) == 1:
        return plane
    return [np.cos(t) * plane[0] + np.sin(t) * plane[1] for t in np.arange(8) * np.pi / 8]


def _halves(part: pd.DataFrame, most: int) -> pd.DataFrame:
    """A part's nodes with the paths of its pieces, each of at most ``most`` nodes.

    A piece is sorted along the second eigenvector of its Laplacian (see _along) and cut where the fewest edges cross, of the places that leave two fifths of
    the weight on either side.
    """
    part = part.sort_values("id", ignore_index=True)
    ids, weight = part["id"].to_numpy(), part["weight"].to_numpy(np.float64)
    place = {v: i for i, v in enumerate(ids)}
    a = np.zeros((len(ids), len(ids)))
    for i, edges in enumerate(part["edges"]):
        for e in edges if edges is not None else ():
            a[i, place[e["w"]]] = e["weight"]
    paths = [part["path"].iloc[0]] * len(ids)
    todo = [np.arange(len(ids))]
    while todo:
        piece = todo.pop()
        if len(piece) <= most:
            continue
        b, best = a[np.ix_(piece, piece)], None
        for along in _along(np.diag(b.sum(1)) - b):
            by = np.lexsort((piece, np.round(along, 9)))
            c = b[np.ix_(by, by)]
            crossing = np.cumsum(c.sum(1) - 2 * np.tril(c, -1).sum(1))[:-1]
            share = np.cumsum(weight[piece][by])[:-1] / weight[piece].sum()
            fair = (share >= 0.4) & (share <= 0.6)
            if not fair.any():  # one heavy node: as near to the middle as can be
                fair = np.abs(share - 0.5) == np.abs(share - 0.5).min()
            cut_ = int(np.flatnonzero(fair)[np.lexsort((np.abs(share[fair] - 0.5), crossing[fair]))[0]])
            if best is None or crossing[cut_] < best:
                best, order, at = crossing[cut_], by, 1 + cut_
        for bit, side in (("0", piece[order[:at]]), ("1", piece[order[at:]])):
            for i in side:
                paths[i] += bit
            todo.append(np.sort(side))
    return pd.DataFrame({"id": ids, "path": paths})


def _ends(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """Edges with the parts of both ends."""
    at = lambda c: parts.select(F.col("id").alias(c), F.col("path").alias(f"{c}_path"))
    return edges.join(at("u"), "u").join(at("w"), "w")


def _halved(nodes: DataFrame, edges: DataFrame, parts: DataFrame, most: int) -> DataFrame:
    """Parts of at most ``most`` nodes; larger ones are cut, each by itself, those that are small enough stay."""
    large = cut(parts.groupBy("path").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select("path"))
    mine = parts.join(large, "path", "left_semi")
    lists = _ends(edges, mine).filter("u_path = w_path").groupBy(F.col("u").alias("id")).agg(F.collect_list(F.struct("w", "weight")).alias("edges"))
    rows = mine.join(nodes, "id").join(lists, "id", "left").select("path", "id", "weight", "edges")
    pieces = rows.groupBy("path").applyInPandas(lambda part: _halves(part, most), "id long, path string")
    return cut(parts.join(large, "path", "left_anti").select("id", "path").union(pieces), instead=[large, parts])


def _refined(edges: DataFrame, parts: DataFrame, up: bool) -> DataFrame:
    """Nodes move to the part that more of their edges lead to, all in one direction of the order of parts, so no two change places.

    A part takes all who come to it or, if that made it too large, nobody; one that would be left with less than a quarter of its bound keeps its nodes.
    """
    ties = _ends(edges, parts).groupBy("u", "u_path", "w_path").agg(F.sum("weight").alias("weight"))
    ahead = F.col("w_path") > F.col("u_path") if up else F.col("w_path") < F.col("u_path")
    best = F.max(F.when(ahead, F.struct("weight", "w_path"))).alias("best")
    own = F.coalesce(F.max(F.when(F.col("w_path") == F.col("u_path"), F.col("weight"))), F.lit(0)).alias("own")
    wish = ties.groupBy(F.col("u").alias("id"), F.col("u_path").alias("path")).agg(best, own).filter("best.weight > own")
    wish = cut(wish.select("id", "path", F.col("best.w_path").alias("to")))
    sizes = parts.groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    coming = wish.groupBy(F.col("to").alias("path")).agg(F.count(F.lit(1)).alias("more"))
    leaving = wish.groupBy("path").agg(F.count(F.lit(1)).alias("less"))
    full = sizes.join(coming, "path").filter(F.col("n") + F.col("more") > 2 * MOST + MOST // 2).select(F.col("path").alias("to"))
    low = sizes.join(leaving, "path").filter(F.col("n") - F.col("less") < MOST // 4).select("path")
    moves = wish.join(full, "to", "left_anti").join(low, "path", "left_anti").select("id", "to")
    return cut(parts.join(moves, "id", "left").select("id", F.coalesce("to", "path").alias("path")), instead=[parts, wish])


def parts_of(edges: DataFrame, leaf: int = 32) -> DataFrame:
    """id, path: a binary tree over the nodes of a symmetrised graph, with at most ``leaf`` nodes for each path; few edges lead from part to part.

    On a grid each coarser graph has 0.65 of the nodes of the one before, so that all graphs together have about three times its nodes and
    the rounds are as its logarithm. Components that are not one with others in the coarsest graph have paths of their own.
    """
    one = F.lit(1).cast("long")
    graph = cut(adjacency(edges).select(F.col("row").alias("u"), F.col("col").alias("w"), one.alias("weight"), one.alias("u_weight"), one.alias("w_weight")))
    nodes = cut(edges.select(F.col("row").cast("long").alias("id")).union(edges.select(F.col("col").cast("long"))).filter("id is not null").distinct().withColumn("weight", one))
    finer: list[tuple[DataFrame, DataFrame, DataFrame]] = []
    while nodes.count() > MOST and not graph.isEmpty():
        match = _matched(nodes, graph, len(finer))
        finer.append((nodes, graph, match))
        graph, nodes = _contracted(graph, match), match.filter("c = id").select("id", "weight")
    root = F.lpad(F.hex("id"), 16, "0") if graph.isEmpty() else F.lit("")
    parts = _halved(nodes, graph, cut(nodes.select("id", root.alias("path"))), MOST if finer else leaf)
    while finer:
        drop(graph)
        nodes, graph, match = finer.pop()
        coarse = parts
        parts = cut(match.join(coarse.withColumnRenamed("id", "c"), "c").select("id", "path"), instead=[coarse])
        for up in (True, False):
            parts = _refined(graph, parts, up)
        parts = _halved(nodes, graph, parts, MOST if finer else leaf)
        drop(match)
    drop(graph)
    return parts


def separated(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """id, part, separator: the nodes that stand between the two sides of each split have its path and ``2``, the others keep theirs.

    Depth by depth, of the edges between sides whose ends no split before has taken, one end each is taken: all ends on one side, or all on the other, or the end with
    more such edges, whichever takes the fewest nodes of a split. An edge is met at one depth only.
    """
    spark = edges.sparkSession
    table = f"{shared_dir(spark)}/crossing-{uuid.uuid4().hex}"
    taken, fields = f"{shared_dir(spark)}/separators-{uuid.uuid4().hex}", "id long, depth int"
    once = adjacency(edges).filter("row < col").select(F.col("row").alias("u"), F.col("col").alias("w"))
    differ = "transform(sequence(1, least(length(u_path), length(w_path))), i -> substr(u_path, i, 1) <> substr(w_path, i, 1))"
    crossing = _ends(once, parts).filter("u_path <> w_path").withColumn("depth", F.expr(f"cast(array_position({differ}, true) - 1 as int)"))
    left = F.expr("substr(u_path, depth + 1, 1) = '0'")
    sides = crossing.select(F.when(left, F.col("u")).otherwise(F.col("w")).alias("a"), F.when(left, F.col("w")).otherwise(F.col("u")).alias("b"), F.expr("left(u_path, depth)").alias("split"), "depth")
    sides.write.parquet(table + "/all")
    sides = spark.read.schema(sides.schema).parquet(table + "/all")
    spark.createDataFrame([], "id long").write.parquet(f"{taken}/depth=-1")
    for depth in sorted(r.depth for r in sides.select("depth").distinct().collect()):  # as many as the tree is deep
        gone = spark.read.schema(fields).parquet(taken).select("id")
        here = sides.filter(F.col("depth") == depth).select("a", "b", "split")
        here = cut(here.join(gone.withColumnRenamed("id", "a"), "a", "left_anti").join(gone.withColumnRenamed("id", "b"), "b", "left_anti"))
        count = lambda c, n: here.groupBy(c).agg(F.count(F.lit(1)).alias(n))
        per = here.groupBy("split").agg(F.count_distinct("a").alias("of_a"), F.count_distinct("b").alias("of_b"))
        busy = F.when(F.col("n_a") == F.col("n_b"), F.col("of_a") <= F.col("of_b")).otherwise(F.col("n_a") > F.col("n_b"))
        picks = here.join(count("a", "n_a"), "a").join(count("b", "n_b"), "b").join(per, "split").withColumn("pick", F.when(busy, F.col("a")).otherwise(F.col("b")))
        mixed = picks.groupBy("split").agg(F.count_distinct("pick").alias("of_pick"))
        best = F.when(F.col("of_pick") < F.least("of_a", "of_b"), F.col("pick")).when(F.col("of_a") <= F.col("of_b"), F.col("a")).otherwise(F.col("b"))
        picks.join(mixed, "split").select(best.alias("id")).distinct().write.parquet(f"{taken}/depth={depth}")
        drop(here)
    between = spark.read.schema(fields).parquet(taken).filter("depth >= 0")
    part = F.coalesce(F.expr("concat(left(path, depth), '2')"), F.col("path"))
    return parts.join(between, "id", "left").select("id", part.alias("part"), F.col("depth").isNotNull().alias("separator"))


def dissected(edges: DataFrame, leaf: int = 32) -> DataFrame:
    """old_id, new_id, part, separator: the order of ``graph_dissection`` with the tree that it comes from."""
    edges = cut(edges.select("row", "col"))  # stencils that are still to be found are found once
    parts = parts_of(edges, leaf)
    tree = cut(separated(edges, parts), instead=[parts])
    at = lambda c: tree.select(F.col("id").alias(c), F.col("part").alias(f"{c}_part"))
    leaving = adjacency(edges).join(at("row"), "row").join(at("col"), "col").filter("row_part <> col_part")
    outside = leaving.groupBy(F.col("row").alias("id")).agg(F.count(F.lit(1)).alias("outside"))
    rows = tree.join(outside, "id", "left").select(F.col("id").alias("old_id"), "part", "separator", F.coalesce("outside", F.lit(0)).alias("outside"))
    return dense_number(rows, ["part", "outside", "old_id"], "new_id").select("old_id", "new_id", "part", "separator")


def graph_dissection(edges: DataFrame, leaf: int = 32) -> DataFrame:
    """old_id, new_id: a fill-reducing order of the symmetrised graph, by its edges alone.

    The two sides of each split come one after the other and the nodes between them behind both. Inside a part (of at most ``leaf`` nodes), nodes
    with fewer neighbours outside it go first, then by id.
    Defined cases: loops and repeated edges count once, nodes with loops alone are nodes, an edge with a null end counts for
    its other end only, and a graph without rows has an empty order. Of eigenvectors of equal eigenvalues those
    are taken that cross the fewest edges (see _along), whichever of them LAPACK returns.
    """
    return dissected(edges, leaf).select("old_id", "new_id")
