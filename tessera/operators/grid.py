"""Unstructured 2-D grids: nodes (id, x, y), elements (kind, elem, verts) and boundary parts (part, seq, node).

Places (seq) within a part count from 0. Element numbers count within their kind from 0, parts from 0; messages count from 1.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.ordering import dense_number


def walks(bound: DataFrame) -> DataFrame:
    """part, seq, u, v: the edges that boundary parts walk, as a join of each place with the next: a part of any length is dealt over tasks."""
    ahead = bound.select("part", (F.col("seq") - 1).alias("seq"), F.col("node").alias("v"))
    return bound.join(ahead, ["part", "seq"]).select("part", "seq", F.col("node").alias("u"), "v")


def violations(nodes: DataFrame, elements: DataFrame, bound: DataFrame) -> DataFrame:
    """problem, violations: how often the tables break each rule of a grid; a row for each rule. Nulls break the rules that they stand in."""
    known = nodes.select(F.col("id").alias("node")).distinct()
    used = elements.select(F.explode("verts").alias("node")).union(bound.select("node"))
    size = F.when(F.col("kind") == "triangle", 3).when(F.col("kind") == "quadrilateral", 4)
    parts = bound.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("seq").alias("places"), F.min("seq").alias("first"), F.max("seq").alias("last"))
    whole = (F.col("places") == F.col("n")) & (F.col("first") == 0) & (F.col("last") == F.col("n") - 1)
    broken = {
        "elements with another number of nodes than their kind": elements.filter(~F.coalesce(F.size("verts") == size, F.lit(False))),
        "elements that name a node twice": elements.filter(F.size(F.array_distinct("verts")) < F.size("verts")),
        "nodes out of range": used.join(known, "node", "left_anti"),
        "boundary parts of fewer than two nodes": parts.filter("n < 2"),
        "boundary parts whose places are not numbered from 0": parts.filter(~F.coalesce(whole, F.lit(False))),
        "immediate repeats in boundary parts": walks(bound).filter("u = v"),
    }
    rows = [df.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(what).alias("problem"), "violations") for what, df in broken.items()]
    return reduce(DataFrame.unionAll, rows)


def check(nodes: DataFrame, elements: DataFrame, bound: DataFrame) -> None:
    """A ValueError that lists what the tables violate."""
    found = [f"{r.violations} {r.problem}" for r in violations(nodes, elements, bound).filter("violations > 0").collect()]
    if found:
        raise ValueError("; ".join(found))


def sizes(nodes: DataFrame, elements: DataFrame, bound: DataFrame) -> DataFrame:
    kinds = elements.agg(F.count_if(F.col("kind") == "triangle").alias("triangles"), F.count_if(F.col("kind") == "quadrilateral").alias("quadrilaterals"))
    return nodes.agg(F.count(F.lit(1)).alias("nodes")).join(kinds).join(bound.agg(F.count_distinct("part").alias("parts")))


def closed(bound: DataFrame) -> DataFrame:
    """part, closed: whether a part ends where it begins."""
    ends = F.min_by("node", "seq") == F.max_by("node", "seq")
    return bound.groupBy("part").agg((ends & (F.count(F.lit(1)) > 1)).alias("closed"))


def markers(nodes: DataFrame, bound: DataFrame) -> DataFrame:
    """id, marker: the first part (from 1) that lists the node, else 0."""
    first = bound.groupBy(F.col("node").alias("id")).agg((F.min("part") + 1).alias("marker"))
    return nodes.select("id").join(first, "id", "left").fillna(0, ["marker"])


def element_edges(elements: DataFrame) -> DataFrame:
    """kind, elem, side, u, v: the directed edges of all elements, and their place in file order."""
    sides = elements.select("kind", "elem", "verts", F.posexplode("verts").alias("side", "u"))
    place = F.struct((F.col("kind") != "triangle").alias("a"), F.col("elem").cast("long").alias("b"), F.col("side").cast("long").alias("c"))
    return sides.select("kind", "elem", "side", "u", F.element_at("verts", (F.col("side") + 1) % F.size("verts") + 1).alias("v"), place.alias("place"))


def orientation_faults(nodes: DataFrame, elements: DataFrame, bound: DataFrame) -> DataFrame:
    """check, place, message of each violation of the orientation rules; none if the grid follows them.

    1 elements that are not counterclockwise, 2 directed edges used twice, 3 part edges that are no mesh
    boundary walked with the domain on the left, 4 mesh boundary edges that no part walks.
    """
    edges = element_edges(elements)
    at = lambda end: nodes.select(F.col("id").alias(end), F.col("x").alias(f"x{end}"), F.col("y").alias(f"y{end}"))
    no = lambda c: (F.col(c) + 1).cast("string")
    area = edges.join(at("u"), "u").join(at("v"), "v").groupBy("kind", "elem").agg(F.sum(F.col("xu") * F.col("yv") - F.col("xv") * F.col("yu")).alias("area2"), F.min("place").alias("place"))
    flat = area.filter(~(F.col("area2") > 0) | F.isnan("area2")).select(F.lit(1).alias("check"), "place", F.concat("kind", F.lit(" "), no("elem"), F.lit(" is not counterclockwise")).alias("message"))
    once = edges.groupBy("u", "v").agg(F.count(F.lit(1)).alias("uses"), F.min("place").alias("place"))
    twice = once.filter("uses > 1").select(F.lit(2).alias("check"), "place", F.concat(F.lit("element edge "), no("u"), F.lit(" -> "), no("v"), F.lit(" is used twice in the same direction")).alias("message"))
    has = once.select("u", "v", F.lit(True).alias("fwd"))
    against = once.select(F.col("v").alias("u"), F.col("u").alias("v"), F.lit(True).alias("rev"))
    walked = walks(bound).join(has, ["u", "v"], "left").join(against, ["u", "v"], "left").fillna(False, ["fwd", "rev"])
    what = F.when(~F.col("fwd") & F.col("rev"), " walks with the domain on the right").when(F.col("fwd") & F.col("rev"), " is an interior edge").when(~F.col("fwd"), " is not an element edge")
    place = F.struct(F.lit(False).alias("a"), F.col("part").cast("long").alias("b"), F.col("seq").cast("long").alias("c"))
    wrong = walked.filter("not fwd or rev").select(F.lit(3).alias("check"), place.alias("place"), F.concat(F.lit("boundary part "), no("part"), F.lit(", edge "), no("u"), F.lit(" -> "), no("v"), what).alias("message"))
    good = walked.filter("fwd and not rev").select("u", "v").distinct()
    rim = once.join(against.select("u", "v"), ["u", "v"], "left_anti").join(good, ["u", "v"], "left_anti")
    unwalked = rim.select(F.lit(4).alias("check"), "place", F.concat(F.lit("element boundary edge "), no("u"), F.lit(" -> "), no("v"), F.lit(" is not walked by any boundary part")).alias("message"))
    return flat.union(twice).union(wrong).union(unwalked)


def messages(nodes: DataFrame, elements: DataFrame, bound: DataFrame) -> DataFrame:
    """no, check, message: the violations in the order of a walk through the grid's file, check by check (from 0)."""
    found = orientation_faults(nodes, elements, bound).select("check", "place", "message")
    return dense_number(found, ["check", "place", "message"], "no").select("no", "check", "message")
