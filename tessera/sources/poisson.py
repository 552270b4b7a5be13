"""Maximal Poisson-disk sampling as rounds of joins.

The rectangle is cut into cells so small that each has room for one point. In every round each cell that may still have
room throws one dart, whose place and priority are hashes of the seed and the cell, so a cloud depends on its seed
and on nothing else. A dart is refused if a point stands nearer than the distance; of the darts that are left, one
stays if no nearer one has a higher priority. Cells with a point are done; the others are quartered, and quarters that
the disk of one point covers, or that lie outside the region, are left out. This goes on until none is left: then
there is no room for another point. Quartering ends after ``depth`` rounds; what is still open then (the cell's width
over two to the depth, at the corners of three disks) goes on throwing darts until one round finds no place.

All joins are equi-joins on cells, a cell's points are as few as fit into its surroundings, and the rounds get cheaper
as fewer cells are open. Nothing but counts comes to the driver: joins are hinted, as each table that Spark would broadcast
goes through the driver, round after round.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.metric import Box, distance, fold, minimum_image
from tessera.operators.lineage import cut
from tessera.operators.neighbours import around, within

#: What rounding may take from a distance.
SLACK = 1 - 1e-9


@dataclass(frozen=True)
class Region:
    """Where points may stand: whether a place is inside, and whether nothing within some reach of a place is.

    ``beyond`` may say no where the answer is yes, but less and less so as the reach gets small: cells outside are
    quartered as long as it does.
    """

    inside: Callable[[Column, Column], Column]
    beyond: Callable[[Column, Column, float], Column]


def uniform(seed: int, *what: Column | int) -> Column:
    """A number in [0, 1) that the seed and the columns determine."""
    h = F.xxhash64(F.lit(seed).cast("long"), *[w if isinstance(w, Column) else F.lit(w).cast("long") for w in what])
    return F.shiftrightunsigned(h, 11) * 2.0**-53


class PoissonDisk:
    """Points of a rectangle no nearer than r to each other.

    Axes may be periodic; the far sides of the others hold no drawn points. Points that are given stand where they
    are, by default no nearer than r to each other either (``tight``: as near as this share of r). A null or infinite
    coordinate of a given point is a ValueError.
    """

    def __init__(self, spark: SparkSession, r: float, extent: tuple[float, float], periodic: tuple[bool, bool] = (False, False), seed: int | None = None, low: tuple[float, float] = (0.0, 0.0), region: Region | None = None, depth: int = 12) -> None:
        if not (r > 0 and min(extent) > 0):
            raise ValueError("the distance and the extent must be positive")
        if any(p and side < 2 * r for p, side in zip(periodic, extent, strict=True)):
            raise ValueError("a periodic side must be two distances long")
        self.spark, self.r, self.extent, self.low, self.region, self.depth = spark, r * SLACK, extent, low, region, depth
        self.periodic = periodic
        self.seed = int(np.random.SeedSequence().generate_state(1)[0]) if seed is None else seed
        self.box = Box(tuple(s if p else 0.0 for s, p in zip(extent, periodic, strict=True)))
        self.count = [max(1, math.ceil(s * math.sqrt(2) / r)) for s in extent]
        self.width = [s / n for s, n in zip(extent, self.count, strict=True)]
        self.reach = [math.ceil(r / w) for w in self.width]
        self.reset()

    def reset(self) -> None:
        """No points, and the random numbers from the start."""
        self.points = self.spark.createDataFrame([], "ci int, cj int, x double, y double, call int")
        self.calls = 0

    def _cell(self, axis: int, c: Column) -> Column:
        return F.least(F.greatest(F.floor((c - self.low[axis]) / self.width[axis]), F.lit(0)), F.lit(self.count[axis] - 1)).cast("int")

    def add_points(self, given: DataFrame, tight: float = 1.0) -> None:
        """Points (x, y) to keep a distance from; outside the rectangle, or too near to each other or to those there are, is an error."""
        off = F.lit(False)
        for c, lo, s, p in zip(("x", "y"), self.low, self.extent, self.periodic, strict=True):
            off = off | ~F.coalesce((F.col(c) >= lo) & ((F.col(c) < lo + s) if p else (F.col(c) <= lo + s)), F.lit(False))
        stray = given.filter(off).count()
        if stray:
            raise ValueError(f"{stray} given points stand outside")
        given = given.select(self._cell(0, F.col("x")).alias("ci"), self._cell(1, F.col("y")).alias("cj"), "x", "y", F.lit(0).alias("call"))
        every = cut(self.points.union(given))
        near = within(every.select(F.monotonically_increasing_id().alias("id"), (F.col("x") - self.low[0]).alias("x"), (F.col("y") - self.low[1]).alias("y")), self.r * tight, self.box)
        pairs = near.filter((F.col("row") < F.col("col")) & (F.col("dist") < self.r * tight)).count()
        if pairs:
            raise ValueError(f"{pairs} pairs of given points are too near to each other")
        self.points = every

    def _exploded(self, cells: DataFrame, i: str, j: str) -> DataFrame:
        """Each row once for every cell (pi, pj) near its own."""
        return cells.withColumn("pi", F.explode(around(F.col(i), self.reach[0], self.count[0], self.periodic[0]))).withColumn("pj", F.explode(around(F.col(j), self.reach[1], self.count[1], self.periodic[1])))

    def _apart(self, x: Column, y: Column, p: Column) -> Column:
        return distance([x, y], [p["x"], p["y"]], self.box)

    def _near(self, cells: DataFrame, points: DataFrame, columns: list[str]) -> DataFrame:
        """i, j, near: the points around each of the cells (i, j), as many as fit there."""
        met = self._exploded(cells.select("i", "j").distinct(), "i", "j").join(points.select(F.col("ci").alias("pi"), F.col("cj").alias("pj"), *columns).hint("merge"), ["pi", "pj"])
        return met.groupBy("i", "j").agg(F.collect_list(F.struct(*columns)).alias("near"))

    def _thrown(self, active: DataFrame, points: DataFrame, level: int, turn: int) -> DataFrame:
        """The open quarters among the active ones: i, j, a, b, their dart x, y and whether it may stay (ok)."""
        parts, at = 2**level, ("i", "j", "a", "b")
        wide = [w / parts for w in self.width]
        corner = [F.lit(lo) + (F.col(i) + F.col(a) / parts) * w for lo, i, a, w in zip(self.low, "ij", "ab", self.width, strict=True)]
        centre = [c + w / 2 for c, w in zip(corner, wide, strict=True)]
        dart = [c + uniform(self.seed, self.calls, turn, axis, *map(F.col, at)) * w for axis, (c, w) in enumerate(zip(corner, wide, strict=True))]
        rows = active.join(self._near(active, points, ["x", "y"]).hint("merge"), ["i", "j"], "left")

        def covers(p: Column) -> Column:
            far = [F.abs(minimum_image(c - p[n], self.box.side(k))) + w / 2 for k, (c, n, w) in enumerate(zip(centre, "xy", wide, strict=True))]
            return F.hypot(*far) < self.r

        rows = rows.filter(~F.coalesce(F.exists("near", covers), F.lit(False)))
        if self.region:
            rows = rows.filter(~self.region.beyond(*centre, math.hypot(*wide) / 2))
        rows = rows.withColumns({"x": dart[0], "y": dart[1]})
        ok = ~F.coalesce(F.exists("near", lambda p: self._apart(F.col("x"), F.col("y"), p) < self.r), F.lit(False))
        if self.region:
            ok = ok & self.region.inside(F.col("x"), F.col("y"))
        return rows.select(*at, "x", "y", ok.alias("ok"))

    def _stay(self, thrown: DataFrame, turn: int) -> DataFrame:
        """Of the darts that may stay, those with no nearer one of higher priority: ci, cj, x, y, rank."""
        rank = uniform(self.seed, self.calls, turn, 2, *map(F.col, ("i", "j", "a", "b")))
        best = thrown.filter("ok").groupBy("i", "j").agg(F.max(F.struct(rank.alias("rank"), "a", "b", "x", "y")).alias("best"))
        best = best.select("i", "j", F.col("best.rank").alias("rank"), F.col("best.x").alias("x"), F.col("best.y").alias("y"))
        darts = best.select(F.col("i").alias("ci"), F.col("j").alias("cj"), "x", "y", "rank")
        met = best.join(self._near(best, darts, ["ci", "cj", "x", "y", "rank"]).hint("merge"), ["i", "j"])
        order = F.struct("rank", F.col("i").alias("ci"), F.col("j").alias("cj"))
        beaten = F.exists("near", lambda p: (F.struct(p["rank"].alias("rank"), p["ci"].alias("ci"), p["cj"].alias("cj")) > order) & (self._apart(F.col("x"), F.col("y"), p) < self.r))
        return cut(met.filter(~beaten).select(F.col("i").alias("ci"), F.col("j").alias("cj"), "x", "y", "rank"))

    def random(self, n: int | None = None) -> DataFrame:
        """x, y of up to n more points, of all for which there is room without n."""
        self.calls += 1
        nx = self.count[0]
        active = self.spark.range(nx * self.count[1]).select((F.col("id") % nx).cast("int").alias("i"), F.floor(F.col("id") / nx).cast("int").alias("j"), F.lit(0).alias("a"), F.lit(0).alias("b"))
        drawn, tables, before, taken, level, turn = [], [], [], 0, 0, 0
        while n is None or taken < n:
            before = [thrown := cut(self._thrown(active, reduce(DataFrame.union, [self.points, *drawn]), level, turn), instead=before)]
            if thrown.isEmpty():
                break
            won = self._stay(thrown, turn)
            size = won.count()
            if n is not None and taken + size > n:
                won = cut(won.orderBy("rank", "ci", "cj").limit(n - taken), instead=[won])
                size = n - taken
            drawn.append(won.select("ci", "cj", "x", "y", F.lit(self.calls).alias("call")))
            tables.append(won)
            taken += size
            open_cells = thrown.join(won.select(F.col("ci").alias("i"), F.col("cj").alias("j")).hint("merge"), ["i", "j"], "left_anti").select("i", "j", "a", "b")
            if level < self.depth:
                half = F.explode(F.array(F.lit(0), F.lit(1)))
                open_cells = open_cells.withColumn("da", half).withColumn("db", half).select("i", "j", (2 * F.col("a") + F.col("da")).alias("a"), (2 * F.col("b") + F.col("db")).alias("b"))
                level += 1
            elif not size:
                break
            active, turn = open_cells, turn + 1
        mine = cut(reduce(DataFrame.union, drawn, self.points.limit(0)), instead=tables + before)
        self.points = self.points.union(mine)
        return mine.select("x", "y")

    def fill(self) -> DataFrame:
        """x, y of all points, once no room is left."""
        self.random()
        return self.points.select("x", "y")


def wrapped_into(points: DataFrame, low: tuple[float, float], extent: tuple[float, float], periodic: tuple[bool, bool]) -> DataFrame:
    """The points moved by whole periods into the rectangle."""
    return points.withColumns({c: lo + fold(F.col(c) - lo, s) if p else F.col(c) for c, lo, s, p in zip(("x", "y"), low, extent, periodic, strict=True)})
