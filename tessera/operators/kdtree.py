"""Nearest neighbours in any number of dimensions by a k-d partition.

The cloud is cut along its axes in turn, widest first, into slabs of equal counts (approximate quantiles of each part,
from partial aggregates), of every part as many as spread the cuts over all axes; so a few rounds give leaves of a
bounded number of points whatever the cloud's size and shape. The cuts of a level are a table; points and queries find their leaf by
joins with those tables.

A query is searched in its own leaf first. The k-th distance there bounds what else it has to see: it goes down the
levels again, into every slab that this ball reaches, and is searched in the leaves that it arrives at. The queries of a leaf are dealt
over tasks, and its points go to each. A task lays the points in boxes and meets a query with a box only if the ball
reaches it; only the k nearest of a leaf leave the task, so no pairs are shuffled, in however many dimensions.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import partial, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.metric import Box, distance
from tessera.operators.lineage import cut, drop

#: Slabs that a part is cut into at once, at most.
FAN = 16
#: Points of a leaf that is searched, and queries that one task searches in it.
SHARD, QUERIES = 40_000, 10_000
#: Points of a box inside a task, and queries that are met with it at once.
BOXED, TOGETHER = 256, 512
#: Room for rounding where distances bound a search.
WIDER = 1 + 1e-12


def _boxes(x: np.ndarray) -> list[np.ndarray]:
    """The points of a leaf (their numbers) in boxes, halved along their widest sides."""
    found, todo = [], [np.arange(len(x))]
    while todo:
        i = todo.pop()
        if len(i) <= BOXED:
            found.append(i)
            continue
        axis, half = int(np.argmax(np.ptp(x[i], axis=0))), len(i) // 2
        i = i[np.argpartition(x[i, axis], half)]
        todo += [i[half:], i[:half]]
    return found


def _gaps(q: np.ndarray, low: np.ndarray, high: np.ndarray, sides: Sequence[float]) -> np.ndarray:
    """Squared distances from queries to boxes."""
    total = np.zeros((len(q), len(low)))
    for a, side in enumerate(sides):
        gap = reduce(np.minimum, [np.maximum(low[:, a] - x, x - high[:, a]) for x in (q[:, a, None] + s for s in ((-side, 0.0, side) if side else (0.0,)))])
        total += np.square(np.maximum(gap, 0.0))
    return total


def _squares(q: Sequence[np.ndarray], x: Sequence[np.ndarray], sides: Sequence[float]) -> np.ndarray:
    """Squared distances, axis by axis as ``metric.distance`` adds them."""
    total = None
    for a, b, side in zip(q, x, sides, strict=True):
        d = a - b
        if side:
            d = d - side * np.rint(d / side)
        total = d * d if total is None else total + d * d
    return total


def _searched(asked: pd.DataFrame, home: pd.DataFrame, k: int, exclude_self: bool, coords: Sequence[str], sides: Sequence[float]) -> pd.DataFrame:
    """row, col, dist of the k nearest points of a leaf (col, q_ coordinates) for each query (row, coordinates, r), by (dist, col), none beyond r.

    Products of matrices tell, up to their rounding, which points are near enough; the distances of those are then taken exactly.
    """
    home = home.sort_values("col", ignore_index=True)
    x, q = home[[f"q_{c}" for c in coords]].to_numpy(np.float64), asked[list(coords)].to_numpy(np.float64)
    rows, cols, m = asked["row"].to_numpy(), home["col"].to_numpy(), len(asked)
    reach = asked["r"].to_numpy(np.float64, copy=True)
    best, at = np.full((m, k), np.inf), np.full((m, k), len(x))
    if m and len(x):
        boxes = _boxes(x)
        low, high = (np.array([f(x[b], axis=0) for b in boxes]) for f in (np.min, np.max))
        middle, need = (x.min(0) + x.max(0)) / 2, k + exclude_self
        sized = [np.square(x[b] - middle).sum(1) for b in boxes]
        turned = [np.column_stack([-2 * (x[b] - middle), np.ones(len(b)), s]).T for b, s in zip(boxes, sized, strict=True)]
        own = np.concatenate([_gaps(q[i : i + TOGETHER], low, high, sides).argmin(1) for i in range(0, m, TOGETHER)])
        order = np.argsort(own, kind="stable")
        for start in range(0, m, TOGETHER):
            block = order[start : start + TOGETHER]
            gaps = _gaps(q[block], low, high, sides)
            size = np.square(q[block] - middle).sum(1)
            stretched = np.column_stack([q[block] - middle, size, np.ones(len(block))])
            for b in np.argsort(gaps.mean(0), kind="stable"):
                some = np.flatnonzero(gaps[:, b] <= np.square(reach[block]) * WIDER)
                if not some.size:
                    continue
                asking, box = block[some], boxes[b]
                if any(sides):
                    square, slack = _squares(q[asking].T[:, :, None], x[box].T[:, None, :], sides), 0.0
                else:
                    square, slack = stretched[some] @ turned[b], 1e-14 * (len(coords) + 2) * (size[some].max() + sized[b].max())
                bound = np.square(reach[asking]) * WIDER + slack
                near = ~(square > bound[:, None])  # what overflows is near enough, too
                if len(box) > need and np.count_nonzero(near) > 4 * need * len(some):
                    near &= ~(square > (np.partition(square, need - 1, axis=1)[:, need - 1] * WIDER + 2 * slack)[:, None])
                i, j = np.nonzero(near)
                i, j = asking[i], box[j]
                if exclude_self:
                    others = rows[i] != cols[j]
                    i, j = i[others], j[others]
                dist = np.sqrt(_squares(q[i].T, x[j].T, sides))
                kept = dist <= reach[i]
                i, j, dist = i[kept], j[kept], dist[kept]
                if not i.size:
                    continue
                met = np.unique(i)
                i, j, dist = np.concatenate([i, np.repeat(met, k)]), np.concatenate([j, at[met].ravel()]), np.concatenate([dist, best[met].ravel()])
                by = np.lexsort((j, dist, i))
                first = np.searchsorted(i[by], met)[:, None] + np.arange(k)
                best[met], at[met] = dist[by][first], j[by][first]
                reach[met] = np.minimum(reach[met], best[met, -1])
    i, j = np.nonzero(at < len(x))
    return pd.DataFrame({"row": rows[i], "col": cols[at[i, j]], "dist": best[i, j]})


class KdPartition:
    """A cloud (col, coordinates) in leaves of about ``leaf`` points."""

    def __init__(self, cloud: DataFrame, n: int, coords: Sequence[str], box: Box, spread: Sequence[float], leaf: int) -> None:
        self.coords, self.box, self.levels = list(coords), box, []
        order = sorted(range(len(coords)), key=lambda a: -spread[a])
        order = [a for a in order if spread[a] > 0] or order[:1]  # no cut parts points along a flat axis
        rows, leaves = cloud.withColumn("part", F.lit(0).cast("long")), max(1, n // leaf)
        most = min(FAN, max(2, math.ceil(round(leaves ** (1 / len(order)), 9))))
        rows = cut(rows, "cloud") if leaves > 1 else rows
        while leaves > 1:
            axis, fan = order[len(self.levels) % len(order)], min(most, leaves)
            shares = F.array(*[F.lit(i / fan) for i in range(1, fan)])
            at = cut(rows.groupBy("part").agg(F.percentile_approx(self.coords[axis], shares, 10_000).alias("at")), "cuts")
            self.levels.append((axis, fan, at))
            rows = self._down(rows, axis, fan, at)
            leaves = -(-leaves // fan)
        self.points = cut(rows.withColumnsRenamed({c: f"q_{c}" for c in self.coords}), "leaves")
        ends = [f(f"q_{c}").alias(f"{f.__name__}_{c}") for c in self.coords for f in (F.min, F.max)]
        self.leaves = cut(self.points.groupBy("part").agg(F.count(F.lit(1)).alias("size"), *ends), "boxes")

    def _down(self, rows: DataFrame, axis: int, fan: int, at: DataFrame) -> DataFrame:
        """The rows, one level further down."""
        slab = F.size(F.filter("at", lambda s: s < F.col(self.coords[axis])))
        return rows.join(at, "part").withColumn("part", F.col("part") * fan + slab).drop("at")

    def homes(self, queries: DataFrame) -> DataFrame:
        """The queries with the leaf (part) that they fall into."""
        rows = queries.withColumn("part", F.lit(0).cast("long"))
        for level in self.levels:
            rows = self._down(rows, *level)
        return rows

    def _climbed(self, parts: DataFrame, need: int) -> DataFrame:
        """home and the box of the least part around it that holds so many points."""
        ends = [f(f"{f.__name__}_{c}").alias(f"{f.__name__}_{c}") for c in self.coords for f in (F.min, F.max)]
        found, width = [], 1
        left = parts.withColumnRenamed("part", "home")
        for fan in [1, *[f for _, f, _ in reversed(self.levels)]]:
            width *= fan
            up = lambda c: F.floor(F.col(c) / width).cast("long")  # noqa: B023, E731  used before the width changes
            groups = self.leaves.groupBy(up("part").alias("above")).agg(F.sum("size").alias("size"), *ends).filter(F.col("size") >= need).drop("size")
            met = cut(left.withColumn("above", up("home")).join(groups, "above").drop("above"), "above")
            found.append(met)
            left = cut(left.join(met.select("home"), "home", "left_anti"), "left")
            if left.isEmpty():
                break
        return reduce(DataFrame.unionByName, found)

    def _dist(self) -> Column:
        return distance([F.col(c) for c in self.coords], [F.col(f"q_{c}") for c in self.coords], self.box)

    def _reached(self, bounded: DataFrame) -> DataFrame:
        """row, part of the leaves other than its own that a query's ball (r) reaches."""
        ball = bounded.withColumn("part", F.lit(0).cast("long"))
        for i, c in enumerate(self.coords):
            side = self.box.side(i)
            if side:  # the images of the query whose ball reaches into the box
                ball = ball.withColumn("shift", F.explode(F.array(F.lit(-side), F.lit(0.0), F.lit(side)))).withColumn(c, F.col(c) + F.col("shift")).drop("shift")
                ball = ball.filter((F.col(c) + F.col("r") * WIDER >= 0) & (F.col(c) - F.col("r") * WIDER <= side))
        ball = ball.withColumns({f"gap{i}": F.lit(0.0) for i in range(len(self.coords))})
        squares = lambda axes: reduce(Column.__add__, [F.col(f"gap{i}") * F.col(f"gap{i}") for i in axes], F.lit(0.0))
        for axis, fan, at in self.levels:
            x = F.col(self.coords[axis])
            others = [i for i in range(len(self.coords)) if i != axis]
            room = F.sqrt(F.greatest(F.col("r") * F.col("r") * WIDER - squares(others), F.lit(0.0))) * WIDER
            ball = ball.join(at, "part").withColumn("room", room)
            ball = ball.withColumns({"from": x - F.col("room"), "to": x + F.col("room")})
            first, last = F.size(F.filter("at", lambda s: s < F.col("from"))), F.size(F.filter("at", lambda s: s < F.col("to")))
            ball = ball.withColumn("slab", F.explode(F.sequence(first, last)))
            below = F.when(F.col("slab") > 0, F.get("at", F.col("slab") - 1) - x)
            above = F.when(F.col("slab") < F.size("at"), x - F.get("at", F.col("slab")))
            gap = F.greatest(F.lit(0.0), F.coalesce(below, F.lit(0.0)), F.coalesce(above, F.lit(0.0)))
            ball = ball.withColumn(f"gap{axis}", gap).withColumn("part", F.col("part") * fan + F.col("slab")).drop("at", "room", "slab", "from", "to")
        ball = ball.filter("part <> home").join(self.leaves, "part")
        ends = [F.greatest(F.lit(0.0), F.col(f"min_{c}") - F.col(c), F.col(c) - F.col(f"max_{c}")) for c in self.coords]
        near = F.sqrt(reduce(Column.__add__, [e * e for e in ends])) <= F.col("r") * WIDER
        return ball.filter(near).select("row", "part").distinct()

    def _search(self, asked: DataFrame, counted: DataFrame, k: int, exclude_self: bool) -> DataFrame:
        """row, col, dist of the k nearest points in each part that a query is asked for (row, coordinates, r, part); ``counted`` has the same parts."""
        shares = counted.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("shares")).join(self.leaves.select("part", "size"), "part")
        # a leaf that ties have kept from being cut goes in several chunks
        shares = cut(shares.select("part", "shares", F.ceil(F.col("size") / (2 * max(SHARD, k))).cast("int").alias("chunks")), "shares")
        spark = self.points.sparkSession
        tasks = max(2 * (shares.agg(F.sum(F.col("shares") * F.col("chunks"))).first()[0] or 0), int(spark.conf.get("spark.sql.shuffle.partitions")))
        keys, every = ["part", "chunk", "share"], lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        one = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
        probe = asked.join(shares, "part").withColumn("share", one("row", "shares")).withColumn("chunk", every("chunks")).drop("shares", "chunks")
        home = self.points.join(shares, "part").withColumn("chunk", one("col", "chunks")).withColumn("share", every("shares")).drop("shares", "chunks")
        search = partial(_searched, k=k, exclude_self=exclude_self, coords=self.coords, sides=[self.box.side(i) for i in range(len(self.coords))])
        kinds = dict(asked.dtypes)["row"], dict(self.points.dtypes)["col"]
        met = probe.repartition(tasks, *keys).groupBy(*keys).cogroup(home.repartition(tasks, *keys).groupBy(*keys))
        return met.applyInPandas(search, "row {}, col {}, dist double".format(*kinds))

    def nearest(self, queries: DataFrame, k: int, exclude_self: bool) -> DataFrame:
        """row, k, col, dist of the k nearest points of each query (row, coordinates), by (dist, col)."""
        order = Window.partitionBy("row").orderBy("dist", "col")
        top = lambda pairs: pairs.withColumn("k", F.row_number().over(order).cast("int")).filter(F.col("k") <= k).select("row", "k", "col", "dist")
        homes = cut(self.homes(queries), "homes")
        own = cut(self._search(homes.withColumn("r", F.lit(math.inf)), homes, k, exclude_self), "own")
        if not self.levels:
            return top(own)
        known = top(own).filter(F.col("k") == k).select("row", F.col("dist").alias("r"))
        bounded = cut(homes.withColumnRenamed("part", "home").join(known.hint("merge"), "row", "left"), "bounded")
        short = bounded.filter("r is null")
        boxes = self._climbed(short.select(F.col("home").alias("part")).distinct(), k + exclude_self)
        far = [F.greatest(F.abs(F.col(c) - F.col(f"min_{c}")), F.abs(F.col(c) - F.col(f"max_{c}"))) for c in self.coords]
        far = [F.least(f, F.lit(self.box.side(i) / 2)) if self.box.side(i) else f for i, f in enumerate(far)]
        climbed = short.drop("r").join(boxes, "home").withColumn("r", F.sqrt(reduce(Column.__add__, [f * f for f in far])) * WIDER).select(bounded.columns)
        bounded = cut(bounded.filter("r is not null").unionByName(climbed), "bounded", instead=[bounded])
        reached = cut(self._reached(bounded), "reached")
        more = self._search(reached.join(bounded.drop("home").hint("merge"), "row"), reached, k, exclude_self)
        return top(own.unionByName(more))

    def pairs(self, queries: DataFrame, k: int) -> tuple[int, int]:
        """How many pairs of a query and a point there are in the queries' own leaves and in those they reach besides: at most so many are met."""
        homes = cut(self.homes(queries), "homes")
        sizes = self.leaves.select("part", "size")
        first = homes.join(sizes, "part").agg(F.sum("size")).first()[0] or 0
        near = homes.join(self.points, "part").withColumn("dist", self._dist()).withColumn("n", F.row_number().over(Window.partitionBy("row").orderBy("dist", "col"))).filter(F.col("n") <= k)
        r = near.groupBy("row").agg(F.max("dist").alias("r"), F.count(F.lit(1)).alias("n")).filter(F.col("n") == k).drop("n")
        bounded = homes.withColumnRenamed("part", "home").join(r, "row")
        second = self._reached(bounded).join(sizes, "part").agg(F.sum("size")).first()[0] or 0
        drop(homes)
        return first, second
