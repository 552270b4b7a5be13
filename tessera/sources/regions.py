"""Poisson-disk clouds of regions: boxes, annuli, polar regions and unions of lobes.

A region's boundary is a small table of pieces (spots, segments, arcs) that is exploded into nodes; the nodes inside are
drawn by rounds of joins (see poisson). Boundary nodes come first. Only polar curves are laid on the driver: a closed
curve's nodes follow from each other, and are of the order of the root of the cloud's.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.neighbours import thinned
from tessera.sources.generators import NODE, Marker, need, numbered
from tessera.sources.poisson import PoissonDisk, Region

PIECE = "piece int, i int, x double, y double, flag int"


def spots(spark: SparkSession, rows: Sequence[tuple[int, float, float, int]]) -> DataFrame:
    """Nodes (piece, x, y, flag) as they are."""
    return spark.createDataFrame([(p, 0, float(x), float(y), int(f)) for p, x, y, f in rows], PIECE)


def segments(spark: SparkSession, rows: Sequence[tuple[int, float, float, float, float, int, int]], first: int = 0) -> DataFrame:
    """Nodes first .. n - 1 of n even steps from one place to another: (piece, xa, ya, xb, yb, n, flag)."""
    table = spark.createDataFrame([(p, *map(float, ends), n, int(f)) for p, *ends, n, f in rows if n > first], "piece int, xa double, ya double, xb double, yb double, n int, flag int")
    dots = table.withColumn("i", F.explode(F.sequence(F.lit(first), F.col("n") - 1)))
    part = lambda a, b: (F.col(a) + (F.col(b) - F.col(a)) * F.col("i") / F.col("n")).alias(a[0])
    return dots.select("piece", "i", part("xa", "xb"), part("ya", "yb"), "flag")


def arcs(spark: SparkSession, rows: Sequence[tuple[int, float, float, float, float, float, int, int, int]]) -> DataFrame:
    """Nodes first .. last of even turns around a centre: (piece, cx, cy, r, start, turn, first, last, flag)."""
    table = spark.createDataFrame([(p, *map(float, at), a, b, int(f)) for p, *at, a, b, f in rows if b >= a], "piece int, cx double, cy double, r double, start double, turn double, a int, b int, flag int")
    dots = table.withColumn("i", F.explode(F.sequence("a", "b")))
    phi = F.col("start") + F.col("i") * F.col("turn")
    return dots.select("piece", "i", (F.col("cx") + F.col("r") * F.cos(phi)).alias("x"), (F.col("cy") + F.col("r") * F.sin(phi)).alias("y"), "flag")


def chords(r: float, distance: float, span: float = 2 * math.pi) -> int:
    """How many chords of at least the distance fit on an arc."""
    return math.floor(span / (2 * math.asin(min(1.0, distance / (2 * r)))) + 1e-12)


def circle(spark: SparkSession, piece: int, cx: float, cy: float, r: float, distance: float, flag: int) -> DataFrame:
    n = chords(r, distance)
    return arcs(spark, [(piece, cx, cy, r, 0.0, 2 * math.pi / n, 0, n - 1, flag)])


def sampled(spark: SparkSession, rim: DataFrame, distance: float, low: tuple[float, float], high: tuple[float, float], region: Region | None, seed: int | None, periodic: tuple[bool, bool] = (False, False), tight: float = 1.0) -> DataFrame:
    """The boundary nodes and, between two corners, as many inside the region as there is room for."""
    sampler = PoissonDisk(spark, distance, (high[0] - low[0], high[1] - low[1]), periodic, seed, low, region)
    sampler.add_points(rim.select("x", "y"), tight)
    inner = sampler.random().select(F.lit(1 << 30).alias("piece"), F.lit(0).alias("i"), "x", "y", F.lit(0).alias("flag"))
    return numbered(rim.union(inner), "piece", "i", "x", "y").select(*NODE)


def poisson_box(spark: SparkSession, extent: tuple[float, float], distance: float, boundary: str = "periodic", hole: float | None = None, seed: int | None = None, low: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """A Poisson-disk box, periodic, a channel or with walls, around an optional circular hole.

    Nodes of walls stand evenly at least the distance apart, corners included; then come the hole's, then the inside.
    """
    need(boundary in ("periodic", "channel", "walls"), "the boundary is periodic, channel or walls")
    need(min(extent) >= 2 * distance, "the box has to be two distances wide")
    (x0, y0), (lx, ly) = low, extent
    x1, y1 = x0 + lx, y0 + ly
    nx, ny = (max(1, math.floor(s / distance + 1e-12)) for s in extent)
    level = [(1, x0, y0, x1, y0, nx, Marker.SOUTH), (2, x0, y1, x1, y1, nx, Marker.NORTH)]
    upright = [(3, x0, y0, x0, y1, ny, Marker.WEST), (4, x1, y0, x1, y1, ny, Marker.EAST)]
    if boundary == "walls":  # the ends of a wall are corners
        rim = spots(spark, [(0, x, y, Marker.CORNER) for y in (y0, y1) for x in (x0, x1)]).union(segments(spark, level + upright, first=1))
    elif boundary == "channel":  # both ends of a wall are one place of the period
        rim = segments(spark, level)
    else:
        rim = spots(spark, [])
    periodic = (boundary != "walls", boundary == "periodic")
    region = None
    if hole is not None:
        need(hole >= distance, "the hole's radius has to be the distance or more")
        free = [side - 2 * hole - (distance if wraps else 2 * distance) for side, wraps in zip(extent, periodic, strict=True)]
        need(min(free) >= 0, "the hole comes nearer than the distance to a wall or to its own image")
        cx, cy = x0 + lx / 2, y0 + ly / 2
        rim = rim.union(circle(spark, 5, cx, cy, hole, distance, Marker.HOLE))
        region = Region(lambda x, y: F.hypot(x - cx, y - cy) >= hole, lambda x, y, reach: F.hypot(x - cx, y - cy) < hole - reach)
    return sampled(spark, rim, distance, (x0, y0), (x1, y1), region, seed, periodic)


def hole_radius(fraction: float, extent: tuple[float, float]) -> float:
    """The radius of a hole that takes a fraction of the box."""
    return math.sqrt(fraction * extent[0] * extent[1] / math.pi)


def eccentric_annulus(spark: SparkSession, outer: float, inner: float, offset: float, distance: float, seed: int | None = None, centre: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """Between a circle and one moved along x inside it, Poisson-disk sampled."""
    need(min(outer, inner, distance) > 0 and inner >= distance, "radii and distance must be positive, and the inner circle no smaller than the distance")
    need(outer - inner - abs(offset) >= distance, "the circles are nearer than the distance")
    cx, cy = centre
    rim = circle(spark, 0, cx, cy, outer, distance, Marker.CIRCLE).union(circle(spark, 1, cx + offset, cy, inner, distance, Marker.HOLE))
    wide, narrow = lambda x, y: F.hypot(x - cx, y - cy), lambda x, y: F.hypot(x - cx - offset, y - cy)
    region = Region(lambda x, y: (wide(x, y) < outer) & (narrow(x, y) > inner), lambda x, y, reach: (wide(x, y) > outer + reach) | (narrow(x, y) < inner - reach))
    # a node's place on the circle may round to beyond it
    edge = outer + distance
    return sampled(spark, rim, distance, (cx - edge, cy - edge), (cx + edge, cy + edge), region, seed)


Series = Sequence[tuple[int, float, float]]


def polar_series(cos: Sequence[float] = (), sin: Sequence[float] = ()) -> Series:
    """The terms (n, a, b) of r(t) = sum of a cos(n t) + b sin(n t): cosines from n = 0 on, sines from n = 1 on."""
    n = max(len(cos), len(sin) + 1)
    return [(k, cos[k] if k < len(cos) else 0.0, sin[k - 1] if 0 < k <= len(sin) else 0.0) for k in range(n)]


#: The curves of a published elliptic test on a region of about unit size (Bayona and others, 2017).
BAYONA_OUTER = polar_series((1.0, 0.2), (0.0, 0.0, 0.0, 0.15))
BAYONA_INNER = polar_series((0.3,), (0.1, 0.0, 0.0, 0.0, 0.15))


def polar(terms: Series, t: float) -> float:
    return sum(a * math.cos(n * t) + b * math.sin(n * t) for n, a, b in terms)


def _polar_column(terms: Series, t: Column) -> Column:
    total = F.lit(0.0)
    for n, a, b in terms:
        total = total + F.lit(a) * F.cos(t * n) + F.lit(b) * F.sin(t * n)
    return total


def _marched(terms: Series, chord: float, most: int) -> list[float]:
    """The angles of a march along the curve by equal chords, from angle 0 until it has gone around (or ``most`` nodes)."""

    def place(t: float) -> tuple[float, float]:
        r = polar(terms, t)
        return r * math.cos(t), r * math.sin(t)

    def speed(t: float) -> float:
        return math.hypot(polar(terms, t), sum(n * (b * math.cos(n * t) - a * math.sin(n * t)) for n, a, b in terms))

    angles, t = [], 0.0
    while t < 2 * math.pi and len(angles) < most:
        angles.append(t)
        here, behind = place(t), t
        ahead = t + chord / (8 * speed(t))
        while math.dist(place(ahead), here) < chord:  # short steps until the chord is passed, then halvings
            behind, ahead = ahead, ahead + chord / (8 * speed(ahead))
        for _ in range(60):
            middle = (behind + ahead) / 2
            if not behind < middle < ahead:
                break
            if math.dist(place(middle), here) < chord:
                behind = middle
            else:
                ahead = middle
        t = ahead
    return [*angles, t]


def laid_evenly(terms: Series, distance: float) -> list[tuple[float, float]]:
    """Nodes of a closed polar curve, chord by chord: all chords are equal and no shorter than the distance, the last as near to that as it comes."""
    angles = _marched(terms, distance, 1 << 24)
    n = len(angles) - 2  # the march goes once around and its last node beyond the start: a chord less closes with longer ones
    need(n >= 2, "the curve is too short for three nodes")
    n += angles[-1] <= 2 * math.pi
    best, low, high = angles[:n], distance, 2 * distance
    for _ in range(30):  # longer chords until n of them go just around
        chord = (low + high) / 2
        tried = _marched(terms, chord, n)
        if len(tried) == n + 1 and tried[-1] <= 2 * math.pi:
            best, low = tried[:n], chord
        else:
            high = chord
    return [(polar(terms, t) * math.cos(t), polar(terms, t) * math.sin(t)) for t in best]


def polar_region(spark: SparkSession, outer: Series = BAYONA_OUTER, distance: float = 0.05, inner: Series | None = None, seed: int | None = None, centre: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """Between polar curves around a centre, their nodes in even chords; where a curve bends back on itself the later of two near nodes goes."""
    need(distance > 0, "the distance must be positive")
    curves = [outer] + ([inner] if inner else [])
    turns = [2 * math.pi * i / 4000 for i in range(4000)]
    need(all(polar(c, t) > 0 for c in curves for t in turns), "a polar curve must not reach its centre")
    need(not inner or min(polar(outer, t) - polar(inner, t) for t in turns) >= distance, "along some ray the curves are nearer than the distance")
    cx, cy = centre
    laid = [(k, i, cx + x, cy + y, f) for k, (c, f) in enumerate(zip(curves, (int(Marker.CIRCLE), int(Marker.HOLE)), strict=False)) for i, (x, y) in enumerate(laid_evenly(c, distance))]
    # as a frame of ids in the order of the curves, thinning keeps the earlier of two near nodes
    stays = thinned(spark.createDataFrame([(n, *row) for n, row in enumerate(laid)], f"id long, {PIECE}"), distance * (1 - 1e-9))
    wide = max(polar(outer, t) for t in turns) + 2 * distance
    slope = [sum(n * math.hypot(a, b) for n, a, b in c) for c in curves]

    def parts(x: Column, y: Column) -> tuple[Column, Column]:
        return F.hypot(x - cx, y - cy), F.atan2(y - cy, x - cx)

    def inside(x: Column, y: Column) -> Column:
        r, t = parts(x, y)
        return (r < _polar_column(outer, t)) & ((r > _polar_column(inner, t)) if inner else F.lit(True))

    def beyond(x: Column, y: Column, reach: float) -> Column:
        # within the reach of a place at radius r the angle differs by no more than asin(reach / r)
        r, t = parts(x, y)
        swing = F.asin(F.least(F.lit(1.0), F.lit(reach) / F.greatest(r, F.lit(1e-300))))
        far = (r > reach) & (r - reach > _polar_column(outer, t) + swing * slope[0])
        return far | ((r > reach) & (r + reach < _polar_column(inner, t) - swing * slope[1])) if inner else far

    return sampled(spark, stays.drop("id"), distance, (cx - wide, cy - wide), (cx + wide, cy + wide), Region(inside, beyond), seed)


def multilobe(spark: SparkSession, radius: float, spacing: float = 1.0, lobes: int = 3, offset: float | None = None, fillet: float = 0.0, seed: int | None = None, centre: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """The union of circular lobes around a centre, the first pointing up, its notches sharp or rounded by a fillet; Poisson-disk sampled.

    In the frame of a lobe (centre at the offset on the x axis) the next notch lies at the angle ``half``. A fillet is an arc
    that touches both circles of a notch from outside; a sharp notch is one of radius 0. The line from a lobe's centre to that
    of the fillet goes through their common point, so its angle ``open`` tells how far the lobe's own arc goes.
    """
    offset = radius if offset is None else offset
    need(min(radius, spacing, offset) > 0 and fillet >= 0, "radius, spacing and offset have to be positive, and a fillet no less than zero")
    need(lobes >= 2, "two lobes at least make a union")
    half = math.pi / lobes
    rise = offset * math.sin(half)
    need(rise < radius, "neighbouring lobes have to overlap")
    notch = offset * math.cos(half) + math.sqrt((radius + fillet) ** 2 - rise**2)  # how far out the fillet's centre lies
    sharp = offset * math.cos(half) + math.sqrt(radius**2 - rise**2)
    need(lobes == 2 or math.dist((sharp * math.cos(3 * half), sharp * math.sin(3 * half)), (offset, 0.0)) >= radius, "a notch lies inside a third lobe")
    opened = math.atan2(notch * math.sin(half), notch * math.cos(half) - offset)
    n = chords(radius, spacing, 2 * opened)
    need(n >= 1, "between its fillets a lobe has no room for a chord")
    up, (cx, cy) = math.pi / 2, centre
    lobe_at = [(cx + offset * math.cos(t), cy + offset * math.sin(t), t) for t in (up + 2 * half * k for k in range(lobes))]
    notch_at = [(cx + notch * math.cos(t), cy + notch * math.sin(t), t) for t in (up + half + 2 * half * k for k in range(lobes))]
    rim = arcs(spark, [(lobes + k, x, y, radius, t - opened, 2 * opened / n, 1, n - 1, Marker.CIRCLE) for k, (x, y, t) in enumerate(lobe_at)])
    lean = math.atan2(rise, notch - offset * math.cos(half))  # from a fillet's centre, the lobes' lie so far off the line to the middle
    if fillet:
        m = max(1, chords(fillet, spacing, 2 * lean))
        rim = rim.union(arcs(spark, [(k, x, y, fillet, t + math.pi - lean, 2 * lean / m, 0, m, Marker.CIRCLE) for k, (x, y, t) in enumerate(notch_at)]))
    else:
        rim = rim.union(spots(spark, [(k, x, y, Marker.CORNER) for k, (x, y, _) in enumerate(notch_at)]))
    touch = (notch - fillet * math.cos(lean), fillet * math.sin(lean))  # where arcs meet, along the line to the notch and off it
    # a disk around what a fillet adds
    filled = max(touch[1], abs(touch[0] - sharp), abs(notch - fillet - touch[0]))

    def in_lobe(x: Column, y: Column, more: float = 0.0) -> Column:
        found = F.lit(False)
        for px, py, _ in lobe_at:
            found = found | (F.hypot(x - px, y - py) < radius + more)
        return found

    def in_notch(x: Column, y: Column) -> Column:
        found = F.lit(False)
        for px, py, t in notch_at:  # seen from the fillet's centre: between the lines to both lobes, beyond the arc, not beyond the notch
            ahead = (px - x) * math.cos(t) + (py - y) * math.sin(t)
            aside = F.abs((px - x) * math.sin(t) - (py - y) * math.cos(t))
            found = found | ((ahead >= 0) & (ahead <= notch - sharp + 1e-12) & (aside * math.cos(lean) <= ahead * math.sin(lean)) & (F.hypot(ahead, aside) >= fillet))
        return found

    def near_notch(x: Column, y: Column, reach: float) -> Column:
        found = F.lit(False)
        for px, py, t in notch_at:  # within the disk, on the near side of the line between the touching points, and not deep in the fillet's circle
            along = (x - cx) * math.cos(t) + (y - cy) * math.sin(t)
            close = F.hypot(x - cx - touch[0] * math.cos(t), y - cy - touch[0] * math.sin(t)) <= filled + reach
            found = found | (close & (along <= touch[0] + reach) & (F.hypot(x - px, y - py) >= fillet - reach))
        return found

    inside = (lambda x, y: in_lobe(x, y) | in_notch(x, y)) if fillet else in_lobe
    beyond = lambda x, y, reach: ~in_lobe(x, y, reach) & (~near_notch(x, y, reach) if fillet else F.lit(True))
    edge = offset + radius + spacing
    return sampled(spark, rim, spacing, (cx - edge, cy - edge), (cx + edge, cy + edge), Region(inside, beyond), seed, tight=0.95)
