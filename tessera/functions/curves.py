"""Space-filling-curve keys by repeated bisection of a bounding box, as one Catalyst fold per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The Hilbert curve's digit and next rotation for each quadrant (x bit 1, y bit 2) and rotation.
HILBERT_DIGIT = [[0, 3, 1, 2], [2, 3, 1, 0], [2, 1, 3, 0], [0, 1, 3, 2]]
HILBERT_TURN = [[3, 1, 0, 0], [1, 0, 1, 2], [2, 2, 3, 1], [0, 3, 2, 3]]


def _bisected(x: Column, y: Column, bbox: tuple, ndiv: int, step) -> Column:
    """Fold step(quadrant, state) over ndiv halvings of the box; points on a dividing line belong below it."""
    if not 1 <= ndiv <= 31:
        raise ValueError("ndiv must be from 1 to 31")
    x0, y0, x1, y1 = (c if isinstance(c, Column) else F.lit(float(c)) for c in bbox)
    start = F.struct(F.lit(0).cast("long").alias("key"), F.lit(0).alias("turn"), x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))

    def halve(s: Column, _: Column) -> Column:
        cx, cy = (s["x0"] + s["x1"]) * 0.5, (s["y0"] + s["y1"]) * 0.5
        right, upper = x > cx, y > cy
        digit, turn = step(right.cast("int") + 2 * upper.cast("int"), s["turn"])
        return F.struct(
            (s["key"] * 4 + digit).cast("long").alias("key"), turn.cast("int").alias("turn"),
            F.when(right, cx).otherwise(s["x0"]).alias("x0"), F.when(upper, cy).otherwise(s["y0"]).alias("y0"),
            F.when(right, s["x1"]).otherwise(cx).alias("x1"), F.when(upper, s["y1"]).otherwise(cy).alias("y1"),
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(ndiv)), start, halve)["key"]


def morton_key(x: Column, y: Column, bbox: tuple, ndiv: int = 16) -> Column:
    return _bisected(x, y, bbox, ndiv, lambda quadrant, turn: (quadrant, turn))


def hilbert_key(x: Column, y: Column, bbox: tuple, ndiv: int = 16) -> Column:
    digits = F.array(*[F.lit(v) for row in HILBERT_DIGIT for v in row])
    turns = F.array(*[F.lit(v) for row in HILBERT_TURN for v in row])
    return _bisected(x, y, bbox, ndiv, lambda q, turn: (F.element_at(digits, 1 + q + 4 * turn), F.element_at(turns, 1 + q + 4 * turn)))
