"""Periodic-box metric as column expressions.

A box is a tuple of side lengths anchored at the origin; a side of 0 (or None) is an open axis. All
expressions are plain Catalyst expressions on DOUBLE columns.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Box:
    """Side lengths; 0 leaves an axis open."""

    sides: tuple[float, ...]

    def __post_init__(self) -> None:
        if any(not math.isfinite(s) or s < 0 for s in self.sides):
            raise ValueError("box sides must be finite and not negative")

    def side(self, axis: int) -> float:
        return self.sides[axis] if axis < len(self.sides) else 0.0

    def need_positive(self) -> None:
        if not self.sides or any(s <= 0 for s in self.sides):
            raise ValueError("box sides must be positive")


OPEN = Box(())


def fold(x: Column, side: float) -> Column:
    """x moved by whole periods into [0, side); the last step keeps tiny negative values out of side itself."""
    if side == 0:
        return x
    w = x - side * F.floor(x / side)
    return F.when(w >= side, w - side).when(w < 0, w + side).otherwise(w)


def minimum_image(d: Column, side: float, half: str = "even") -> Column:
    """The shortest periodic image of a difference.

    At half a period "even" rounds to the even image, "away" away from zero, "keep" leaves the difference.
    """
    if side == 0:
        return d
    if half == "even":
        return d - side * F.rint(d / side)
    if half == "away":
        return d - side * F.signum(d) * F.floor(F.abs(d / side) + 0.5)
    if half == "keep":
        return F.when(d > side / 2, d - side).when(d < -side / 2, d + side).otherwise(d)
    raise ValueError(f"half must be even, away or keep, not {half!r}")


def differences(a: Sequence[Column], b: Sequence[Column], box: Box = OPEN) -> list[Column]:
    return [minimum_image(p - q, box.side(i)) for i, (p, q) in enumerate(zip(a, b, strict=True))]


def distance(a: Sequence[Column], b: Sequence[Column], box: Box = OPEN, norm: str = "euclid") -> Column:
    """Euclidean or, with norm "chebyshev", largest-axis distance."""
    d = differences(a, b, box)
    if norm == "chebyshev":
        return F.greatest(*map(F.abs, d)) if len(d) > 1 else F.abs(d[0])
    return F.sqrt(reduce(lambda s, t: s + t, [v * v for v in d]))


def wavenumber(box: Box, modes: Sequence[int]) -> tuple[float, ...]:
    box.need_positive()
    return tuple(2 * math.pi * n / s for n, s in zip(modes, box.sides, strict=True))


def invalid(*coords: Column) -> Column:
    """True where a coordinate is null, NaN or infinite."""
    return reduce(lambda s, t: s | t, [c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")) for c in coords])
