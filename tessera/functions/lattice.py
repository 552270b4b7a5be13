"""D2Q9 lattice-Boltzmann operators on columns rho, ux, uy and f0..f8, as projections.

Fixed values: directions rest, E, N, W, S, NE, NW, SW, SE with weights 4/9, 1/9 (x4), 1/36 (x4).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.names import fresh

CX = (0, 1, 0, -1, 0, 1, -1, -1, 1)
CY = (0, 0, 1, 0, -1, 1, 1, -1, -1)
WEIGHT = (4 / 9, 1 / 9, 1 / 9, 1 / 9, 1 / 9, 1 / 36, 1 / 36, 1 / 36, 1 / 36)
POPULATIONS = [f"f{a}" for a in range(9)]


def _total(terms: list[Column]) -> Column:
    return reduce(lambda s, t: s + t, terms)


def isotropic(ux: Column, uy: Column) -> Column:
    """The part of the equilibrium that all directions share."""
    return F.lit(1 / 3) - (ux * ux + uy * uy) * 0.5


def equilibrium(rho: Column, ux: Column, uy: Column, shared: Column) -> list[Column]:
    out = []
    for cx, cy, w in zip(CX, CY, WEIGHT, strict=True):
        along = [s * u for s, u in ((cx, ux), (cy, uy)) if s]
        cu = _total(along) if along else None
        out.append(rho * (3 * w) * (shared if cu is None else shared + cu + cu * cu * 1.5))
    return out


def feq(df: DataFrame) -> DataFrame:
    """Adds f0..f8 from rho, ux, uy."""
    shared = fresh(df, "__shared")[0]
    df = df.withColumn(shared, isotropic(F.col("ux"), F.col("uy")))
    f = equilibrium(F.col("rho"), F.col("ux"), F.col("uy"), F.col(shared))
    return df.withColumns(dict(zip(POPULATIONS, f, strict=True))).drop(shared)


def macros(df: DataFrame) -> DataFrame:
    """Adds rho, ux, uy from f0..f8; at zero density the velocity is null."""
    f = [F.col(c) for c in POPULATIONS]
    df = df.withColumn("rho", ((f[5] + f[7]) + (f[6] + f[8])) + ((f[1] + f[3]) + (f[2] + f[4])) + f[0])
    mx = _total([c * f[a] for a, c in enumerate(CX) if c])
    my = _total([c * f[a] for a, c in enumerate(CY) if c])
    return df.withColumns({"ux": F.try_divide(mx, F.col("rho")), "uy": F.try_divide(my, F.col("rho"))})


def bgk(df: DataFrame, omega: float, split: bool = False) -> DataFrame:
    """Relaxes f0..f8 towards equilibrium; adds rho, ux, uy from before, with split also indp, the shared part."""
    df = macros(df).withColumn("indp", isotropic(F.col("ux"), F.col("uy")))
    eq = equilibrium(F.col("rho"), F.col("ux"), F.col("uy"), F.col("indp"))
    df = df.withColumns({c: F.col(c) * (1 - omega) + e * omega for c, e in zip(POPULATIONS, eq, strict=True)})
    return df if split else df.drop("indp")


def strained_equilibrium(df: DataFrame, tau: float, csqr: float = 1 / 3) -> DataFrame:
    """feq with the first-order non-equilibrium part of a strain rate sxx, sxy, syy."""
    df = feq(df)
    new = {}
    for c, cx, cy, w in zip(POPULATIONS, CX, CY, WEIGHT, strict=True):
        q = F.col("sxx") * (cx * cx - csqr) + F.col("sxy") * (2 * cx * cy) + F.col("syy") * (cy * cy - csqr)
        new[c] = F.col(c) - F.col("rho") * q * (w * tau / csqr)
    return df.withColumns(new)
