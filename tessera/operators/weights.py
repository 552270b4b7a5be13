"""Radial-basis-function interpolation weights of stencils, and sparse operators.

Each stencil's dense system is solved in batches with LAPACK behind mapInArrow: stencils are gathered into
array columns by one join and one aggregation, so a batch of rows is a batch of systems.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.metric import OPEN, Box, minimum_image


#: Bytes of the matrices that a task solves at once; elimination takes a few times as much.
MATRICES = 4 << 20


def at_once(size: int) -> int:
    """How many systems of a size are solved at once."""
    return max(1, MATRICES // (8 * size * size))


def solve_each(m: np.ndarray, rhs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Solutions of a stack of systems by elimination with partial pivoting, all systems a column at a time; and info.

    info is 0, or the place (from 1) of the first pivot that is zero: such a system is singular and its solution zero.
    """
    m, w = m.copy(), rhs.copy()
    b, size = m.shape[:2]
    info, each = np.zeros(b, np.int32), np.arange(b)
    for j in range(size):
        at = j + np.abs(m[:, j:, j]).argmax(axis=1)
        for x in (m, w):
            x[each, at], x[:, j] = x[:, j].copy(), x[each, at]
        pivot = m[:, j, j]
        info[(pivot == 0) & (info == 0)] = j + 1
        share = m[:, j + 1 :, j] / np.where(pivot == 0, 1.0, pivot)[:, None]
        m[:, j + 1 :, j:] -= share[:, :, None] * m[:, None, j, j:]
        w[:, j + 1 :] -= share[:, :, None] * w[:, None, j]
    m[info != 0], w[info != 0] = np.eye(size), 0.0
    for j in range(size - 1, -1, -1):
        w[:, j] = (w[:, j] - (m[:, j, None, j + 1 :] @ w[:, j + 1 :])[:, 0]) / m[:, j, j, None]
    return w, info


@dataclass(frozen=True)
class Interpolation:
    """Stencil size n, polynomial degree p, odd power q of the polyharmonic spline r**q."""

    n: int
    p: int = 2
    q: int = 3

    def __post_init__(self) -> None:
        if self.q < 3 or self.q % 2 == 0:
            raise ValueError("the spline's power must be odd and at least 3")
        if self.p < -1 or self.n < self.terms:
            raise ValueError("a stencil needs as many nodes as polynomial terms")

    @property
    def terms(self) -> int:
        return (self.p + 1) * (self.p + 2) // 2

    def polynomials(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """1, x, y, x^2, xy, y^2, ... on a last axis."""
        return np.stack([x ** (d - j) * y**j for d in range(self.p + 1) for j in range(d + 1)], axis=-1) if self.p >= 0 else np.zeros((*x.shape, 0))

    def spline(self, dx: np.ndarray, dy: np.ndarray) -> np.ndarray:
        return (dx * dx + dy * dy) ** (self.q / 2)

    def weights(self, x: np.ndarray, y: np.ndarray, xc: np.ndarray, yc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weights (stencil, centre, node) at the centres, in frames local to the stencils, and info for each stencil.

        info is 0, or the place of the pivot at which a singular stencil fails; its weights are zero.
        """
        b, n = x.shape
        size = n + self.terms
        m = np.zeros((b, size, size))
        m[:, :n, :n] = self.spline(x[:, :, None] - x[:, None, :], y[:, :, None] - y[:, None, :])
        m[:, :n, n:] = poly = self.polynomials(x, y)
        m[:, n:, :n] = poly.transpose(0, 2, 1)
        rhs = np.zeros((b, size, len(xc)))
        rhs[:, :n] = self.spline(x[:, :, None] - xc, y[:, :, None] - yc)
        rhs[:, n:] = self.polynomials(xc, yc).T
        try:
            w, info = np.linalg.solve(m, rhs), np.zeros(b, np.int32)
        except np.linalg.LinAlgError:  # some system of the batch is singular, and LAPACK does not tell which
            w, info = solve_each(m, rhs)
        return w[:, :n].transpose(0, 2, 1), info


def gathered(nodes: DataFrame, edges: DataFrame, box: Box = OPEN, local: bool = True) -> DataFrame:
    """row, cols, dx, dy: each stencil in order of k, as differences to its own node (through the periodic images in a box).

    Without ``local`` dx and dy are the nodes' own coordinates.
    """
    here = nodes.select(F.col("id").alias("row"), F.col("x").alias("x0"), F.col("y").alias("y0"))
    there = nodes.select(F.col("id").alias("col"), "x", "y")
    joined = edges.select("row", "k", "col").join(there, "col")
    if not local:
        joined = joined.withColumns({"x0": F.lit(0.0), "y0": F.lit(0.0)})
    else:
        joined = joined.join(here, "row")
    dx, dy = minimum_image(F.col("x") - F.col("x0"), box.side(0)), minimum_image(F.col("y") - F.col("y0"), box.side(1))
    stencils = joined.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("k", "col", dx.alias("dx"), dy.alias("dy")))).alias("s"))
    return stencils.select("row", F.col("s.col").alias("cols"), F.col("s.dx").alias("dx"), F.col("s.dy").alias("dy"))


def interpolation_weights(nodes: DataFrame, edges: DataFrame, config: Interpolation, centres: Sequence[tuple[float, float]], box: Box = OPEN, local: bool = True, ragged: bool = False) -> DataFrame:
    """row, k, col, op, weight, info: weights of every stencil for the value at its node displaced by each centre.

    Without ``local`` the systems are set up in the nodes' own coordinates, and the centres are places in them.
    ``ragged`` allows stencils of any size from the number of polynomial terms on.
    """
    if not local and any(box.side(i) for i in range(2)):
        raise ValueError("a periodic box needs local frames")
    xc, yc = np.array([c[0] for c in centres], float), np.array([c[1] for c in centres], float)
    schema = "row long, k int, col long, op int, weight double, info int"

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.array([len(v) for v in batch.column(1)])
            for n in np.unique(size):  # ragged graphs: systems of one size at a time
                part = batch.take(pa.array(np.nonzero(size == n)[0]))
                if n != config.n and not (ragged and n >= config.terms):
                    raise ValueError(f"a stencil has {n} nodes, not {config.n}{' or at least ' + str(config.terms) if ragged else ''}")
                step = at_once(n + config.terms)
                for a in range(0, part.num_rows, step):
                    some = part.slice(a, step)
                    cols, x, y = (some.column(i).flatten().to_numpy().reshape(-1, n) for i in (1, 2, 3))
                    w, info = config.weights(x, y, xc, yc)
                    b, ops = len(x), len(xc)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.repeat(some.column(0).to_numpy(), ops * n)),
                            pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), b * ops)),
                            pa.array(np.repeat(cols[:, None, :], ops, axis=1).ravel()),
                            pa.array(np.tile(np.repeat(np.arange(ops, dtype=np.int32), n), b)),
                            pa.array(w.ravel()),
                            pa.array(np.repeat(info, ops * n)),
                        ],
                        ["row", "k", "col", "op", "weight", "info"],
                    )

    return gathered(nodes, edges, box, local).mapInArrow(solve, schema)


def summed(weights: DataFrame, ops: Sequence[int]) -> DataFrame:
    """row, k, col, weight: operators added up entry by entry, as a Laplacian from its two second derivatives."""
    return weights.filter(F.col("op").isin(*ops)).groupBy("row", "k", "col").agg(F.sum("weight").alias("weight"))


def singular(weights: DataFrame) -> DataFrame:
    """How many stencils could not be solved."""
    return weights.agg(F.count_distinct(F.when(F.col("info") != 0, F.col("row"))).alias("singular"))


def apply(weights: DataFrame, field: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """row, value = sum of weight * field[col]; with nodes, boundary nodes (flag not 0) keep the field's value."""
    product = weights.join(field.select(F.col("id").alias("col"), F.col("value").alias("u")), "col").groupBy("row").agg(F.sum(F.col("weight") * F.col("u")).alias("value"))
    if nodes is None:
        return product
    own = field.select(F.col("id").alias("row"), F.col("value").alias("u")).join(nodes.select(F.col("id").alias("row"), "flag"), "row")
    return product.join(own, "row").select("row", F.when(F.col("flag") != 0, F.col("u")).otherwise(F.col("value")).alias("value"))


def triplets(weights: DataFrame) -> DataFrame:
    return weights.select("row", "col", F.col("weight").alias("value"))
