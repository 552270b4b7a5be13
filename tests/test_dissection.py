"""Dissection of graphs: bounds of parts, separators, and fill against the dissection by coordinates."""

import numpy as np
import pandas as pd
import pytest

from tessera.operators import dissection, factor, ordering


def fill(pairs, order, n):
    """Entries of the factor, by elimination in a matrix."""
    new = {r.old_id: r.new_id for r in order.collect()}
    full = np.eye(n, dtype=bool)
    for a, b in pairs:
        full[new[a], new[b]] = full[new[b], new[a]] = True
    for k in range(n):
        below = np.flatnonzero(full[k + 1 :, k]) + k + 1
        full[np.ix_(below, below)] = True
    return int(np.tril(full).sum())


def check(spark, pairs, leaf):
    edges = spark.createDataFrame(pairs, "row long, col long")
    tree = dissection.dissected(edges, leaf).cache()
    rows = {r.old_id: r for r in tree.collect()}
    assert sorted(r.new_id for r in rows.values()) == list(range(len(rows))) and tree.count() == len(rows)
    assert set(rows) == {v for p in pairs for v in p if v is not None}
    sizes = {}
    for r in rows.values():
        if not r.separator:
            sizes[r.part] = sizes.get(r.part, 0) + 1
    assert max(sizes.values()) <= leaf
    for a, b in pairs:
        if a is None or b is None or rows[a].part == rows[b].part:
            continue
        high, low = sorted((rows[a], rows[b]), key=lambda r: -r.new_id)
        assert high.separator and low.part.startswith(high.part[:-1])
    return rows


def test_graph_dissection_of_an_irregular_graph(spark, monkeypatch):
    """A node that a third of the others hang on, a long path, a clique, small components, loops, repeats and nulls."""
    monkeypatch.setattr(dissection, "MOST", 16)
    monkeypatch.setattr(dissection, "CROWD", 4)
    star = [(0, i) for i in range(1, 60)]
    path = [(i, i + 1) for i in range(100, 150)]
    clique = [(i, j) for i in range(200, 212) for j in range(200, i)]
    small = [(300 + 2 * i, 301 + 2 * i) for i in range(10)]
    odd = [(400, 400), (0, 1), (1, 0), (401, None), (-5, 100)]
    rows = check(spark, star + path + clique + small + odd, 8)
    assert rows[0].separator  # the star falls apart without it


def test_graph_dissection_fills_no_more_than_coordinates(spark):
    n = 20
    pairs = [(i * n + j, (i + a) * n + j + b) for i in range(n) for j in range(n) for a, b in ((0, 1), (1, 0), (1, 1)) if i + a < n and j + b < n]
    edges = spark.createDataFrame(pairs, "row long, col long")
    points = spark.createDataFrame([(i * n + j, float(i), float(j)) for i in range(n) for j in range(n)], "id long, x double, y double")
    by_graph = fill(pairs, ordering.check_permutation(dissection.graph_dissection(edges)), n * n)
    assert by_graph <= 1.03 * fill(pairs, factor.nested_dissection(points, edges), n * n) < fill(pairs, ordering.identity(points), n * n)


@pytest.mark.parametrize("turn", [0.0, 0.3, 0.8, 2.0])
def test_a_square_is_cut_across_its_side(monkeypatch, turn):
    """Two eigenvectors of a square have the same eigenvalue: whichever LAPACK returns, six edges cross, and the sides are the same."""
    n, eigh = 6, np.linalg.eigh

    def turned(a):
        values, v = eigh(a)
        x, y = v[:, 1].copy(), v[:, 2].copy()
        if values[2] - values[1] < 1e-9:
            v[:, 1], v[:, 2] = np.cos(turn) * x + np.sin(turn) * y, np.cos(turn) * y - np.sin(turn) * x
        return values, v

    near = [[(i + a) * n + j + b for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0)) if 0 <= i + a < n and 0 <= j + b < n] for i in range(n) for j in range(n)]
    part = pd.DataFrame({"id": range(n * n), "path": "", "weight": 1, "edges": [[{"w": w, "weight": 1} for w in ws] for ws in near]})
    plain = dissection._halves(part, 20)
    monkeypatch.setattr(np.linalg, "eigh", turned)
    halves = dissection._halves(part, 20)
    path = halves["path"].tolist()
    assert halves.equals(plain) and path.count("0") == 18
    assert sum(path[v] != path[w] for v, ws in enumerate(near) for w in ws) == 2 * n


def test_pieces_that_do_not_hang_together():
    """Three paths and a lone node: no edge needs to cross."""
    part = pd.DataFrame({"id": range(13), "path": "", "weight": 1, "edges": [[{"w": w, "weight": 1} for w in (v - 1, v + 1) if w // 4 == v // 4 and 0 <= w < 12] if v < 12 else None for v in range(13)]})
    sizes = dissection._halves(part, 8).groupby("path").size()
    assert sizes.sum() == 13 and sizes.max() <= 8


@pytest.mark.parametrize("pairs", [[], [(3, 3)], [(1, 2), (2, 1)]])
def test_graph_dissection_of_tiny_graphs(spark, pairs):
    order = dissection.graph_dissection(spark.createDataFrame(pairs, "row long, col long"))
    assert sorted(r.old_id for r in order.collect()) == sorted({v for p in pairs for v in p})
