"""Nearest neighbours in three and more dimensions, against all distances."""

import numpy as np
import pandas as pd
import pytest

from tessera.functions.metric import Box
from tessera.operators import kdtree, neighbours


def frame(spark, x, first=0):
    names = [f"x{i}" for i in range(x.shape[1])]
    rows = [(first + i, *map(float, p)) for i, p in enumerate(x)]
    return spark.createDataFrame(rows, "id long, " + ", ".join(f"{n} double" for n in names)), names


def brute(q, x, k, sides, skip_self):
    out = {}
    for i, p in enumerate(q):
        d = x - p
        for a, s in enumerate(sides):
            if s:
                d[:, a] -= s * np.rint(d[:, a] / s)
        dist = np.sqrt((d * d).sum(axis=1))
        out[i] = [j for j in sorted(range(len(x)), key=lambda j: (round(dist[j], 12), j)) if not (skip_self and j == i)][:k]
    return out


def clouds():
    r = np.random.default_rng(1)
    spread = r.random((300, 3))
    clustered = np.concatenate([0.5 + 1e-4 * r.standard_normal((250, 3)), r.random((50, 3))])
    repeated = np.round(r.random((200, 4)) * 3)  # many ties and points at one place
    return {"spread": (spread, (0, 0, 0)), "clustered": (clustered, (0, 0, 0)), "periodic": (spread, (1.0, 0, 1.0)), "repeated": (repeated, (0, 0, 0, 0)), "flat": (np.c_[spread, np.zeros(300)], (0, 0, 0, 0)), "eight": (r.random((150, 8)), (0,) * 8), "few": (r.random((7, 3)), (0, 0, 0))}


@pytest.mark.parametrize("name", list(clouds()))
def test_neighbours_are_all_distances_nearest(spark, name):
    x, sides = clouds()[name]
    points, names = frame(spark, x)
    box, k = Box(tuple(map(float, sides))), min(6, len(x) - 1)
    for skip in (False, True):
        got = {}
        for r in neighbours.knn_join(points, points, k, names, box, exclude_self=skip, block=8).collect():
            got.setdefault(r.row, []).append((r.k, r.col))
        want = brute(x, x.copy(), k, sides, skip)
        assert {i: [j for _, j in sorted(v)] for i, v in got.items()} == want


@pytest.mark.parametrize("name", list(clouds()))
def test_neighbours_from_many_leaves(spark, monkeypatch, name):
    """Small leaves, shares and boxes; ties keep leaves of the repeated points from being cut, so they go in chunks."""
    for size, value in (("SHARD", 12), ("QUERIES", 7), ("BOXED", 4), ("TOGETHER", 5)):
        monkeypatch.setattr(kdtree, size, value)
    x, sides = clouds()[name]
    points, names = frame(spark, x)
    box, k = Box(tuple(map(float, sides))), min(6, len(x) - 1)
    got = {}
    for r in neighbours.knn_join(points, points, k, names, box, exclude_self=True).collect():
        got.setdefault(r.row, []).append((r.k, r.col))
    assert {i: [j for _, j in sorted(v)] for i, v in got.items()} == brute(x, x.copy(), k, sides, True)


def test_search_inside_a_leaf(monkeypatch):
    """Places far from zero, ids that are strings, distances beyond what a double holds, and a bound that a tie lies on."""
    monkeypatch.setattr(kdtree, "BOXED", 4)
    x = np.array([[1e6 + i % 3, 1e6, -1e6 + i // 3] for i in range(12)])
    home = pd.DataFrame(x, columns=["q_a", "q_b", "q_c"]).assign(col=[f"p{i:02d}" for i in range(12)])
    ask = pd.DataFrame(x[:1], columns=["a", "b", "c"]).assign(row="p00", r=1.0)
    found = kdtree._searched(ask, home[::-1], 3, True, ["a", "b", "c"], [0.0] * 3)
    assert found[["col", "dist"]].values.tolist() == [["p01", 1.0], ["p03", 1.0]]
    with np.errstate(all="ignore"):
        far = kdtree._searched(ask.assign(a=1e200, r=np.inf), home, 3, False, ["a", "b", "c"], [0.0] * 3)
    assert far["col"].tolist() == ["p00", "p01", "p02"]


def test_cuts_are_spread_over_all_axes(spark):
    """Eight axes and a flat one: slabs of two or three on each of the eight, where slabs of sixteen would leave six of them whole."""
    n = 8_000
    cloud = spark.range(n).selectExpr("id as col", *[f"(abs(xxhash64(id, {a}L)) % 1000003) / 1000003.0D as x{a}" for a in range(8)], "0.0D as x8")
    part = kdtree.KdPartition(cloud, n, [f"x{a}" for a in range(9)], Box(()), [1.0] * 8 + [0.0], 40)
    assert {axis for axis, _, _ in part.levels} == set(range(8)) and part.leaves.agg({"size": "max"}).first()[0] <= 80


def test_a_search_sends_no_pairs(spark, monkeypatch):
    """What leaves the tasks of a search are the nearest of each query, also where a ball of eight dimensions reaches everything."""
    monkeypatch.setattr(kdtree, "SHARD", 250)
    n, k = 1_000, 5
    cloud = spark.range(n).selectExpr("id as col", *[f"(abs(xxhash64(id, {a}L)) % 1000003) / 1000003.0D as x{a}" for a in range(8)])
    part = kdtree.KdPartition(cloud, n, [f"x{a}" for a in range(8)], Box(()), [1.0] * 8, 250)
    asked = cloud.withColumnRenamed("col", "row").crossJoin(part.leaves.select("part")).selectExpr("*", "double('inf') as r")
    assert part._search(asked, asked, k, False).count() == n * k * part.leaves.count()


def test_queries_of_another_table_and_far_away(spark):
    r = np.random.default_rng(2)
    x, q = r.random((400, 3)), np.concatenate([r.random((40, 3)), 50 + r.random((3, 3)), [[-9, 0.5, 0.5]]])
    points, names = frame(spark, x)
    queries, _ = frame(spark, q)
    got = {}
    for row in neighbours.knn_join(queries, points, 5, names, block=8).collect():
        got.setdefault(row.row, []).append((row.k, row.col))
    assert {i: [j for _, j in sorted(v)] for i, v in got.items()} == brute(q, x, 5, (0, 0, 0), False)
    with pytest.raises(ValueError):
        neighbours.knn_join(queries, points, 401, names)


def test_pairs_for_each_query_do_not_grow_with_the_cloud(spark):
    pairs = {}
    for n in (4_000, 32_000):
        cloud = spark.range(n).selectExpr("id as col", *[f"(abs(xxhash64(id, {a}L)) % 1000003) / 1000003.0D as x{a}" for a in range(3)])
        part = kdtree.KdPartition(cloud, n, ["x0", "x1", "x2"], Box(()), [1.0, 1.0, 1.0], 48)
        asked = cloud.filter("col % 40 = 0").withColumnRenamed("col", "row")
        pairs[n] = sum(part.pairs(asked, 10)) / asked.count()
    assert pairs[32_000] < 1.6 * pairs[4_000] < 2_500
