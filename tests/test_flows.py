"""Flows over files, fill-reducing orders, registered queries and their columns."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.metric import Box
from tessera.operators import factor, neighbours, ordering
from tessera.operators.lineage import cut
from tessera.plans import cases, queries
from tessera.sources import generators, poisson, regions, sinks, split, text


def test_inspect_finds_statistics_and_all_problems(spark, tmp_path):
    cloud = regions.poisson_box(spark, (8.0, 8.0), 1.0, seed=1)
    line = cases.finish(cloud, str(tmp_path / "a"), (8.0, 8.0), Box((8.0, 8.0)), value=9, title="box").first()
    n = cloud.count()
    assert (line.n, line.stencil_min, line.stencil_max) == (n, 9, 9) and math.isclose(line.density, n / 64)
    rows = cases.inspect(spark, [str(tmp_path / "a.node"), str(tmp_path / "a.graph")], Box((8.0, 8.0))).collect()
    values = {(r.file[-5:], r.metric): r.value for r in rows}
    assert not any(r.fault for r in rows) and values["graph", "nnz"] == 9 * n and values[".node", "nn_min"] >= 1 - 1e-8
    assert values[".node", "n"] == values[".node", "marker 0"] == n
    (tmp_path / "b.points").write_text("3\n0 0\n0 0\n1 1\n")
    (tmp_path / "c.graph").write_text("2 4\n1 2\n2 1\n")
    rows = cases.inspect(spark, [str(tmp_path / "b.points"), str(tmp_path / "c.graph"), str(tmp_path / "a.graph")]).collect()
    faults = {name: " ".join(r.fault for r in rows if r.fault and (r.file or "").endswith(name)) for name in ("b.points", "c.graph")}
    assert "coincident" in faults["b.points"] and "1-based" in faults["c.graph"]
    told = next(r.fault for r in rows if r.file is None)
    assert told.startswith("the files disagree") and f"a.graph: {n}" in told and "b.points: 3" in told and "c.graph" not in told


def test_polar_region_keeps_its_distance(spark):
    for outer, inner, h in ((regions.BAYONA_OUTER, regions.BAYONA_INNER, 0.05), (regions.polar_series((6.0, 0.0, 3.0), (0.5,)), None, 0.5)):
        c = regions.polar_region(spark, outer, h, inner, seed=2)
        assert neighbours.nearest(c).agg(F.min("dist")).first()[0] >= h * (1 - 1e-8)
        assert c.filter("flag = 6").isEmpty() == (inner is None)
        rows = c.collect()
        for r in rows:
            t, d = math.atan2(r.y, r.x), math.hypot(r.x, r.y)
            at = [regions.polar(s, t) if s else 0.0 for s in (outer, inner)]
            assert at[1] - 1e-9 <= d <= at[0] + 1e-9 and (r.flag == 0 or min(abs(d - x) for x in at) < 1e-3)
        rim = sum(r.flag == 1 for r in rows)
        m = np.linspace(0, 2 * math.pi, 20_001)
        assert 0.8 * np.abs(np.diff([regions.polar(outer, u) * np.exp(1j * u) for u in m])).sum() / h < rim
    with pytest.raises(ValueError):
        regions.polar_region(spark, [(0, 1.0, 0.0)], 0.2, [(0, 0.9, 0.0)])
    with pytest.raises(ValueError):
        regions.polar_region(spark, [(0, 1.0, 0.0), (1, 2.0, 0.0)], 0.2)


def apart(a, b, extent, periodic):
    d = a[:, None] - b[None]
    for k in range(2):
        if periodic[k]:
            d[..., k] -= extent[k] * np.rint(d[..., k] / extent[k])
    return np.hypot(d[..., 0], d[..., 1])


def test_sampler_draws_up_to_a_number(spark):
    extent, periodic = (9.0, 7.0), (True, False)
    s = poisson.PoissonDisk(spark, 1.0, extent, periodic, seed=4)
    points = lambda df: sorted(map(tuple, df.collect()))
    first = points(s.random(5))
    assert len(first) == 5 and s.random(3).count() == 3
    every = points(s.fill())
    assert set(first) <= set(every) and s.random(4).count() == 0
    at = np.array(every)
    assert (at >= 0).all() and (at < extent).all()
    assert (apart(at, at, extent, periodic) + 10 * np.eye(len(at))).min() >= 1 - 1e-9
    probes = np.random.default_rng(0).random((3000, 2)) * extent
    assert apart(probes, at, extent, periodic).min(axis=1).max() <= 1.001  # no room is left
    s.reset()
    assert points(s.random(5)) == first
    with pytest.raises(ValueError, match="1 given points stand outside"):
        s.add_points(spark.createDataFrame([(9.0, 3.0)], "x double, y double"))  # the far side of a period is its near side
    with pytest.raises(ValueError, match="too near"):
        s.add_points(spark.createDataFrame([first[0]], "x double, y double"))
    poisson.PoissonDisk(spark, 1.0, extent).add_points(spark.createDataFrame([extent], "x double, y double"))
    for wrong in ((0.0, extent), (1.0, (0.0, 1.0)), (4.0, extent)):
        with pytest.raises(ValueError):
            poisson.PoissonDisk(spark, *wrong, (True, True))
    with pytest.raises(ValueError, match="stand outside"):
        s.add_points(spark.createDataFrame([(None, 3.0), (float("nan"), 1.0)], "x double, y double"))


def test_a_seed_gives_one_cloud_at_any_partitioning(spark):
    draw = lambda seed: sorted(map(tuple, regions.poisson_box(spark, (6.0, 5.0), 1.0, "channel", seed=seed).collect()))
    first, before = draw(5), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert draw(5) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert draw(6) != first


def test_displaced_lattices_follow_numpys_stream(spark):
    n, sigma = 6, 0.2
    d = np.random.default_rng(3).uniform(-sigma, sigma, (28, 2))
    got = sorted((round(r.x, 9), round(r.y, 9), r.flag) for r in generators.triangle(spark, n, sigma, seed=3).collect())
    want, at = [], 0
    for j in range(n + 1):
        for i in range(n + 1 - j):
            x, y, (dx, dy) = i + j / 2, j * math.sqrt(3) / 2, d[at]
            at += 1
            sides = (j == 0) + (i == 0) + (i == n - j)
            if sides >= 2:
                flag, move = 5, (0.0, 0.0)
            elif j == 0:
                flag, move = 1, (dx, 0.0)
            elif i == 0:
                flag, move = 4, (dx / 2, dx * math.sqrt(3) / 2)
            elif i == n - j:
                flag, move = 2, (-dx / 2, dx * math.sqrt(3) / 2)
            else:
                flag, move = 0, (dx, dy)
            want.append((round(round(x + move[0], 12), 9), round(round(y + move[1], 12), 9), flag))
    assert len(got) == len(want)
    for a, b in zip(got, sorted(want), strict=True):
        assert a[2] == b[2] and math.dist(a[:2], b[:2]) < 1e-8
    d = np.random.default_rng(5).uniform(-sigma, sigma, (5 * 6, 2)).reshape(6, 5, 2)
    rows = {r.id: r for r in generators.grid(spark, 5, sigma, "channel", seed=5).collect()}
    for y in range(6):
        for x in range(5):
            r = [q for q in rows.values() if abs(((q.x - x - d[y, x, 0]) + 2.5) % 5 - 2.5) < 1e-9 and abs(q.y - y - (0 if y in (0, 5) else d[y, x, 1])) < 1e-9]
            assert len(r) == 1 and r[0].flag == {0: 1, 5: 3}.get(y, 0)


@pytest.mark.parametrize(
    ("name", "options"),
    [("disk", {"radius": 5.0}), ("triangle", {"n": 8}), ("perturbed_grid", {"n": 7, "sigma": 0.1, "seed": 1}), ("refined_cavity", {"steps": 2}), ("reentrant_corner", {"size": 8.0}), ("poisson_box", {"extent": (7.0, 7.0), "distance": 1.0, "seed": 2}), ("multilobe", {"radius": 4.0, "seed": 1}), ("eccentric_annulus", {"outer": 6.0, "inner": 1.5, "offset": 1.0, "distance": 1.0, "seed": 1}), ("polar_region", {"distance": 0.15, "seed": 1})],
)
def test_every_generator_writes_a_case(spark, tmp_path, name, options):
    line = cases.generate(spark, name, str(tmp_path / "a.node"), value=6, **options).first()
    rows = cases.inspect(spark, [str(tmp_path / "a.node"), str(tmp_path / "a.graph")]).collect()
    assert not any(r.fault for r in rows) and line.n > 25 and (line.stencil_min, line.stencil_max) == (6, 6)
    head = (tmp_path / "a.node").read_text().split("\n", 1)[0]
    assert head.startswith(f"# {name} ")
    for bad in ({"method": "nearest"}, {"value": 1}, {"value": 2.5}, {"method": "radius", "value": 0.0}):
        with pytest.raises(ValueError):
            cases.generate(spark, name, str(tmp_path / "b"), **bad, **options)


def test_reorder(spark, tmp_path):
    cloud = generators.triangle(spark, 5)
    sinks.write_graph(neighbours.knn_stencils(cloud, 5), str(tmp_path / "a"))
    r = cases.reorder(spark, str(tmp_path / "a.graph"), str(tmp_path / "a")).first()
    assert r.after < r.before
    text.register(spark)
    ordering.check_permutation(spark.read.format("iperm").load(str(tmp_path / "a.iperm")))
    with pytest.raises(ValueError, match="rcm, nd, amd"):
        cases.reorder(spark, str(tmp_path / "a.graph"), str(tmp_path / "b"), method="none")


@pytest.mark.parametrize("method", ["nd", "amd"])
def test_reorder_reports_fill(spark, tmp_path, method):
    n = 6
    near = lambda i, j: [(i + a) * n + j + b for a, b in ((0, 0), (0, 1), (1, 0), (0, -1), (-1, 0)) if 0 <= i + a < n and 0 <= j + b < n]
    rows = [near(i, j) for i in range(n) for j in range(n)]
    (tmp_path / "a.graph").write_text(f"{n * n} {sum(map(len, rows))}\n" + "".join(" ".join(map(str, r)) + "\n" for r in rows))
    r = cases.reorder(spark, str(tmp_path / "a.graph"), str(tmp_path / "a"), method, fill=True).first()
    order = split.read_ordering(spark, str(tmp_path / "a.iperm"))
    ordering.check_permutation(order)
    assert order.count() == n * n and r.before == n and r.after > 0
    assert r.fill_after < r.fill_before == n * n + (n - 1) + (n * n - n) * n  # below the diagonal, the grid's first row is a path; behind it the band fills up


def test_fill_reducing_orders(spark):
    n = 8
    at = lambda i, j: i * n + j
    pairs = [(at(i, j), at(i + a, j + b)) for i in range(n) for j in range(n) for a, b in ((0, 1), (1, 0)) if i + a < n and j + b < n]
    edges = spark.createDataFrame(pairs, "row long, col long")
    points = spark.createDataFrame([(at(i, j), float(i), float(j)) for i in range(n) for j in range(n)], "id long, x double, y double")
    filled = {}
    for name, p in (("plain", ordering.identity(points)), ("dissection", factor.nested_dissection(points, edges, leaf=16)), ("degree", factor.minimum_degree(edges))):
        p = ordering.check_permutation(p)
        filled[name] = factor.factor_nonzeros(edges, p).first()[0]
        m = np.eye(n * n) * 8
        new = {r.old_id: r.new_id for r in p.collect()}
        for a, b in pairs:
            m[new[a], new[b]] = m[new[b], new[a]] = -1 - (a % 7) / 100
        assert filled[name] == (np.abs(np.linalg.cholesky(m)) > 1e-14).sum()
    assert filled["dissection"] < filled["plain"]
    near = {i: set() for i in range(n * n)}
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    one_by_one = 0
    while near:
        i = min(near, key=lambda v: (len(near[v]), v))
        around = near.pop(i)
        one_by_one += 1 + len(around)
        for j in around:
            near[j] = (near[j] | around) - {i, j}
    assert filled["degree"] <= 1.25 * one_by_one < filled["plain"]


def test_factor_rows_of_an_irregular_graph(spark):
    """A node that a quarter of the others neighbour, lone nodes, repeated edges and loops; against elimination in a matrix."""
    n, rng = 40, np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, n - 3, (50, 2))] + [(0, 0)] + [(0, i) for i in range(5, n - 3, 4)]
    new = rng.permutation(n)
    full = np.eye(n, dtype=bool)
    for a, b in pairs:
        full[new[a], new[b]] = full[new[b], new[a]] = True
    for k in range(n):
        below = np.flatnonzero(full[k + 1 :, k]) + k + 1
        full[np.ix_(below, below)] = True
    edges = spark.createDataFrame(pairs, "row long, col long")
    order = spark.createDataFrame([(i, int(v)) for i, v in enumerate(new)], "old_id long, new_id long")
    assert {r.row: r.nonzeros for r in factor.factor_rows(edges, order).collect()} == {i: int(np.tril(full)[i].sum()) for i in range(n)}


@pytest.mark.parametrize("most", [60, 10_000])
def test_elimination_tree_by_stretches(spark, monkeypatch, most):
    """A tree as deep as a grid's band, over many stretches and in one; the tables it writes are as many as the stretches need."""
    n = 20
    pairs = [(i * n + j, v) for i in range(n) for j in range(n) for v in ((i * n + j + 1,) if j < n - 1 else ()) + ((i * n + n + j,) if i < n - 1 else ())]
    pairs += [(7, v) for v in range(30, n * n - 40, 3)]
    parent, near = {}, {v: {b for a, b in pairs if a == v} for v in range(n * n)}
    for v in range(n * n):  # what a node leaves behind goes to its parent
        if near[v]:
            parent[v] = min(near[v])
            near[parent[v]] |= near[v] - {parent[v]}
    written = []
    monkeypatch.setattr(factor, "cut", lambda df, *a, **k: written.append(0) or cut(df, *a, **k))
    lower = spark.createDataFrame([(b, a) for a, b in pairs], "i long, j long")
    assert {r.node: r.parent for r in factor.elimination_tree(lower, most).collect()} == parent
    assert len(written) <= 2 + 2 * (n * n // factor.BLOCK + 1)


@pytest.mark.parametrize("most", [400, factor.PIECE])
def test_minimum_degree_by_pieces(spark, monkeypatch, most):
    """A grid in many pieces and in one: a permutation, fill near that of one node at a time, and few tables written."""
    n, written = 12, []
    pairs = [(i * n + j, v) for i in range(n) for j in range(n) for v in ((i * n + j + 1,) if j < n - 1 else ()) + ((i * n + n + j,) if i < n - 1 else ())]
    monkeypatch.setattr(factor, "cut", lambda df, *a, **k: written.append(0) or cut(df, *a, **k))
    made = factor.minimum_degree(spark.createDataFrame(pairs, "row long, col long"), **({} if most == factor.PIECE else {"most": most}))
    new = {r.old_id: r.new_id for r in ordering.check_permutation(made).collect()}
    if most == factor.PIECE:
        assert len(written) < 20  # whatever the number of nodes

    def fill(order=None):
        near, total = {i: set() for i in range(n * n)}, 0
        for a, b in pairs:
            near[a].add(b)
            near[b].add(a)
        while near:
            i = min(near, key=lambda v: order[v] if order else (len(near[v]), v))
            around = near.pop(i)
            total += 1 + len(around)
            for j in around:
                near[j] = (near[j] | around) - {i, j}
        return total

    assert len(new) == n * n and fill(new) <= (1.25 if most == factor.PIECE else 1.6) * fill()


def test_minimum_degree_without_insides(spark):
    """Any two nodes are neighbours, or many hang on one: pieces have no inside, and rounds over the whole graph go on."""
    pairs = [(i, j) for i in range(14) for j in range(i)] + [(0, i) for i in range(20, 90)]
    order = ordering.check_permutation(factor.minimum_degree(spark.createDataFrame(pairs, "row long, col long").repartition(2).selectExpr("IF(row >= 20, row - 6, row) row", "IF(col >= 20, col - 6, col) col"), most=60))
    assert order.count() == 84


def test_orders_of_graphs_without_edges(spark):
    none = spark.createDataFrame([], "row long, col long")
    assert factor.minimum_degree(none).count() == 0
    assert factor.factor_nonzeros(none, factor.minimum_degree(none)).first()[0] == 0
    lone = spark.createDataFrame([(i, i) for i in range(3)], "row long, col long")
    order = ordering.check_permutation(factor.minimum_degree(lone))
    assert order.count() == 3 and factor.factor_nonzeros(lone, order).first()[0] == 3


@pytest.mark.parametrize(("lobes", "fillet"), [(3, 0.0), (3, 2.0), (4, 3.0)])
def test_multilobe(spark, lobes, fillet):
    c = regions.multilobe(spark, 6.0, 1.0, lobes=lobes, fillet=fillet, seed=1)
    assert c.filter("flag = 5").count() == (0 if fillet else lobes)
    assert neighbours.nearest(c).agg(F.min("dist")).first()[0] >= 0.95 - 1e-9
    rim = sorted(c.filter("flag > 0").collect(), key=lambda r: math.atan2(r.y, r.x))
    assert max(math.dist((a.x, a.y), (b.x, b.y)) for a, b in zip(rim, rim[1:] + rim[:1], strict=True)) < 1.6
    assert c.filter("x * x + y * y > 144.0001").count() == 0
    with pytest.raises(ValueError):
        regions.multilobe(spark, 6.0, lobes=2, offset=6.0)


def test_every_query_has_one_schema_and_rows(spark, tmp_path):
    n = 40
    rng = np.random.default_rng(1)
    spark.createDataFrame([(i, rng.uniform(-0.4, 0.4, 4).astype("float32").tolist(), i % 4) for i in range(n)], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    for name in ("knn_periodic", "radius_graph", "hilbert_order", "renumber_stencils", "graph_stats", "spmv", "source_graph"):
        assert queries.QUERIES[name](spark, str(tmp_path)).count() > 0


def test_entry_has_queries_for_all_sql(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert {"knn_stencils", "source_points"} <= set(__spark_entry__.queries())
