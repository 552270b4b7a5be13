"""Operators against brute force, laws and invariants."""

import math
import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import curves, fields, lattice, metric
from tessera.functions.metric import OPEN, Box
from tessera.operators import dissection, factor, grid, neighbours, ordering, stats, weights
from tessera.operators.lineage import cut
from tessera.sources import generators, poisson, regions, sinks
from tests.test_sources import GRID, parse


def cloud(spark, pts, names=("x", "y")):
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(pts)], f"id long, {', '.join(f'{n} double' for n in names)}")


def brute(pts, q, k, sides):
    pts, q = np.asarray(pts, float), np.asarray(q, float)
    d = q[:, None, :] - pts[None]
    for a, s in enumerate(sides):
        if s:
            d[:, :, a] -= s * np.rint(d[:, :, a] / s)
    d = np.sqrt((d * d).sum(2))
    return [[(j, d[i, j]) for j in np.lexsort((np.arange(len(pts)), np.round(d[i], 12)))[:k]] for i in range(len(q))]


@pytest.mark.parametrize(
    ("dim", "sides", "n", "k"),
    [(1, (), 200, 5), (1, (5.0,), 200, 5), (2, (), 500, 8), (2, (1.0, 1.0), 500, 8), (2, (2.0, 5.0), 300, 12), (2, (1.0, 0.05), 40, 40), (3, (1.0, 3.0, 0.5), 200, 16), (2, (1.0, 0.0), 200, 6)],
)
def test_knn_matches_brute_force(spark, dim, sides, n, k):
    rng = np.random.default_rng(dim * n)
    scale = np.array([s or 1.0 for s in (*sides, *[1.0] * (dim - len(sides)))])
    pts, q = rng.uniform(size=(n, dim)) * scale, rng.uniform(-2, 3, size=(64, dim)) * scale
    names = ("x", "y", "z")[:dim]
    got = neighbours.knn_join(cloud(spark, q, names), cloud(spark, pts, names), k, names, Box(sides)).collect()
    want = brute(pts, q, k, (*sides, *[0.0] * (dim - len(sides))))
    assert len(got) == 64 * k
    for r in got:
        assert abs(want[r.row][r.k - 1][1] - r.dist) <= 1e-9 * (1 + r.dist)
    assert all(len({r.col for r in got if r.row == i}) == k for i in range(64))


@pytest.mark.parametrize("pts", [[(0.5, 0.5)], [(1.0, 2.0)] * 16, [(float(i), 0.0) for i in range(32)], [(0.0, 0.0)] * 40 + [(1.0, 1.0)] * 3])
def test_degenerate_clouds(spark, pts):
    k = min(5, len(pts))
    got = neighbours.knn_stencils(cloud(spark, pts), k).collect()
    want = brute(pts, pts, k, (0, 0))
    assert sorted((r.row, r.k, r.col) for r in got) == sorted((i, j + 1, c) for i, w in enumerate(want) for j, (c, _) in enumerate(w))


def test_periodicity_changes_the_neighbours(spark):
    pts = cloud(spark, [(0.02, 0.02), (0.98, 0.02), (0.02, 0.98), (0.98, 0.98), (0.5, 0.5)])
    assert {r.row: r.col for r in neighbours.nearest(pts).collect() if r.row < 4} == dict.fromkeys(range(4), 4)
    near = neighbours.nearest(pts, Box((1.0, 1.0))).collect()
    assert all(r.col != 4 and abs(r.dist - 0.04) < 1e-12 for r in near if r.row < 4)


def test_bad_arguments(spark):
    pts = cloud(spark, [(0.0, 0.0), (0.0, 0.0), (1.0, 1.0)])
    for call in (
        lambda: neighbours.knn_stencils(pts, 4), lambda: neighbours.knn_stencils(pts, 0), lambda: neighbours.knn_stencils(pts, 2, on_duplicate="error"),
        lambda: neighbours.within(pts, 0.6, Box((1.0, 1.0))), lambda: neighbours.within(pts, 0.1, on_duplicate="error"),
        lambda: neighbours.validated(cloud(spark, [(math.nan, 0.0)])), lambda: Box((-1.0,)), lambda: curves.morton_key(F.lit(0.0), F.lit(0.0), (0, 0, 1, 1), 32),
    ):
        with pytest.raises(ValueError):
            call()


@pytest.mark.parametrize("norm", ["euclid", "chebyshev"])
def test_within_matches_brute_force(spark, norm):
    pts = np.random.default_rng(4).uniform(size=(150, 2))
    for sides in ((), (1.0, 1.0)):
        got = neighbours.within(cloud(spark, pts), 0.2, Box(sides), norm=norm).collect()
        d = pts[:, None] - pts[None]
        d = d - np.rint(d) if sides else d
        dist = np.abs(d).max(2) if norm == "chebyshev" else np.sqrt((d * d).sum(2))
        assert {(r.row, r.col) for r in got} == set(zip(*map(np.ndarray.tolist, np.nonzero(dist <= 0.2)), strict=True))
        assert all(r.col == r.row for r in got if r.k == 1)


def test_thinning_is_greedy(spark):
    pts = np.random.default_rng(5).uniform(size=(200, 2))
    kept = []
    for i, p in enumerate(pts):
        if all(math.dist(p, pts[j]) >= 0.1 for j in kept):
            kept.append(i)
    assert sorted(r.id for r in neighbours.thinned(cloud(spark, pts), 0.1).collect()) == kept


def test_fold_and_images(spark):
    one = spark.range(1)
    got = one.select(*[metric.fold(F.lit(v), 4.0) for v in (4.5, -0.25, -1e-30, 4.0)]).first()
    assert got[0] == 0.5 and got[1] == 3.75 and 0 <= got[2] < 4 and got[3] == 0
    got = one.select(metric.minimum_image(F.lit(3.0), 4.0), metric.minimum_image(F.lit(-2.0), 3.0), F.abs(metric.minimum_image(F.lit(2.0), 4.0)), metric.minimum_image(F.lit(2.0), 4.0, "keep")).first()
    assert tuple(got) == (-1.0, 1.0, 2.0, 2.0)


def test_curves_on_a_lattice(spark):
    pts = cloud(spark, [(i + 0.5, j + 0.5) for j in range(4) for i in range(4)])
    box = (0.0, 0.0, 4.0, 4.0)
    key = lambda name: [r.key for r in ordering.curve_keys(pts, name, 2, box).orderBy("id").collect()]
    assert key("morton") == [0, 1, 4, 5, 2, 3, 6, 7, 8, 9, 12, 13, 10, 11, 14, 15]
    assert key("hilbert") == [0, 1, 14, 15, 3, 2, 13, 12, 4, 7, 8, 11, 5, 6, 9, 10]
    for n in (3, 4):
        m = 1 << n
        pts = cloud(spark, [(i + 0.5, j + 0.5) for j in range(m) for i in range(m)])
        at = {r.key: (r.id % m, r.id // m) for r in ordering.curve_keys(pts, "hilbert", n, (0, 0, m, m)).collect()}
        assert sorted(at) == list(range(m * m))
        assert all(abs(at[i][0] - at[i + 1][0]) + abs(at[i][1] - at[i + 1][1]) == 1 for i in range(m * m - 1))


def test_permutations(spark):
    made = lambda gather: spark.createDataFrame([(old, new) for new, old in enumerate(gather)], "old_id long, new_id long")
    p, q = made((2, 0, 3, 1)), made((1, 3, 0, 2))
    rows = spark.createDataFrame([(i, 10 + i) for i in range(4)], "id long, v int")
    order = lambda df: [r.v for r in df.orderBy("id").collect()]
    assert order(ordering.permute(rows, p)) == [12, 10, 13, 11]
    assert order(ordering.unpermute(ordering.permute(rows, p), p)) == [10, 11, 12, 13]
    assert order(ordering.permute(ordering.permute(rows, p), q)) == order(ordering.permute(rows, ordering.then(p, q)))
    assert sorted(ordering.then(p, ordering.inverse(p)).collect()) == [(i, i) for i in range(4)]
    with pytest.raises(ValueError):
        ordering.check_permutation(spark.createDataFrame([(0, 0), (1, 0)], "old_id long, new_id long"))
    flags = spark.createDataFrame([(i, f) for i, f in enumerate((0, 1, 0, 1, 0, 0, 2))], "id long, flag int")
    gather = lambda df: [r.old_id for r in df.orderBy("new_id").collect()]
    assert gather(ordering.boundary_last(flags)) == [0, 2, 4, 5, 1, 3, 6]
    assert gather(ordering.boundary_first(flags)) == [1, 3, 6, 0, 2, 4, 5]
    listed = spark.createDataFrame([(1,), (3,), (6,)], "id long")
    assert gather(ordering.boundary_last_by_index(flags, listed)) == [0, 2, 4, 5, 1, 3, 6]
    ring = spark.createDataFrame([(i, k + 1, (i + k) % 4) for i in range(4) for k in range(2)], "row long, k int, col long")
    new = ordering.renumber_edges(ring, p).collect()
    assert all(r.row == r.col for r in new if r.k == 1)
    assert [tuple(r) for r in ordering.row_pointer(ring).orderBy("row").collect()] == [(i, 2 * i) for i in range(5)]


def test_reverse_cuthill_mckee_narrows_a_shuffled_path(spark):
    ids = list(range(24))
    random.Random(1).shuffle(ids)
    pairs = [(ids[i], 1, ids[i]) for i in range(24)] + [(ids[i], 2, ids[i + 1]) for i in range(23)]
    edges = spark.createDataFrame(pairs, "row long, k int, col long")
    p = ordering.check_permutation(ordering.reverse_cuthill_mckee(edges))
    assert stats.bandwidth(ordering.renumber_edges(edges, p)).first()[0] <= 2 < stats.bandwidth(edges).first()[0]


def frames(spark, content):
    kinds = (("nodes", "id long, x double, y double"), ("elements", "kind string, elem long, verts array<long>"), ("bound", "part int, seq int, node long"))
    return [spark.createDataFrame(parse("grid", content, section=s), schema) for s, schema in kinds]


def counts(spark, content):
    got = [r["check"] for r in grid.orientation_faults(*frames(spark, content)).collect()]
    return [got.count(i) for i in (1, 2, 3, 4)]


def test_grid_rules(spark):
    n, e, b = frames(spark, GRID)
    grid.check(n, e, b)
    assert [r.marker for r in grid.markers(n, b).orderBy("id").collect()] == [2, 1, 2, 1, 2, 2, 1, 2, 1]
    assert all(r.closed for r in grid.closed(b).collect())
    assert counts(spark, GRID) == [0, 0, 0, 0]
    bad = spark.createDataFrame([("triangle", 0, [0, 1, 99])], "kind string, elem long, verts array<long>")
    with pytest.raises(ValueError, match="out of range"):
        grid.check(n, bad, b)
    odd = spark.createDataFrame([("triangle", 0, [0, 1, 1]), ("quadrilateral", 0, [0, 1, 2]), ("triangle", 1, None), ("pentagon", 0, [0, 1, 2])], "kind string, elem long, verts array<long>")
    walk = spark.createDataFrame([(0, 0, 1), (0, 1, 1), (1, 0, 2), (2, 1, 3), (2, 3, 77), (3, 0, None), (3, 1, 2)], "part int, seq int, node long")
    assert [r.violations for r in grid.violations(n, odd, walk).collect()] == [3, 1, 2, 1, 1, 1]
    triangle = "3 1 0\n0 0\n1 0\n0 1\n{}\n1\n4\n{}\n"
    parts = lambda *v: "\n".join(map(str, v))
    assert counts(spark, triangle.format("1 2 3", parts(1, 2, 3, 1))) == [0, 0, 0, 0]
    assert counts(spark, triangle.format("1 3 2", parts(1, 2, 3, 1))) == [1, 0, 3, 3]
    assert counts(spark, triangle.format("1 2 3", parts(1, 3, 2, 1))) == [0, 0, 3, 3]
    square = "4 2 0\n0 0\n1 0\n1 1\n0 1\n1 2 3\n1 3 4\n1\n2\n{}\n"
    assert counts(spark, square.format(parts(1, 3))) == [0, 0, 1, 4]
    messages = [r.message for r in grid.orientation_faults(*frames(spark, square.format(parts(2, 4)))).collect()]
    assert "boundary part 1, edge 2 -> 4 is not an element edge" in messages


def test_lattice_laws(spark):
    rows = spark.createDataFrame([(1.0, 0.0, 0.0), (1.1, 0.05, -0.02), (0.9, -0.1, 0.03)], "rho double, ux double, uy double")
    f = lattice.feq(rows).drop("rho", "ux", "uy")
    for a, b in zip(rows.collect(), lattice.macros(f).select("rho", "ux", "uy").collect(), strict=True):
        assert np.allclose(a, b, atol=1e-14)
    off = f.withColumn("f1", F.col("f1") + 0.01)
    after = lattice.macros(lattice.bgk(off, 0.8).drop("rho", "ux", "uy"))
    for a, b in zip(lattice.macros(off).collect(), after.collect(), strict=True):
        assert math.isclose(a.rho, b.rho, abs_tol=1e-14) and math.isclose(a.ux, b.ux, abs_tol=1e-14)
    relaxed = lattice.bgk(off, 1.0).select("rho", "ux", "uy", *lattice.POPULATIONS)
    for a, b in zip(relaxed.collect(), lattice.feq(relaxed).collect(), strict=True):
        assert np.allclose(a, b, atol=1e-14)
    empty = spark.createDataFrame([[0.0] * 9], lattice.POPULATIONS)
    assert lattice.macros(empty).first().ux is None


def test_field_laws(spark):
    box = Box((4.0, 3.0))
    wave = fields.shear_wave(box, 2, 1, 0.1, 0.02, 0.3)
    pts = cloud(spark, np.random.default_rng(1).uniform(-5, 5, (50, 2)))
    t = F.lit(0.7)
    at = lambda dx: pts.select(*wave.fields(F.col("x") + dx, F.col("y") - 3.0, t)).collect()
    assert np.allclose(at(0.0), at(4.0), atol=1e-12)
    frac = spark.range(1).select(wave.decay(F.lit(wave.decay_time(0.25)))).first()[0]
    assert math.isclose(frac, 0.25)
    sound = fields.AcousticWave(box, 1, 1, 0.01, 0.02)
    assert all(r[1] == 0 == r[2] for r in pts.select(*sound.fields(F.col("x"), F.col("y"), F.lit(0.0))).collect())
    for bad in (
        lambda: fields.shear_wave(box, 0, 0, 1.0, 1.0), lambda: fields.shear_wave(box, 1, 0, 1.0, 0.0), lambda: fields.taylor_green(box, 0, 1, 1.0, 1.0), lambda: wave.decay_time(0.0),
        lambda: fields.ShearModes(box, [fields.Mode(1, 1, 0), fields.Mode(1, -1, 0)], 1.0), lambda: fields.ShearModes(box, [fields.Mode(1, 1, 0), fields.Mode(1, 0, 1)], 1.0),
        lambda: fields.AcousticWave(box, 1, 1, 0.01, 50.0), lambda: fields.shear_layer(box, 1.0, F.lit(0.0), F.lit(0.0), k=0),
    ):
        with pytest.raises(ValueError):
            bad()


def test_interpolation_weights(spark):
    rng = np.random.default_rng(2)
    n = cloud(spark, rng.uniform(size=(120, 2)))
    e = neighbours.knn_stencils(n, 15, Box((1.0, 1.0)))
    w = weights.interpolation_weights(n, e, weights.Interpolation(15), [(0.0, 0.0), (0.01, 0.02)], Box((1.0, 1.0)))
    rows = w.collect()
    assert all(r.info == 0 for r in rows)
    assert all(abs(r.weight - (r.k == 1)) < 1e-8 for r in rows if r.op == 0)
    pts = {r.id: (r.x, r.y) for r in n.collect()}
    for i in range(120):
        own = [r for r in rows if r.row == i and r.op == 1]
        d = [((pts[r.col][0] - pts[i][0] + 0.5) % 1 - 0.5, (pts[r.col][1] - pts[i][1] + 0.5) % 1 - 0.5) for r in own]
        for a in range(3):
            for b in range(3 - a):
                got = sum(r.weight * x**a * y**b for r, (x, y) in zip(own, d, strict=True))
                assert abs(got - 0.01**a * 0.02**b) < 1e-8
    x = np.zeros((2, 6))
    x[1], y = rng.uniform(size=6), np.array([np.zeros(6), rng.uniform(size=6)])
    got, info = weights.Interpolation(6, p=1).weights(x, y, np.array([0.0]), np.array([0.0]))
    assert info.tolist() == [2, 0] and (got[0] == 0).all() and abs(got[1].sum() - 1) < 1e-10


def test_ragged_weights_in_the_nodes_own_coordinates(spark):
    rng = np.random.default_rng(8)
    xy = rng.uniform(size=(20, 2)).round(6)
    nodes = spark.createDataFrame([(i, *p) for i, p in enumerate(xy.tolist())], "id long, x double, y double")
    order = [sorted(range(20), key=lambda j, i=i: math.dist(xy[i], xy[j])) for i in range(20)]
    edges = spark.createDataFrame([(i, k + 1, j) for i in range(20) for k, j in enumerate(order[i][: 9 + i % 4])], "row long, k int, col long")
    with pytest.raises(Exception, match="a stencil has"):
        weights.interpolation_weights(nodes, edges, weights.Interpolation(9), [(0.5, 0.5)], local=False).collect()
    w = weights.interpolation_weights(nodes, edges, weights.Interpolation(9), [(0.5, 0.5), (0.25, 0.5)], local=False, ragged=True)
    rows = w.collect()
    assert len(rows) == 2 * edges.count()
    for i in range(20):
        for a, b in ((0, 0), (1, 0), (0, 1), (2, 0), (1, 1), (0, 2)):
            got = [sum(r.weight * xy[r.col][0] ** a * xy[r.col][1] ** b for r in rows if r.row == i and r.op == op) for op in (0, 1)]
            assert abs(got[0] - 0.5 ** (a + b)) < 1e-8 and abs(got[1] - 0.25**a * 0.5**b) < 1e-8
    both = {(r.row, r.k): r.weight for r in weights.summed(w, (0, 1)).collect()}
    for r in rows:
        other = next(s.weight for s in rows if (s.row, s.k) == (r.row, r.k) and s.op != r.op)
        assert abs(both[r.row, r.k] - r.weight - other) < 1e-12


@pytest.mark.parametrize("box", [OPEN, Box((1.0, 1.0)), Box((0.0, 1.0))])
def test_clustered_clouds_are_searched_on_finer_grids(spark, box, monkeypatch):
    rng = np.random.default_rng(10)
    pts = np.concatenate([rng.uniform(size=(250, 2)), 0.31 + 1e-3 * rng.standard_normal((900, 2)), 0.999 + 1e-4 * rng.uniform(size=(500, 2)), 0.7 + 1e-6 * rng.uniform(size=(350, 2))])
    pairs = []
    whole = neighbours._Grid.search
    monkeypatch.setattr(neighbours._Grid, "search", lambda self, *a: pairs.append(max(self.count)) or whole(self, *a))
    got = {}
    for r in neighbours.knn_stencils(cloud(spark, pts), 5, box).collect():
        got.setdefault(r.row, {})[r.k] = (r.dist, r.col)
    sides = [box.side(i) for i in range(2)]
    d = np.abs(pts[:, None] - pts[None])
    for a, s in enumerate(sides):
        if s:
            d[..., a] = np.minimum(d[..., a], s - d[..., a])
    d = np.hypot(d[..., 0], d[..., 1])
    assert len(got) == len(pts) and len(pairs) > 3 and pairs[0] > 1000 * pairs[-1]
    for i in range(len(pts)):
        best = np.sort(d[i])[:5]
        assert np.allclose([got[i][k][0] for k in range(1, 6)], best, rtol=0, atol=1e-12)
        assert len({c for _, c in got[i].values()}) == 5 and all(abs(d[i, c] - x) < 1e-12 for x, c in got[i].values())


@pytest.mark.parametrize("bad", [None, float("nan"), float("inf"), float("-inf")])
def test_points_without_finite_coordinates_are_refused(spark, bad):
    rng = np.random.default_rng(9)
    good = spark.createDataFrame([(i, *p) for i, p in enumerate(rng.uniform(size=(60, 2)).tolist())], "id long, x double, y double")
    faulty = good.union(spark.createDataFrame([(60, 0.5, bad)], good.schema))
    for run in (
        lambda: neighbours.knn_stencils(faulty, 3),
        lambda: neighbours.knn_stencils(faulty, 3, Box((1.0, 1.0))),
        lambda: neighbours.knn_join(faulty, good, 2),
        lambda: neighbours.knn_join(good, faulty, 2),
        lambda: neighbours.nearest(faulty),
        lambda: neighbours.within(faulty, 0.1),
        lambda: ordering.curve_order(faulty),
    ):
        with pytest.raises(ValueError, match="1 points have coordinates"):
            run()


def test_row_pointer_keeps_empty_rows(spark, tmp_path):
    edges = spark.createDataFrame([(0, 1, 0), (0, 2, 2), (2, 1, 2)], "row long, k int, col long")
    ia = lambda *a: [r.ia for r in ordering.row_pointer(edges, *a).orderBy("row").collect()]
    assert ia() == [0, 2, 2, 3] and ia(5) == [0, 2, 2, 3, 3, 3]
    assert [r.ia for r in ordering.row_pointer(edges.limit(0)).collect()] == [0]
    with pytest.raises(ValueError, match="beyond"):
        ordering.row_pointer(edges, 2)
    p = spark.createDataFrame([(0, 2), (1, 0), (2, 1)], "old_id long, new_id long")
    assert [r.ia for r in ordering.row_pointer(ordering.renumber_edges(edges, p), 3).orderBy("row").collect()] == [0, 0, 1, 3]
    with pytest.raises(ValueError, match="1 of 3 nodes have no row"):
        sinks.write_graph(edges, str(tmp_path / "a"))


def test_generators(spark):
    assert generators.triangle(spark, 7).count() == 8 * 9 // 2
    assert generators.triangle(spark, 7).filter("flag = 5").count() == 3
    for boundary, sides in (("periodic", (12.0, 10.0)), ("channel", (12.0, 0.0)), ("walls", (0.0, 0.0))):
        c = regions.poisson_box(spark, (12.0, 10.0), 1.0, boundary, seed=3)
        assert neighbours.nearest(c, Box(sides)).agg(F.min("dist")).first()[0] >= 1 - 1e-8
        assert c.count() > 0.55 * 120
    a = regions.eccentric_annulus(spark, 8.0, 2.0, 1.5, 1.0, seed=2)
    assert neighbours.nearest(a).agg(F.min("dist")).first()[0] >= 1 - 1e-8
    assert a.filter("flag = 0 and x * x + y * y >= 64").count() == 0
    corner = generators.ReentrantCorner(12.0).nodes(spark)
    assert corner.filter("x > 1e-9 and y < -1e-9").count() == 0
    assert corner.filter("flag = 5").count() == 6
    assert neighbours.coincident(corner).count() == 0
    assert neighbours.coincident(generators.cavity(spark, 3)).count() == 0
    g = generators.grid(spark, 6, 0.2, "periodic", seed=1)
    assert stats.outside(g, Box((6.0, 6.0))).first()[0] == 0
    assert generators.tile(g, (6.0, 6.0), (2, 2)).count() == 4 * 36
    for bad in (lambda: generators.disk(spark, -1.0), lambda: generators.triangle(spark, 1), lambda: regions.poisson_box(spark, (1.0, 9.0), 1.0), lambda: generators.ReentrantCorner(5.0, omega=1.0), lambda: generators.cavity(spark, 3, (1.0, 1.0))):
        with pytest.raises(ValueError):
            bad()


def test_statistics(spark):
    e = spark.createDataFrame([(0, 1, 0), (0, 2, 9), (1, 1, 1), (1, 2, 0), (2, 1, 0), (2, 2, 2)], "row long, k int, col long")
    s = stats.graph_stats(e).first()
    assert (s.n, s.nnz, s.not_self_first, s.no_diagonal, s.bandwidth, s.transposed) == (3, 6, 1, 0, 9, 3)
    assert sorted(map(tuple, stats.cache_lines(e).collect())) == [(0, 9, 2, 1), (1, 1, 1, 0), (2, 2, 1, 0)]
    with pytest.raises(ValueError):
        stats.same_size(spark.range(2), spark.range(3))
    nodes, pairs = spark.range(6), ordering.adjacency(spark.createDataFrame([(0, 1), (1, 2), (4, 5)], "row long, col long"))
    assert {r.id: r.component for r in stats.connected(nodes, pairs).collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 4}


def test_open_box_is_open():
    assert OPEN.side(0) == 0 and Box((1.0,)).side(1) == 0


def test_elimination_tells_the_pivot_that_fails():
    r = np.random.default_rng(4)
    m, rhs = r.standard_normal((40, 7, 7)), r.standard_normal((40, 7, 3))
    m[3, :, 4] = 0
    m[5] = 0
    m[6, 6] = m[6, 2] = np.arange(7)
    m[6, :, :] = np.round(m[6])
    w, info = weights.solve_each(m, rhs)
    good = info == 0
    assert info[3] == 5 and info[5] == 1 and info[6] > 0 and good.sum() == 37
    assert np.allclose(w[good], np.linalg.solve(m[good], rhs[good])) and not w[~good].any()


def test_selection_is_the_sorted_value(spark):
    r = np.random.default_rng(6)
    for values in (r.random(3001), np.repeat([1.0, 2.0, 5.0], [500, 1, 700]), np.concatenate([1e-9 * r.random(2000), [1e12]]), np.array([4.0]), np.full(900, 3.5), np.array([-1e308, 0.0, 1e308])):
        frame = spark.createDataFrame([(float(v),) for v in values], "v double")
        told = sorted(values.tolist())
        for rank in {0, len(told) // 3, len(told) - 1}:
            assert stats.nth(frame, "v", rank, buckets=7, few=10) == told[rank]
        assert stats.median(frame, "v", len(told)) == pytest.approx(float(np.median(values)))
    with pytest.raises(ValueError):
        stats.nth(frame, "v", 3)


def test_numberings_give_clashing_columns_back(spark):
    own = ["__part", "__size", "__before", "__n", "__k0", "__k1", "__last", "__in", "__shared"]
    rows = spark.createDataFrame([(i, float(-i), *[f"{c}{i}" for c in own]) for i in range(20)], "id long, x double, " + ", ".join(f"{c} string" for c in own))
    for r in ordering.dense_number(rows, ["x", F.col("id")], "no").collect():
        assert r.no == 19 - r.id and all(r[c] == f"{c}{r.id}" for c in own)
    last = ordering.boundary_last_by_index(rows, rows.filter("id < 3").select("id"))
    assert sorted((r.new_id, r.old_id) for r in last.collect())[-3:] == [(17, 0), (18, 1), (19, 2)]
    flow = rows.select("*", F.lit(1.0).alias("rho"), F.lit(0.1).alias("ux"), F.lit(0.0).alias("uy"))
    assert all(r["__shared"] == f"__shared{r.id}" for r in lattice.feq(flow).collect())


def test_cuthill_mckee_by_parents(spark):
    """Against a queue, on graphs with several components, lone nodes and loops."""
    rng = np.random.default_rng(5)
    for n, m in ((1, 1), (40, 45)):
        pairs = [(int(a), int(b)) for a, b in rng.integers(0, n, (m, 2))] + [(i, i) for i in range(n)]
        near = {i: set() for i in range(n)}
        for a, b in pairs:
            if a != b:
                near[a].add(b)
                near[b].add(a)
        order, left = [], set(range(n))
        while left:
            component, front = {min(left)}, [min(left)]
            while front:
                front = [j for i in front for j in near[i] if j not in component and not component.add(j)]
            queue = [min(component, key=lambda i: (len(near[i]), i))]
            left -= {queue[0]}
            for i in queue:
                more = sorted(near[i] & left, key=lambda j: (len(near[j]), j))
                queue += more
                left -= set(more)
            order.append(queue)
        expected = {i: k for k, i in enumerate(reversed([i for queue in order for i in queue]))}
        p = ordering.check_permutation(ordering.reverse_cuthill_mckee(spark.createDataFrame(pairs, "row long, col long")))
        assert {r.old_id: r.new_id for r in p.collect()} == expected
    assert ordering.reverse_cuthill_mckee(spark.createDataFrame([], "row long, col long")).count() == 0


@pytest.mark.parametrize(("held", "wide"), [(10_000_000, 100_000), (150, 100_000), (150, 4), (100, 100_000)])
def test_cuthill_mckee_walks_many_levels_in_one_job(spark, monkeypatch, held, wide):
    """A long ladder with a crowd at its end and a path: walked by one task, by several that meet for each level, with a level too wide for them, and by joins."""
    ladder = [(2 * i + a, 2 * i + b) for i in range(45) for a, b in ((0, 1), (0, 2), (1, 3))]
    pairs = [*ladder, *[(90, 130 + i) for i in range(20)], *[(200 + i, 201 + i) for i in range(60)]]
    monkeypatch.setattr(ordering, "HELD", held)
    monkeypatch.setattr(ordering, "WIDE", wide)
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    order, left = [], set(near)
    for least in (0, 200):
        component = {i for i in near if (i < 200) == (least < 200)}
        queue = [min(component, key=lambda i: (len(near[i]), i))]
        left -= {queue[0]}
        for i in queue:
            more = sorted(near[i] & left, key=lambda j: (len(near[j]), j))
            queue += more
            left -= set(more)
        order += queue
    spark.sparkContext.setJobGroup(f"ladder {held} {wide}", "")
    edges = cut(spark.createDataFrame(pairs, "row long, col long"))
    p = {r.old_id: r.new_id for r in ordering.reverse_cuthill_mckee(edges).collect()}
    assert p == {i: k for k, i in enumerate(reversed(order))}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"ladder {held} {wide}"))
    spark.sparkContext.setJobGroup("", "")
    assert jobs > 200 if held == 100 else jobs < 150


def test_components_of_many_pairs_are_contracted(spark, monkeypatch):
    """Against plain merging, by one task and by rounds; rounds are few on a path whose ids go up and down."""
    rng = np.random.default_rng(8)
    ids = rng.permutation(400).tolist()
    pairs = [*zip(ids[:299], ids[1:300], strict=True), *[(a, b) for a, b in rng.choice(ids[300:380], (60, 2)).tolist() if a != b]]
    least = {i: i for i in ids}
    for _ in ids:
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
    nodes = spark.createDataFrame([(i,) for i in ids], "id long")
    both = cut(spark.createDataFrame([*pairs, *[(b, a) for a, b in pairs]], "row long, col long"))
    for most in (2_000_000, 5):
        monkeypatch.setattr(stats, "MERGED", most)
        tables = []
        monkeypatch.setattr(stats, "cut", lambda df, *a, **k: tables.append(df) or cut(df, *a, **k))  # noqa: B023
        assert {r.id: r.component for r in stats.connected(nodes, both).collect()} == least
        assert len(tables) < 50


@pytest.mark.parametrize("box", [Box((1.0, 1.0)), Box((0.0, 0.0))])
def test_radius_join_deals_crowded_cells_and_moves_no_pairs(spark, monkeypatch, box):
    """Crowded cells are dealt over tasks with the same result, and pairs are not shuffled after they are made."""
    rng = np.random.default_rng(5)
    xy = np.concatenate([rng.random((150, 2)), 0.5 + 0.01 * rng.random((150, 2)), [[0.25, 0.25]] * 5])
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "id long, x double, y double")
    plain = neighbours.within(points, 0.1, box)
    monkeypatch.setattr(neighbours, "SORTED", 2_000)
    dealt = neighbours.within(points, 0.1, box)
    assert sorted(plain.collect()) == sorted(dealt.collect())
    d = np.abs(xy[:, None] - xy[None])
    d = np.minimum(d, 1 - d) if box.side(0) else d
    assert dealt.count() == (np.sqrt((d**2).sum(-1)) <= 0.1).sum()
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    above_join = plan[: plan.index("SortMergeJoin")]
    assert "Window" in above_join and "Exchange" not in above_join


@pytest.mark.parametrize(("sides", "norm"), [((1.0, 1.0), "euclid"), ((), "euclid"), ((), "chebyshev")])
def test_crowded_cells_are_copied_by_their_rows(spark, monkeypatch, sides, norm):
    """A crowded cell's points go to as many tasks as its rows need, not to as many as its pairs do, and rows are found and ordered the same."""
    rng = np.random.default_rng(6)
    xy = np.concatenate([rng.random((100, 2)), 0.55 + 0.02 * rng.random((400, 2)), [[0.25, 0.25]] * 40, 0.125 * rng.integers(0, 9, (60, 2))])
    points = spark.createDataFrame([(f"n{i:03d}", float(x), float(y)) for i, (x, y) in enumerate(xy)], "id string, x double, y double")
    plain = neighbours.within(points, 0.1, Box(sides), norm=norm).select("row", "k", "col", "dist")
    copies = []
    by_rows = neighbours._row_by_row
    monkeypatch.setattr(neighbours, "_row_by_row", lambda probe, home, *a: copies.append(home.agg(F.sum("shares")).first()[0]) or by_rows(probe, home, *a))
    monkeypatch.setattr(neighbours, "SORTED", 500)
    monkeypatch.setattr(neighbours, "ROWS", 100)
    monkeypatch.setattr(neighbours, "SENT", 150)
    found = neighbours.within(points, 0.1, Box(sides), norm=norm)
    assert sorted(found.collect()) == sorted(plain.collect())
    d = np.abs(xy[:, None] - xy[None])
    d = np.minimum(d, 1 - d) if sides else d
    assert found.count() == ((d.max(-1) if norm == "chebyshev" else np.sqrt((d**2).sum(-1))) <= 0.1).sum()
    assert 0 < copies[0] < 9 * len(xy) * 5  # dealt by pairs it would be over a million


def test_singular_batches_are_bounded_in_memory():
    """A full batch of Arrow's rows is solved in pieces, and the pieces with singular stencils take few MB as well."""
    config = weights.Interpolation(15)
    step = weights.at_once(15 + config.terms)
    assert 1 < step < 10_000 and weights.at_once(10_000) == 1
    x, y = np.random.default_rng(2).random((2, step, 15))
    x[::37], y[::37] = 0.0, 0.0
    tracemalloc.start()
    info = config.weights(x, y, np.array([0.0]), np.array([0.0]))[1]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (info[::37] != 0).all() and peak < 40 << 20


@pytest.mark.parametrize("order", [ordering.reverse_cuthill_mckee, dissection.graph_dissection, factor.minimum_degree])
def test_orders_find_their_edges_once(spark, order):
    """Edges may be the unevaluated result of a search, which no order repeats."""
    met = spark.sparkContext.accumulator(0)

    def seen(v):
        met.add(1)
        return v

    pairs = spark.createDataFrame([(0, 1), (1, 2), (2, 0)], "row long, col long")
    found = order(pairs.select(F.udf(seen, "long")("row").alias("row"), "col"))
    assert {r.old_id for r in found.collect()} == {0, 1, 2} and met.value == 3


def test_searches_broadcast_nothing(spark, monkeypatch):
    """Places that repeat have small files and are large in memory: no join of a search sends them through the driver."""
    plans = []
    monkeypatch.setattr(neighbours, "cut", lambda df, *a, **k: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df, *a, **k))
    cloud = cut(spark.range(2000).select("id", (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 11 / (1 + F.col("id") % 3 * 50)).alias("y")))
    found = neighbours.knn_stencils(cloud, 8)
    assert found.count() == 16_000
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)


def test_rounds_of_darts_broadcast_nothing(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(poisson, "cut", lambda df, *a, **k: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df, *a, **k))
    assert poisson.PoissonDisk(spark, 1.0, (5.0, 5.0), seed=1, depth=2).fill().count() > 10
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)


def test_tasks_of_a_search_follow_its_pairs(spark, monkeypatch):
    """Where many queries meet many points, the pairs are dealt over more tasks than the session's partitions, and none is lost."""
    monkeypatch.setattr(neighbours, "SEARCHED", 500, raising=False)
    dealt = []
    monkeypatch.setattr(neighbours, "cut", lambda df, *a, **k: dealt.append(df._jdf.queryExecution().toString()) or cut(df, *a, **k))
    rng = np.random.default_rng(3)
    at = np.concatenate([rng.uniform(0, 1, (150, 2)), rng.normal(0.5, 1e-4, (450, 2))])
    cloud = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(at)], "id long, x double, y double")
    found = {(r.row, r.k): r.col for r in neighbours.knn_stencils(cloud, 3).collect()}
    far = np.hypot(at[:, None, 0] - at[None, :, 0], at[:, None, 1] - at[None, :, 1])
    assert found == {(i, j + 1): int(c) for i in range(600) for j, c in enumerate(np.lexsort((np.arange(600), far[i]))[:3])}
    assert any("share" in p and "RepartitionByExpression" in p for p in dealt)
