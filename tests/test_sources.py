"""Readers and writers: fixtures, dialects, faults and round trips."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.sources import joins, sinks, text

AWKWARD = [0.1, 1 / 3, 2 / 3, 1e-300, 123456.789012345, -9.87654321e-7]


def parse(kind, content, **options):
    return list(text.FORMATS[kind][0](content, "f", options))


def faults(kind, content, **options):
    with pytest.raises(text.FormatError) as e:
        parse(kind, content, **options)
    assert all(p.startswith("f: ") for p in e.value.problems)
    return e.value.problems


def test_points():
    assert parse("points", "3\n0.1 0.2\n1.5 -2.5\n1e-300 3\n") == [(0, 0.1, 0.2), (1, 1.5, -2.5), (2, 1e-300, 3.0)]
    assert parse("points", "1\n7 8\n9 10\n") == [(0, 7.0, 8.0)]
    assert parse("points", "0\n") == []
    faults("points", "2\n1 2\n")
    faults("points", "2\n1 2\n\n3 4\n")
    assert len(faults("points", "3\n1 nan\nx 2\n1 2 3\n")) == 3


def test_node():
    got = parse("node", "# a cloud\r\n\r\n3 2 0 1\r\n1 0.5 1.5 1 # first\r\n2 2.5 3.5 0\r\n\r\n3 4.5 5.5 7\r\n")
    assert [r[:4] for r in got] == [(0, 0.5, 1.5, 1), (1, 2.5, 3.5, 0), (2, 4.5, 5.5, 7)]
    got = parse("node", "2 2 2 0\n0 1 2 3 4\n1 5 6 7 8\n")
    assert got == [(0, 1.0, 2.0, 0, [3.0, 4.0]), (1, 5.0, 6.0, 0, [7.0, 8.0])]
    faults("node", "1 3 0 0\n0 1 2\n")
    faults("node", "2 2 0 0\n0 1 2\n2 3 4\n")
    faults("node", "1 2 0 0\n0 1 2\n1 3 4\n")
    faults("node", "1 2 0 1\n0 1 2 1.5\n")
    assert len(faults("node", "2 2 0 0\n0 inf 2\n1 3 nan\n")) == 2


def test_graph():
    assert parse("graph", "3 6\n0 1 2\n1 0\n2\n") == [(0, 1, 0), (0, 2, 1), (0, 3, 2), (1, 1, 1), (1, 2, 0), (2, 1, 2)]
    assert len(parse("graph", "3 6\n0 1\n1 2\n2 0\n", k="2")) == 6
    assert parse("graph", "0 0\n") == []
    assert "the numbering looks 1-based" in " ".join(faults("graph", "2 4\n1 2\n2 1\n"))
    faults("graph", "2 3\n0 1\n1\n", k="2")
    faults("graph", "2 3\n0 0\n1\n")
    faults("graph", "2 2\n0 1\n\n")
    faults("graph", "2 4\n0 1\n1\n")


def test_ordering_and_conditions():
    assert parse("iperm", "1\n3\n0\n2\n") == [(0, 1), (1, 3), (2, 0), (3, 2)]
    assert "1-based" in faults("iperm", "1 2 3")[0]
    faults("iperm", "0 0")
    assert parse("bcmap", "! tags\n1 freestream\n2 subsonic_outflow\n3 viscous_wall\n")[2] == (2, 3, 0, "viscous_wall")
    faults("bcmap", "1 a\n1 b\n")
    assert parse("mapbc", "3\n1 5050\n2 5051 outflow\n3 4000\n") == [(0, 1, 5050, ""), (1, 2, 5051, "outflow"), (2, 3, 4000, "")]
    faults("mapbc", "2\n1 5050\n1 4000\n")
    faults("mapbc", "1\n1 5050\n2 4000\n")


GRID = """9 5 2
0 0
2 2
0 3
2 1
2 0
3 3
1.3 1
3 0
1.3 2
9 2 3
5 8 4
2 6 3
1 7 9
1 9 3
1 5 4 7
4 8 6 2
2
5
6
4
7
9
2
4
1
5
8
6
3
1
"""


def test_grid():
    assert len(parse("grid", GRID)) == 9
    assert parse("grid", GRID, section="elements")[5] == ("quadrilateral", 0, [0, 4, 3, 6])
    assert [r[2] for r in parse("grid", GRID, section="bound") if r[0] == 0] == [3, 6, 8, 1, 3]
    faults("grid", GRID + "1\n")
    faults("grid", GRID.replace("9 2 3", "9 2 2", 1))
    faults("grid", GRID.replace("1.3 2\n", "1.3 nan\n", 1))
    faults("grid", GRID[:60])


def test_sources_and_round_trips(spark, tmp_path):
    text.register(spark)
    nodes = spark.createDataFrame([(i, v, -v, i % 3, [v, 1.0]) for i, v in enumerate(AWKWARD)], "id long, x double, y double, marker int, attrs array<double>")
    stem = str(tmp_path / "case")
    sinks.write_points(nodes, stem)
    sinks.write_nodes(nodes, stem, attrs="attrs", title="awkward")
    read = lambda kind, ext, **o: spark.read.format(kind).options(**o).load(f"{stem}.{ext}")
    assert sorted(read("points", "points").collect()) == sorted(nodes.select("id", "x", "y").collect())
    assert sorted(read("node", "node").collect()) == sorted(nodes.collect())
    edges = spark.createDataFrame([(0, 1, 0), (0, 2, 2), (1, 1, 1), (2, 1, 2), (2, 2, 1)], "row long, k int, col long")
    sinks.write_graph(edges, stem)
    assert sorted(read("graph", "graph").collect()) == sorted(edges.collect())
    p = spark.createDataFrame([(2, 3), (0, 1), (3, 2), (1, 0)], "old_id long, new_id long")
    sinks.write_ordering(p, stem)
    assert open(f"{stem}.iperm").read() == "1\n0\n3\n2\n"
    assert sorted(read("iperm", "iperm").collect()) == sorted(p.collect())
    (tmp_path / "g.grid").write_text(GRID)
    g = [spark.read.format("grid").option("section", s).load(str(tmp_path / "g.grid")) for s in ("nodes", "elements", "bound")]
    sinks.write_grid(*g, str(tmp_path / "h"))
    assert (tmp_path / "h.grid").read_text() == GRID
    assert sorted(r.path[-8:] for r in spark.read.format("points").option("with_path", "1").load(str(tmp_path / "*.points")).select("path").distinct().collect()) == ["e.points"]


def test_text_sinks(spark, tmp_path):
    entries = spark.createDataFrame([(0, 1, 0, 1.0), (0, 2, 3, 0.5), (1, 1, 1, 1e-300), (2, 1, 0, 2.0), (2, 2, 2, -1.0), (2, 3, 3, 3.0)], "row long, k int, col long, value double")
    sinks.write_matrix_market(entries, str(tmp_path / "a"), 3, 4)
    assert (tmp_path / "a.mtx").read_text() == "%%MatrixMarket matrix coordinate real general\n3 4 6\n1 1 1\n1 4 0.5\n2 2 1e-300\n3 1 2\n3 3 -1\n3 4 3\n"
    sinks.write_matrix_market(entries, str(tmp_path / "b"), 3, 4, value=None)
    assert (tmp_path / "b.mtx").read_text().splitlines()[:3] == ["%%MatrixMarket matrix coordinate pattern general", "3 4 6", "1 1"]
    pts = spark.createDataFrame([(1, 1.0, 2.0, 0.25, 3.0), (0, 0.0, 0.5, 0.1, -1.0)], "id long, x double, y double, u double, v double")
    sinks.write_columns(pts, str(tmp_path / "c"), ["u"])
    assert (tmp_path / "c.dat").read_text() == "# x y u\n0 0.5 0.1\n1 2 0.25\n"
    sinks.write_vtk(pts, str(tmp_path / "d"), ["u"], [("U", "u", "v")], title="t")
    assert (tmp_path / "d.vtk").read_text() == (
        "# vtk DataFile Version 2.0\nt\nASCII\nDATASET POLYDATA\nPOINTS 2 double\n0 0.5 0\n1 2 0\nVERTICES 2 4\n1 0\n1 1\n"
        "POINT_DATA 2\nSCALARS u double 1\nLOOKUP_TABLE default\n0.1\n0.25\nVECTORS U double\n0.1 -1 0\n0.25 3 0\n"
    )
    with pytest.raises(ValueError):
        sinks.write_vtk(pts, str(tmp_path / "e"), ["a b"])
    with pytest.raises(ValueError):
        sinks.write_vtk(pts.withColumn("w", F.lit(1.0)), str(tmp_path / "e"), ["w"], title="x\ny")


@pytest.mark.parametrize("join", [None, joins.by_offsets, joins.by_file_system])
def test_pieces_are_joined_in_order(spark, tmp_path, join, monkeypatch):
    """Three headers and two sections of four and three pieces (one of them empty), by either way of joining."""
    if join:
        monkeypatch.setattr(joins, "by_offsets", join)
    first = spark.range(0, 1000, 1, 4).select(F.concat(F.lit("ä"), F.col("id").cast("string")).alias("value"))
    second = spark.range(0, 10, 1, 3).filter("id < 3 or id > 5").select(F.col("id").cast("string").alias("value"))
    target = tmp_path / "a b#c%20.txt"
    target.write_text("old")
    joins.write(spark, ["one\n", first, "two\nthree\n", second, second.limit(0), "end\n"], str(target))
    assert target.read_text() == "one\n" + "".join(f"ä{i}\n" for i in range(1000)) + "two\nthree\n" + "".join(f"{i}\n" for i in (0, 1, 2, 6, 7, 8, 9)) + "end\n"
    assert [f for f in os.listdir(tmp_path) if not f.startswith(".")] == [target.name]


def test_writers_use_many_tasks_and_leave_nothing_when_they_fail(spark, tmp_path, monkeypatch):
    seen = []
    whole = joins.by_offsets
    monkeypatch.setattr(joins, "by_offsets", lambda spark, parts, *more: (seen.append(sum(isinstance(p, tuple) for p in parts)), whole(spark, parts, *more)))
    rng = np.random.default_rng(3)
    order = rng.permutation(5000)
    points = spark.createDataFrame([(int(i), float(v), -float(v)) for i, v in zip(order, rng.normal(size=5000), strict=True)], "id long, x double, y double").repartition(4)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sinks.write_points(points, str(tmp_path / "a"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert seen == [4]
    rows = sorted(points.collect())
    assert (tmp_path / "a.points").read_text() == "5000\n" + "".join(f"{r.x!r} {r.y!r}\n" for r in rows)

    def broken(v):
        if v == rows[4000].x:
            raise RuntimeError("a task fails")
        return repr(v)

    with pytest.raises(Exception, match="a task fails"):
        sinks.write_points(points, str(tmp_path / "a"), text=broken)
    assert (tmp_path / "a.points").read_text().startswith("5000\n") and os.listdir(tmp_path) == ["a.points"]
