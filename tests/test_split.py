"""Large text files read in many splits, against the readers of one task."""

import random

import pytest

from tessera.sources import split, text
from tests.test_sources import GRID

READ = {"points": split.read_points, "node": split.read_nodes, "graph": split.read_graph, "iperm": split.read_ordering}


@pytest.fixture(scope="module")
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "200b", "spark.sql.files.openCostInBytes": "200"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield spark
    for n, v in before.items():
        spark.conf.set(n, v)


def cases():
    r = random.Random(3)
    n = 150
    points = "".join(f"{r.uniform(-9, 9)!r}\t{r.choice(['1', '-2.5e-3', '.5', '7.'])}{r.choice(['', ' ', chr(13)])}\n" for _ in range(n))
    nodes = "".join(f"{i + 1} {i * 0.5} {-i} 1.5 inf {i % 3}{' # said' * (i % 4 == 0)}\n" + "\n" * (i % 5 == 0) for i in range(n))
    graph = "".join(" ".join(str((i + j * j) % n) for j in range(1 + i % 5)) + "\n" for i in range(n))
    nnz, order = sum(1 + i % 5 for i in range(n)), list(range(n))
    r.shuffle(order)
    return {
        "points": [f"{n}\n{points}", f"{n}\n{points}ignored\n", "0\n", f"{n}\n{points}".rstrip("\n")],
        "node": [f"# a cloud\n\n{n} 2 2 1\n{nodes}", "1 2 0 0\n0 1 2"],
        "graph": [f"{n} {nnz}\n{graph}\n\n", "0 0\n"],
        "iperm": ["\n".join(map(str, order)), "1 0\n2\n", ""],
    }


WRONG = {
    "points": ["x\n1 2\n", "-1\n", "3\n1 2\n", "2\n1 2\n\n3 4\n", "3\n1 nan\nx 2\n1 2 3\n", "1 2\n3 4\n", ""],
    "node": ["", "# none\n", "1 3 0 0\n0 1 2\n", "2 2 0 0\n0 1 2\n2 3 4\n", "1 2 0 0\n0 1 2\n1 3 4\n", "1 2 0 1\n0 1 2 1.5\n", "2 2 0 0\n0 inf 2\n1 3 nan\n", "1 2 0\n"],
    "graph": ["2 4\n1 2\n2 1\n", "2 3\n0 0\n1\n", "2 2\n0 1\n\n", "2 4\n0 1\n1\n", "3 3\n0\n\n2\n", "2 2\n0\nx\n", "1 1\n0\n0\n"],
    "iperm": ["1 2 3", "0 0", "0 x", "0 5"],
}


@pytest.mark.parametrize("kind", list(READ))
def test_files_read_as_by_one_task(small_splits, tmp_path, kind):
    for i, content in enumerate(cases()[kind]):
        path = tmp_path / f"{i}.{kind}"
        path.write_text(content, newline="")
        found = READ[kind](small_splits, str(path))
        assert sorted(map(tuple, found.collect())) == sorted(text.FORMATS[kind][0](content, "f", {})), (kind, i)
        if len(content) > 4000:
            assert small_splits.read.text(str(path)).rdd.getNumPartitions() > 5


@pytest.mark.parametrize("kind", list(READ))
def test_faults_are_found_as_by_one_task(small_splits, tmp_path, kind):
    for i, content in enumerate(WRONG[kind]):
        path = tmp_path / f"{i}.{kind}"
        path.write_text(content, newline="")
        with pytest.raises(text.FormatError) as one:
            list(text.FORMATS[kind][0](content if kind == "iperm" else content.removesuffix("\n").split("\n"), str(path), {}))
        with pytest.raises(text.FormatError) as many:
            READ[kind](small_splits, str(path))
        assert len(many.value.problems) == len(one.value.problems), (kind, i, many.value.problems, one.value.problems)


def test_many_faults_are_named_up_to_a_number(small_splits, tmp_path):
    path = tmp_path / "a.points"
    path.write_text("300\n" + "1 x\n" * 300)
    with pytest.raises(text.FormatError) as e:
        split.read_points(small_splits, str(path))
    assert len(e.value.problems) == 101 and e.value.problems[0].endswith("line 2: not a number") and e.value.problems[-1].endswith("and 200 more")


def test_grid(small_splits, tmp_path):
    spark, file = small_splits, tmp_path / "a.grid"
    file.write_text(GRID.replace("3 6\n", "3 6\n\n"))
    for got, section in zip(split.read_grid(spark, str(file)), ("nodes", "elements", "bound"), strict=True):
        assert sorted(tuple(r) for r in got.collect()) == sorted(text.FORMATS["grid"][0](GRID, "f", {"section": section}))
    for broken, said in (
        (GRID + "1\n", "behind"),
        (GRID[:60], "ends before"),
        (GRID.replace("1.3 2\n", "1.3 nan\n", 1).replace("5 8 4", "5 8 8"), "not finite"),
        (GRID.replace("5 8 4", "5 8 10"), "out of range"),
        (GRID.replace("2\n5\n6\n", "2\n1\n10\n"), "fewer than two"),
    ):
        file.write_text(broken)
        with pytest.raises(text.FormatError) as e:
            split.read_grid(spark, str(file))
        assert any(said in p for p in e.value.problems), e.value.problems
