"""The jobs: growing input, reruns, odd texts, and a command line."""

import json
import logging
import os
import re
import subprocess
import sys

import numpy as np
import pytest

from jobs import common, prepare_cloud, registered, text_intake
from tessera.operators import intake

DOCS = "doc_id long, text string, lang string, source string, n_chars int"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def put_docs(spark, folder, name, rows, mode="append"):
    docs = spark.createDataFrame([(i, t, lang, f"s{k % 2}", len(t or "")) for k, (i, t, lang) in enumerate(rows)], DOCS)
    docs.coalesce(1).write.mode(mode).parquet(f"{folder}/{name}")


FIRST = [(1, "2\n0.5 1\n-1e3 .5\n", "en"), (2, "words here\n3 4", "fr"), (3, "1\n0\n2\n", ""), (4, None, None)]
LATER = [(5, "3\n1 2\n", "en"), (6, "# only this\n\n", "fr"), (2, "again", "fr")]


def test_intake_takes_only_what_is_new(spark, tmp_path, caplog):
    config, tables, out, mark = common.config_of("text_intake"), str(tmp_path / "t"), str(tmp_path / "out"), str(tmp_path / "mark")
    put_docs(spark, tables, "documents.parquet", FIRST)
    with caplog.at_level(logging.INFO):
        assert text_intake.run(spark, tables, out, mark, config) == {"read": 4, "reports": 4}
    assert "read 4 new texts" in caplog.text
    files = lambda: {f: os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(out) for f in fs if f.endswith(".parquet")}
    before = files()
    assert text_intake.run(spark, tables, out, mark, config) == {"read": 0, "reports": 4}
    assert files() == before
    put_docs(spark, tables, "documents.parquet", LATER)
    assert text_intake.run(spark, tables, out, mark, config) == {"read": 3, "reports": 7}
    assert before.items() <= files().items()
    got = {(r.id, r.format): r for r in text_intake.read(spark, out).collect()}
    assert {k for k in got} == {(1, "points"), (2, "text"), (3, "ordering"), (4, "empty"), (5, "faulty"), (6, "empty")}
    assert {(r.id, r.part) for r in got.values()} == {(1, "en"), (2, "fr"), (3, None), (4, None), (5, "en"), (6, "fr")}
    assert {d for d in os.listdir(out) if d.startswith("part=")} == {"part=en", "part=fr", "part=__HIVE_DEFAULT_PARTITION__"}


def test_a_lost_batch_is_taken_again_once(spark, tmp_path):
    """A run that broke off before its batch was committed is mended by the next one, without a second copy of what the sink has."""
    config, tables, out, mark = common.config_of("text_intake"), str(tmp_path / "t"), str(tmp_path / "out"), str(tmp_path / "mark")
    put_docs(spark, tables, "documents.parquet", FIRST)
    text_intake.run(spark, tables, out, mark, config)
    for name in os.listdir(f"{mark}/commits"):
        os.remove(f"{mark}/commits/{name}")
    assert text_intake.run(spark, tables, out, mark, config)["reports"] == 4


def described(text):
    """Lines of each kind of a text, in plain Python."""
    lines = (text or "").split("\n")
    lines = lines[:-1] if lines[-1] == "" else lines
    kinds = []
    for line in lines:
        said = re.split(r"[ \t\r\x0b\x0c]+", line.split("#", 1)[0].strip(" \t\r\x0b\x0c"))
        whole = all(re.fullmatch(r"-?[0-9]+", t) and -(2**63) <= int(t) < 2**63 for t in said)
        real = all(re.fullmatch(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?", t) and abs(float(t)) < float("inf") for t in said)
        blank = not line.strip(" \t\r\x0b\x0c")
        kinds.append("blank" if blank else "comment" if said == [""] else "count" if whole and len(said) == 1 else "point" if real and len(said) == 2 else "integers" if whole else "numbers" if real else "text")
    return kinds


def test_lines_are_described_as_by_plain_python(spark):
    texts = ["", "\n", "a\n\n", "1", "1\n", "-5 # five", "1 2", "1 2 3", "1 2.5 3", "1e999 2", "99999999999999999999", "1.5", "+1", "1d 2f", "0x10", " 7\t", "7\r\n8 9\r\n", "#", "1 nan", "-- 1", "٣", ". 1", "5. .5", "1_0", "x" * 50_000, "3 " * 20_000, "1\n" * 20_000, None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    from tessera.functions import lines

    for r in intake.described(rows).collect():
        kinds = described(texts[r.id])
        assert [r[f"n_{k}"] for k in lines.KINDS] == [kinds.count(k) for k in lines.KINDS], (r.id, texts[r.id] and texts[r.id][:50])
        assert r.n_lines == len(kinds) and r.first_text == (kinds.index("text") + 1 if "text" in kinds else None)


def test_described_keeps_clashing_columns(spark):
    rows = spark.createDataFrame([(1, "a", "b", "c", "x\n")], "id long, __lines string, __kinds string, `a.b` string, text string")
    (r,) = intake.described(rows).collect()
    assert (r["__lines"], r["__kinds"], r["a.b"], r.n_text) == ("a", "b", "c", 1)
    assert intake.described(rows.filter("id = 2")).count() == 0


@pytest.fixture(scope="module")
def cloud(spark, tmp_path_factory):
    tables = str(tmp_path_factory.mktemp("cloud"))
    xy = np.random.default_rng(8).random((90, 2)) * 3 - 1
    rows = [(i, [float(x), float(y)], int(i % 5 == 0)) for i, (x, y) in enumerate(xy)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").coalesce(2).write.parquet(f"{tables}/embeddings.parquet")
    return tables, xy


def test_prepared_cloud(spark, cloud, tmp_path):
    tables, xy = cloud
    config = common.config_of("prepare_cloud") | {"k": 6, "block_rows": 25}
    told = prepare_cloud.run(spark, tables, str(tmp_path / "out"), config)
    assert told["nodes"] == 90 and told["boundary"] == 18
    rows = sorted(prepare_cloud.read(spark, str(tmp_path / "out")).collect(), key=lambda r: r.row)
    assert [r.row for r in rows] == list(range(90)) and {(r.row // 25) for r in rows} == {0, 1, 2, 3} and all(r.block == r.row // 25 for r in rows)
    assert [r.flag for r in rows] == [0] * 72 + [1] * 18
    at = np.array([[r.x, r.y] for r in rows])
    assert np.allclose(at, np.mod(xy[[r.file_id for r in rows]], 1.0))
    away = at[:, None] - at[None]
    dist = np.sqrt(((away - np.rint(away)) ** 2).sum(-1))
    for r in rows:
        want = sorted(range(90), key=lambda j: (dist[r.row, j], j))[:6]
        assert list(r.stencil) == want and abs(r.reach - dist[r.row, want[-1]]) < 1e-12
    assert told["bandwidth"] == max(abs(r.row - j) for r in rows for j in r.stencil)
    # a rerun replaces everything, fewer blocks included
    prepare_cloud.run(spark, tables, str(tmp_path / "out"), config | {"block_rows": 90})
    again = sorted(prepare_cloud.read(spark, str(tmp_path / "out")).collect(), key=lambda r: r.row)
    assert [r[:7] for r in again] == [r[:7] for r in rows] and {r.block for r in again} == {0}


def test_a_cloud_that_cannot_be_prepared(spark, cloud, tmp_path):
    tables, _ = cloud
    for wrong in ({"k": 91}, {"x": "cast('nan' as double)"}):
        with pytest.raises(ValueError):
            prepare_cloud.run(spark, tables, str(tmp_path / "none"), common.config_of("prepare_cloud") | wrong)


def test_registered_jobs_run_twice(spark, cloud, tmp_path):
    tables, _ = cloud
    put_docs(spark, tables, "documents.parquet", FIRST + LATER, "overwrite")
    assert registered.job1_prepare_cloud(spark, tables).count() == 90
    assert sorted(r.doc_id for r in registered.job2_text_intake(spark, tables).collect()) == [1, 2, 2, 3, 4, 5, 6]


def test_command_line(cloud, tmp_path):
    tables, _ = cloud
    (tmp_path / "few.json").write_text(json.dumps({"k": 3, "block_rows": 50}))
    call = [sys.executable, "-m", "jobs.prepare_cloud", "--tables", tables, "--output", str(tmp_path / "out"), "--config", str(tmp_path / "few.json")]
    done = subprocess.run(call, cwd=ROOT, capture_output=True, text=True, timeout=300, env=os.environ | {"SPARK_LOCAL_DIRS": str(tmp_path)})
    assert done.returncode == 0 and "wrote 90 rows in 2 blocks" in done.stderr
    assert sorted(d for d in os.listdir(tmp_path / "out" / "rows") if d.startswith("block")) == ["block=0", "block=1"]
    (tmp_path / "wrong.json").write_text('{"kk": 3}')
    with pytest.raises(ValueError):
        common.config_of("prepare_cloud", str(tmp_path / "wrong.json"))
