"""The jobs as queries: each runs its job twice into one new folder and gives the output back as it stands then."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from jobs import common, prepare_cloud, text_intake
from tessera.operators.lineage import shared_dir
from tessera.plans import queries


def _folder(spark: SparkSession, job: str) -> str:
    return f"{shared_dir(spark)}/{job}-{uuid.uuid4().hex}"


def job1_prepare_cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, config = _folder(spark, "prepare_cloud"), common.config_of("prepare_cloud")
    for _ in range(2):
        prepare_cloud.run(spark, sf_dir, folder, config)
    rows = prepare_cloud.read(spark, folder)
    return rows.withColumns({c: queries.r9(c) for c in ("x", "y", "reach")})


def job2_text_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, config = _folder(spark, "text_intake"), common.config_of("text_intake")
    for _ in range(2):
        text_intake.run(spark, sf_dir, f"{folder}/reports", f"{folder}/checkpoint", config)
    return text_intake.read(spark, f"{folder}/reports").withColumnsRenamed({"id": "doc_id", "part": "lang"})


JOB1_SQL = f"""WITH raw AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, label AS flag FROM embeddings),
given AS (SELECT id, {queries._fold_sql("x", "1.0")} AS x, {queries._fold_sql("y", "1.0")} AS y, flag FROM raw),
nodes AS (SELECT * FROM given), {queries.HILBERT.replace("FROM nodes", "FROM given")},
along AS (SELECT g.id AS file_id, x, y, flag, row_number() OVER (ORDER BY key, g.id) AS place FROM given g JOIN keys k ON g.id = k.id),
moved AS (SELECT row_number() OVER (ORDER BY flag <> 0, place) - 1 AS id, file_id, x, y, flag FROM along),
ranked AS (SELECT a.id AS row, b.id AS col, {queries.ROUND} AS dist, row_number() OVER (PARTITION BY a.id ORDER BY {queries.ROUND}, b.id) AS k FROM moved a CROSS JOIN moved b),
found AS (SELECT row, list(col ORDER BY k) AS stencil, max(dist) AS reach FROM ranked WHERE k <= 12 GROUP BY row)
SELECT row, file_id, round(x, 9) + 0.0 AS x, round(y, 9) + 0.0 AS y, flag, stencil, round(reach, 9) + 0.0 AS reach, row // 128 AS block FROM found JOIN moved ON row = id
"""

_TOKEN = r"string_split_regex(trim(split_part(line, '#', 1), chr(32) || chr(9) || chr(13) || chr(11) || chr(12)), '[ \t\r\x0B\x0C]+')"
_BLANKS = "chr(32) || chr(9) || chr(13) || chr(11) || chr(12)"

JOB2_SQL = rf"""
WITH cut AS (
  SELECT doc_id, source, nullif(lang, '') AS lang,
         CASE WHEN coalesce(text, '') = '' THEN [] WHEN ends_with(text, chr(10)) THEN string_split(left(text, length(text) - 1), chr(10)) ELSE string_split(text, chr(10)) END AS lines
  FROM documents),
each_line AS (SELECT doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS no FROM cut),
said AS (SELECT doc_id, no, trim(line, {_BLANKS}) AS whole, trim(split_part(line, '#', 1), {_BLANKS}) AS content, {_TOKEN} AS tokens FROM each_line),
numbers AS (
  SELECT doc_id, no, whole, content, len(tokens) AS n,
         len(list_filter(tokens, lambda t: regexp_full_match(t, '-?[0-9]+') AND TRY_CAST(t AS BIGINT) IS NOT NULL)) AS integers,
         len(list_filter(tokens, lambda t: regexp_full_match(t, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') AND coalesce(isfinite(TRY_CAST(t AS DOUBLE)), false))) AS reals FROM said),
kinds AS (
  SELECT doc_id, no, content, CASE WHEN whole = '' THEN 'blank' WHEN content = '' THEN 'comment' WHEN n = 1 AND integers = 1 THEN 'count' WHEN n = 2 AND reals = 2 THEN 'point'
         WHEN integers = n THEN 'integers' WHEN reals = n THEN 'numbers' ELSE 'text' END AS kind FROM numbers),
heads AS (SELECT doc_id, CAST(content AS BIGINT) AS announced FROM kinds WHERE no = 1 AND kind = 'count'),
counted AS (
  SELECT doc_id, count(*) FILTER (kind = 'blank') AS n_blank, count(*) FILTER (kind = 'comment') AS n_comment, count(*) FILTER (kind = 'count') AS n_count, count(*) FILTER (kind = 'point') AS n_point,
         count(*) FILTER (kind = 'integers') AS n_integers, count(*) FILTER (kind = 'numbers') AS n_numbers, count(*) FILTER (kind = 'text') AS n_text, min(no) FILTER (kind = 'text') AS first_text,
         coalesce(min(no) FILTER (no > 1 AND kind <> 'point'), max(no) + 1) - 2 AS points_behind, arg_min(kind, no) FILTER (kind NOT IN ('blank', 'comment')) AS first_kind FROM kinds GROUP BY doc_id)
SELECT c.doc_id, source, len(lines) AS n_lines, coalesce(n_blank, 0) AS n_blank, coalesce(n_comment, 0) AS n_comment, coalesce(n_count, 0) AS n_count, coalesce(n_point, 0) AS n_point,
       coalesce(n_integers, 0) AS n_integers, coalesce(n_numbers, 0) AS n_numbers, coalesce(n_text, 0) AS n_text, first_text, announced,
       CASE WHEN first_kind IS NULL THEN 'empty' WHEN announced >= 0 AND points_behind >= announced THEN 'points' WHEN n_count > 0 AND n_point + n_integers + n_numbers + n_text = 0 THEN 'ordering'
            WHEN first_kind <> 'text' THEN 'faulty' ELSE 'text' END AS format, lang
FROM cut c LEFT JOIN counted k ON c.doc_id = k.doc_id LEFT JOIN heads h ON c.doc_id = h.doc_id
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"job1_prepare_cloud": job1_prepare_cloud, "job2_text_intake": job2_text_intake}
SQL: dict[str, str] = {"job1_prepare_cloud": JOB1_SQL, "job2_text_intake": JOB2_SQL}
