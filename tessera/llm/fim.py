"""Fill-in-middle transformation of documents, by DuckDB on Arrow batches.

Each document is cut into lines (a line break belongs to the line it ends). Two cuts fall between lines, at places
that the hash of a seed and the document's id tells; what lies between them is the middle. The parts are put in the
order prefix, suffix, middle (``psm``) or suffix, prefix, middle (``spm``), each behind its sentinel:

* ``psm``: ``<P>`` prefix ``<S>`` suffix ``<M>`` middle
* ``spm``: ``<S>`` suffix ``<P>`` prefix ``<M>`` middle

A document stays ``plain`` if it is empty, holds one of the sentinels, or is not among the transformed share. ``restore``
gives the exact text back from the output and its form.

Both are one SQL statement that DuckDB runs over each registered batch inside ``mapInArrow``: lines, cuts, parts and
hashes are columns of that statement, and Arrow batches go in and come out. Batches are cut into groups of bounded
bytes; nothing is shuffled, and a document's outcome depends on its id and text alone, so a task that runs twice
gives the same rows.

Defined cases: a null text counts as empty; a null id is hashed as an empty string; rows that repeat an id are cut at
places of their own texts; a text of one line gets its cuts before or behind that line; bytes that are not
UTF-8 read as U+FFFD; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from . import common

#: Prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")

_TRANSFORM = r"""
WITH lines AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS units, sha256($seed || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) AS hash FROM batch),
drawn AS (
  SELECT doc_id, text, units, len(units) AS n, list_transform(range(4), lambda g: CAST('0x' || substr(hash, 8 * g + 1, 8) AS BIGINT)) AS h FROM lines),
cuts AS (
  SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, $p) OR contains(text, $s) OR contains(text, $m) OR h[3] % 100 >= $share THEN 'plain'
              WHEN h[4] % 100 < $spm THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (
  SELECT *, coalesce(array_to_string(list_slice(units, 1, a), ''), '') AS prefix, coalesce(array_to_string(list_slice(units, a + 1, b), ''), '') AS middle,
         coalesce(array_to_string(list_slice(units, b + 1, n), ''), '') AS suffix FROM cuts)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       CASE form WHEN 'plain' THEN text WHEN 'psm' THEN $p || prefix || $s || suffix || $m || middle ELSE $s || suffix || $p || prefix || $m || middle END AS output
FROM parts
"""

# the parts hold no sentinel, so each sentinel is found where it was put
_RESTORE = """
WITH halves AS (
  SELECT *, split_part({output}, $m, 1) AS front, split_part({output}, $m, 2) AS middle,
         CASE {form} WHEN 'psm' THEN $p ELSE $s END AS outside, CASE {form} WHEN 'psm' THEN $s ELSE $p END AS inside FROM batch),
parts AS (
  SELECT *, substr(split_part(front, inside, 1), 1 + length(outside)) AS first, split_part(front, inside, 2) AS second FROM halves)
SELECT {columns}, CASE {form} WHEN 'plain' THEN {output} WHEN 'psm' THEN first || middle || second ELSE second || middle || first END AS text
FROM parts
"""


def _sql_over(frame: DataFrame, sql: str, parameters: dict, schema: StructType | str, sized: str) -> DataFrame:
    """The statement's rows over groups of the frame's batches; ``sized`` names the text column whose bytes bound a group."""
    at = frame.columns.index(sized)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb
        import pyarrow.compute as pc

        # DuckDB's own threads would come on top of the task's
        with duckdb.connect(config={"threads": 1, "temp_directory": ""}) as con:
            for batch in batches:
                size = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
                cuts = np.flatnonzero(np.diff(np.cumsum(size) // common.GROUP_BYTES)) + 1
                for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(size)], strict=True):
                    con.register("batch", pa.Table.from_batches([batch.slice(a, b - a)]))
                    yield from con.sql(sql, params=parameters).to_arrow_table().rename_columns(told.names).cast(told).to_batches()
                    con.unregister("batch")
        common.release()

    told = frame.sparkSession.createDataFrame([], schema).toArrow().schema
    return frame.mapInArrow(run, schema)


def _named(sentinels: tuple[str, str, str]) -> dict:
    marks = [s for s in sentinels if s]
    apart = len({*marks}) == 3 and not any(a != b and b in a for a in marks for b in marks)
    if not apart or any(a[-i:] == b[:i] for a in marks for b in marks for i in range(1, min(len(a), len(b)))):
        raise ValueError("sentinels must be three texts of which none holds or overlaps another")
    return dict(zip("psm", sentinels, strict=True))


def transform(docs: DataFrame, seed: int = 7, share: int = 100, spm: int = 50, sentinels: tuple[str, str, str] = SENTINELS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output of each document.

    n counts the lines, the characters are code points (null where plain). ``share`` percent of the documents are
    transformed, ``spm`` percent of these suffix first.
    """
    text = F.coalesce(F.make_valid_utf8(text_col), F.lit("")).alias("text")
    frame = docs.select(F.col(id_col).cast("long").alias("doc_id"), text)
    parameters = _named(sentinels) | {"seed": str(seed), "share": share, "spm": spm}
    return _sql_over(frame, _TRANSFORM, parameters, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string", "text")


def restore(transformed: DataFrame, sentinels: tuple[str, str, str] = SENTINELS, as_col: str = "text") -> DataFrame:
    """Transformed rows (form, output and any others) with the texts that they were made from."""
    if as_col in transformed.columns:
        raise ValueError(f"there is a column {as_col} already: name another by as_col")
    names = [f"c{i}" for i in range(len(transformed.columns))]
    at = dict(zip(transformed.columns, names, strict=True))
    sql = _RESTORE.format(columns=", ".join(names), form=at["form"], output=at["output"])
    schema = StructType([*transformed.schema.fields, StructField(as_col, StringType())])
    return _sql_over(transformed.toDF(*names), sql, _named(sentinels), schema, at["output"])
