"""Cutting the lineage of iterated frames."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (spark.checkpoint.dir).

    A session in one process (a local master) may have none, as in tests, and gets a temporary one; any other is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="tessera-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame, tag: str = "cut", instead: Iterable[DataFrame] = ()) -> DataFrame:
    """The frame, written below the shared folder and read again; tables that it stands ``instead`` of are deleted then.

    Unlike a checkpoint, a table has the size of its files as its estimate; estimates that are carried through
    many rounds of joins grow without bound.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_at = path
    for old in instead:
        drop(old)
    return table


def drop(table: DataFrame) -> None:
    """Deletes a table that ``cut`` has written and nothing reads any more; of other frames, nothing."""
    path = getattr(table, "written_at", None)
    if path:
        sc = table.sparkSession.sparkContext
        place = sc._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(sc._jsc.hadoopConfiguration()).delete(place, True)
