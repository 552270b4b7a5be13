"""Text files that many tasks write: sections as folders of pieces, and pieces joined into one file."""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

BLOCK = 1 << 23


def _place(spark: SparkSession, path: str):
    """The file system of a path as Spark reads it, and the qualified path in it."""
    sc = spark.sparkContext
    place = sc._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(sc._jsc.hadoopConfiguration())
    return system, system.makeQualified(place)


def _pieces(system, folder) -> list[tuple[str, int]]:
    """The pieces of a section in the order of its rows, which their names keep, with their sizes; empty ones left out."""
    found = [(s.getPath().toString(), s.getPath().getName(), s.getLen()) for s in system.listStatus(folder) if s.isFile()]
    return [(path, size) for path, name, size in sorted(found, key=lambda f: f[1]) if name.startswith("part-") and size]


def write(spark: SparkSession, sections: Iterable[str | DataFrame], path: str) -> None:
    """Texts and frames of lines (value, in the order of their partitions), one behind another, as the file of a path.

    Each task writes its own lines. A failure leaves the file as it was.
    """
    system, target = _place(spark, path)
    folder = f"{target.toString()}.pieces-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    try:
        parts: list[str | tuple[str, int]] = []
        for i, section in enumerate(sections):
            if isinstance(section, str):
                parts.append(section)
            else:
                section.write.option("lineSep", "\n").option("compression", "none").text(f"{folder}/{i}")
                parts += _pieces(system, at(f"{folder}/{i}"))
        if target.toUri().getScheme() == "file":
            by_offsets(spark, parts, target.toString(), folder)
        else:
            by_file_system(spark, parts, target.toString(), folder)
    finally:
        system.delete(at(folder), True)


def _local(path: str) -> str:
    """The path of a qualified path of a mounted disk; it is not encoded as a URI would be."""
    return path.removeprefix("file://").removeprefix("file:")


def by_offsets(spark: SparkSession, parts: list[str | tuple[str, int]], target: str, folder: str) -> None:
    """Joins the parts of a file on a disk that all tasks see: each piece is copied to its place by a task of its own.

    A copy that is made again writes the same bytes to the same place.
    """
    whole = f"{_local(folder)}/whole"
    os.makedirs(_local(folder), exist_ok=True)
    offset, copies = 0, []
    with open(whole, "wb") as f:
        for part in parts:
            if isinstance(part, str):
                f.seek(offset)
                offset += f.write(part.encode())
            else:
                copies.append((_local(part[0]), offset))
                offset += part[1]
        f.truncate(offset)

    def copy(rows):
        for r in rows:
            with open(r.piece, "rb") as source, open(whole, "r+b") as f:
                f.seek(r.at)
                shutil.copyfileobj(source, f, BLOCK)
                f.flush()
                os.fsync(f.fileno())

    if copies:
        spark.createDataFrame(copies, "piece string, at long").repartition(min(len(copies), 1024), "piece").foreachPartition(copy)
    os.replace(whole, _local(target))


def by_file_system(spark: SparkSession, parts: list[str | tuple[str, int]], target: str, folder: str) -> None:
    """Joins the parts within their file system: by its own concatenation, which moves no bytes, if it has one.

    Others (object stores) have none: there, bytes stream from the pieces into the file, a buffer at a time.
    """
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path
    system, place = _place(spark, target)
    whole = at(f"{folder}/whole")
    joined = system.hasPathCapability(place, "fs.capability.paths.concat")
    if joined:
        pieces = []
        for i, part in enumerate(parts):
            if isinstance(part, str):
                piece = at(f"{folder}/text-{i}")
                _put(system, piece, part)
                pieces.append(piece)
            else:
                pieces.append(at(part[0]))
        system.create(whole, True).close()
        if pieces:
            array = spark.sparkContext._gateway.new_array(at, len(pieces))
            for i, piece in enumerate(pieces):
                array[i] = piece
            system.concat(whole, array)
    else:
        out = system.create(whole, True)
        try:
            for part in parts:
                if isinstance(part, str):
                    out.write(bytearray(part.encode()))
                    continue
                source = system.open(at(part[0]))
                try:
                    jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, BLOCK, False)
                finally:
                    source.close()
        finally:
            out.close()
    if system.exists(place):
        system.delete(place, False)
    if not system.rename(whole, place):
        raise OSError(f"{target} could not be put in its place")


def _put(system, piece, content: str) -> None:
    out = system.create(piece, True)
    try:
        out.write(bytearray(content.encode()))
    finally:
        out.close()
