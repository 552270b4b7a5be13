"""Files of any file system that pyarrow reaches, by path or URI."""

from __future__ import annotations

import fnmatch
import io
import re
from collections.abc import Iterator

from pyarrow import fs


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if re.match(r"[a-z][a-z0-9+.-]+:", path):
        return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return fs.LocalFileSystem(), path


def listed(path: str) -> list[str]:
    """The files of a folder or a pattern in the last part of the path, in order of their names; or the path itself."""
    system, place = filesystem(path)
    scheme = path[: len(path) - len(place)] if path.endswith(place) else ""
    kind = system.get_file_info(place).type
    if kind == fs.FileType.Directory:
        found = [f.path for f in system.get_file_info(fs.FileSelector(place)) if f.type == fs.FileType.File]
    elif kind == fs.FileType.NotFound and any(c in place for c in "*?["):
        folder = place.rsplit("/", 1)[0] if "/" in place else "."
        inside = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        found = [f.path for f in inside if f.type == fs.FileType.File and fnmatch.fnmatch(f.path, place if "/" in place else f"./{place}")]
    else:
        found = []
    return [scheme + f for f in sorted(found)] or [path]


def read_text(path: str) -> str:
    system, place = filesystem(path)
    with system.open_input_stream(place) as f:
        return f.read().decode("utf-8")


def read_lines(path: str) -> Iterator[str]:
    system, place = filesystem(path)
    with system.open_input_stream(place) as f, io.TextIOWrapper(f, encoding="utf-8", newline="\n") as text:
        yield from (line.removesuffix("\n") for line in text)
