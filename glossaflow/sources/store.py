"""Files that Python workers read and write by themselves, in any store that Arrow's file systems know.

A path is a local one, or a URI (file, hdfs, s3, gs, abfs and so on). All that
is written is written under another name first and moved when it is whole.
"""

from __future__ import annotations

import fnmatch
import os
import posixpath
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as arrow_fs

_WILD = re.compile(r"[*?\[]")


@dataclass(frozen=True)
class Found:
    path: str  # as a caller writes it
    size: int


def opened(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of a path, and the path inside it."""
    path = re.sub(r"^s3[an]://", "s3://", re.sub(r"^file:/+", "/", path))  # Hadoop's names
    return arrow_fs.FileSystem.from_uri(path if "://" in path else posixpath.abspath(path))


def known(path: str) -> bool:
    """Whether Arrow has a file system for a path."""
    try:
        opened(path)
    except (pa.ArrowException, OSError, ValueError):
        return False
    return True


def _matches(path: str, pattern: str) -> bool:
    """Wildcards don't reach over a slash."""
    a, b = path.strip("/").split("/"), pattern.strip("/").split("/")
    return len(a) == len(b) and all(fnmatch.fnmatchcase(x, y) for x, y in zip(a, b, strict=True))


def walked(fs: arrow_fs.FileSystem, folder: str, deep: bool, wanted: Callable[[str], bool]) -> Iterator[tuple[str, int]]:
    """(path, size) of the wanted files of a folder that is there, as they come: a local folder is never held, however much is in it; Arrow lists one of another store whole."""
    if not isinstance(fs, arrow_fs.LocalFileSystem):
        for i in fs.get_file_info(arrow_fs.FileSelector(folder, recursive=deep)):
            if i.type == arrow_fs.FileType.File and wanted(i.path):
                yield i.path, i.size or 0
        return
    stack = [os.scandir(folder)]
    try:
        while stack:
            entry = next(stack[-1], None)
            if entry is None:
                stack.pop().close()
            elif entry.is_dir():
                if deep:
                    stack.append(os.scandir(entry.path))
            elif wanted(entry.path) and entry.is_file():
                try:
                    size = entry.stat().st_size
                except FileNotFoundError:  # it went meanwhile
                    continue
                yield entry.path, size
    finally:
        for scan in stack:
            scan.close()


def scanned(path: str, ending: str = "") -> Iterator[Found]:
    """The files at a path, a pattern, or below a folder that have the ending, in no order, so that no list of them is made."""
    fs, inner = opened(path)
    bare = path.rstrip("/")
    prefix = bare[: -len(inner)] if "://" in path and not path.startswith("file:") and bare.endswith(inner) else ""
    if _WILD.search(inner):
        base = inner[: _WILD.search(inner).start()].rpartition("/")[0] or "/"
        there = fs.get_file_info(base).type != arrow_fs.FileType.NotFound
        files = walked(fs, base, True, lambda p: _matches(p, inner)) if there else ()
    else:
        info = fs.get_file_info(inner)
        if info.type == arrow_fs.FileType.NotFound:
            raise FileNotFoundError(path)
        if info.type == arrow_fs.FileType.Directory:
            files = walked(fs, inner, True, lambda p: p.endswith(ending))
        else:
            files = [(info.path, info.size or 0)] if info.type == arrow_fs.FileType.File else ()
    for found, size in files:
        yield Found(prefix + found, size)


def listed(path: str, ending: str = "") -> list[Found]:
    """The files of ``scanned`` in the order of their paths."""
    return sorted(scanned(path, ending), key=lambda f: f.path)


def _emptied(folder: str) -> None:
    """Removes a local folder, of which nothing is listed, as a folder may have millions of files."""
    while True:
        gone = 0
        with os.scandir(folder) as entries:
            for entry in entries:
                gone += 1
                if entry.is_dir(follow_symlinks=False):
                    _emptied(entry.path)
                else:
                    os.unlink(entry.path)
        try:
            return os.rmdir(folder)
        except OSError:  # while files go, a store may pass over others
            if not gone:
                raise


def drop(path: str) -> None:
    """Removes a folder and what is in it, if it is there."""
    fs, inner = opened(path)
    if fs.get_file_info(inner).type == arrow_fs.FileType.Directory:
        _emptied(inner) if isinstance(fs, arrow_fs.LocalFileSystem) else fs.delete_dir(inner)
