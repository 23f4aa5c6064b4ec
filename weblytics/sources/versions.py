"""Versions of a stored thing (a model, a table) under one root folder.

A writer writes a whole version into a folder of its own and then adds one
numbered marker that names it; readers follow the highest complete marker.  So

* a writer that dies leaves the version before it in force;
* a reader that has opened a version keeps its files while others replace it;
* creating fails if a version is present: marker 1 is made exclusively, so of two
  creators one succeeds;
* a ledger (``add_once``) admits every run id once.

A marker is created without overwriting and its text ends with a line feed; one
without it belongs to a writer that died and counts for nothing.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import SparkSession

from ..session import file_system


class AlreadyPresent(Exception):
    """A version (or run) of that name is already there."""


def _create(spark: SparkSession, path: str, text: str) -> None:
    """Make a small file; ``AlreadyPresent`` if it exists."""
    fs, jpath = file_system(spark, path)
    if fs.getUri().getScheme() == "file":
        # Hadoop's local files are made in two steps (look, then open): two writers
        # could both pass the first one
        fs.mkdirs(jpath.getParent())
        try:
            with open(jpath.toUri().getPath(), "x", encoding="utf-8") as out:
                out.write(f"{text}\n")
        except FileExistsError as e:
            raise AlreadyPresent(path) from e
        return
    try:
        out = fs.create(jpath, False)
    except Exception as e:
        if fs.exists(jpath):
            raise AlreadyPresent(path) from e
        raise
    try:
        out.write(bytearray(f"{text}\n", "utf-8"))
    finally:
        out.close()


def _read(spark: SparkSession, path: str) -> str | None:
    """Text of a complete marker, else None."""
    fs, jpath = file_system(spark, path)
    size = int(fs.getFileStatus(jpath).getLen())
    stream = fs.open(jpath)
    try:
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8") if size else ""
    finally:
        stream.close()
    return text[:-1] if text.endswith("\n") else None


def _files(spark: SparkSession, folder: str) -> list[str]:
    fs, jpath = file_system(spark, folder)
    if not fs.exists(jpath):
        return []
    return sorted(f.getPath().getName() for f in fs.listStatus(jpath) if f.isFile()
                  and not f.getPath().getName().startswith("."))


def new_folder(root: str) -> str:
    """A folder for the next version's files."""
    return f"{root}/versions/{uuid.uuid4().hex}"


def numbers(spark: SparkSession, root: str) -> list[int]:
    return [int(n) for n in _files(spark, f"{root}/markers")]


def current(spark: SparkSession, root: str) -> str | None:
    """Folder of the version in force, or None."""
    for n in reversed(numbers(spark, root)):
        name = _read(spark, f"{root}/markers/{n:010d}")
        if name:
            return f"{root}/versions/{name}"
    return None


def commit(spark: SparkSession, root: str, folder: str, replace: bool = True) -> None:
    """Put a written version in force."""
    name = folder.rsplit("/", 1)[1]
    if not replace:
        if current(spark, root) is not None:
            raise AlreadyPresent(root)
        _create(spark, f"{root}/markers/{1:010d}", name)
        return
    while True:
        at = max(numbers(spark, root), default=0) + 1
        try:
            return _create(spark, f"{root}/markers/{at:010d}", name)
        except AlreadyPresent:      # another writer was faster: ours comes after it
            continue


def add_once(spark: SparkSession, root: str, run_id: str, folder: str) -> bool:
    """Enter a written folder for a run; False if that run is entered already."""
    key = hashlib.sha256(run_id.encode()).hexdigest()
    try:
        _create(spark, f"{root}/ledger/{key}", folder.rsplit("/", 1)[1])
    except AlreadyPresent:
        if _read(spark, f"{root}/ledger/{key}") is not None:
            return False
        # its writer died between making and filling the marker
        fs, jpath = file_system(spark, f"{root}/ledger/{key}")
        fs.delete(jpath, False)
        return add_once(spark, root, run_id, folder)
    return True


def entered(spark: SparkSession, root: str) -> list[str]:
    """Folder names of all runs of the ledger."""
    names = (_read(spark, f"{root}/ledger/{n}") for n in _files(spark, f"{root}/ledger"))
    return [n for n in names if n]
