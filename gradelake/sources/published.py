"""Folders that are published whole: versions beside each other, and a pointer that is switched last.

A version is written under a name of its own and marked when it is complete; then the pointer ``CURRENT`` is replaced by one rename, so that a reader sees
the version before or the new one and never a part. A writer that dies between two steps leaves the version before in place. Where the pointer is gone, or
names a version that is not complete, readers fall back to the newest complete one. Old versions go only after the switch, at the next publication at the
latest. One writer at a time publishes into a folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MARK, POINTER = "_COMPLETE", "CURRENT"


def _path(spark: SparkSession, name: str):
    return spark._jvm.org.apache.hadoop.fs.Path(name)


def _files(spark: SparkSession, name: str):
    return _path(spark, name).getFileSystem(spark._jsc.hadoopConfiguration())


def _write(spark: SparkSession, name: str, text: str) -> None:
    out = _files(spark, name).create(_path(spark, name), True)
    try:
        out.write(bytearray(text.encode()))
        out.hsync()
    finally:
        out.close()


def _read(spark: SparkSession, name: str) -> str | None:
    files = _files(spark, name)
    if not files.exists(_path(spark, name)):
        return None
    stream = files.open(_path(spark, name))
    try:
        return bytes(stream.readAllBytes()).decode(errors="replace").strip()
    finally:
        stream.close()


def _switch(spark: SparkSession, folder: str, version: str) -> None:
    """The pointer replaced by one rename over it."""
    aside = f"{folder}/.{POINTER}.{uuid.uuid4().hex}"
    _write(spark, aside, version)
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(_path(spark, folder).toUri(), spark._jsc.hadoopConfiguration()) if _path(spark, folder).toUri().getScheme() else spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(spark._jsc.hadoopConfiguration())
    overwrite = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(_path(spark, aside), _path(spark, f"{folder}/{POINTER}"), overwrite)


def _complete(spark: SparkSession, folder: str) -> list[str]:
    """Names of the complete versions, the newest first."""
    files = _files(spark, folder)
    if not files.exists(_path(spark, folder)):
        return []
    names = [s.getPath().getName() for s in files.listStatus(_path(spark, folder)) if s.isDirectory()]
    numbered = [n for n in names if n.startswith("v=") and n[2:].isdigit() and files.exists(_path(spark, f"{folder}/{n}/{MARK}"))]
    return sorted(numbered, key=lambda n: -int(n[2:]))


def versions(spark: SparkSession, folder: str) -> list[str]:
    """Folders of the complete versions: the one that the pointer names, then older and other ones."""
    folder = folder.rstrip("/")
    found, told = _complete(spark, folder), _read(spark, f"{folder}/{POINTER}")
    if told in found:
        found = [told, *(n for n in found if n != told)]
    return [f"{folder}/{n}" for n in found]


def current(spark: SparkSession, folder: str) -> str | None:
    """The folder of the version that readers are to take."""
    found = versions(spark, folder)
    return found[0] if found else None


def publish(spark: SparkSession, folder: str, write: Callable[[str], None], keep: int = 2) -> str:
    """``write`` fills a new version's folder, which then becomes the current one; the newest ``keep`` complete versions stay. Gives the version's folder."""
    if keep < 1:
        raise ValueError("at least the current version stays")
    folder, files = folder.rstrip("/"), _files(spark, folder)
    files.mkdirs(_path(spark, folder))
    taken = [int(s.getPath().getName()[2:]) for s in files.listStatus(_path(spark, folder)) if s.getPath().getName()[:2] == "v=" and s.getPath().getName()[2:].isdigit()]
    name = f"v={max(taken, default=0) + 1:08d}"
    write(f"{folder}/{name}")
    _write(spark, f"{folder}/{name}/{MARK}", name)
    _switch(spark, folder, name)
    for old in taken:  # what an interrupted writer left goes too
        stale = f"v={old:08d}"
        if stale not in _complete(spark, folder)[:keep]:
            files.delete(_path(spark, f"{folder}/{stale}"), True)
    return f"{folder}/{name}"


def publish_tables(spark: SparkSession, folder: str, tables: dict[str, DataFrame], keep: int = 2) -> str:
    """Tables published together, such as a validator's state; none is seen without the others."""

    def write(aside: str) -> None:
        for name, df in tables.items():
            df.write.parquet(f"{aside}/{name}")

    return publish(spark, folder, write, keep)


def read_tables(spark: SparkSession, folder: str, schemas: dict[str, str]) -> dict[str, DataFrame] | None:
    """The current version's tables with the given schemas, or None where nothing was published yet."""
    now = current(spark, folder)
    return None if now is None else {name: spark.read.schema(kind).parquet(f"{now}/{name}") for name, kind in schemas.items()}
