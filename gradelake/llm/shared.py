"""Folders that driver and executors share, checkpoints, and grouped iteration over sorted Arrow batches."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SALTS = 8


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, a local one is made and set on a local master, and on a cluster it is an error."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='gradelake-')}"
        context.setCheckpointDir(found)
    return found


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder: a lost executor loses none of it, and its lineage ends here."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, of which a later scan reads only the columns that it needs."""
    folder = fresh_dir(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def salted(df: DataFrame, small: DataFrame, keys: list[str], by: str, how: str = "inner") -> DataFrame:
    """df joined with ``small`` (a row a key); the rows of each key are dealt over SALTS tasks by a hash of the column ``by``."""
    many = small.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = df.withColumn("salt_", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    return dealt.join(many, [*keys, "salt_"], how).drop("salt_")


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def write_file(folder: str, name: str, raw: bytes) -> None:
    """A file of a shared folder that appears under its name only when it is complete; a task that runs again replaces it."""
    source, path = filesystem(folder)
    source.create_dir(path, recursive=True)
    part = f"{path}/.{uuid.uuid4().hex}"
    with source.open_output_stream(part) as f:
        f.write(raw)
    source.move(part, f"{path}/{name}")


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys from batches sorted by them; a run may span batches."""
    held: list[pa.RecordBatch] = []
    held_key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        change = None
        for k in keys:
            col = table.column(k).combine_chunks()
            col = col.chunk(0) if isinstance(col, pa.ChunkedArray) else col
            differs = pc.fill_null(pc.not_equal(col.slice(1), col.slice(0, len(col) - 1)), True)
            change = differs if change is None else pc.or_(change, differs)
        ends = [i + 1 for i in pc.indices_nonzero(change).to_pylist()] + [batch.num_rows]
        start = 0
        for end in ends:
            part = batch.slice(start, end - start)
            key = tuple(part.column(part.schema.get_field_index(k))[0].as_py() for k in keys)
            if held and key != held_key:
                yield pa.Table.from_batches(held)
                held = []
            held, held_key, start = [*held, part], key, end
    if held:
        yield pa.Table.from_batches(held)


def portions(batches: Iterator[pa.RecordBatch], name: str, size: int) -> Iterator[list[pa.RecordBatch]]:
    """Runs of batches whose columns ``name`` have at least ``size`` bytes together, but for the last run."""
    held, have = [], 0
    for batch in batches:
        held.append(batch)
        have += batch.column(batch.schema.get_field_index(name)).nbytes
        if have >= size:
            yield held
            held, have = [], 0
    if held:
        yield held


def release() -> None:
    """Gives a Python worker's free memory back to the system at the end of a task; workers live on idle beside the next stage."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):  # another C library, without this call
            pass
