"""Python data sources that scan a seeded part of Parquet or JSONL files: whole row groups, or whole byte blocks.

Options: ``paths`` (JSON list), ``seed``, ``name``; for Parquet also ``columns`` (JSON list). Rows carry ``block_ord`` (the block's place in the seeded
order) and ``pos`` (the row's place in its block). A line of JSONL that crosses the border of two blocks is in neither; bad lines are skipped.

A block is a partition. ``first`` and ``last`` (exclusive) bound the blocks that are planned at all: none outside is opened, and of Parquet files
behind the last block not even the footer is read, so that a reader that goes on where it stopped reads nothing twice. With the option ``push``
comparisons of block_ord with numbers are pushed down to the same bounds; Spark then wants spark.sql.python.filterPushdown.enabled, and ``scan`` follows
that setting.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from gradelake.config import PROTOCOL

BLOCK = 1 << 20
MAX_FILES, MAX_GROUPS = 512, 4_096


def partial_count(total: int) -> int:
    """How many of ``total`` blocks are scanned: nine tenths, but one at least, and never all of several."""
    return 1 if total == 1 else min(total - 1, max(1, total * PROTOCOL.scan_bps // 10_000))


def seeded_order(items: list, seed: str, name: str, kind: str) -> list:
    """Items by a hash of their canonical JSON; no library's random numbers are involved."""

    def key(item) -> str:
        raw = {"domain": PROTOCOL.domain, "item": item, "kind": kind, "seed": seed, "source": name}
        return hashlib.sha256(json.dumps(raw, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()

    return sorted(items, key=key)


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


@dataclass
class Block(InputPartition):
    path: str
    part: int
    ord: int


class _Sampled(DataSource):
    def _option(self, name: str, default: str | None = None) -> str:
        found = self.options.get(name, default)
        if found is None:
            raise ValueError(f"option {name} is missing")
        return found

    @property
    def paths(self) -> list[str]:
        found = json.loads(self._option("paths"))
        if not 0 < len(found) <= MAX_FILES:
            raise ValueError(f"{len(found)} files; 1 to {MAX_FILES} are allowed")
        return found


    @property
    def bounds(self) -> tuple[int, int | None]:
        first, last = int(self._option("first", "0")), self.options.get("last")
        if first < 0 or last is not None and int(last) < first:
            raise ValueError(f"no range of blocks: {first} to {last}")
        return first, None if last is None else int(last)

    @property
    def pushes(self) -> bool:
        return self._option("push", "false").lower() == "true"


class _BlockReader(DataSourceReader):
    """Plans the blocks of ``order()`` whose place lies within the bounds, and stops asking for more behind the last one."""

    first: int
    last: int | None

    def order(self) -> Iterator[tuple[str, int]]:
        """Path and number of each scanned block, in the seeded order."""
        raise NotImplementedError

    def partitions(self) -> list[Block]:
        out: list[Block] = []
        if self.last is None or self.first < self.last:
            for n, (path, part) in enumerate(self.order()):
                if n >= self.first:
                    out.append(Block(path, part, n))
                if self.last is not None and n + 1 >= self.last:
                    break
        # Without any partition Spark would fail; this one opens nothing.
        return out or [Block("", -1, -1)]


class _Pushing:
    """Comparisons of block_ord as bounds of a reader."""

    def narrow(self, first: int, last: int) -> None:
        self.first = max(self.first, first)
        self.last = last if self.last is None else min(self.last, last)

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            value = getattr(f, "value", None)
            if getattr(f, "attribute", None) != ("block_ord",) or value is None:
                yield f
            elif isinstance(f, EqualTo):
                self.narrow(value, value + 1)
            elif isinstance(f, In) and value and None not in value:
                self.narrow(min(value), max(value) + 1)
                yield f  # Spark drops the blocks between
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.first = max(self.first, value + isinstance(f, GreaterThan))
            elif isinstance(f, (LessThan, LessThanOrEqual)):
                self.narrow(0, value + isinstance(f, LessThanOrEqual))
            else:
                yield f


class RowGroups(_Sampled):
    """Seeded row groups of seeded files, only the columns asked for."""

    @classmethod
    def name(cls) -> str:
        return "sampled_parquet"

    def schema(self) -> str:
        source, path = opened(self.paths[0])
        with source.open_input_file(path) as f:
            fields = pq.ParquetFile(f).schema_arrow
        from pyspark.sql.pandas.types import from_arrow_type

        own = [f"`{c}` {from_arrow_type(fields.field(c).type).simpleString()}" for c in json.loads(self._option("columns"))]
        return ", ".join([*own, "block_ord long", "pos long"])

    def reader(self, schema) -> DataSourceReader:
        kind = _PushingRowGroupReader if self.pushes else _RowGroupReader
        return kind(self.paths, self._option("seed"), self._option("name", "source"), json.loads(self._option("columns")), *self.bounds)


class _RowGroupReader(_BlockReader):
    def __init__(self, paths: list[str], seed: str, name: str, columns: list[str], first: int, last: int | None) -> None:
        self.paths, self.seed, self.name, self.columns, self.first, self.last = paths, seed, name, columns, first, last

    def order(self) -> Iterator[tuple[str, int]]:
        files = seeded_order(self.paths, self.seed, self.name, "file")
        for path in files[: partial_count(len(files))]:
            source, inner = opened(path)
            with source.open_input_file(inner) as f:
                groups = pq.ParquetFile(f).num_row_groups
            if not 0 < groups <= MAX_GROUPS:
                raise ValueError(f"{path} has {groups} row groups; 1 to {MAX_GROUPS} are allowed")
            yield from map(tuple, seeded_order([[path, g] for g in range(groups)], self.seed, self.name, "row_group")[: partial_count(groups)])

    def read(self, block: Block) -> Iterator[pa.RecordBatch]:
        if block.part < 0:
            return
        source, inner = opened(block.path)
        with source.open_input_file(inner) as f:
            at = 0
            for batch in pq.ParquetFile(f).iter_batches(row_groups=[block.part], columns=self.columns):
                n = batch.num_rows
                extra = [pa.array([block.ord] * n, pa.int64()), pa.array(range(at, at + n), pa.int64())]
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in self.columns] + extra, [*self.columns, "block_ord", "pos"])
                at += n


class _PushingRowGroupReader(_Pushing, _RowGroupReader):
    pass


def block_lines(raw: bytes, before: bytes, last: bool) -> list[bytes]:
    """The whole lines of a byte block: a leading part of a line goes, and a trailing one unless the file ends with it."""
    if before and before != b"\n":
        _, found, raw = raw.partition(b"\n")
        if not found:
            return []
    if not last and not raw.endswith(b"\n"):
        raw = raw[: raw.rfind(b"\n") + 1]
    return raw.split(b"\n")


class ByteBlocks(_Sampled):
    """Seeded byte blocks of JSONL files; a row is the JSON text of one object."""

    @classmethod
    def name(cls) -> str:
        return "sampled_jsonl"

    def schema(self) -> str:
        return "value string, block_ord long, pos long"

    def reader(self, schema) -> DataSourceReader:
        kind = _PushingByteBlockReader if self.pushes else _ByteBlockReader
        return kind(self.paths, self._option("seed"), self._option("name", "source"), int(self._option("block", str(BLOCK))), *self.bounds)


class _ByteBlockReader(_BlockReader):
    def __init__(self, paths: list[str], seed: str, name: str, size: int, first: int, last: int | None) -> None:
        self.paths, self.seed, self.name, self.size, self.first, self.last = paths, seed, name, size, first, last

    def order(self) -> Iterator[tuple[str, int]]:
        every = []
        for path in self.paths:
            source, inner = opened(path)
            every += [[path, i] for i in range(-(-source.get_file_info(inner).size // self.size))]
        if every:
            yield from map(tuple, seeded_order(every, self.seed, self.name, "block")[: partial_count(len(every))])

    def read(self, block: Block) -> Iterator[pa.RecordBatch]:
        if block.part < 0:
            return
        source, inner = opened(block.path)
        start = block.part * self.size
        with source.open_input_file(inner) as f:
            f.seek(max(0, start - 1))
            before = f.read(1) if start else b""
            raw = f.read(self.size)
            last = start + len(raw) >= f.size()
        rows = []
        for line in block_lines(raw, before, last):
            try:
                if isinstance(json.loads(line), dict):
                    rows.append(line.decode())
            except ValueError:
                continue
        n = len(rows)
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string()), pa.array([block.ord] * n, pa.int64()), pa.array(range(n), pa.int64())], ["value", "block_ord", "pos"])


class _PushingByteBlockReader(_Pushing, _ByteBlockReader):
    pass


def register(spark) -> None:
    spark.dataSource.register(RowGroups)
    spark.dataSource.register(ByteBlocks)


KINDS = {"parquet": "sampled_parquet", "jsonl": "sampled_jsonl"}


def _options(kind: str, paths: list[str], seed: str, name: str, columns: list[str] | None, block: int | None) -> dict[str, str]:
    if kind not in KINDS:
        raise ValueError(f"unknown kind of source: {kind!r}")
    out = {"paths": json.dumps(paths), "seed": seed, "name": name}
    if kind == "parquet":
        return out | {"columns": json.dumps(columns)}
    return out | ({} if block is None else {"block": str(block)})


def scan(spark, kind: str, paths: list[str], seed: str, name: str, columns: list[str] | None = None, first: int = 0, last: int | None = None, block: int | None = None):
    """The seeded scan of a source by its kind, of its blocks from ``first`` to before ``last``; an unknown kind is an error."""
    options = _options(kind, paths, seed, name, columns, block)
    push = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    reader = spark.read.format(KINDS[kind]).options(**options, first=str(first), push=push)
    return (reader if last is None else reader.option("last", str(last))).load()


def blocks(kind: str, paths: list[str], seed: str, name: str, columns: list[str] | None = None, block: int | None = None) -> int:
    """How many blocks the whole seeded scan of a source has; only footers and sizes are read."""
    source = {"parquet": RowGroups, "jsonl": ByteBlocks}
    options = _options(kind, paths, seed, name, columns, block)
    return sum(1 for _ in source[kind](options).reader(None).order())


def describe(kind: str, name: str, revision: str, paths: list[str], columns: list[str] | None = None) -> dict:
    """A source's row in a manifest; only row groups are read by columns."""
    out = {"name": name, "kind": kind, "revision": revision, "files": list(paths)}
    return out | {"columns": list(columns or [])} if kind == "parquet" else out
