"""Packing of documents into token sequences: concatenate and cut.

1. Every task encodes its documents once and writes their ids, each with the number of tokens before it in its task, as a table in the shared folder; a
   lost executor loses none of it, and a task that runs again replaces what it wrote.
2. The tasks' token totals (one number a task of the first pass, 16 bytes each) are added up on the driver; with them every document has its place in the
   concatenation of all documents.
3. Windows of fixed size cut the concatenation: a document's pieces follow from its place alone, without a shuffle. Where whole sequences are asked for,
   those that lie in one stretch of a task are put together there, and only boundary records, of sequences that two tasks share, meet in a shuffle.

A document is its ids and then id 0. Every sequence but the last is full; a sequence that is not full is padded to its size unless the number of its
tokens is a power of two. Documents follow each other in the order of the tasks that encoded them, not of their ids.

Rows: a null or empty text is id 0 alone. Repeated rows are packed each; a null id stays null. An empty table gives an empty result. Texts of any length
are encoded whole; their ids are stored in runs of at most RUN, at which pieces end too. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradelake.llm.bpe import read, vocabulary
from gradelake.llm.pieces import piece_coder
from gradelake.llm.shared import fresh_dir, release
from gradelake.llm.textcore import column

SIZE, END = 1024, 0
#: Ids of a stored row, and bytes of ids of a batch, at most.
RUN, BATCH_BYTES = 1 << 20, 4 << 20
ROWS = "doc_id {0}, part int, before long, start long, n long, doc_tokens long, ids binary"


def padded(tokens: int, size: int = SIZE) -> int:
    """The length of a sequence of so many tokens after padding."""
    return tokens if tokens & (tokens - 1) == 0 else size


def encoded(docs: DataFrame, path: str, end: int = END) -> DataFrame:
    """First pass: the stored ids of all documents, in runs. A row holds its task (part), the tokens of the task before it, and its place in the document."""
    shared = docs.sparkSession.sparkContext.broadcast(read(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = piece_coder(shared.value)
        kind = "<u2" if max(coder.largest, end) < 1 << 16 else "<u4"
        part, before, rows, held = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            ids_of = coder.encode(column(batch, "text"))
            for at, ids in enumerate(ids_of):
                ids = np.append(ids, end).astype(kind)
                for start in range(0, len(ids), RUN):
                    chunk = ids[start : start + RUN]
                    rows.append((at, part, before, start, len(chunk), len(ids), chunk.tobytes()))
                    before += len(chunk)
                    held += chunk.nbytes
                    if held > BATCH_BYTES:
                        yield written(column(batch, "doc_id"), rows)
                        rows, held = [], 0
            if rows:
                yield written(column(batch, "doc_id"), rows)
            rows, held = [], 0
        release()

    def written(keys: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        kinds = [pa.int32(), *[pa.int64()] * 4, pa.binary()]
        return pa.RecordBatch.from_arrays([keys.take(pa.array(columns[0])), *map(pa.array, columns[1:], kinds)], ["doc_id", "part", "before", "start", "n", "doc_tokens", "ids"])

    folder = fresh_dir(docs.sparkSession, "packing")
    table = docs.select("doc_id", "text").mapInArrow(run, ROWS.format(docs.schema["doc_id"].dataType.simpleString()))
    table.write.option("compression", "zstd").parquet(folder)
    return docs.sparkSession.read.parquet(folder)


def offsets(table: DataFrame) -> dict[int, int]:
    """Second pass: the tokens before each part, from the parts' totals."""
    totals = sorted((r.part, r.tokens) for r in table.groupBy("part").agg(F.sum("n").alias("tokens")).collect())
    ends = np.cumsum([n for _, n in totals], dtype=np.int64)
    return {part: int(end) - n for (part, n), end in zip(totals, ends, strict=True)}


def unpacked(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, f"<u{len(raw) // n}").astype("<u4")


def runs(batches: Iterator[pa.RecordBatch], base: dict[int, int]) -> Iterator[tuple[object, int, int, int, np.ndarray]]:
    """doc_id, place in the document, tokens of the document, place in the concatenation and ids of each stored row."""
    for batch in batches:
        for r in batch.to_pylist():
            yield r["doc_id"], r["start"], r["doc_tokens"], base[r["part"]] + r["before"], unpacked(r["ids"], r["n"])


def cuts(place: int, n: int, size: int) -> Iterator[tuple[int, int]]:
    """Bounds, within a run of n tokens at ``place``, of the pieces that fixed windows cut it into."""
    at = 0
    while at < n:
        end = min(n, at + size - (place + at) % size)
        yield at, end
        at = end


def pieces(table: DataFrame, size: int = SIZE) -> DataFrame:
    """One row a piece of a document: where it starts in the document, and where it stands in which sequence."""
    shared = table.sparkSession.sparkContext.broadcast(offsets(table))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        kind = None

        def written() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:])], names)

        for batch in batches:
            kind = column(batch, "doc_id").type
            for doc, start, tokens, place, ids in runs(iter([batch]), shared.value):
                for a, b in cuts(place, len(ids), size):
                    rows.append((doc, start + a, b - a, zlib.crc32(ids[a:b]), tokens, (place + a) // size, (place + a) % size))
                if len(rows) > 10_000:
                    yield written()
                    rows = []
            if rows:
                yield written()
            rows = []
        release()

    kind = table.schema["doc_id"].dataType.simpleString()
    return table.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{x} long" for x in names[1:]))


def sequences(table: DataFrame, size: int = SIZE, pad: int = END) -> DataFrame:
    """sequence_id, n_tokens and ids (padded) of every sequence."""
    spark = table.sparkSession
    shared = spark.sparkContext.broadcast(offsets(table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        first = then = 0
        rows: list[tuple[int, int, bytes]] = []

        def close() -> None:
            nonlocal held
            if held:
                rows.append((first // size, first % size, np.concatenate(held).tobytes()))
                held = []

        def written() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(list(map(pa.array, zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.binary()))), ["sequence_id", "offset", "ids"])

        for _, _, _, place, ids in runs(batches, shared.value):
            for a, b in cuts(place, len(ids), size):
                if place + a != then or then % size == 0:
                    close()
                    first = place + a
                held.append(ids[a:b])
                then = place + b
            if len(rows) > 1000:
                yield written()
                rows.clear()
        close()
        if rows:
            yield written()
        release()

    folder = fresh_dir(spark, "sequences")
    table.mapInArrow(run, "sequence_id long, offset int, ids binary").write.option("compression", "zstd").parquet(folder)
    found = spark.read.parquet(folder)
    full = F.length("ids") == 4 * size
    boundary = found.where(~full).groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))  # of at most ``size`` tokens
    whole = found.where(full).select("sequence_id", F.array(F.struct("offset", "ids")).alias("parts")).unionByName(boundary)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = [np.frombuffer(b"".join(p["ids"] for p in parts), "<u4") for parts in column(batch, "parts").to_pylist()]
            filled = [np.r_[t, np.full(padded(len(t), size) - len(t), pad, np.uint32)].astype(np.int64) for t in tokens]
            yield pa.RecordBatch.from_arrays([column(batch, "sequence_id"), pa.array(list(map(len, tokens)), pa.int32()), pa.array(filled, pa.list_(pa.int64()))], ["sequence_id", "n_tokens", "ids"])
        release()

    return whole.mapInArrow(finish, "sequence_id long, n_tokens int, ids array<long>")


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces(encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary()))
