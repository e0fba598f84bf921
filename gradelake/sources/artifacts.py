"""JSONL files and rollout bundles: exact readers that fail on the first wrong line, ordered writers with their hash.

Files are read in blocks of bytes, a task a block: a first pass counts the lines that start in each block, and with these counts every line has its number
in the file whichever task reads it (``numbered_lines``). A line belongs to the block in which it starts. Writers are one task a file, since a file's hash is
one sequence of bytes (8 GiB at most by protocol).
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradelake.config import PROTOCOL, Protocol
from gradelake.functions import native as N
from gradelake.functions import scalars as S
from gradelake.sources.sampled import opened

# Limits of a rollout file, of its lines and of its manifest in bytes, and the manifest's fields.
MAX_FILE, MAX_LINE, MAX_MANIFEST = 8 << 30, 256 << 10, 64 << 10
MANIFEST = {
    "hotkey": str, "model_repo": str, "model_revision": str, "digest": str, "window": int, "evaluation_seed": str, "evaluation_root": str, "row_count": int, "rows_sha256": str,
    "base_model": str, "base_revision": str, "max_output_tokens": int, "protocol": str,
}
PIECE = 1 << 20
#: Bytes of a block of a file that one task reads, and tasks of a pass at most (each then has several blocks).
BLOCK, MAX_TASKS = 8 << 20, 4_096


def _block_lines(f, start: int, end: int, limit: int | None) -> Iterator[bytes]:
    """The lines, without their line feeds, that start in [start, end) of an open file; of a line over ``limit`` bytes a beginning that is still over it."""
    f.seek(max(0, start - 1))
    at, held, skip = start, b"", start > 0 and f.read(1) != b"\n"  # skip: the block begins within a line of an earlier one
    while at < end or held or (skip and at < end):
        piece = f.read(min(PIECE, end - at) if at < end else 4096)
        if not piece:
            break
        parts, begins = piece.split(b"\n"), at
        for k, part in enumerate(parts[:-1]):
            if skip:
                skip = False
            elif k or held or begins < end:
                yield held + part
            held, begins = b"", begins + len(part) + 1
            if begins >= end:
                return
        at += len(piece)
        if not skip:
            held += parts[-1]
        if limit is not None and len(held) > limit:
            yield held
            return
        if skip and at >= end:
            return
    if held:
        yield held


def _starts(f, start: int, end: int) -> int:
    """How many lines start in [start, end)."""
    f.seek(max(0, start - 1))
    left, n = end - max(1, start), int(start == 0 and end > 0)
    while left > 0 and (piece := f.read(min(PIECE, left))):
        n += piece.count(b"\n")
        left -= len(piece)
    return n


def numbered_lines(spark: SparkSession, path: str, limit: int | None = None, block: int = BLOCK) -> DataFrame:
    """line (from 1), value (bytes without the line feed) of a file; lines over ``limit`` bytes are errors. The blocks' line counts, a number a block, pass the driver."""
    source, inner = opened(path)
    size = source.get_file_info(inner).size
    if size is None:
        raise FileNotFoundError(path)
    n = max(1, -(-size // block))
    blocks = spark.range(0, n, 1, min(n, MAX_TASKS))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, inner = opened(path)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            with source.open_input_file(inner) as f:
                counts = [_starts(f, b * block, min(size, (b + 1) * block)) for b in ids]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(counts, pa.int64())], ["id", "n"])

    counts = dict(map(tuple, blocks.mapInArrow(count, "id long, n long").collect()))
    before, total = {}, 0
    for b in range(n):
        before[b], total = total, total + counts[b]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, inner = opened(path)
        for batch in batches:
            for b in batch.column(0).to_pylist():
                with source.open_input_file(inner) as f:
                    first, rows, have = before[b] + 1, [], 0
                    for line in _block_lines(f, b * block, min(size, (b + 1) * block), limit):
                        if limit is not None and len(line) >= limit:  # its line feed counts
                            raise ValueError(f"line {first + len(rows)} has over {limit} bytes")
                        rows.append(line)
                        have += len(line)
                        if have > PIECE:
                            yield pa.RecordBatch.from_arrays([pa.array(range(first, first + len(rows)), pa.int64()), pa.array(rows, pa.binary())], ["line", "value"])
                            rows, first, have = [], first + len(rows), 0
                    yield pa.RecordBatch.from_arrays([pa.array(range(first, first + len(rows)), pa.int64()), pa.array(rows, pa.binary())], ["line", "value"])

    return blocks.mapInArrow(run, "line long, value binary")


BLANK = r"\A[\x09-\x0d\x1c-\x20\x85]*\z"


def load_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a schema with row_id; blank lines are passed over, and a row without an id is called after its line (blank ones counted)."""
    rows = numbered_lines(spark, path).select("line", F.decode("value", "utf-8").alias("text")).where(~F.col("text").rlike(BLANK))
    rows = rows.select("line", F.from_json("text", schema, {"mode": "FAILFAST"}).alias("x"), F.get_json_object("text", "$.row_id").alias("id"))
    cols = [c for c in rows.select("x.*").columns if c != "row_id"]
    return rows.select(F.coalesce("id", F.concat(F.lit("row-"), F.col("line"))).alias("row_id"), *[F.col("x")[c].alias(c) for c in cols], "line")


def load_exact(spark: SparkSession, path: str) -> DataFrame:
    """line and text of the objects of a file; any other line that is not blank is an error."""
    rows = numbered_lines(spark, path).select("line", F.decode("value", "utf-8").alias("text")).where(~F.col("text").rlike(BLANK))
    kind = F.schema_of_variant(F.try_parse_json("text"))
    return rows.select("line", N.demand(kind.startswith("OBJECT"), F.col("text"), "a line is no JSON object").alias("text"))


def rollout_row(raw: bytes, most: int, vocabulary: int | None) -> dict:
    """A strict rollout row: exactly row_id and tokens (older rows also have three more, which are left out), ids of their form, tokens in range."""
    found = S.strict_json(raw, MAX_LINE)
    if not isinstance(found, dict) or set(found) not in ({"row_id", "tokens"}, {"row_id", "tokens", "finish_reason", "stop_reason", "max_tokens"}):
        raise ValueError("a rollout row has unknown or missing fields")
    name, tokens = found["row_id"], found["tokens"]
    if not isinstance(name, str) or not re.search(S.ROW_ID.replace(r"\z", r"\Z"), name):
        raise ValueError("a rollout has a row_id of another form")
    if not isinstance(tokens, list) or len(tokens) > most:
        raise ValueError(f"rollout {name} has no list of at most {most} tokens")
    if any(type(t) is not int or t < 0 or (vocabulary is not None and t >= vocabulary) for t in tokens):
        raise ValueError(f"rollout {name} has a token that is no id of the vocabulary")
    return {"row_id": name, "tokens": tokens}


def load_rollouts(spark: SparkSession, path: str, most: int | None = None, vocabulary: int | None = None, protocol: Protocol = PROTOCOL) -> DataFrame:
    """pos, row_id, tokens of a rollout file. Blank lines, rows of another form, long lines and large files are errors."""
    source, inner = opened(path)
    if source.get_file_info(inner).size > MAX_FILE:
        raise ValueError(f"over {MAX_FILE} bytes of rollouts")
    most = protocol.max_context if most is None else most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for line, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not raw.strip():
                    raise ValueError(f"line {line} is blank")
                rows.append(rollout_row(raw, most, vocabulary) | {"pos": line - 1})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("pos", pa.int64()), ("row_id", pa.string()), ("tokens", pa.list_(pa.int32()))]))

    return numbered_lines(spark, path, MAX_LINE).mapInArrow(run, "pos long, row_id string, tokens array<int>")


class _Hashed:
    """A file that appears under its name when complete, with the SHA-256 of its bytes."""

    def __init__(self, path: str) -> None:
        self.source, self.path = opened(path)
        if isinstance(self.source, pafs.LocalFileSystem):
            self.source.create_dir(self.path.rpartition("/")[0] or ".", recursive=True)
        self.stream, self.hash, self.size = self.source.open_output_stream(f"{self.path}.part", compression=None), hashlib.sha256(), 0

    def write(self, raw: bytes) -> None:
        self.stream.write(raw)
        self.hash.update(raw)
        self.size += len(raw)

    def done(self) -> str:
        self.stream.close()
        self.source.move(f"{self.path}.part", self.path)
        return self.hash.hexdigest()


def _write_lines(df: DataFrame, order: str, path: str, most: int | None = None) -> tuple[str, int]:
    """Writes the column line of df in order as one file; its SHA-256 and number of lines. One task writes, since the bytes have one order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n = _Hashed(path), 0
        for batch in batches:
            for line in batch.column(0).to_pylist():
                raw = line.encode() + b"\n"
                if most is not None and len(raw) > MAX_LINE or most is not None and out.size + len(raw) > most:
                    raise ValueError("a line or the file is larger than the protocol allows")
                out.write(raw)
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([out.done()]), pa.array([n], pa.int64())], ["sha256", "n"])

    row = df.repartition(1).sortWithinPartitions(order).select("line").mapInArrow(run, "sha256 string, n long").first()
    return row.sha256, row.n


def write_rollouts(rollouts: DataFrame, path: str) -> tuple[str, int]:
    """Writes pos, row_id, tokens as canonical JSON lines in order of pos; the file's SHA-256 and its number of rows."""
    tokens = F.col("tokens")
    sound = F.col("row_id").rlike(S.ROW_ID) & F.forall(tokens, lambda t: t >= 0) & (F.size(tokens) <= PROTOCOL.max_context)
    line = F.concat(F.lit('{"row_id":"'), F.col("row_id"), F.lit('","tokens":['), F.array_join(F.transform(tokens, lambda t: t.cast("string")), ","), F.lit("]}"))
    return _write_lines(rollouts.select("pos", N.demand(sound, line, "a rollout row of another form").alias("line")), "pos", path, MAX_FILE)


def write_jsonl(df: DataFrame, order: str, path: str, ascii_only: bool = False) -> tuple[str, int]:
    """Writes the columns of df (without ``order``) as JSON lines with sorted keys; with ascii_only other characters become escapes, so no line splitter errs."""
    cols = sorted(c for c in df.columns if c != order)

    @F.pandas_udf("string")
    def line(x):
        return x.map(lambda t: json.dumps(json.loads(t), sort_keys=True, ensure_ascii=ascii_only))

    text = F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})
    return _write_lines(df.select(order, line(text).alias("line")), order, path)


def write_json(value, path: str) -> None:
    out = _Hashed(path)
    out.write(json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False).encode() + b"\n")
    out.done()


def read_bytes(path: str, limit: int) -> bytes:
    source, inner = opened(path)
    if source.get_file_info(inner).size > limit:
        raise ValueError(f"over {limit} bytes in {path}")
    with source.open_input_stream(inner, compression=None) as f:
        return f.read(limit + 1)


def file_sha256(path: str) -> str:
    source, inner = opened(path)
    found = hashlib.sha256()
    with source.open_input_stream(inner, compression=None) as f:
        while piece := f.read(PIECE):
            found.update(piece)
    return found.hexdigest()


def load_manifest(path: str, rows: int, protocol: Protocol = PROTOCOL) -> dict:
    """A rollout manifest: exactly its fields, each of its kind and form, for ``rows`` rows."""
    found = S.strict_json(read_bytes(path, MAX_MANIFEST), MAX_MANIFEST)
    if not isinstance(found, dict) or set(found) != set(MANIFEST):
        raise ValueError(f"fields that are missing or unknown: {sorted(set(found) ^ set(MANIFEST)) if isinstance(found, dict) else found!r}")
    if wrong := [k for k, kind in MANIFEST.items() if type(found[k]) is not kind]:
        raise ValueError(f"fields of another kind: {wrong}")
    for name, form in (("model_repo", S.REPO), ("model_revision", S.REVISION), ("digest", S.DIGEST), ("evaluation_seed", S.DIGEST), ("evaluation_root", S.DIGEST), ("rows_sha256", S.DIGEST)):
        S._form(form, found[name], name)
    if not 0 < len(found["hotkey"]) <= 128 or found["row_count"] != rows or found["window"] < 0 or not 0 < found["max_output_tokens"] <= protocol.max_context:
        raise ValueError("hotkey, number of rows, window or token limit is out of range")
    return found


def manifest_fault(manifest: dict, expected: dict) -> str | None:
    """The first field in which a manifest differs from what chain and evaluation tell."""
    return next((k for k in ("hotkey", "model_repo", "model_revision", "digest", "window", "evaluation_seed", "evaluation_root") if manifest.get(k) != expected.get(k)), None)


def load_bundle(spark: SparkSession, folder: str, evaluation: DataFrame, vocabulary: int | None = None) -> tuple[dict, DataFrame]:
    """(manifest, rollouts) of a bundle whose file has the stated hash and whose row ids are those of ``evaluation`` (pos, row_id) in order."""
    manifest = load_manifest(f"{folder}/manifest.json", evaluation.count())
    if file_sha256(f"{folder}/rollouts.jsonl") != manifest["rows_sha256"]:
        raise ValueError("the rollouts have another hash than their manifest tells")
    rows = load_rollouts(spark, f"{folder}/rollouts.jsonl", manifest["max_output_tokens"], vocabulary)
    other = evaluation.select("pos", F.col("row_id").alias("want")).join(rows.select("pos", "row_id"), "pos", "full_outer")
    if other.where(~F.col("want").eqNullSafe(F.col("row_id"))).limit(1).count():
        raise ValueError("the rollouts' rows differ from the evaluation's in number or order")
    return manifest, rows
