"""Line deduplication through a sharded minimal perfect hash.

A line's key is the line without white space ``[\\x20\\x09-\\x0D]`` at both ends and with A-Z lower-cased. Keys of at least ``min_chars``
code points that are found in at least ``min_docs`` documents lose all their lines except in the largest doc_id that holds them.

1. Every document emits its distinct long keys as two 64-bit hashes; Spark counts documents and takes the largest doc_id by key
   (a sum and a maximum, pre-aggregated before the shuffle, so that a line of a third of all documents is no hot spot).
2. Repeated keys are dealt by hash prefix to shards of bounded size. Each shard becomes a minimal perfect hash with compact arrays of
   fingerprints, counts and kept ids, written as one file into the shared folder; a lost executor loses no shard.
3. Documents probe the arrays; no line is joined. A task gathers the hashes of all lines of a portion of its documents and probes each shard once
   with them, those that the worker holds already first; a worker keeps its shards from task to task. So a task reads a shard at most once for every
   PORTION bytes of its texts, however many shards there are. The second 64-bit hash is the fingerprint, so a line that is not indexed passes with a
   chance of 2**-64.

Rows: a null or empty text is one empty line. A repeated row counts as a document of its own. Equal doc_ids keep their lines alike. A null
doc_id is smaller than every other. An empty table gives an empty result. Other columns are carried along, whatever their names.
"""

from __future__ import annotations

import hashlib
import io
from collections import OrderedDict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradelake.llm.shared import cut, filesystem, fresh_dir, grouped, portions, release, write_file
from gradelake.llm.textcore import LOWER, SPACE, column, mix, segments, span_hashes

MIN_CHARS, MIN_DOCS = 40, 5
#: Keys a shard, about (24 bytes each), bytes of shards that a worker holds at a time, and bytes of text (at least) whose lines probe together.
SHARD_KEYS, HELD_BYTES, PORTION = 200_000, 128 << 20, 48 << 20
NO_ID = np.iinfo(np.int64).min


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: at each level a key that has its slot for itself is settled, the others go on."""

    LEVELS, ROOM = 40, 2

    def __init__(self, keys: np.ndarray) -> None:
        self.bits, self.before, settled = [], [], 0
        rest = keys
        while len(rest) and len(self.bits) < self.LEVELS:
            size = max(64, self.ROOM * len(rest))
            slot = self.slot(rest, len(self.bits), size)
            alone = np.bincount(slot, minlength=size) == 1
            self.bits.append(np.packbits(alone, bitorder="little"))
            self.before.append(settled)
            settled += int(alone.sum())
            rest = rest[~alone[slot]]
        self.rest, self.settled = np.sort(rest), settled

    @staticmethod
    def slot(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) % np.uint64(size)).astype(np.int64)

    def ranks(self) -> list[np.ndarray]:
        """Ones before each byte of a level, from which a key's index follows."""
        return [np.r_[0, np.cumsum(np.bitwise_count(b).astype(np.int64))] for b in self.bits]

    def find(self, keys: np.ndarray, sizes: list[int], ranks: list[np.ndarray]) -> np.ndarray:
        """Index of each key, below the number of keys; of a foreign key any index or -1."""
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, bits in enumerate(self.bits):
            slot = self.slot(keys[open_], level, sizes[level])
            byte, bit = slot >> 3, (slot & 7).astype(np.uint8)
            here = (bits[byte] >> bit) & 1 == 1
            below = np.bitwise_count(bits[byte] & ((np.uint8(1) << bit) - np.uint8(1)))
            out[open_[here]] = self.before[level] + ranks[level][byte[here]] + below[here]
            open_ = open_[~here]
        if len(self.rest) and len(open_):
            at = np.minimum(np.searchsorted(self.rest, keys[open_]), len(self.rest) - 1)
            same = self.rest[at] == keys[open_]
            out[open_[same]] = self.settled + at[same]
        return out


class Shard:
    """A perfect hash with the arrays that it indexes."""

    def __init__(self, keys: np.ndarray, fingerprints: np.ndarray, counts: np.ndarray, keep: np.ndarray) -> None:
        self.hash = PerfectHash(keys)
        self.sizes = self._sizes(len(keys))
        self.ranks = self.hash.ranks()
        at = self.hash.find(keys, self.sizes, self.ranks)
        self.fingerprints, self.counts, self.keep = np.zeros_like(fingerprints), np.zeros_like(counts), np.zeros_like(keep)
        self.fingerprints[at], self.counts[at], self.keep[at] = fingerprints, counts, keep

    def _sizes(self, n: int) -> list[int]:
        sizes, left = [], n
        for i in range(len(self.hash.bits)):
            sizes.append(max(64, PerfectHash.ROOM * left))
            left = n - (self.hash.before[i + 1] if i + 1 < len(self.hash.bits) else self.hash.settled)
        return sizes

    def lookup(self, keys: np.ndarray, fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which keys are indexed, and their counts and kept ids."""
        if not len(self.keep):
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        at = self.hash.find(keys, self.sizes, self.ranks)
        found = (at >= 0) & (self.fingerprints[at] == fingerprints)
        return found, self.counts[at], self.keep[at]

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, fingerprints=self.fingerprints, counts=self.counts, keep=self.keep, rest=self.hash.rest, settled=np.array([self.hash.settled]), before=np.array(self.hash.before, np.int64), **{f"bits{i}": b for i, b in enumerate(self.hash.bits)})
        return out.getvalue()

    @classmethod
    def from_bytes(cls, raw: bytes) -> Shard:
        x = np.load(io.BytesIO(raw))
        self, own = cls.__new__(cls), PerfectHash.__new__(PerfectHash)
        own.before, own.rest, own.settled = x["before"].tolist(), x["rest"], int(x["settled"][0])
        own.bits = [x[f"bits{i}"] for i in range(len(own.before))]
        self.hash, self.fingerprints, self.counts, self.keep = own, x["fingerprints"], x["counts"], x["keep"]
        self.ranks, self.sizes = own.ranks(), self._sizes(len(self.keep))
        return self


class Lines:
    """Line bounds, key bounds, key lengths in code points and document of each line of a segment."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray) -> None:
        n = len(offsets) - 1
        breaks = np.flatnonzero(buf == 10)
        owner = np.searchsorted(offsets, breaks, side="right") - 1
        first = np.searchsorted(breaks, offsets[:-1]) + np.arange(n)
        self.start, self.end = np.zeros(len(breaks) + n, np.int64), np.zeros(len(breaks) + n, np.int64)
        self.start[first] = offsets[:-1]
        self.start[np.arange(len(breaks)) + owner + 1] = breaks + 1
        self.end[np.r_[first[1:], len(breaks) + n] - 1 if n else []] = offsets[1:]
        self.end[np.arange(len(breaks)) + owner] = breaks
        self.count = np.diff(np.r_[first, len(breaks) + n])
        self.doc = np.repeat(np.arange(n), self.count)
        solid = np.flatnonzero(~SPACE[buf])
        low, high = np.searchsorted(solid, self.start), np.searchsorted(solid, self.end)
        has = high > low
        self.key_start, self.key_end = self.start.copy(), self.start.copy()
        self.key_start[has], self.key_end[has] = solid[low[has]], solid[high[has] - 1] + 1
        points = np.r_[0, np.cumsum((buf & 0xC0) != 0x80)]
        self.chars = points[self.key_end] - points[self.key_start]

    def hashes(self, buf: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low = LOWER[buf]
        return tuple(span_hashes(low, self.key_start[which], self.key_end[which], salt) for salt in (0, 77))


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return column(batch, "doc_id").cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)


def document_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """h1, h2, doc_id: the distinct long keys of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = _ids(batch)
            for first, _, buf, offsets in segments(column(batch, "text")):
                lines = Lines(buf, offsets)
                long = np.flatnonzero(lines.chars >= min_chars)
                if not len(long):
                    continue
                h1, h2 = lines.hashes(buf, long)
                doc = lines.doc[long]
                order = np.lexsort((h2, h1, doc))
                h1, h2, doc = h1[order], h2[order], doc[order]
                new = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]) | (doc[1:] != doc[:-1])]
                yield pa.RecordBatch.from_arrays([pa.array(h1[new].view(np.int64)), pa.array(h2[new].view(np.int64)), pa.array(ids[first + doc[new]])], ["h1", "h2", "doc_id"])

    return docs.select("doc_id", "text").mapInArrow(run, "h1 long, h2 long, doc_id long")


def build_index(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> tuple[str, int]:
    """Folder of the shards and the number of bits of a hash that tell the shard."""
    spark = docs.sparkSession
    repeated = cut(document_keys(docs, min_chars).groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keep")).where(F.col("n") >= min_docs))
    keys = repeated.count()
    bits = max(0, int(np.ceil(np.log2(max(1, keys) / SHARD_KEYS))))
    folder = fresh_dir(spark, "lines")
    shard = F.shiftrightunsigned("h1", 64 - bits).cast("int") if bits else F.lit(0)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, ["shard"]):
            name = table["shard"][0].as_py()
            h1, h2 = (table[c].to_numpy().view(np.uint64) for c in ("h1", "h2"))
            raw = Shard(h1, h2, table["n"].to_numpy(), table["keep"].to_numpy()).to_bytes()
            write_file(folder, f"{name}.npz", raw)
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.int32()), pa.array([len(h1)], pa.int64())], ["shard", "n"])

    made = repeated.withColumn("shard", shard).repartition(max(1, 1 << bits), "shard").sortWithinPartitions("shard").mapInArrow(write, "shard int, n long")
    total = made.agg(F.sum("n")).first()[0] or 0
    if total != keys:
        raise RuntimeError(f"{total} of {keys} keys were written")
    return folder, bits


class Index:
    """The shards of a folder, read when asked for and held within HELD_BYTES."""

    def __init__(self, folder: str, bits: int) -> None:
        self.source, self.path = filesystem(folder)
        self.bits, self.held, self.bytes = bits, OrderedDict(), 0

    def shard(self, name: int) -> Shard | None:
        if name in self.held:
            self.held.move_to_end(name)
            return self.held[name][0]
        path = f"{self.path}/{name}.npz"
        found, size = None, 0
        if self.source.get_file_info(path).is_file:
            with self.source.open_input_stream(path) as f:
                raw = f.read()
            found, size = Shard.from_bytes(raw), len(raw)
        while self.held and self.bytes + size > HELD_BYTES:
            self.bytes -= self.held.popitem(last=False)[1][1]
        self.held[name] = (found, size)
        self.bytes += size
        return found

    def keepers(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are repeated ones, and the doc_id that keeps each."""
        found, keep = np.zeros(len(h1), bool), np.zeros(len(h1), np.int64)
        names = (h1 >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(h1), np.int64)
        for name in sorted(np.unique(names).tolist(), key=lambda n: (n not in self.held, n)):
            shard = self.shard(name)
            if shard is not None:
                here = np.flatnonzero(names == name)
                found[here], _, keep[here] = shard.lookup(h1[here], h2[here])
        return found, keep


@lru_cache(1)
def index_of(folder: str, bits: int) -> Index:
    """The worker's own view of an index, kept from task to task."""
    return Index(folder, bits)


def judged(batches: list[pa.RecordBatch], index: Index, min_chars: int) -> Iterator[tuple[pa.RecordBatch, list[tuple]]]:
    """Each batch of a portion with its segments: bytes, offsets, lines, and which lines go. The index is probed once for all of them."""
    work, h1, h2 = [], [], []
    for batch in batches:
        ids, parts = _ids(batch), []
        for first, last, buf, offsets in segments(column(batch, "text")):
            lines = Lines(buf, offsets)
            long = np.flatnonzero(lines.chars >= min_chars)
            if len(long):
                one, two = lines.hashes(buf, long)
                h1.append(one)
                h2.append(two)
            parts.append((buf, offsets, lines, long, ids[first:last]))
        work.append((batch, parts))
    found, keep = index.keepers(np.concatenate(h1), np.concatenate(h2)) if h1 else (None, None)
    at = 0
    for batch, parts in work:
        out = []
        for buf, offsets, lines, long, ids in parts:
            drop = np.zeros(len(lines.doc), bool)
            if len(long):
                here = slice(at, at + len(long))
                drop[long] = found[here] & (keep[here] != ids[lines.doc[long]])
                at += len(long)
            out.append((buf, offsets, lines, drop))
        yield batch, out


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, digests: bool = False) -> DataFrame:
    """docs with the lines that stay (and n_chars anew, where there is such a column); or the digests that op7 returns."""
    folder, bits = build_index(docs, min_chars, min_docs)
    if digests:
        docs = docs.select("doc_id", "text")

    def rewritten(batch: pa.RecordBatch, parts: list[tuple]) -> pa.RecordBatch:
        kept, n_lines, n_dropped, hashes = [], [], [], []
        for buf, offsets, lines, drop in parts:
            n = len(offsets) - 1
            raw, dropped = buf.tobytes(), np.bincount(lines.doc[drop], minlength=n)
            at = 0
            for i in range(n):
                end = at + int(lines.count[i])
                text = raw[offsets[i] : offsets[i + 1]]
                if dropped[i]:
                    text = b"\n".join(raw[lines.start[k] : lines.end[k]] for k in range(at, end) if not drop[k])
                if digests:
                    hashes.append(hashlib.sha256(text).hexdigest())
                else:
                    kept.append(text.decode() if dropped[i] else None)
                at = end
            n_lines += lines.count.tolist()
            n_dropped += dropped.tolist()
        if digests:
            return pa.RecordBatch.from_arrays([column(batch, "doc_id").cast(pa.int64()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(hashes, pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])
        texts = column(batch, "text")
        new = pa.array([k if d else t for k, d, t in zip(kept, n_dropped, texts.to_pylist(), strict=True)], texts.type)
        arrays = list(batch.columns)
        arrays[batch.schema.get_field_index("text")] = new
        at = batch.schema.get_field_index("n_chars")
        if at >= 0 and pa.types.is_integer(arrays[at].type):
            arrays[at] = pa.array([len(k) if d else n for k, d, n in zip(kept, n_dropped, arrays[at].to_pylist(), strict=True)], arrays[at].type)
        return pa.RecordBatch.from_arrays(arrays, schema=batch.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_of(folder, bits)
        for portion in portions(batches, "text", PORTION):
            for batch, parts in judged(portion, index, min_chars):
                yield rewritten(batch, parts)
        release()

    return docs.mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string" if digests else docs.schema)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"), digests=True)


OP7_SQL = r"""
WITH lines AS (
  SELECT doc_id, rid, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos
  FROM (SELECT doc_id, row_number() OVER () AS rid, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), repeated AS (
  SELECT key, max(doc_id) AS keep FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT rid) >= 5
), marked AS (
  SELECT k.doc_id, k.rid, k.pos, k.line, r.key IS NOT NULL AND k.doc_id IS DISTINCT FROM r.keep AS dropped
  FROM keyed k LEFT JOIN repeated r ON k.key = r.key
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE dropped) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id, rid
"""
