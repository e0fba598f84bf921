"""Vectorised text primitives for Arrow batches: word bounds, word hashes and shingle sets over one contiguous byte buffer.

Words are runs of bytes outside ``[\\x20\\x09-\\x0D]``; all functions work on the UTF-8 bytes of many documents at once, so the
cost per byte is a few numpy passes and the memory is a small multiple of ``SEGMENT`` (or of the longest single document).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled together; one longer document is handled alone.
SEGMENT = 1 << 19

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of a block that are kept when a span ends inside it.
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits (wraps silently)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """64-bit hash of each byte span [start, end); equal spans have equal hashes wherever they stand.

    A span is cut into blocks of eight bytes; every block is mixed with a key of its place and the salt, and the mixed blocks are added up. The
    mixing is not linear in the bytes, so no arrangement of equal letters cancels out, and hashes under two salts are independent.
    """
    length = (ends - starts).astype(np.int64)
    if not len(length):
        return np.zeros(0, np.uint64)
    blocks = np.ndarray((len(buf) + 1,), "<u8", buf.tobytes() + bytes(8), 0, (1,))  # the block that starts at each byte
    seed = mix(np.array([salt * 2 + 1], np.uint64))
    key = mix(np.arange(1, int(length.max()) // 8 + 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + seed)
    total = mix((blocks[starts] & _MASK[np.minimum(length, 8)]) ^ key[0])
    far = np.flatnonzero(length > 8)
    if len(far):
        times = (length[far] - 1) // 8  # blocks behind the first
        first = np.r_[0, np.cumsum(times)[:-1]]
        place = np.arange(int(times.sum())) - np.repeat(first, times) + 1
        rest = np.repeat(length[far], times) - 8 * place
        more = mix((blocks[np.repeat(starts[far], times) + 8 * place] & _MASK[np.minimum(rest, 8)]) ^ key[place])
        total[far] += np.add.reduceat(more, first)
    return mix(total + length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + seed)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string array; a null counts as an empty text."""
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def segments(texts: pa.Array, limit: int = SEGMENT) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last + 1, bytes, offsets) of runs of whole documents of at most ``limit`` bytes, or of a single longer one."""
    raw, offsets = text_buffer(texts)
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        last = min(last, n)
        yield first, last, raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def word_bounds(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document index of every word; no word spans two documents."""
    if not len(buf):
        return (np.zeros(0, np.int64),) * 3
    solid = ~SPACE[buf]
    before, after = np.zeros(len(buf), bool), np.zeros(len(buf), bool)
    before[1:], after[:-1] = solid[:-1], solid[1:]
    inner = offsets[(offsets > 0) & (offsets < len(buf))]
    before[inner], after[inner - 1] = False, False
    starts = np.flatnonzero(solid & ~before)
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def shingle_hashes(words: np.ndarray, docs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word shingles and their document index; a document of 1 to n - 1 words gives its whole sequence."""
    factors = mix(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    whole = np.flatnonzero(docs[: len(docs) - n + 1] == docs[n - 1 :]) if len(docs) >= n else np.zeros(0, np.int64)
    total = np.zeros(len(whole), np.uint64)
    for k in range(n):
        total += words[whole + k] * factors[k]
    out, owner = mix(total + np.uint64(n)), docs[whole]
    first = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1]])
    count = np.diff(np.r_[first, len(docs)])
    short = first[count < n]
    if len(short):
        total, size = np.zeros(len(short), np.uint64), count[count < n]
        for k in range(n - 1):
            has = size > k
            total[has] += words[short[has] + k] * factors[k]
        out, owner = np.r_[out, mix(total + size.astype(np.uint64) + np.uint64(n << 8))], np.r_[owner, docs[short]]
        order = np.argsort(owner, kind="stable")
        out, owner = out[order], owner[order]
    return out, owner


def shingle_runs(texts: pa.Array, n: int, lower: bool = True) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of every segment the number of documents, the hashes of all their shingles, and each one's document."""
    for first, last, buf, offsets in segments(texts):
        buf = LOWER[buf] if lower else buf
        starts, ends, docs = word_bounds(buf, offsets)
        yield last - first, *shingle_hashes(span_hashes(buf, starts, ends), docs, n)


def shingle_sets(texts: pa.Array, n: int, lower: bool = True) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each document, in order; empty without words."""
    for size, hashes, owner in shingle_runs(texts, n, lower):
        cut = np.searchsorted(owner, np.arange(size + 1))
        for i in range(size):
            yield np.unique(hashes[cut[i] : cut[i + 1]])
