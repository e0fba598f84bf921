"""Benchmark decontamination by q-gram lemma filtering.

Texts are normalised (lower case, every run of other ASCII characters than letters and digits is one space). A document is contaminated by
an item if any WINDOW bytes of the item, wherever they start, are found in it within an edit distance of ``errors`` times the window's
length, or the whole item where it is shorter. Items of less than two windows are also looked for as a whole, with the edits of their whole
length; with longer ones any two windows' length that is found within its edits holds a window that is.

Two strings of which one has length L and that are within k edits share at least L - q + 1 - k q of the q-grams (q-gram lemma), and the shared
ones lie on diagonals no further apart than k. Shared q-grams are therefore counted in overlapping diagonal bands, over each window's length
of the item; windows that meet the bound are either equal to the text or verified by a banded alignment. The filter loses nothing; the
alignment lets no false window pass.

Items of fewer than MIN_ITEM normalised bytes, which common words would match, contaminate the documents that consist of them and of nothing else.

The benchmark is dealt into parts of about PASS_CHARS bytes; executors make each part's table of q-grams and write it into the shared folder. A task
goes through the parts one after another and holds at most HELD_BYTES of them, from task to task, so nothing of the benchmark is collected or broadcast;
a part is read at most once for every PORTION bytes of a task's texts.

Rows: a null or empty text is never contaminated. Repeated rows are judged alike, one result each. Items without a letter or digit are no
evidence and match nothing; repeated items count once. With an empty benchmark all documents are clean. Other columns are
carried along by ``decontaminate``, whatever their names. Documents stay where they are: there is no shuffle of them.
"""

from __future__ import annotations

import pickle
from collections import OrderedDict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradelake.llm.shared import filesystem, fresh_dir, grouped, portions, release, write_file
from gradelake.llm.textcore import column, segments

Q = 8  # one q-gram fills a 64-bit integer, so q-grams are compared exactly
#: Windows start at every position (a stride of 1).
WINDOW, STRIDE, MIN_ITEM, ERRORS = 50, 1, 24, 0.08
#: Windows that are aligned together.
ALIGNED = 8_192
#: Benchmark bytes of a part (about 50 bytes of tables each), and bytes of parts that a worker holds at a time.
PASS_CHARS, HELD_BYTES = 1_000_000, 256 << 20
#: Bytes of text (at least) that are searched for one part after another together.
PORTION = 48 << 20
#: Places of q-grams in documents and items that are looked at together; more only where one document and one item alone have them.
EXPANDED = 4_000_000

PLAIN = np.arange(256, dtype=np.uint8)
PLAIN[65:91] += 32
PLAIN[[b for b in range(128) if not chr(b).isalnum()]] = 32


def normalise(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normalised bytes and offsets; letters U+00C0 to U+00DE are lower-cased too."""
    if not len(buf):
        return buf, offsets
    out = PLAIN[buf]
    latin = np.zeros(len(buf), bool)
    latin[1:] = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)
    out[latin] += 32
    blank = out == 32
    before = np.ones(len(buf), bool)
    before[1:] = blank[:-1]
    before[offsets[:-1][offsets[:-1] < len(buf)]] = True
    keep = ~(blank & before)
    return out[keep], np.r_[0, np.cumsum(keep)][offsets]


def qgrams(buf: np.ndarray) -> np.ndarray:
    """The q-gram that starts at each position, as an integer."""
    if len(buf) < Q:
        return np.zeros(0, np.uint64)
    return np.ndarray((len(buf) - Q + 1,), "<u8", np.ascontiguousarray(buf).tobytes(), 0, (1,))


def align_all(patterns: np.ndarray, buf: np.ndarray, low: np.ndarray, width: int, begin: np.ndarray, end: np.ndarray, budget: int) -> np.ndarray:
    """For each row of patterns the least edits that turn it into some part of buf[begin:end], on diagonals that start at one of ``width`` places from low on; budget + 1 if more."""
    out = np.full(len(patterns), budget + 1, np.int16)
    far, long, step = budget + 1, patterns.shape[1], np.arange(width, dtype=np.int16)[:, None]
    at = low + np.arange(long + width)[:, None]
    text = np.where((at >= begin) & (at < end), buf[np.clip(at, 0, len(buf) - 1)], 255).astype(np.uint8)
    row = np.where((at[:width] >= begin) & (at[:width] <= end), 0, far).astype(np.int16)
    pattern, live = np.ascontiguousarray(patterns.T), np.arange(len(patterns))
    for i in range(long):
        new = row + (text[i : i + width] != pattern[i])
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)
        row = np.minimum(np.minimum.accumulate(new - step) + step, far)
        if i % 8 == 7:
            on = row.min(0) < far
            if not on.all():
                row, text, pattern, live = row[:, on], text[:, on], pattern[:, on], live[on]
                if not len(live):
                    return out
    at = low[live] + long + step
    out[live] = np.where((at >= begin[live]) & (at <= end[live]), row, far).min(0)
    return out


def align(pattern: np.ndarray, text: np.ndarray, low: int, high: int, budget: int) -> int:
    """Least edits that turn the whole pattern into some part of text that starts on a diagonal from low to high; budget + 1 if more."""
    begin, end = np.zeros(1, np.int64), np.array([len(text)])
    return int(align_all(pattern[None], np.r_[text, np.uint8(255)], begin + low - budget, high - low + 1 + 2 * budget, begin, end, budget)[0])


class Benchmark:
    """Texts of the items, each to be found by spans of one length at every position, and the sorted table of their q-grams."""

    def __init__(self, items: list[tuple[int | None, str | None]], errors: float = ERRORS) -> None:
        self.ids, texts, owner, span = [i for i, _ in items], [], [], []
        self.short: dict[bytes, list[int]] = {}
        for n, (_, text) in enumerate(items):
            raw = np.frombuffer((text or "").encode(), np.uint8)
            plain, _ = normalise(raw, np.array([0, len(raw)]))
            plain = plain[:-1] if len(plain) and plain[-1] == 32 else plain
            if len(plain) < MIN_ITEM:
                if len(plain):
                    self.short.setdefault(plain.tobytes(), []).append(n)
                continue
            for length in {min(len(plain), WINDOW), len(plain) if len(plain) < 2 * WINDOW else WINDOW}:
                texts.append(plain)
                owner.append(n)
                span.append(length)
        self.owner, self.span = np.array(owner, np.int64), np.array(span, np.int64)
        self.size = np.array([len(x) for x in texts], np.int64)
        self.start = np.r_[0, np.cumsum(self.size)].astype(np.int64)
        self.bytes = np.concatenate(texts) if texts else np.zeros(0, np.uint8)
        self.budget = np.floor(errors * self.span).astype(np.int64)
        self.least = self.span - Q + 1 - self.budget * Q
        self.step = self.budget + 1  # bands are twice as wide, so any two diagonals within the budget share one
        grams = [qgrams(x) for x in texts]
        gram = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        entry = np.repeat(np.arange(len(grams)), [len(g) for g in grams]) if grams else np.zeros(0, np.int64)
        place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64)
        order = np.argsort(gram, kind="stable")
        gram, self.entry, self.place = gram[order], entry[order], place[order]
        self.grams, self.first = np.unique(gram, return_index=True)
        self.count = np.diff(np.r_[self.first, len(gram)])
        self.key = np.repeat(np.arange(len(self.grams)), self.count) * len(self.size) + self.entry
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[self._slot(self.grams)] = True

    @staticmethod
    def _slot(grams: np.ndarray) -> np.ndarray:
        return ((grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42)).astype(np.int64)

    def find(self, buf: np.ndarray, offsets: np.ndarray) -> list[list[int]]:
        """For each document the item (its place in ``ids``) of every separate stretch of an item that windows found in it cover."""
        out: list[list[int]] = [[] for _ in range(len(offsets) - 1)]
        buf, offsets = normalise(buf, offsets)
        if self.short:
            for d in np.flatnonzero(np.diff(offsets) <= MIN_ITEM).tolist():
                out[d] += self.short.get(buf[offsets[d] : offsets[d + 1]].tobytes().rstrip(b" "), [])
        grams = qgrams(buf)
        if not len(grams) or not len(self.grams):
            return out
        at = np.flatnonzero(self.maybe[self._slot(grams)])
        slot = np.minimum(np.searchsorted(self.grams, grams[at]), len(self.grams) - 1)
        hit = self.grams[slot] == grams[at]
        at, slot = at[hit], slot[hit]
        doc = np.searchsorted(offsets, at, side="right") - 1
        inside = at + Q <= offsets[doc + 1]
        at, slot, doc = at[inside], slot[inside], doc[inside]
        found = [self._windows(buf, offsets, at[i:j], slot[i:j], doc[i:j], a, b) for i, j, a, b in self._portions(slot, doc)]
        if not found:
            return out
        doc, entry, begin = (np.concatenate(x) for x in zip(*found, strict=True))
        end, item = begin + self.span[entry], self.owner[entry]
        order = np.lexsort((begin, item, doc))
        last = (-1, -1, -1)
        for d, n, b, e in zip(doc[order].tolist(), item[order].tolist(), begin[order].tolist(), end[order].tolist(), strict=True):
            if (d, n) != last[:2] or b > last[2]:
                out[d].append(n)
                last = (d, n, e)
            else:
                last = (d, n, max(e, last[2]))
        return out

    def _portions(self, slot: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """Hits (from, to) of whole documents and entries (from, to) whose places together are about EXPANDED."""
        total = np.r_[0, np.cumsum(self.count[slot])]
        border = np.r_[np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]), len(doc)] if len(doc) else np.zeros(1, np.int64)
        i = 0
        while i < len(border) - 1:
            j = max(i + 1, int(np.searchsorted(total[border], total[border[i]] + EXPANDED, side="right")) - 1)
            first, last, size = int(border[i]), int(border[j]), int(total[border[j]] - total[border[i]])
            if size <= EXPANDED:
                yield first, last, 0, len(self.size)
            else:  # one document with very many places
                own, times = np.unique(slot[first:last], return_counts=True)
                weight = np.zeros(len(self.size))
                for s, t in zip(own.tolist(), times.tolist(), strict=True):
                    weight += t * np.bincount(self.entry[self.first[s] : self.first[s] + self.count[s]], minlength=len(self.size))
                step, a = np.cumsum(weight), 0
                while a < len(self.size):
                    b = max(a + 1, int(np.searchsorted(step, (step[a - 1] if a else 0) + EXPANDED, side="right")))
                    yield first, last, a, b
                    a = b
            i = j

    def _windows(self, buf: np.ndarray, offsets: np.ndarray, at: np.ndarray, slot: np.ndarray, doc: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, entry and start of the windows of the entries from low to high that are found."""
        if (low, high) == (0, len(self.size)):
            first, times = self.first[slot], self.count[slot]
        else:
            first = np.searchsorted(self.key, slot * len(self.size) + low)
            times = np.searchsorted(self.key, slot * len(self.size) + high) - first
        row = np.repeat(first - np.r_[0, np.cumsum(times)[:-1]], times) + np.arange(times.sum())
        entry, place, doc = self.entry[row], self.place[row], np.repeat(doc, times)
        group, diagonal = doc * len(self.size) + entry, np.repeat(at, times) - place
        groups, group, count = np.unique(group, return_inverse=True, return_counts=True)
        enough = count[group] >= self.least[entry]
        group, diagonal, place, entry = group[enough], diagonal[enough], place[enough], entry[enough]
        if not len(group):
            return (np.zeros(0, np.int64),) * 3
        wide = int(self.size.max()) + 1  # window = group * wide + start in the item
        equal = self._equal(group, diagonal, place, entry, wide)
        window, band = self._likely(group, diagonal, place, entry, wide)
        open_ = ~np.isin(window, equal)
        window, band = window[open_], band[open_]
        found = np.unique(np.r_[equal, window[self._verify(buf, offsets, groups[window // wide], window % wide, band)]])
        return *np.divmod(groups[found // wide], len(self.size)), found % wide

    def _equal(self, group: np.ndarray, diagonal: np.ndarray, place: np.ndarray, entry: np.ndarray, wide: int) -> np.ndarray:
        """Windows all of whose q-grams lie on one diagonal."""
        order = np.lexsort((place, diagonal, group))
        group, diagonal, place, entry = group[order], diagonal[order], place[order], entry[order]
        more = self.span[entry] - Q
        end = np.minimum(np.arange(len(group)) + more, len(group) - 1)
        whole = (group[end] == group) & (diagonal[end] == diagonal) & (place[end] - place == more)
        return np.unique(group[whole] * wide + place[whole])

    def _likely(self, group: np.ndarray, diagonal: np.ndarray, place: np.ndarray, entry: np.ndarray, wide: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, band) of all windows that share enough q-grams within a band."""
        band = diagonal // self.step[entry] + wide  # not negative
        group, entry, place, band = np.r_[group, group], np.r_[entry, entry], np.r_[place, place], np.r_[band, band - 1]
        order = np.lexsort((place, band, group))
        group, entry, place, band = group[order], entry[order], place[order], band[order]
        new = np.ones(len(group), bool)
        new[1:] = (group[1:] != group[:-1]) | (band[1:] != band[:-1]) | (place[1:] != place[:-1])
        group, entry, place, band = group[new], entry[new], place[new], band[new]
        end = np.arange(len(group)) + self.least[entry] - 1
        inside = end < len(group)
        end = np.minimum(end, len(group) - 1)
        near = np.flatnonzero(inside & (group[end] == group) & (band[end] == band) & (place[end] + Q - place <= self.span[entry]))
        group, entry, band, first, last = group[near], entry[near], band[near], place[near], place[end[near]]
        low = np.maximum(0, last + Q - self.span[entry])
        high = np.minimum(first, self.size[entry] - self.span[entry])
        same = np.zeros(len(group), bool)
        same[1:] = (group[1:] == group[:-1]) & (band[1:] == band[:-1])
        low[same] = np.maximum(low[same], high[np.flatnonzero(same) - 1] + 1)  # both grow with the place, so windows come once a band
        times = np.maximum(0, high - low + 1)
        start = np.repeat(low - np.r_[0, np.cumsum(times)[:-1]], times) + np.arange(times.sum()) if len(times) else low
        return np.repeat(group, times) * wide + start, np.repeat(band - wide, times)

    def _verify(self, buf: np.ndarray, offsets: np.ndarray, group: np.ndarray, start: np.ndarray, band: np.ndarray) -> np.ndarray:
        """Which windows are found in their document on the diagonals of their band."""
        out = np.zeros(len(group), bool)
        doc, entry = np.divmod(group, len(self.size))
        span = self.span[entry]
        for length in np.unique(span).tolist():
            mine = np.flatnonzero(span == length)
            for i in range(0, len(mine), ALIGNED):
                part = mine[i : i + ALIGNED]
                d, e, s = doc[part], entry[part], start[part]
                step, budget = int(self.step[e[0]]), int(self.budget[e[0]])
                patterns = self.bytes[(self.start[e] + s)[:, None] + np.arange(length)]
                out[part] = align_all(patterns, buf, s + band[part] * step - budget, 2 * step + 2 * budget, offsets[d], offsets[d + 1], budget) <= budget
        return out


def build(benchmark: DataFrame, errors: float) -> tuple[str, int]:
    """The folder of the benchmark's parts, and their number (0 without items)."""
    if any(n - Q + 1 - int(errors * n) * Q < 1 for n in range(MIN_ITEM, 2 * WINDOW)):
        raise ValueError(f"with {errors} edits a character windows need not share a q-gram, so the filter would lose some")
    items = benchmark.where("text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    parts = -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PASS_CHARS)
    folder = fresh_dir(benchmark.sparkSession, "benchmark")
    if not parts:
        return folder, 0

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, ["part"]):
            name = table["part"][0].as_py()
            made = Benchmark(list(zip(table["item_id"].to_pylist(), table["text"].to_pylist(), strict=True)), errors)
            write_file(folder, f"{name}.part", pickle.dumps(made, protocol=5))
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.int32()), pa.array([table.num_rows], pa.int64())], ["part", "n"])

    dealt = items.withColumn("part", F.pmod(F.xxhash64("text"), F.lit(parts)).cast("int")).repartition(parts, "part").sortWithinPartitions("part", "item_id", "text")
    dealt.mapInArrow(write, "part int, n long").agg(F.sum("n")).first()
    return folder, parts


class Parts:
    """The parts of a folder, held within HELD_BYTES."""

    def __init__(self, folder: str, parts: int) -> None:
        self.source, self.path = filesystem(folder)
        self.names = [f"{self.path}/{n}.part" for n in range(parts)]
        self.held: OrderedDict[str, tuple[Benchmark | None, int]] = OrderedDict()

    def load(self, name: str) -> Benchmark | None:
        if name not in self.held:
            raw = b""
            if self.source.get_file_info(name).is_file:
                with self.source.open_input_stream(name) as f:
                    raw = f.read()
            while self.held and sum(n for _, n in self.held.values()) + len(raw) > HELD_BYTES:
                self.held.popitem(last=True)  # what was held before the portion stays, for the next one to begin with
            self.held[name] = (pickle.loads(raw) if raw else None, len(raw))
        return self.held[name][0]

    def find(self, portion: list[pa.Array]) -> list[tuple[list[set[int]], list[int]]]:
        """For each array of texts the items found in each text (those with an id), and the number of separate stretches. Every part is loaded at most once for
        all of them, those that are held first."""
        out = [([set() for _ in range(len(texts))], [0] * len(texts)) for texts in portion]
        for name in sorted(self.names, key=lambda x: x not in self.held):
            part = self.load(name)
            if part is None:
                continue
            for texts, (ids, n) in zip(portion, out, strict=True):
                for first, _, buf, offsets in segments(texts):
                    for i, found in enumerate(part.find(buf, offsets), first):
                        n[i] += len(found)
                        ids[i].update(part.ids[x] for x in found if part.ids[x] is not None)
        return out


@lru_cache(1)
def parts_of(folder: str, parts: int) -> Parts:
    """The worker's own view of a benchmark's parts, kept from task to task."""
    return Parts(folder, parts)


def searched(batches: Iterator[pa.RecordBatch], known: Parts) -> Iterator[tuple[pa.RecordBatch, list[set[int]], list[int]]]:
    """Each batch with what is found in its texts."""
    for portion in portions(batches, "text", PORTION):
        for batch, (ids, n) in zip(portion, known.find([column(b, "text") for b in portion]), strict=True):
            yield batch, ids, n


REPORT = "doc_id long, contaminated boolean, item_ids array<long>, n_regions long"


def contamination(docs: DataFrame, benchmark: DataFrame, errors: float = ERRORS) -> DataFrame:
    """doc_id, contaminated, item_ids (sorted, distinct) and n_regions (separate stretches of items found) of every row."""
    folder, parts = build(benchmark, errors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, ids, n in searched(batches, parts_of(folder, parts)):
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id").cast(pa.int64()), pa.array([x > 0 for x in n], pa.bool_()), pa.array(map(sorted, ids), pa.list_(pa.int64())), pa.array(n, pa.int64())], ["doc_id", "contaminated", "item_ids", "n_regions"])
        release()

    return docs.select("doc_id", "text").mapInArrow(run, REPORT)


def decontaminate(docs: DataFrame, benchmark: DataFrame, errors: float = ERRORS) -> DataFrame:
    """The rows of docs that are not contaminated, with all their columns."""
    folder, parts = build(benchmark, errors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, n in searched(batches, parts_of(folder, parts)):
            yield batch.filter(pa.array([not x for x in n], pa.bool_()))
        release()

    return docs.mapInArrow(run, docs.schema)


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
