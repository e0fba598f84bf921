"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Grades are ordered: 0 toxic, 1 poor, 2 good. A text has a vector of hashed words, the same weights for all grades, and ordered thresholds cut the
score: P(grade <= k) = sigmoid(threshold_k - score). The expected grade and the tail probability P(grade = 2) select documents.

Features of a whole text: its distinct words (A-Z lower-cased, outer punctuation off), their distinct runs of GRAM bytes, and the character classes of its words, each hashed to
one of DIMS buckets. A word weighs PRESENT, a character class its share of the words times CLASS. Buckets that fewer than SUPPORT rated texts
have, or that do not tell the grades apart, get no weight, so long texts do not score by chance.

The model is fitted on at most SAMPLE rated rows, chosen by a hash of their ids (the bound is a parameter), with all features of each. A first pass over
them counts texts by bucket and grade (DIMS * GRADES numbers at most reach the driver), which tells the buckets that get a weight; a second one brings the
rated rows to the driver with the features of these buckets only, at most 8 bytes for each of a row's. Everything else runs over all rows and all
features, in Arrow batches without a shuffle, with the weights (4 * DIMS bytes) broadcast.

Rows: a null or empty text scores by the intercept alone. Ratings without a document, or null ones, are not used; of several ratings of one id
each counts, and so does each text of several of one id, but rows that repeat id, text and grade count once. Equal hashes are told apart by id,
grade and features. Without any rating, or with ratings of one grade only, the thresholds are the smoothed frequencies. Repeated rows score
alike. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradelake.llm.shared import stored
from gradelake.llm.textcore import LOWER, SPACE, column, mix, segments, span_hashes, word_bounds

DIMS, SAMPLE, GRADES, GRAM = 1 << 18, 8_000, 3, 4
STEPS, RATE, RIDGE, SUPPORT, PRESENT, CLASS = 250, 0.3, 1e-4, 5, 0.25, 4.0
APART = 4.0
#: Kept are documents of at least this probability of the best grade.
TAIL = 0.5

_EDGE = np.zeros(256, bool)
_EDGE[[b for b in range(33, 128) if not chr(b).isalnum()]] = True


def features(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets and weights of each text."""
    for first, last, buf, offsets in segments(texts):
        low = LOWER[buf]
        starts, ends, docs = word_bounds(low, offsets)
        edge = np.r_[0, np.cumsum(_EDGE[low])] if len(low) else np.zeros(1, np.int64)
        odd = edge[ends] - edge[starts]
        for _ in range(4):  # outer punctuation, up to four characters at either end
            s = (ends > starts) & _EDGE[low[np.minimum(starts, len(low) - 1)]] if len(low) else np.zeros(0, bool)
            starts = starts + s
            e = (ends > starts) & _EDGE[low[ends - 1]] if len(low) else np.zeros(0, bool)
            ends = ends - e
        upper = np.r_[0, np.cumsum((buf >= 65) & (buf <= 90))] if len(buf) else np.zeros(1, np.int64)
        capitals = upper[ends] - upper[starts]
        size = ends - starts
        word = span_hashes(low, starts, ends, 5)
        shape = mix(np.minimum(odd, 4).astype(np.uint64) * np.uint64(1000) + np.minimum(size // 4, 6).astype(np.uint64) * np.uint64(10) + np.where(capitals == 0, 0, np.where(capitals == size, 2, 1)).astype(np.uint64))
        cut = np.searchsorted(docs, np.arange(last - first + 1))
        solid = np.r_[0, np.cumsum(SPACE[low])]
        inside = np.flatnonzero(solid[GRAM:] == solid[:-GRAM]) if len(low) >= GRAM else np.zeros(0, np.int64)
        inside = inside[inside + GRAM <= offsets[np.searchsorted(offsets, inside, side="right")]] if len(inside) else inside
        grams = np.ndarray((max(0, len(low) - GRAM + 1),), "<u4", np.ascontiguousarray(low).tobytes() + b"\0", 0, (1,))[inside] if len(inside) else np.zeros(0, np.uint32)
        grams = (mix(grams.astype(np.uint64) + np.uint64(1 << 40)) % np.uint64(DIMS)).astype(np.int32)
        edges = np.searchsorted(inside, offsets)
        for i in range(last - first):
            a, b = cut[i], cut[i + 1]
            words = np.unique(word[a:b] % np.uint64(DIMS)).astype(np.int64)
            parts = np.unique(grams[edges[i] : edges[i + 1]]).astype(np.int64)
            shapes, times = np.unique(shape[a:b] % np.uint64(DIMS), return_counts=True)
            repeats = mix(np.array([12345], np.uint64)) % np.uint64(DIMS)
            fresh = len(words) / max(1, b - a)
            yield np.r_[words, parts, shapes.astype(np.int64), repeats.astype(np.int64)], np.r_[np.full(len(words) + len(parts), PRESENT), CLASS * times / max(1, b - a), CLASS * (1 - fresh)]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Model:
    """Weights and ordered thresholds, fitted by adaptive gradient steps on the penalised likelihood."""

    def __init__(self, texts: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray) -> None:
        self.weights = np.zeros(DIMS)
        share = np.cumsum(np.bincount(grades, minlength=GRADES)[:GRADES] + 0.5) / (len(grades) + 0.5 * GRADES)
        self.cuts = np.log(share[:-1] / (1 - share[:-1]))
        if len(np.unique(grades)) < 2:
            return
        row = np.repeat(np.arange(len(texts)), [len(i) for i, _ in texts])
        col, val = np.concatenate([i for i, _ in texts]), np.concatenate([v for _, v in texts])
        pair, place = np.unique(row * DIMS + col, return_inverse=True)  # a text has a bucket once, whatever falls into it
        row, col, val = pair // DIMS, pair % DIMS, np.bincount(place, val, len(pair))
        well = self.telling(row, col, grades)[col]
        row, col, val = row[well], col[well], val[well]
        balance = len(grades) / (len(np.unique(grades)) * np.bincount(grades, minlength=GRADES)[grades])
        balance = np.sqrt(balance)
        past, past_cuts = np.full(DIMS, 1e-8), np.full(GRADES - 1, 1e-8)
        for _ in range(STEPS):
            slope, rise = self.slopes(row, col, val, grades, balance, self.weights, self.cuts)
            past += slope**2
            self.weights -= RATE * slope / np.sqrt(past)
            past_cuts += rise**2
            self.cuts = np.sort(self.cuts - 0.1 * rise / np.sqrt(past_cuts))
        self.weights = self.weights.astype(np.float32)

    @staticmethod
    def slopes(row: np.ndarray, col: np.ndarray, val: np.ndarray, grades: np.ndarray, balance: np.ndarray, weights: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Derivatives of the penalised negative log-likelihood, a mean over texts weighted by balance, by weights and by thresholds."""
        n = len(grades)
        score = np.bincount(row, val * weights[col], n)
        edges = np.r_[-np.inf, cuts, np.inf]
        high, low = sigmoid(edges[grades + 1] - score), sigmoid(edges[grades] - score)
        high, low = np.where(grades == GRADES - 1, 1.0, high), np.where(grades == 0, 0.0, low)
        p = np.maximum(high - low, 1e-12)
        up, down = high * (1 - high) / p * balance, low * (1 - low) / p * balance
        slope = np.bincount(col, val * (up - down)[row], DIMS) / n + RIDGE * weights
        return slope, np.array([(down[grades == k + 1].sum() - up[grades == k].sum()) / n for k in range(GRADES - 1)])

    @staticmethod
    def telling(row: np.ndarray, col: np.ndarray, grades: np.ndarray) -> np.ndarray:
        return apart(np.array([np.bincount(col[(grades == g)[row]], minlength=DIMS) for g in range(GRADES)]), np.bincount(grades, minlength=GRADES))

    def at_most(self, texts: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """P(grade <= k) for every text and every k below the best grade."""
        score = np.array([float(self.weights[i] @ v) for i, v in texts])
        return sigmoid(self.cuts[None, :] - score[:, None])


def apart(counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Buckets whose share of texts differs between lower and higher grades by APART standard errors, at some threshold. counts: texts by grade and
    bucket; sizes: texts by grade."""
    n, have = int(sizes.sum()), counts.sum(0)
    out = np.zeros(DIMS, bool)
    for k in range(GRADES - 1):
        m, own = int(sizes[: k + 1].sum()), counts[: k + 1].sum(0)
        if not 0 < m < n:
            continue
        p = have / n
        error = np.sqrt(np.maximum(p * (1 - p), 1e-12) * n / (m * (n - m)))
        out |= (np.abs(own / m - (have - own) / (n - m)) > APART * error) | (have >= n - 1)
    return out & (have >= SUPPORT)


def rated(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, text and grade of the documents of at most ``sample`` ratings, chosen by a hash of the id."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2)
    graded = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL AND quality IS NOT NULL").select("doc_id", grade.alias("grade"))
    chosen = graded.orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(sample)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "grade")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits on the hashed features of the sample; what reaches the driver is bounded by it."""
    names, kind = ["doc_id", "grade", "cols", "vals"], "doc_id long, grade int, cols binary, vals binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = list(features(column(part, "text")))
                yield pa.RecordBatch.from_arrays([column(part, "doc_id"), column(part, "grade"), pa.array([i.astype("<i4").tobytes() for i, _ in found], pa.binary()), pa.array([v.astype("<f4").tobytes() for _, v in found], pa.binary())], names)

    order = [F.xxhash64("doc_id"), "doc_id", "grade", "key"]
    every = stored(rated(docs, labels, sample).mapInArrow(run, kind).withColumn("key", F.xxhash64("cols", "vals")), "rated")
    chosen = every.select("doc_id", "grade", "key").distinct().orderBy(*order).limit(sample)
    rows = stored(every.join(F.broadcast(chosen), ["doc_id", "grade", "key"], "left_semi").dropDuplicates(["doc_id", "grade", "key"]), "chosen")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((GRADES, DIMS), np.int64)
        for batch in batches:
            for g, cols in zip(column(batch, "grade").to_pylist(), column(batch, "cols").to_pylist(), strict=True):
                counts[g, np.unique(np.frombuffer(cols, "<i4"))] += 1  # a text has a bucket once, whatever falls into it
        g, bucket = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(g, pa.int32()), pa.array(bucket, pa.int32()), pa.array(counts[g, bucket])], ["grade", "bucket", "n"])

    counts, sizes = np.zeros((GRADES, DIMS), np.int64), np.zeros(GRADES, np.int64)
    found = rows.select("grade", "cols").mapInArrow(count, "grade int, bucket int, n long").groupBy("grade", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts[found["grade"].to_numpy(), found["bucket"].to_numpy()] = found["n"].to_numpy()
    for x in rows.groupBy("grade").count().collect():
        sizes[x["grade"]] = x["count"]
    shared = docs.sparkSession.sparkContext.broadcast(apart(counts, sizes))

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols, vals = [], []
            for i, v in zip(column(batch, "cols").to_pylist(), column(batch, "vals").to_pylist(), strict=True):
                i, v = np.frombuffer(i, "<i4"), np.frombuffer(v, "<f4")
                well = shared.value[i]
                cols.append(i[well].tobytes())
                vals.append(v[well].tobytes())
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "grade"), pa.array(cols, pa.binary()), pa.array(vals, pa.binary())], names)

    table = rows.select(*names).mapInArrow(narrow, kind).toArrow()
    table = table.sort_by([("doc_id", "ascending"), ("grade", "ascending"), ("cols", "ascending"), ("vals", "ascending")])
    texts = [(np.frombuffer(c, "<i4").astype(np.int64), np.frombuffer(v, "<f4")) for c, v in zip(table["cols"].to_pylist(), table["vals"].to_pylist(), strict=True)]
    return Model(texts, np.array(table["grade"].to_pylist(), np.int64))


SCHEMA = "doc_id long, expected_grade double, tail_prob double, toxic_prob double, toxic boolean, kept boolean"


def grade_documents(docs: DataFrame, model: Model, tail: float = TAIL) -> DataFrame:
    """doc_id, expected_grade, tail_prob = P(good), toxic_prob = P(toxic), toxic and kept for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            below = shared.value.at_most(features(column(batch, "text"))).reshape(batch.num_rows, GRADES - 1)
            good, toxic = 1 - below[:, -1], below[:, 0]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id").cast(pa.int64()), pa.array((1 - below).sum(1)), pa.array(good), pa.array(toxic), pa.array(toxic > 0.5), pa.array(good >= tail)], ["doc_id", "expected_grade", "tail_prob", "toxic_prob", "toxic", "kept"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return grade_documents(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
