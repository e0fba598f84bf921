"""Embedding whitening from a two-pass covariance.

A usable vector has the table's dimension and only finite entries; an entry c becomes the integer x = floor(64 c) + 1000000 (held within
-2**62 and 2**62). Usable vectors are the fit list.

1. Every task adds up its vectors' integers exactly; Spark adds the tasks' sums as decimals. With n vectors and sums S the mean is S / n.
2. Every task adds up the outer products of its centred vectors by one GEMM a batch; treeAggregate merges these d x d matrices level by
   level, so neither the driver nor any task meets more than a few of them. A vector is centred exactly: x less the whole part of the mean is an
   integer, and only the fraction is subtracted in doubles.
3. LAPACK's symmetric eigensolver gives components by falling eigenvalue; the projection (d x components, a bounded size) is broadcast, a
   third pass over the vectors measures the covariance of what is projected, and the projection is applied in Arrow batches.

The order in which matrices are merged may change the last bits of the doubles. Integer sums, n and deviations do not depend on it.

Rows: a vector that is null, or holds a null or non-finite entry, is dropped. The dimension is the most frequent length of the others (of two equally
frequent the larger); vectors of another length, empty ones too, are dropped. Repeated rows count and are returned each; a null id stays null. In the query a deviation of 2**63 or more is null (the operator's own is a
decimal).
A component without variance (eigenvalue within rounding of 0, all of them for a single vector) has no whitened value (null) and does not enter the identity error,
which is null where no component is left; explained is null where the trace is 0. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradelake.llm.shared import release
from gradelake.llm.textcore import column

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
BOUND = 1 << 62
#: Decimals of Spark hold this much.
WIDEST = 10**38
_LOW31, _LOW32 = (1 << 31) - 1, (1 << 32) - 1


def usable(vectors: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Of each length the row numbers and entries (doubles, a row a vector) of the vectors that are finite throughout."""
    rows = np.flatnonzero(vectors.is_valid().to_numpy(zero_copy_only=False))
    there = vectors.filter(vectors.is_valid())
    sizes = pc.list_value_length(there).to_numpy(zero_copy_only=False)
    flat = there.flatten()
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls are NaN
    starts = np.cumsum(sizes) - sizes
    out = {}
    for size in np.unique(sizes[sizes > 0]).tolist():
        chosen = np.flatnonzero(sizes == size)
        table = values[starts[chosen, None] + np.arange(size)] if len(chosen) < len(sizes) else values.reshape(-1, size)
        fine = np.isfinite(table).all(1)
        if fine.any():
            out[size] = rows[chosen[fine]], table[fine]
    return out


def quantised(values: np.ndarray) -> np.ndarray:
    """x = floor(64 c) + 1000000 of each entry, as integers."""
    scaled = np.floor(values * SCALE)
    out = np.where(np.abs(scaled) < BOUND, scaled, 0).astype(np.int64)
    out[scaled >= BOUND], out[scaled <= -BOUND] = BOUND - SHIFT, -BOUND - SHIFT
    return out + SHIFT


def exact_sums(x: np.ndarray) -> list[int]:
    """Sums of the columns: halves of 32 bits cannot overflow, whatever the entries."""
    return [(int(a) << 32) + int(b) for a, b in zip((x >> 32).sum(0), (x & _LOW32).sum(0), strict=True)]


def squared_lengths(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Of each row the sum over dimensions of (n x - S)**2, exactly."""
    whole = np.array([s // n for s in sums], np.int64)
    near = x - whole if max(int(x.max()), -int(x.min())) < BOUND // 2 else None
    if near is None or max(int(near.max()), -int(near.min())) * n + n >= BOUND:
        return [sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist()]
    v = n * near - np.array([s % n for s in sums], np.int64)
    if float(np.abs(v).max()) ** 2 * v.shape[1] < BOUND:
        return (v * v).sum(1).tolist()
    v = np.abs(v)
    high, low = v >> 31, v & _LOW31
    total = 0
    for part, shift in ((high * high, 62), (high * low, 32), (low * low, 0)):
        total = total + (((part >> 32).sum(1).astype(object) * (1 << 32) + (part & _LOW32).sum(1).astype(object)) * (1 << shift))
    return total.tolist()


@dataclass(frozen=True)
class Whitening:
    """n vectors with sums S a dimension; components as columns, scaled to unit variance; the shares of variance; the error measured on the fit list."""

    n: int
    sums: tuple[int, ...]
    projection: np.ndarray
    explained: tuple[float | None, ...]
    has_variance: tuple[bool, ...]
    identity_error: float | None

    def centred(self, x: np.ndarray) -> np.ndarray:
        return centred(x, self.n, self.sums)

    def transform(self, df: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
        """vec_id, deviation (decimal; null from 10**38 on) and whitened (array, null for components without variance) of every usable vector."""
        shared, size = df.sparkSession.sparkContext.broadcast(self), len(self.sums)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own: Whitening = shared.value
            gaps = ~np.array(own.has_variance, bool)
            for batch in batches:
                found = usable(column(batch, vector)).get(size)
                if found is None:
                    continue
                rows, values = found
                x = quantised(values)
                white = own.centred(x) @ own.projection
                flat = pa.array(white.ravel(), mask=np.broadcast_to(gaps, white.shape).ravel())
                offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * white.shape[1])
                lengths = squared_lengths(x, own.n, list(own.sums))
                big = max(lengths) >= BOUND
                lengths = pa.array([Decimal(v) if v < WIDEST else None for v in lengths], pa.decimal128(38, 0)) if big else pa.array(lengths, pa.int64()).cast(pa.decimal128(38, 0))
                yield pa.RecordBatch.from_arrays([column(batch, key).take(pa.array(rows)), lengths, pa.ListArray.from_arrays(offsets, flat)], ["vec_id", "deviation", "whitened"])
            release()

        kind = df.schema[key].dataType.simpleString()
        return df.select(key, vector).mapInArrow(run, f"vec_id {kind}, deviation decimal(38,0), whitened array<double>")


def centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    whole = np.array([s // n for s in sums], np.int64)
    fraction = np.array([(s % n) / n for s in sums])
    return (x - whole).astype(np.float64) - fraction


def outer_products(df: DataFrame, vector: str, n: int, sums: tuple[int, ...], projection: np.ndarray | None = None) -> np.ndarray:
    """The covariance of the centred vectors, or of their projections: one matrix a task, merged as a tree."""
    size, context = len(sums), df.sparkSession.sparkContext
    shared = context.broadcast((n, sums, projection))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, projection = shared.value
        total = None
        for batch in batches:
            found = usable(column(batch, vector)).get(size)
            if found is not None:
                d = centred(quantised(found[1]), n, sums)
                d = d if projection is None else d @ projection
                total = d.T @ d if total is None else total + d.T @ d
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["m"])
        release()

    wide = size if projection is None else projection.shape[1]
    parts = df.select(vector).mapInArrow(run, "m binary").rdd.map(lambda r: np.frombuffer(r.m, np.float64).reshape(wide, wide))
    return parts.treeAggregate(np.zeros((wide, wide)), lambda a, b: a + b, lambda a, b: a + b, depth=3) / n


def fit(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """The whitening of all usable vectors of ``df`` (an array column); None where there is none.

    The driver holds one d x d matrix of doubles for vectors of d entries (32 KB for 64, 128 MB for 4,096), whatever the number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, list] = {}
        for batch in batches:
            for size, (rows, values) in usable(column(batch, vector)).items():
                sums = exact_sums(quantised(values))
                held = totals.setdefault(size, [0, [0] * size])
                held[0] += len(rows)
                held[1] = [a + b for a, b in zip(held[1], sums, strict=True)]
        for size, (n, sums) in totals.items():
            out = [pa.array([size] * size, pa.int32()), pa.array(range(size), pa.int32()), pa.array([n] * size, pa.int64()), pa.array(list(map(Decimal, sums)), pa.decimal128(38, 0))]
            yield pa.RecordBatch.from_arrays(out, ["size", "place", "n", "s"])
        release()

    parts = df.select(vector).mapInArrow(run, "size int, place int, n long, s decimal(38,0)")
    found: dict[int, dict[int, tuple[int, int]]] = {}
    for r in parts.groupBy("size", "place").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect():
        found.setdefault(r.size, {})[r.place] = r.n, int(r.s)
    if not found:
        return None
    size = max(found, key=lambda k: (found[k][0][0], k))
    n, sums = found[size][0][0], tuple(found[size][k][1] for k in range(size))
    covariance = outer_products(df, vector, n, sums)
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    trace = float(np.trace(covariance))
    fine = values > max(float(values[0]), 0.0) * size * np.finfo(float).eps
    projection = np.where(fine, vectors / np.sqrt(np.where(fine, values, 1.0)), 0.0)
    left = np.flatnonzero(fine)
    error = None
    if len(left):
        measured = outer_products(df, vector, n, sums, projection[:, left])
        error = float(np.abs(measured - np.eye(len(left))).max())
    explained = tuple(float(max(e, 0.0)) / trace if trace > 0 else None for e in values)
    return Whitening(n, sums, projection, explained, tuple(fine.tolist()), error)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    model = fit(vectors)
    if model is None:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    rows = model.transform(vectors).select("vec_id", F.expr("try_cast(deviation AS bigint)").alias("deviation"), F.posexplode("whitened").alias("place", "whitened"))
    explained = F.array(*[F.lit(e).cast("double") for e in model.explained])
    return rows.select("vec_id", (F.col("place") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("place")).alias("explained"), F.lit(model.identity_error).cast("double").alias("identity_error"))
