"""Evaluation windows from raw sources: seeded blocks, normalisers, filters, de-duplication, quotas, budgets, order and attestation.

Sources are taken in their order; keys of rows that one selected are reserved against later ones. A source is read in portions of blocks in seeded order, each
portion once and going on where the one before ended, until its quota is filled or its blocks are at an end; the pool, cut at the end of the block that
fills the quota, is then ranked by a keyed hash. Blocks without a row are blocks like any other. A quota that cannot be filled, a wrong verifier and a
repeated id are errors, never a shorter window.

Rows: what a normaliser or filter rejects goes; repeated prompts and ids go after the first in scan order; ranks tie by row_id. Extra columns of raw
rows are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradelake.config import PROTOCOL, Protocol
from gradelake.functions import canonical as C
from gradelake.functions import native as N
from gradelake.operators import integrity as I
from gradelake.operators import normalize as R
from gradelake.operators import ordering as O

#: Blocks of a source's first portion; each further one is of four times as many.
FIRST_BLOCKS = 16
COLUMNS = ["row_id", "task_type", "prompt", "expected", "verifier", "source_dataset", "license", "category"]


@dataclass(frozen=True)
class Source:
    """A raw source: ``read(first, last)`` gives the rows of those blocks of the seeded order (the last excluded), with block_ord and pos, ``blocks()`` the
    number of blocks there are; size is its stated number of rows."""

    name: str
    size: int
    read: Callable[[int, int], DataFrame]
    blocks: Callable[[], int]
    normalizer: str
    category: str
    verifier: str
    license: str | None = None


def described(sources: list[Source]) -> list[dict]:
    """What a manifest says of the sources."""
    return [{k: v for k, v in vars(s).items() if k not in ("read", "blocks")} for s in sources]


def candidates(raw: DataFrame, source: Source, protocol: Protocol = PROTOCOL, rows_before: int = 0) -> DataFrame:
    """Normalised rows that pass the filters, with their place in the scan, fingerprint and category; ``rows_before`` is the number of raw rows of earlier blocks."""
    kwargs = {}
    if source.normalizer in R.BY_ORDINAL:  # rows are numbered from 1 over all blocks, rejected ones too
        before = raw.groupBy("block_ord").agg(F.count(F.lit(1)).alias("n_")).withColumn("before_", F.coalesce(F.sum("n_").over(Window.orderBy("block_ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        raw = raw.join(F.broadcast(before.select("block_ord", "before_")), "block_ord").withColumn("ordinal_", F.col("before_") + F.col("pos") + 1 + rows_before)
        kwargs["ordinal"] = F.col("ordinal_")
    rows = R.NORMALIZERS[source.normalizer](raw, source.name, license=source.license, **kwargs)
    rows = rows.withColumn("verifier", N.demand(F.col("verifier") == source.verifier, F.col("verifier"), f"source {source.name} made another verifier than {source.verifier}"))
    rows = rows.where(F.length("prompt").between(1, protocol.max_prompt) & N.suspicious(F.col("prompt")).isNull())
    return rows.select(*COLUMNS[:-1], F.lit(source.category).alias("category"), F.struct("block_ord", "pos").alias("scan"), N.fingerprint(F.col("prompt")).alias("print"))


def up_to_quota(pool: DataFrame, quota: int) -> DataFrame:
    """The pool up to the end of the block in which it reaches the quota. Blocks are few: a row each."""
    blocks = pool.groupBy(F.col("scan.block_ord").alias("block_")).agg(F.count(F.lit(1)).alias("n_"))
    before = F.coalesce(F.sum("n_").over(Window.orderBy("block_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    need = blocks.withColumn("before_", before).where(F.col("before_") < quota).select("block_")
    return pool.join(F.broadcast(need), F.col("scan.block_ord") == F.col("block_"), "left_semi")


def select_source(source: Source, seed: str, quota: int, reserved: DataFrame | None, protocol: Protocol = PROTOCOL) -> DataFrame:
    """The quota rows of a source of the smallest keyed ranks, with their fingerprints."""
    pool, seen, done, portion, before, usable = None, reserved, 0, FIRST_BLOCKS, 0, 0
    total = source.blocks()
    while usable < quota:
        if done >= total:
            raise ValueError(f"source {source.name} gave {usable} usable rows and needs {quota}")
        last = min(done + portion, total)
        raw = O.settle(source.read(done, last))  # opened once; what follows reads the settled rows
        new = O.settle(O.two_key_dedupe(candidates(raw, source, protocol, before), "scan", "row_id", "print", seen))
        pool = new if pool is None else pool.unionByName(new)
        keys = new.select("row_id", "print")
        seen = keys if seen is None else seen.unionByName(keys)
        before, usable = before + raw.count(), usable + new.count()
        done, portion = last, portion * 4
    ranked = up_to_quota(pool, quota).withColumn("rank", N.keyed_rank(seed, source.name, F.col("row_id"), protocol))
    need = pool.sparkSession.createDataFrame([(source.name, quota)], "source_dataset string, quota long")
    return O.settle(O.top_by_rank(ranked, "source_dataset", "rank", "row_id", need).select(*COLUMNS, "print"))


def build_window(spark: SparkSession, sources: list[Source], seed: str, rows: int | None = None, protocol: Protocol = PROTOCOL) -> DataFrame:
    """pos and the evaluation row (COLUMNS, reasoning_budget_tokens) of exactly ``rows`` rows (the protocol's number, if none is given)."""
    rows = protocol.evaluation_rows if rows is None else rows
    sizes = spark.createDataFrame([(s.name, s.size) for s in sources], "name string, size long")
    quotas = dict(map(tuple, O.quotas(sizes, rows).collect()))
    kept: DataFrame | None = None
    for source in sources:
        reserved = None if kept is None else kept.select("row_id", "print")
        part = select_source(source, seed, quotas[source.name], reserved, protocol)
        kept = part if kept is None else kept.unionByName(part)
    if kept is None or kept.count() != rows:
        raise ValueError(f"the window has another number of rows than {rows}")
    if kept.select("row_id").distinct().count() != rows:
        raise ValueError("the window has a repeated row_id")
    order = kept.select(*COLUMNS, N.budget(seed, F.col("row_id"), protocol).alias("reasoning_budget_tokens"), N.keyed_rank(seed, "order", F.col("row_id"), protocol).alias("o"))
    return O.position(order, "o", "row_id").drop("o").select("pos", *COLUMNS, "reasoning_budget_tokens")


def histograms(window: DataFrame) -> DataFrame:
    """kind, value, n: rows by task, category, verifier, license (null as None) and reasoning budget, from one pass."""
    kinds = {"task_type": "task_type", "category": "category", "verifier": "verifier", "license": "license", "budget": "reasoning_budget_tokens"}
    each = F.array(*[F.struct(F.lit(k).alias("kind"), F.coalesce(F.col(c).cast("string"), F.lit("None")).alias("value")) for k, c in kinds.items()])
    return window.select(F.explode(each).alias("x_")).groupBy("x_.kind", "x_.value").agg(F.count(F.lit(1)).alias("n"))


def root_of(window: DataFrame) -> str:
    """Merkle root over the rows in their order."""
    cols = [c for c in sorted(window.columns) if c != "pos"]
    return I.merkle_root(window, "pos", C.row_json(window, cols))


def identity(sources: list[Source], protocol: Protocol = PROTOCOL) -> str:
    """Hash of all that decides which rows pass: sources, filters, limits and domain."""
    told = {"sources": described(sources), "suspicious": N.SUSPICIOUS, "conflict": R.CONFLICT, "protocol": asdict(protocol)}
    return hashlib.sha256(json.dumps(told, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def ensure_window(spark: SparkSession, folder: str, sources: list[Source], seed: str, rows: int | None = None, protocol: Protocol = PROTOCOL) -> DataFrame:
    """The window's table in ``folder``: reused only if its manifest tells the same seed, identity and count and its recomputed root is the stated one, else built."""
    want = {"seed": seed, "identity": identity(sources, protocol), "rows": protocol.evaluation_rows if rows is None else rows}
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/manifest")
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        told = spark.read.json(f"{folder}/manifest").first().asDict()
        held = spark.read.parquet(f"{folder}/rows")
        if {k: told.get(k) for k in want} == want and held.count() == want["rows"] and root_of(held) == told.get("root"):
            return held
    build_window(spark, sources, seed, rows, protocol).write.mode("overwrite").parquet(f"{folder}/rows")
    held = spark.read.parquet(f"{folder}/rows")
    line = json.dumps(want | {"root": root_of(held), "sources": described(sources), "histograms": {f"{x.kind}:{x.value}": x.n for x in histograms(held).collect()}}, sort_keys=True)
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/manifest")
    return held
