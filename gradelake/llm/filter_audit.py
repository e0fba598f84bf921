"""How filters interact: a Walsh-Hadamard audit over every subset and order of five filters.

1. One pass over the texts gives each document the bits of the filters A to D that it fails, and the digest of its text. Filter E (the text is that of
   a smaller doc_id, table-wide) is answered by aggregates on digests: the rows of one text, part and label class become one row before
   anything is compared, so a text of a third of all rows meets in no task. Texts are never shuffled.
2. For each part and label class (all, good, toxic) 32 signed parity sums are aggregated, sum((-1)**|mask & s|) for each subset s. They are
   plain sums, pre-aggregated by every task, and the transform inverts exactly: a cell of the 32 masks is the signed sum of them over 32.
3. From the cells follow, for each subset of filters, the documents that it keeps; an order's step is a difference of two subsets. A filter's Shapley
   sum over all orders is closed: a document with k failures is removed by each of its failing filters in 120 / k of the 120 orders.

Conditions (words are maximal runs ``[^\\x20\\x09-\\x0D]+``, case-sensitive): A under 200 words; B 100 * distinct words < 50 * words; C 100 * letters A-Z >
2 * code points; D any of ``#$%&*|``; E equal text at a smaller doc_id.

Rows: a null text is empty; it fails A, and E beside other empty texts. A null source is the part ``""``. Every row counts, a repeated one too; rows of
one doc_id are no copies of each other, and a null doc_id is neither smaller nor larger than any. A document is good (quality 1) or toxic (toxic 1) if
any of its labels says so; labels of no document count nowhere, and null labels say nothing. An empty table gives an empty result. Other columns, whatever
their names, are ignored. Texts count as equal by SHA-256.
"""

from __future__ import annotations

import hashlib
import itertools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradelake.llm.shared import release
from gradelake.llm.textcore import SPACE, column, text_buffer

FILTERS = "ABCDE"
MIN_WORDS, DISTINCT_SHARE, UPPER_SHARE, SYMBOLS = 200, 50, 2, b"#$%&*|"
#: Bytes of one text whose words are held at a time.
CHUNK = 1 << 20
MASKS, ORDERS = 1 << len(FILTERS), 120
LABELS = ("all", "good", "toxic")
#: A null doc_id joins nothing; such rows are dealt over this many keys.
NULL_SALTS = 64

_UPPER, _LEAD, _SYMBOL = np.zeros(256, np.uint8), np.ones(256, np.uint8), np.zeros(256, np.uint8)
_UPPER[65:91] = 1
_LEAD[0x80:0xC0] = 0
_SYMBOL[list(SYMBOLS)] = 1


def word_counts(text: memoryview) -> tuple[int, int]:
    """Words and distinct words; bytes.split parts at just these six white characters."""
    if len(text) <= CHUNK:
        words = bytes(text).split()
        return len(words), len(set(words))
    n, seen, start = 0, set(), 0
    while start < len(text):
        end = start + CHUNK
        while end < len(text) and not SPACE[text[end]]:
            end += 1
        words = bytes(text[start:end]).split()
        n += len(words)
        seen.update(words)
        start = end
    return n, len(seen)


def _masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offsets = text_buffer(column(batch, "text"))
        view, masks, digests = memoryview(raw), [], []
        for start, end in itertools.pairwise(offsets.tolist()):
            text, part = view[start:end], raw[start:end]
            words, distinct = word_counts(text)
            fails = (words < MIN_WORDS, 100 * distinct < DISTINCT_SHARE * words, 100 * int(np.count_nonzero(_UPPER[part])) > UPPER_SHARE * int(np.count_nonzero(_LEAD[part])), bool(_SYMBOL[part].any()))
            masks.append(sum(1 << k for k, x in enumerate(fails) if x))
            digests.append(hashlib.sha256(text).digest())
        yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "part"), pa.array(masks, pa.int32()), pa.array(digests, pa.binary())], ["doc_id", "part", "mask", "digest"])
    release()


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, good, toxic, mask and n: how many documents of a part and label class fail just the filters of the mask."""
    each = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), "text").mapInArrow(_masks, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, part string, mask int, digest binary")
    rated = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    rated = rated.select("doc_id", F.lit(0).alias("salt"), F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    # Repeated rows become one before the join, and rows without an id are dealt out.
    each = each.groupBy("doc_id", "part", "mask", "digest").agg(F.count(F.lit(1)).alias("n"))
    salt = F.when(F.col("doc_id").isNull(), 1 + F.pmod(F.xxhash64("digest"), F.lit(NULL_SALTS)).cast("int")).otherwise(0)
    each = each.withColumn("salt", salt).join(rated, ["doc_id", "salt"], "left").fillna(False, ["good", "toxic"])
    own = ["digest", "part", "good", "toxic"]  # now every doc_id has one row of each text and part
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first")
    groups = each.groupBy(*own, "mask").agg(first, F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))).alias("nulls"))
    least = groups.groupBy("digest").agg(F.min("first.doc_id").alias("least"))
    groups = groups.join(least, "digest")
    kept = F.coalesce("nulls", F.lit(0)) + F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    copies = F.explode(F.array(F.struct(F.col("mask").alias("m"), kept.alias("c")), F.struct((F.col("mask") + MASKS // 2).alias("m"), (F.col("n") - kept).alias("c"))))
    return groups.select("part", "good", "toxic", copies.alias("x")).select("part", "good", "toxic", F.col("x.m").alias("mask"), F.col("x.c").alias("n")).where("n > 0")


def parity_sums(cells: DataFrame) -> DataFrame:
    """part, label and sums: the 32 signed parity sums of a part's documents of a label class."""
    label = F.explode(F.filter(F.array(F.lit("all"), F.when(F.col("good"), F.lit("good")), F.when(F.col("toxic"), F.lit("toxic"))), lambda x: x.isNotNull()))
    sums = [F.sum(F.when(F.bit_count(F.col("mask").bitwiseAND(s)) % 2 == 1, -F.col("n")).otherwise(F.col("n"))).alias(f"s{s}") for s in range(MASKS)]
    return cells.select("part", label.alias("label"), "mask", "n").groupBy("part", "label").agg(*sums).select("part", "label", F.array(*[f"s{s}" for s in range(MASKS)]).alias("sums"))


def inverted(sums: Column) -> Column:
    """The 32 mask cells: each is the signed sum of the parity sums, over 32 without a rest."""

    def cell(mask: Column) -> Column:
        signed = F.transform(sums, lambda x, s: F.when(F.bit_count(s.bitwiseAND(mask)) % 2 == 1, -x).otherwise(x))
        return F.floor(F.aggregate(signed, F.lit(0).cast("long"), lambda a, x: a + x) / MASKS)

    return F.transform(F.sequence(F.lit(0), F.lit(MASKS - 1)), cell)


def total(cells: Column, chosen) -> Column:
    """For each subset s of the filters the documents of the cells that ``chosen(mask, s)`` names."""

    def of(s: Column) -> Column:
        return F.aggregate(F.transform(cells, lambda n, m: F.when(chosen(m, s), n).otherwise(0)), F.lit(0).cast("long"), lambda a, x: a + x)

    return F.transform(F.sequence(F.lit(0), F.lit(MASKS - 1)), of)


def over_cells(of) -> Column:
    """The sum of what ``of(count, mask)`` gives for the cells of all documents."""
    return F.aggregate(F.transform("all", lambda n, m: F.coalesce(of(n, m), F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, x: a + x)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row a part, order and step, zeros included."""
    sums = parity_sums(failures(docs, labels))
    by_label = sums.groupBy("part").agg(*[F.max(F.when(F.col("label") == x, F.col("sums"))).alias(x) for x in LABELS])
    none = F.array_repeat(F.lit(0).cast("long"), MASKS)
    cells = by_label.select("part", *[inverted(F.coalesce(F.col(x), none)).alias(x) for x in LABELS])
    kept = [total(F.col(x), lambda m, applied: m.bitwiseAND(applied) == 0).alias(f"{x}_kept") for x in LABELS]
    bits = [1 << k for k in range(len(FILTERS))]
    fails = F.array(*[over_cells(lambda n, m, b=b: F.when(m.bitwiseAND(b) != 0, n)) for b in bits])
    only = F.array(*[F.get("all", F.lit(b)) for b in bits])
    shapley = F.array(*[over_cells(lambda n, m, b=b: F.when(m.bitwiseAND(b) != 0, n * F.floor(F.lit(ORDERS) / F.bit_count(m)))) for b in bits])
    parts = cells.select("part", *kept, fails.alias("fails"), only.alias("only"), shapley.alias("shapley"))
    # Fixed rows: 600 orders and steps, whatever the input; before and then are the subsets applied before and after the step.
    steps = [(order, k, sum(1 << FILTERS.index(f) for f in order[:k]), FILTERS.index(order[k])) for order in itertools.permutations(FILTERS) for k in range(len(FILTERS))]
    steps = [{"filter_order": "".join(order), "step": k + 1, "before": before, "then": before + (1 << at), "at": at} for order, k, before, at in steps]
    steps = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order: string, step: int, before: int, then: int, at: int>>")
    rows = parts.withColumn("x", F.explode(steps))
    lost = lambda label: F.get(f"{label}_kept", F.col("x.before")) - F.get(f"{label}_kept", F.col("x.then"))
    return rows.select(
        "part",
        "x.filter_order",
        "x.step",
        F.get("all_kept", F.col("x.then")).alias("kept"),
        lost("all").alias("removed"),
        (F.get("fails", F.col("x.at")) - lost("all")).alias("redundant"),
        F.get("only", F.col("x.at")).alias("unique_fails"),
        lost("good").alias("good_lost"),
        lost("toxic").alias("toxic_lost"),
        F.get("shapley", F.col("x.at")).alias("shapley"),
    )


def op13_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP13_SQL = """
WITH t AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), firsts AS (
  SELECT text, min(doc_id) AS least FROM t GROUP BY text
), masks AS (
  SELECT t.doc_id, t.part,
    (CASE WHEN len(words) < 200 THEN 1 ELSE 0 END)
    + (CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * length(regexp_replace(t.text, '[^A-Z]', '', 'g')) > 2 * length(t.text) THEN 4 ELSE 0 END)
    + (CASE WHEN regexp_matches(t.text, '[#$%&*|]') THEN 8 ELSE 0 END)
    + (CASE WHEN t.doc_id > firsts.least THEN 16 ELSE 0 END) AS mask
  FROM t JOIN firsts ON t.text = firsts.text
), rated AS (
  SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), cells AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM masks LEFT JOIN rated ON masks.doc_id = rated.doc_id GROUP BY part, mask
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit
), orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31
), steps AS (
  SELECT filter_order, s AS step, bits[s] AS bit, coalesce(list_sum(bits[1:s - 1]), 0)::BIGINT AS before FROM orders, range(1, 6) AS r(s)
), one AS (
  SELECT part, filter_order, step, bit,
    sum(n) FILTER (mask & (before + bit) = 0) AS kept, sum(n) FILTER (mask & before = 0 AND mask & bit > 0) AS removed,
    sum(n) FILTER (mask & before > 0 AND mask & bit > 0) AS redundant, sum(n) FILTER (mask = bit) AS unique_fails,
    sum(good) FILTER (mask & before = 0 AND mask & bit > 0) AS good_lost, sum(toxic) FILTER (mask & before = 0 AND mask & bit > 0) AS toxic_lost
  FROM cells, steps GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
  CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost,
  CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost, CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM one
"""
