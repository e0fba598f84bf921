"""Merkle roots over ordered rows, reward bits, and confidence bounds."""

from __future__ import annotations

import hashlib
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradelake.functions import native as N

EMPTY = hashlib.sha256(b"").hexdigest()
FOLD = 10
#: Bytes of packed bits that are unpacked at a time.
PIECE = 512


def parent(left: bytes, right: bytes) -> bytes:
    return hashlib.sha256(b"node:" + left + right).digest()


def fold(level: list[bytes]) -> list[bytes]:
    """One level up; an odd node pairs with itself."""
    return [parent(level[i], level[min(i + 1, len(level) - 1)]) for i in range(0, len(level), 2)]


def leaf(payload: Column) -> Column:
    return F.unhex(F.sha2(F.concat(F.lit("leaf:"), payload), 256))


def _fold_block(only: bool):
    def up(part: pd.DataFrame) -> pd.DataFrame:
        hashes, steps = part.sort_values("i")["h"].tolist(), 0
        while len(hashes) > 1 if only else steps < FOLD:
            hashes, steps = fold(hashes), steps + 1
        return pd.DataFrame({"i": [int(part["b"].iloc[0])], "h": hashes})

    return up


def merkle_root(df: DataFrame, pos: str, payload: Column) -> str:
    """Root over the rows in the order of ``pos`` (0-based, without gaps). Aligned blocks of 2**FOLD leaves are folded side by side, each exactly
    FOLD levels unless it is the only one, until one hash is left; only that reaches the driver."""
    level = df.select(F.col(pos).cast("long").alias("i"), leaf(payload).alias("h"))
    count = df.count()
    if not count:
        return EMPTY
    while count > 1:
        blocks = -(-count >> FOLD)
        level = level.withColumn("b", F.shiftright("i", FOLD)).groupBy("b").applyInPandas(_fold_block(blocks == 1), "i long, h binary")
        count = blocks
    return bytes(level.first()["h"]).hex()


def pack_bits(df: DataFrame, group: list[str], pos: str, reward: str) -> DataFrame:
    """group, bits: rewards by position, least bit first in each byte, in base64. Rewards other than 0 and 1, and positions that repeat or leave a gap, are errors."""
    one = F.col(reward).cast("int")
    sound = N.demand(F.col(reward).isNotNull() & F.col(reward).isin(0, 1), one, "a reward is 0 or 1")
    byte = df.groupBy(*group, N.div(F.col(pos).cast("long"), 8).alias("byte")).agg(
        F.sum(sound * F.pow(F.lit(2), F.col(pos) % 8).cast("int")).alias("v"),
        F.count(F.lit(1)).alias("n"), F.count_distinct(F.col(pos)).alias("d"), F.max(pos).alias("top"), F.min(pos).alias("low"),
    )
    cells = F.sort_array(F.collect_list(F.struct("byte", F.lpad(F.hex("v"), 2, "0").alias("x"))))
    packed = byte.groupBy(*group).agg(F.base64(F.unhex(F.array_join(F.transform(cells, lambda c: c["x"]), ""))).alias("bits"), F.sum("n").alias("n"), F.sum("d").alias("d"), F.max("top").alias("top"), F.min("low").alias("low"))
    whole = (F.col("low") == 0) & (F.col("n") == F.col("d")) & (F.col("top") + 1 == F.col("n"))
    return packed.select(*group, N.demand(whole, F.col("bits"), "positions run from 0 without a gap and do not repeat").alias("bits"))


def _byte(raw: Column, i: Column) -> Column:
    """Byte i of a text of hex digits."""
    return F.conv(F.substr(raw, (i * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")


def checked_bits(bits: Column, rows: Column) -> Column:
    """Hex digits of packed bits; a length that does not fit or set padding bits are errors."""

    def checked(raw: Column) -> Column:
        n = F.length(raw) / 2
        padding = F.when(rows % 8 > 0, _byte(raw, n - 1) < F.pow(F.lit(2), rows % 8)).otherwise(True)
        return N.demand((n == F.ceil(rows / 8)) & padding, raw, "reward bits do not fit their rows")

    return N.bound(F.hex(F.unbase64(bits)), checked)


def unpack_bits(df: DataFrame, group: list[str], bits: str, rows: Column) -> DataFrame:
    """group, pos, reward; a length that does not fit or set padding bits are errors. An empty vector has no rows."""
    # a vector falls into pieces first, so that no row of a bit carries or walks through all of it
    count = rows.cast("long")
    steps = F.sequence(F.lit(0).cast("long"), N.div(count - 1, 8 * PIECE))
    cut = lambda raw: F.transform(steps, lambda i: F.struct((i * 8 * PIECE).alias("from"), F.substr(raw, (i * PIECE + 1).cast("int"), F.lit(PIECE)).alias("raw")))
    part = df.where(count > 0).select(*group, count.alias("rows_"), F.explode(N.bound(F.unhex(checked_bits(F.col(bits), rows)), cut)).alias("p_"))
    left = F.least(F.lit(8 * PIECE).cast("long"), F.col("rows_") - F.col("p_.from"))
    bit = F.explode(F.sequence(F.lit(0).cast("long"), left - 1)).alias("bit_")
    byte = _byte(F.hex(F.substr(F.col("p_.raw"), (N.div(F.col("bit_"), 8) + 1).cast("int"), F.lit(1))), F.lit(0))
    return part.select(*group, "p_", bit).select(*group, (F.col("p_.from") + F.col("bit_")).alias("pos"), (F.floor(byte / F.pow(F.lit(2), F.col("bit_") % 8)).cast("int") % 2).alias("reward"))


def bit_sums(one: Column, two: Column) -> Column:
    """struct(one, two, differ): bits set in each of two texts of hex digits of equal length, and bits that differ; 7 bytes at a time, so nothing is exploded.
    Both become bytes once, since a place in them is found at once and one in a text by going through what is before it."""
    part = lambda x, i: F.coalesce(F.conv(F.hex(F.substr(x, i * 7 + 1, F.lit(7))), 16, 10).cast("long"), F.lit(0).cast("long"))
    count = lambda x: F.bit_count(x).cast("long")
    zero = F.struct(*[F.lit(0).cast("long").alias(k) for k in ("one", "two", "differ")])

    def summed(both: Column) -> Column:
        x, y = both["x"], both["y"]
        steps = F.sequence(F.lit(0), F.greatest(F.ceil(F.length(x) / 7).cast("int") - 1, F.lit(0)))
        return F.aggregate(steps, zero, lambda s, i: F.struct((s["one"] + count(part(x, i))).alias("one"), (s["two"] + count(part(y, i))).alias("two"), (s["differ"] + count(part(x, i).bitwiseXOR(part(y, i)))).alias("differ")))

    return N.bound(F.struct(F.unhex(one).alias("x"), F.unhex(two).alias("y")), summed)


def familywise_z(z: float, comparisons: int) -> float:
    """The one-sided bound's z after a Bonferroni correction."""
    if comparisons < 1:
        raise ValueError("at least one comparison")
    if not 0 < z < float("inf"):
        raise ValueError("z is positive and finite")
    normal = NormalDist()
    return normal.inv_cdf(1 - (1 - normal.cdf(z)) / comparisons)


def paired_bound(delta: Column, z: float) -> tuple[Column, Column]:
    mean, n = F.avg(delta), F.count(delta)
    return mean, mean - F.lit(z) * F.coalesce(F.sqrt(F.var_samp(delta) / n), F.lit(0.0))


def unpaired_bound(p: Column, n: Column, q: Column, m: Column, z: float) -> Column:
    return p - q - F.lit(z) * F.sqrt(p * (1 - p) / n + q * (1 - q) / m)
