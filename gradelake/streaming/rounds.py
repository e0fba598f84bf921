"""Earliest-wins priorities and the audit rounds with their common barrier, over whole tables; ``keyed`` has the streams, ``cycle`` the composed loop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradelake.config import PROTOCOL, Protocol

def priority(state: DataFrame | None, batch: DataFrame) -> DataFrame:
    """key, block, hotkey: the earliest submitter of each key; one that turns up later with an earlier block displaces the holder."""
    new = batch.select("key", "block", "hotkey")
    both = new if state is None else state.unionByName(new)
    return both.groupBy("key").agg(F.min(F.struct("block", "hotkey")).alias("f")).select("key", "f.block", "f.hotkey")


def schedule(state: DataFrame, current: int, protocol: Protocol = PROTOCOL) -> DataFrame:
    """state (hotkey, round, status, challenge_block) with the next challenges. Up to the required rounds everyone goes on; beyond them a round starts
    only when all participants that are not out have reached it, which one aggregate row tells."""
    out = F.col("status").isin("failed", "copied", "blacklisted")
    slow = state.agg(F.min(F.when(~out, F.col("round"))).alias("least"))
    both = state.join(F.broadcast(slow))
    free = (F.col("round") < protocol.required_rounds) | (F.col("least") >= F.col("round"))
    go = ~out & F.col("challenge_block").isNull() & (F.col("round") < protocol.total_rounds) & free
    label = F.when(out, F.col("status")).when(F.col("round") >= protocol.total_rounds, "passed").when(F.col("round") >= protocol.required_rounds, "monitoring").otherwise("auditing")
    return both.select("hotkey", "round", label.alias("status"), F.when(go, current + protocol.audit_delay).otherwise(F.col("challenge_block")).alias("challenge_block"))
