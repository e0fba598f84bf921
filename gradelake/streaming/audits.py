"""The audit of submitted bundles as transitions over state tables: due work, rounds, status, retry, strikes, retraction and the window's rollover.

State tables have a row a hotkey. Each function takes the tables before and gives the tables after; ``cycle`` composes them. Null counters are 0; a hotkey without a row has no state; empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradelake.config import PROTOCOL, Protocol
from gradelake.functions import native as N

# Reasons of failures that are no strike, since a race with the chain or another submitter explains them.
NO_STRIKE = ("commitment_disappeared", "commitment_changed", "no_rows_left", "duplicate_rollout")


def due(pending: DataFrame, block: int) -> DataFrame:
    """Pending audits whose challenge block is reached."""
    return pending.where(F.col("challenge_block") <= block)


def gates(correct: Column, protocol: Protocol = PROTOCOL) -> tuple[Column, Column]:
    """Rounds required and in total, capped by the rounds that cover all correct rows."""
    cover = N.div(correct.cast("long") + protocol.audit_rows - 1, protocol.audit_rows)
    return F.least(F.lit(protocol.required_rounds), cover).cast("int"), F.least(F.lit(protocol.total_rounds), cover).cast("int")


def audit_status(valid: Column, passed: Column, required: Column, total: Column) -> Column:
    return F.when(~F.coalesce(valid, F.lit(False)), "failed").when(passed >= total, "passed").when(passed >= required, "monitoring").otherwise("auditing")


def sample(scored: DataFrame, audited: DataFrame, seeds: DataFrame, protocol: Protocol = PROTOCOL) -> DataFrame:
    """hotkey, row_id of the next round: of each hotkey in ``seeds`` (hotkey, seed) its correct rows of least keyed hash that were not audited yet."""
    pool = scored.where("reward = 1").join(audited.select("hotkey", "row_id"), ["hotkey", "row_id"], "left_anti").join(F.broadcast(seeds), "hotkey")
    key = F.sha2(F.concat(F.lit(protocol.domain), F.lit("\0"), F.col("seed"), F.lit("\0audit\0"), F.col("row_id")), 256)
    least = pool.groupBy("hotkey").agg(F.slice(F.sort_array(F.collect_set(F.struct(key.alias("k"), F.col("row_id")))), 1, protocol.audit_rows).alias("x"))
    return least.select("hotkey", F.explode("x").alias("x")).select("hotkey", "x.row_id")


def audit_step(progress: DataFrame, reports: DataFrame, scores: DataFrame, protocol: Protocol = PROTOCOL) -> DataFrame:
    """hotkey, rounds_passed, exact, checked (over all rounds), correct, score, valid, audit_status, required and total rounds after one round.

    reports: hotkey and the row reports of the round (valid, exact, checked); scores: hotkey, correct, score of the whole bundle; progress: hotkey,
    rounds_passed, exact, checked before. A round passes if all its rows are valid with enough exact tokens; only a result with its required
    rounds is valid, and only a valid one has a score.
    """
    told = reports.groupBy("hotkey").agg(F.bool_and("valid").alias("all"), F.sum("exact").alias("e"), F.sum("checked").alias("c"))
    told = told.withColumn("ok", F.col("all") & (F.col("c") > 0) & (F.col("e") >= protocol.exact_ratio * F.col("c")))
    both = told.join(progress.select("hotkey", "rounds_passed", F.col("exact").alias("e0"), F.col("checked").alias("c0")), "hotkey", "left").join(scores, "hotkey")
    zero = F.lit(0)
    passed = F.coalesce("rounds_passed", zero) + F.col("ok").cast("int")
    required, total = gates(F.col("correct"), protocol)
    full = F.col("ok") & (passed >= required)
    return both.select("hotkey", passed.cast("int").alias("rounds_passed"), (F.coalesce("e0", zero) + F.col("e")).cast("long").alias("exact"), (F.coalesce("c0", zero) + F.col("c")).cast("long").alias("checked"), "correct",
                       F.when(full, F.col("score")).otherwise(0.0).alias("score"), full.alias("valid"), audit_status(F.col("ok"), passed, required, total).alias("audit_status"), required.alias("required"), total.alias("total"))


def retry(pending: DataFrame, failed: DataFrame, results: DataFrame, block: int, protocol: Protocol = PROTOCOL) -> tuple[DataFrame, DataFrame]:
    """(pending, results) after operational failures of the hotkeys in ``failed``: another attempt with a longer delay; a valid result of the same digest and
    revision is kept, any other becomes invalid with score 0, both retrying. pending: hotkey, digest, revision, challenge_block, attempts."""
    marked = pending.join(failed.select("hotkey").distinct().withColumn("f", F.lit(True)), "hotkey", "left")
    attempts = F.coalesce("attempts", F.lit(0)) + 1
    delay = F.greatest(F.lit(1), N.retry_delay(attempts))
    after = marked.select(*[F.when(F.col("f"), x).otherwise(F.col(c)).cast(pending.schema[c].dataType).alias(c) if x is not None else F.col(c) for c in pending.columns for x in [{"attempts": attempts, "challenge_block": block + delay}.get(c)]])
    now = marked.where("f").select("hotkey", F.col("digest").alias("d"), F.col("revision").alias("r"))
    both = now.join(results, "hotkey", "full_outer")
    same = F.coalesce(F.col("valid") & (F.col("d") == F.col("digest")) & (F.col("r") == F.col("revision")), F.lit(False))
    touched = F.col("d").isNotNull()
    new = {"valid": same, "score": F.when(same, F.col("score")).otherwise(0.0), "audit_status": F.lit("retrying"), "digest": F.col("d"), "revision": F.col("r")}
    return after, both.select(*[F.when(touched, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in results.columns])


def strike(strikes: DataFrame, failures: DataFrame, block: int, limit: int = 3, duration: int = 7_200) -> tuple[DataFrame, DataFrame]:
    """(strikes, new blacklist entries) after failures (hotkey, key, reason): each key counts once, lifecycle races do not count; at ``limit`` a hotkey is out.

    strikes: hotkey, keys; the blacklist: hotkey, since_block, until_block, rounds.
    """
    new = failures.where(~F.coalesce(F.col("reason"), F.lit("")).isin(*NO_STRIKE)).groupBy("hotkey").agg(F.collect_set("key").alias("new"))
    empty = F.array().cast("array<string>")
    both = strikes.join(new, "hotkey", "full_outer").select("hotkey", F.array_sort(F.array_union(F.coalesce("keys", empty), F.coalesce("new", empty))).alias("keys"))
    out = both.where(F.size("keys") >= limit).select("hotkey", F.lit(block).cast("long").alias("since_block"), F.lit(block + duration).cast("long").alias("until_block"), F.size("keys").alias("rounds"))
    return both.where(F.size("keys") < limit), out


def active(blacklist: DataFrame, block: int) -> DataFrame:
    """Entries that have not expired."""
    return blacklist.where(F.col("until_block") > block)


def retract(results: DataFrame, priority: DataFrame) -> DataFrame:
    """results of which those with rollouts (column rows_key) that an earlier submitter holds by now are copies: invalid, score 0. priority: key, hotkey."""
    owner = priority.select(F.col("key").alias("rows_key"), F.col("hotkey").alias("owner"))
    both = results.join(owner, "rows_key", "left")
    copy = F.coalesce(F.col("owner") != F.col("hotkey"), F.lit(False))
    new = {"valid": F.lit(False), "score": F.lit(0.0), "audit_status": F.lit("copied"), "copy_kind": F.lit("rollout"), "copy_source": F.col("owner")}
    return both.select(*[F.when(copy, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in results.columns])


def prune(priority: DataFrame, commitments: DataFrame, window: int) -> DataFrame:
    """Priorities of this window whose holder (hotkey and block) is still committed."""
    mine = priority.where(F.col("window") == window)
    return mine.join(commitments.select("hotkey", F.col("commit_block").alias("block")), ["hotkey", "block"], "left_semi").select(priority.columns)


def revise(pending: DataFrame, submissions: DataFrame, block: int, protocol: Protocol = PROTOCOL) -> DataFrame:
    """pending after the current submissions (hotkey, digest, revision, commit_block): what is unchanged goes on; a changed or new one starts at round 1."""
    now = submissions.select("hotkey", F.col("digest").alias("d"), F.col("revision").alias("r"), F.col("commit_block").alias("b"))
    both = now.join(pending, "hotkey", "left")
    same = F.coalesce((F.col("d") == F.col("digest")) & (F.col("r") == F.col("revision")), F.lit(False))
    start = {"digest": F.col("d"), "revision": F.col("r"), "commit_block": F.col("b"), "pinned_block": F.lit(block), "challenge_block": F.lit(block + protocol.audit_delay), "round": F.lit(1), "attempts": F.lit(0)}
    return both.select(*[F.when(same, F.col(c)).otherwise(start[c]).cast(pending.schema[c].dataType).alias(c) if c in start else F.col(c) for c in pending.columns])


def produced(done: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted rollouts (hotkey, window, revision, digest, block, limit) that were not produced with all of these equal before."""
    return wanted.dropDuplicates().join(done, wanted.columns, "left_anti")
