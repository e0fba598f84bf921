"""The validator's whole cycle as one dataflow: rollover, copies, due audits from validation to verdict, and the next challenges.

A ``State`` holds the tables that live between cycles; ``cycle`` gives the next state from the last one, the chain's view at a block and the bundles
that were fetched. An audit goes through these steps, each over all due submitters at once:

1. due work is held against the current commitments and its manifest, and the bundle's rows against the evaluation's, by number and place;
2. sound bundles enter the priorities; whoever does not hold the priority of its rows is a copy, and a former holder becomes one;
3. the others are scored, and a bundle with a broken row, or without a correct one, fails;
4. of each bundle the correct rows of least keyed hash that were not audited yet are sampled, and joined to their prompts, levels and tokens for the engine;
5. the engine's candidates become a report a row, reports a round, rounds a status; a bundle for which the engine gave less than a report a sampled row
   has an operational failure.

Deterministic failures count a strike, races of the lifecycle do not, and operational failures (a bundle or a report that is not there) are tried again
later, with the last valid result of the same revision kept. A submitter's verdict does not depend on the order in which submitters are looked at: who copies
whom is settled before anything is scored.

Rows: a row a hotkey in every table but audited (a row an audited row) and priority (a row a key); a hotkey without a row has no state. Null counters are 0.
Empty tables give empty results. Columns that end in an underscore are the operators' own.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradelake.config import PROTOCOL, Protocol
from gradelake.operators import grading as G
from gradelake.operators import promotion as P
from gradelake.operators.ordering import top_by_rank, written
from gradelake.sources.published import publish_tables, read_tables
from gradelake.streaming import audits as A
from gradelake.streaming import rounds as R

#: The state's tables and their columns.
TABLES = {
    "pending": "hotkey string, digest string, revision string, commit_block long, pinned_block long, challenge_block long, round int, attempts int",
    "results": "hotkey string, uid int, valid boolean, score double, raw_score double, correct long, rows long, digest string, revision string, commit_block long, audit_status string, reason string, copy_kind string, "
    "copy_source string, rows_key string, audit_round int, audit_required_rounds int, audit_total_rounds int, audited_count long, exact long, checked long, audit_block long, blacklisted_until_block long",
    "progress": "hotkey string, digest string, revision string, rounds_passed int, exact long, checked long",
    "audited": "hotkey string, digest string, revision string, row_id string",
    "priority": "key string, block long, hotkey string",
    "strikes": "hotkey string, keys array<string>",
    "blacklist": "hotkey string, since_block long, until_block long, rounds int",
    "carried": "hotkey string, uid int, digest string, score double, valid boolean, carryover boolean, source_window long, revision string, commit_block long",
}
NAMES = {t: [c.split()[0] for c in told.replace("array<string>", "array").split(", ")] for t, told in TABLES.items()}

#: Rows that the engine is to verify in, candidates of their tokens out (hotkey, row_id, position, submitted_token, token_id, logprob, rank).
Engine = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class State:
    pending: DataFrame
    results: DataFrame
    progress: DataFrame
    audited: DataFrame
    priority: DataFrame
    strikes: DataFrame
    blacklist: DataFrame
    carried: DataFrame

    @classmethod
    def empty(cls, spark: SparkSession) -> State:
        return cls(*(spark.createDataFrame([], TABLES[f.name]) for f in fields(cls)))

    def settled(self) -> State:
        """The state computed once, with its lineage cut."""
        return State(*(written(conform(getattr(self, f.name), f.name)) for f in fields(self)))


def save(state: State, folder: str) -> str:
    """The state's tables published together as the next version in ``folder``; a writer that dies leaves the version before."""
    tables = {f.name: conform(getattr(state, f.name), f.name) for f in fields(State)}
    return publish_tables(state.pending.sparkSession, folder, tables)


def load(spark: SparkSession, folder: str) -> State:
    """The last published state, an empty one where there is none."""
    found = read_tables(spark, folder, TABLES)
    return State.empty(spark) if found is None else State(**found)


@dataclass(frozen=True)
class Chain:
    """What is public at a block: current commitments (hotkey, uid, digest, commit_block), the rollout revision of each (hotkey, revision; missing where it
    could not be resolved), and the seed of each due challenge (hotkey, seed)."""

    block: int
    window: int
    commitments: DataFrame
    revisions: DataFrame
    seeds: DataFrame


@dataclass(frozen=True)
class Bundles:
    """What was fetched: manifests (hotkey, digest, revision, window, evaluation_root, rows_sha256, max_tokens) and rollouts (hotkey, pos, row_id, tokens)."""

    manifests: DataFrame
    rollouts: DataFrame


def conform(df: DataFrame, table: str) -> DataFrame:
    """df with the columns and types of a state table; what it lacks is null."""
    kinds = dict(c.split(" ", 1) for c in TABLES[table].split(", "))
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(kind).alias(c) for c, kind in kinds.items()])


def put(old: DataFrame, new: DataFrame, table: str) -> DataFrame:
    """old with the rows of new in place of those of the same hotkeys."""
    return old.join(new.select("hotkey"), "hotkey", "left_anti").select(NAMES[table]).unionByName(conform(new, table))


def rollover(state: State, window: int) -> State:
    """The state at the start of a window: what is verified is carried over, pending work, results and progress begin anew, priorities of other windows
    go; strikes and the blacklist stay."""
    carried = conform(P.carry_over(state.results, state.carried, window - 1), "carried")
    none = {t: getattr(state, t).limit(0) for t in ("pending", "results", "progress", "audited")}
    return replace(state, carried=carried, priority=state.priority.where(F.col("key").startswith(f"{window}:")), **none)


def validated(due: DataFrame, chain: Chain, bundles: Bundles, evaluation: DataFrame, root: str) -> DataFrame:
    """due with uid, rows_key, max_tokens and reason: why the submission is no sound bundle of this window, or null."""
    n = evaluation.count()
    ids = evaluation.select(F.col("pos").alias("pos_"), F.col("row_id").alias("id_"))
    theirs = bundles.rollouts.select("hotkey", "pos", "row_id").join(due.select("hotkey"), "hotkey", "left_semi")
    met = theirs.join(ids, (F.col("pos") == F.col("pos_")) & (F.col("row_id") == F.col("id_")), "left")
    places = met.groupBy("hotkey", "pos").agg(F.count(F.lit(1)).alias("n_"), F.count("pos_").alias("met_"))
    whole = places.groupBy("hotkey").agg(((F.sum("n_") == n) & (F.count_if((F.col("n_") == 1) & (F.col("met_") == 1)) == n)).alias("whole_"))
    now = chain.commitments.select("hotkey", "uid", F.col("digest").alias("digest_"), F.col("commit_block").alias("block_"))
    told = bundles.manifests.select("hotkey", *[F.col(c).alias(f"{c}_m_") for c in ("digest", "revision", "window", "evaluation_root")], "rows_sha256", "max_tokens")
    both = due.join(now, "hotkey", "left").join(told, "hotkey", "left").join(whole, "hotkey", "left")
    same = (F.col("digest_m_") == F.col("digest")) & (F.col("revision_m_") == F.col("revision")) & (F.col("window_m_") == chain.window) & (F.col("evaluation_root_m_") == root)
    reason = (
        F.when(F.col("digest_").isNull(), "commitment_disappeared")
        .when((F.col("digest_") != F.col("digest")) | ~F.col("block_").eqNullSafe(F.col("commit_block")), "commitment_changed")
        .when(F.col("rows_sha256").isNull(), "bundle_missing")
        .when(~F.coalesce(same, F.lit(False)), "manifest_mismatch")
        .when(~F.coalesce("whole_", F.lit(False)), "rows_differ")
    )
    key = F.concat(F.lit(f"{chain.window}:"), "rows_sha256")
    return both.select(*due.columns, "uid", key.alias("rows_key"), "max_tokens", reason.alias("reason"))


def sampled(scored: DataFrame, audited: DataFrame, seeds: DataFrame, protocol: Protocol = PROTOCOL) -> DataFrame:
    """hotkey, row_id of a round: the correct rows of least keyed hash that were not audited yet, of each hotkey in seeds (hotkey, seed)."""
    pool = scored.where("reward = 1").select("hotkey", "row_id").join(audited.select("hotkey", "row_id"), ["hotkey", "row_id"], "left_anti").join(seeds, "hotkey")
    key = F.sha2(F.concat(F.lit(protocol.domain), F.lit("\0"), F.col("seed"), F.lit("\0audit\0"), F.col("row_id")), 256)
    quota = seeds.select("hotkey", F.lit(protocol.audit_rows).cast("long").alias("quota"))
    return top_by_rank(pool.select("hotkey", "row_id", key.alias("rank")), "hotkey", "rank", "row_id", quota).select("hotkey", "row_id")


def to_verify(sample: DataFrame, evaluation: DataFrame, rollouts: DataFrame) -> DataFrame:
    """hotkey, row_id, prompt, reasoning_budget_tokens, tokens of the sampled rows."""
    theirs = rollouts.select("hotkey", "row_id", "tokens").join(sample, ["hotkey", "row_id"])
    return theirs.join(evaluation.select("row_id", "prompt", "reasoning_budget_tokens"), "row_id").select("hotkey", "row_id", "prompt", "reasoning_budget_tokens", "tokens")


def audit_due(state: State, chain: Chain, bundles: Bundles, evaluation: DataFrame, root: str, engine: Engine, tokenizer, protocol: Protocol = PROTOCOL) -> State:
    """The state after all due audits of a block."""
    due = A.due(state.pending, chain.block).select(NAMES["pending"])
    checked = written(validated(due, chain, bundles, evaluation, root))
    # Priorities: the earliest committer of a window's rows; a copy is told by the holder.
    sound = checked.where("reason IS NULL")
    priority = written(R.priority(state.priority, sound.select(F.col("rows_key").alias("key"), F.col("commit_block").alias("block"), "hotkey")))
    holders = priority.select(F.col("key").alias("rows_key"), F.col("hotkey").alias("holder_"))
    sound = sound.join(holders, "rows_key").withColumn("copy_source", F.when(F.col("holder_") != F.col("hotkey"), F.col("holder_"))).drop("holder_")
    # Scores.
    rows = bundles.rollouts.join(sound.where("copy_source IS NULL").select("hotkey", "max_tokens"), "hotkey")
    scored = written(G.score_bundles(evaluation, rows.select("hotkey", "pos", "row_id", "tokens", "max_tokens"), tokenizer, protocol))
    facts = scored.groupBy("hotkey").agg(F.count("fault").alias("faults"), F.sum("reward").alias("correct"), F.count(F.lit(1)).alias("rows"), (F.sum("reward") / F.count(F.lit(1))).alias("raw_score"))
    broken = F.when(F.col("copy_source").isNotNull(), "duplicate_rollout").when(F.col("faults") > 0, "rollout_fault").when(F.col("correct") == 0, "no_correct_rows")
    scores = written(sound.join(facts, "hotkey", "left").withColumn("reason", broken))
    # The sample and its reports.
    open_ = scores.where("reason IS NULL")
    before = state.audited.join(open_.select("hotkey", "digest", "revision"), ["hotkey", "digest", "revision"], "left_semi")
    chosen = written(sampled(scored.join(open_.select("hotkey"), "hotkey", "left_semi"), before, chain.seeds.join(open_.select("hotkey"), "hotkey", "left_semi"), protocol))
    candidates = engine(to_verify(chosen, evaluation, bundles.rollouts))
    by = ("hotkey", "row_id")
    reports = G.audit_rows(G.audit_positions(candidates, protocol, by), by).join(chosen, list(by), "left_semi")
    reports = written(reports)
    counts = chosen.groupBy("hotkey").agg(F.count(F.lit(1)).alias("wanted_")).join(reports.groupBy("hotkey").agg(F.count(F.lit(1)).alias("given_")), "hotkey", "left")
    seeded = chain.seeds.select("hotkey", F.lit(True).alias("seed_"))
    engaged = open_.join(counts, "hotkey", "left").join(seeded, "hotkey", "left")
    missing = F.when(F.col("seed_").isNull(), "seed_missing").when(F.col("wanted_").isNull(), "no_rows_left").when(F.coalesce("given_", F.lit(0)) < F.col("wanted_"), "engine_incomplete")
    engaged = written(engaged.withColumn("reason", missing))
    # Rounds.
    full = engaged.where("reason IS NULL")
    progress = state.progress.join(full.select("hotkey", "digest", "revision"), ["hotkey", "digest", "revision"], "left_semi")
    step = A.audit_step(progress.select("hotkey", "rounds_passed", "exact", "checked"), reports.join(full.select("hotkey"), "hotkey", "left_semi"), full.select("hotkey", "correct", F.col("raw_score").alias("score")), protocol)
    step = written(step.withColumnsRenamed({"valid": "valid_", "score": "score_", "audit_status": "status_", "correct": "correct_"}))
    done = full.join(step, "hotkey")
    count = before.groupBy("hotkey").agg(F.count(F.lit(1)).alias("old_"))
    done = done.join(count, "hotkey", "left").withColumn("audited_count", F.coalesce("old_", F.lit(0)) + F.col("wanted_"))
    passed = done.select(
        *due.columns, "uid", "rows_key", F.when(F.col("status_") == "failed", "round_failed").alias("reason"), "raw_score", "correct_", "rows", F.col("valid_").alias("valid"), F.col("score_").alias("score"), F.col("status_").alias("audit_status"),
        F.col("rounds_passed").alias("audit_round"), F.col("required").alias("audit_required_rounds"), F.col("total").alias("audit_total_rounds"), "audited_count", "exact", "checked",
    ).withColumnRenamed("correct_", "correct")
    # Failures of every step.
    again = ("bundle_missing", "seed_missing", "engine_incomplete")
    parts = [checked.where("reason IS NOT NULL"), scores.where("reason IS NOT NULL"), engaged.where("reason IS NOT NULL")]
    lost = parts[0].withColumn("copy_source", F.lit(None).cast("string"))
    for part in parts[1:]:
        lost = lost.unionByName(part.select(*parts[0].columns, "copy_source"))
    lost = written(lost)
    failed = lost.where(~F.col("reason").isin(*again))
    retried = lost.where(F.col("reason").isin(*again)).select("hotkey")
    failed = failed.withColumns({"valid": F.lit(False), "score": F.lit(0.0), "audit_status": F.when(F.col("copy_source").isNotNull(), "copied").otherwise("failed"), "copy_kind": F.when(F.col("copy_source").isNotNull(), "rollout")})
    # Strikes.
    told = failed.select("hotkey", "digest", "revision", "round", "reason").unionByName(passed.where("reason IS NOT NULL").select("hotkey", "digest", "revision", "round", "reason"))
    key = F.concat_ws(":", "digest", "revision", F.col("round").cast("string"))
    strikes, out = A.strike(state.strikes, told.select("hotkey", key.alias("key"), "reason"), chain.block)
    out = written(out)
    until = out.select("hotkey", F.col("until_block").alias("until_"))
    now = conform(passed, "results").unionByName(conform(failed, "results"))
    now = now.drop("audit_block").join(due.select("hotkey", F.col("challenge_block").alias("audit_block")), "hotkey").join(until, "hotkey", "left")
    now = now.withColumns({"audit_status": F.when(F.col("until_").isNotNull(), "blacklisted").otherwise(F.col("audit_status")), "blacklisted_until_block": F.col("until_")})
    results = put(state.results, written(now.select(NAMES["results"])), "results")
    # Former holders of a priority become copies, whatever they had.
    taken = state.priority.select("key", F.col("hotkey").alias("old_")).join(priority.select("key", F.col("hotkey").alias("new_")), "key").where("old_ <> new_")
    displaced = taken.groupBy(F.col("old_").alias("hotkey")).agg(F.min_by(F.struct("key", "new_"), "key").alias("x_")).select("hotkey", F.col("x_.key").alias("rows_key"), F.col("x_.new_").alias("copy_source"))
    facts = chain.commitments.select("hotkey", "uid", "digest", "commit_block")
    copied = displaced.join(facts, "hotkey", "left").select("hotkey", "uid", "digest", "commit_block", "rows_key", "copy_source", F.lit(False).alias("valid"), F.lit(0.0).alias("score"), F.lit("copied").alias("audit_status"), F.lit("rollout").alias("copy_kind"), F.lit("duplicate_rollout").alias("reason"))
    copied = written(copied)
    results = put(results, copied, "results")
    # What is done leaves the pending work; operational failures come back later.
    pending, results = settle_retries(state.pending, retried, results, chain.block, protocol)
    finished = passed.select("hotkey").union(failed.select("hotkey")).union(copied.select("hotkey")).union(out.select("hotkey"))
    pending = pending.join(finished, "hotkey", "left_anti")
    rounds = step.select("hotkey", "rounds_passed", "exact", "checked").join(full.select("hotkey", "digest", "revision"), "hotkey")
    more = chosen.join(done.select("hotkey", "digest", "revision"), "hotkey")
    return State(
        pending=pending.select(NAMES["pending"]),
        results=results,
        progress=put(state.progress, rounds, "progress"),
        audited=state.audited.unionByName(conform(more, "audited")),
        priority=conform(priority, "priority"),
        strikes=conform(strikes, "strikes"),
        blacklist=put(state.blacklist, out, "blacklist"),
        carried=state.carried,
    )


def settle_retries(pending: DataFrame, retried: DataFrame, results: DataFrame, block: int, protocol: Protocol = PROTOCOL) -> tuple[DataFrame, DataFrame]:
    """(pending, results) after operational failures: a kept result keeps all its columns, of any other only who was to be audited for what stays."""
    after, told = A.retry(pending.select(NAMES["pending"]), retried, written(results), block, protocol)
    told = conform(told, "results").join(retried.select("hotkey", F.lit(True).alias("again_")), "hotkey", "left")
    gone = F.coalesce("again_", F.lit(False)) & ~F.col("valid")
    stay = ("hotkey", "uid", "valid", "score", "digest", "revision", "audit_status")
    return written(after), written(told.select(*[F.col(c) if c in stay else F.when(~gone, F.col(c)).alias(c) for c in NAMES["results"]]))


def mark(state: State, chain: Chain) -> State:
    """The state with model copies and blacklisted hotkeys marked, copies whose original is gone released, and stale priorities dropped."""
    current = written(chain.commitments.select("hotkey", "uid", "digest", "commit_block"))
    copies = P.copies(current).where("copy_of IS NOT NULL")
    priority = written(A.prune(state.priority.withColumn("window", F.split("key", ":")[0].cast("long")), current, chain.window).select(NAMES["priority"]))
    holder = priority.select(F.col("key").alias("rows_key"), F.col("hotkey").alias("holder_"))
    was = state.results.where("audit_status = 'copied'").select("hotkey", "copy_kind", "rows_key")
    was = was.join(copies.select("hotkey", F.lit(True).alias("model_")), "hotkey", "left").join(holder, "rows_key", "left")
    still = F.when(F.col("copy_kind") == "model", F.col("model_")).when(F.col("copy_kind") == "rollout", F.col("holder_") != F.col("hotkey"))
    released = written(was.where(~F.coalesce(still, F.lit(False))).select("hotkey"))
    results = state.results.join(released, "hotkey", "left_anti").select(NAMES["results"])
    pending = state.pending.join(released, "hotkey", "left_anti").select(NAMES["pending"])
    told = {"valid": F.lit(False), "score": F.lit(0.0)}
    results = put(results, copies.withColumns(told | {"audit_status": F.lit("copied"), "copy_kind": F.lit("model"), "copy_source": F.col("copy_of"), "reason": F.lit("duplicate_model")}), "results")
    out = A.active(state.blacklist, chain.block)
    marked = out.select("hotkey", F.col("until_block").alias("blacklisted_until_block")).join(current, "hotkey", "left").withColumns(told | {"audit_status": F.lit("blacklisted"), "reason": F.lit("invalid_rounds")})
    # A former result's reasons are kept in the table of strikes, not here.
    return replace(state, priority=priority, results=put(results, written(marked), "results"), pending=pending.join(out.select("hotkey"), "hotkey", "left_anti").select(NAMES["pending"]), blacklist=out)


def scheduled(state: State, chain: Chain, protocol: Protocol = PROTOCOL) -> State:
    """The state with the next challenge of everyone who is to have one.

    Participants are current originals that are not out, with a resolved revision. Pending work of the same digest and revision goes on; of another one it
    begins anew, and so do result and progress. Failed and copied submissions wait for a new revision, complete ones too; those that have their required
    rounds go on only when all participants have them or are out (the barrier).
    """
    current = P.copies(chain.commitments.select("hotkey", "uid", "digest", "commit_block")).where("copy_of IS NULL").drop("copy_of")
    current = current.join(A.active(state.blacklist, chain.block).select("hotkey"), "hotkey", "left_anti").join(chain.revisions.where("revision IS NOT NULL").select("hotkey", "revision"), "hotkey")
    own = state.results.select("hotkey", F.col("digest").alias("digest_"), F.col("revision").alias("revision_"), "audit_status", F.coalesce("audit_round", F.lit(0)).alias("round_"), "audit_total_rounds")
    both = current.join(own, "hotkey", "left")
    same = F.coalesce((F.col("digest_") == F.col("digest")) & (F.col("revision_") == F.col("revision")), F.lit(False))
    both = written(both.withColumn("same_", same))
    out = F.col("same_") & F.col("audit_status").isin("failed", "copied", "blacklisted")
    reached = F.when(F.col("same_"), F.col("round_")).otherwise(0) >= protocol.required_rounds
    barrier = both.agg(F.coalesce(F.bool_and(F.coalesce(out, F.lit(False)) | reached), F.lit(True)).alias("complete_"))
    # A new revision is a new trial.
    fresh = written(both.where(~F.col("same_") & F.col("digest_").isNotNull()).select("hotkey"))
    progress = state.progress.join(fresh, "hotkey", "left_anti").select(NAMES["progress"])
    waiting = state.pending.select("hotkey", F.col("digest").alias("d_"), F.col("revision").alias("r_"))
    goes_on = F.coalesce((F.col("d_") == F.col("digest")) & (F.col("r_") == F.col("revision")), F.lit(False))
    total = F.coalesce("audit_total_rounds", F.lit(protocol.total_rounds))
    ended = F.col("same_") & (F.col("audit_status").isin("failed", "copied") | ((F.col("audit_status") == "passed") & (F.col("round_") >= total)))
    held = ~F.col("complete_") & (F.col("round_") >= protocol.required_rounds)
    each = both.join(waiting, "hotkey", "left").join(F.broadcast(barrier)).withColumn("on_", goes_on)
    due = each.where(~F.col("on_") & ~F.coalesce(ended, F.lit(False)) & ~F.coalesce(held, F.lit(False)))
    due = due.join(progress.select("hotkey", "digest", "revision", "rounds_passed"), ["hotkey", "digest", "revision"], "left")
    block = F.lit(chain.block).cast("long")
    new = due.select("hotkey", "digest", "revision", "commit_block", block.alias("pinned_block"), (block + protocol.audit_delay).alias("challenge_block"), (F.coalesce("rounds_passed", F.lit(0)) + 1).alias("round"), F.lit(0).alias("attempts"))
    kept = state.pending.join(each.where("on_").select("hotkey"), "hotkey", "left_semi").select(NAMES["pending"])
    rest = state.pending.join(each.select("hotkey"), "hotkey", "left_anti").select(NAMES["pending"])
    return replace(
        state,
        pending=kept.unionByName(rest).unionByName(conform(new, "pending")),
        results=state.results.join(fresh, "hotkey", "left_anti").select(NAMES["results"]),
        progress=progress,
        audited=state.audited.join(fresh, "hotkey", "left_anti").select(NAMES["audited"]),
    )


def cycle(state: State, last_window: int | None, chain: Chain, bundles: Bundles, evaluation: DataFrame, root: str, engine: Engine, tokenizer, protocol: Protocol = PROTOCOL) -> State:
    """One validator cycle: rollover where a window began, marks, due audits and the next challenges; the state comes back settled."""
    if last_window is not None and last_window != chain.window:
        state = rollover(state, chain.window).settled()
    state = audit_due(mark(state, chain), chain, bundles, evaluation, root, engine, tokenizer, protocol)
    return scheduled(state, chain, protocol).settled()


def status_counts(results: DataFrame) -> DataFrame:
    """One row: evaluated, valid, auditing, monitoring and invalid results."""
    status, valid = F.coalesce("audit_status", F.lit("")), F.coalesce("valid", F.lit(False))
    trying: Column = status.isin("auditing", "retrying")
    return results.agg(
        F.count(F.lit(1)).alias("evaluated"),
        F.count_if(valid).alias("valid"),
        F.count_if(~valid & trying).alias("auditing"),
        F.count_if((status == "monitoring") | (valid & (status == "retrying"))).alias("monitoring"),
        F.count_if(status.isin("failed", "blacklisted") | (~valid & ~trying)).alias("invalid"),
    )


def latest_audited(results: DataFrame) -> DataFrame:
    """hotkey, audit_block of the result that was audited last; of several the smallest hotkey."""
    return results.where("audit_block IS NOT NULL").orderBy(F.desc("audit_block"), "hotkey").limit(1).select("hotkey", "audit_block")
