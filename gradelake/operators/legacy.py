"""The older submission protocol: submissions of texts with claimed rewards, scored, audited against an adapter's answers, promoted and weighted.

Rows: a submission (hotkey, adapter_hash, pos, row_id, answer, tokens, reward_claimed) has a row a row_id; evaluation rows are pos, row_id, prompt, expected,
verifier. An unknown row_id is graded against no expected value. Null rewards count as unclaimed; empty tables give a score of 0 and nothing to audit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradelake.config import PROTOCOL, Protocol
from gradelake.functions import canonical as C
from gradelake.functions import native as N
from gradelake.functions import scalars as S
from gradelake.operators import grading as G
from gradelake.operators import integrity as I


def roots(submission: DataFrame) -> tuple[str, str]:
    """Merkle roots of a submission's answers with their rewards, and of its tokens."""
    rows = submission.withColumn("reward", F.col("reward_claimed"))
    return I.merkle_root(rows, "pos", C.row_json(rows, ["answer", "reward", "row_id"])), I.merkle_root(rows, "pos", C.row_json(rows, ["row_id", "tokens"]))


def structure_faults(submission: DataFrame, evaluation: DataFrame, head: dict, expected: dict, keys: dict[str, bytes] | None = None) -> list[str]:
    """What is wrong with a submission: its head (base_hash, evaluation_root, adapter_hash, answer_root, rollout_root, signature) against what is expected (base_hash,
    evaluation_root, adapter_hash), its roots, its rows' ids and order, and its signature where keys are given."""
    # The messages of faults.
    out = [f"{k} mismatch" for k in ("base_hash", "evaluation_root", "adapter_hash") if head.get(k) != expected.get(k)]
    both = evaluation.select("pos", F.col("row_id").alias("want")).join(submission.select("pos", "row_id"), "pos", "full_outer")
    if both.where(~F.col("want").eqNullSafe(F.col("row_id"))).limit(1).count():
        out.append("rows differ from the evaluation's in number or order")
    out += [f"{k} mismatch" for k, root in zip(("answer_root", "rollout_root"), roots(submission), strict=True) if head.get(k) != root]
    if keys is not None and not S.signed({k: v for k, v in head.items() if k != "signature"}, head.get("signature", {}), keys):
        out.append("signature invalid")
    return out


def score_submission(submission: DataFrame, evaluation: DataFrame) -> DataFrame:
    """row_id, reward, claimed, mismatch of every submitted row; the score is the sum of rewards over the evaluation's rows."""
    known = evaluation.select("row_id", "expected", "verifier")
    rows = submission.join(known, "row_id", "left").withColumns({"expected": F.coalesce("expected", F.array(F.lit(None).cast("string"))), "response": F.coalesce("answer", F.lit(""))})
    graded = G.grade(rows.select("row_id", "response", "expected", "verifier", "reward_claimed"))
    return graded.select("row_id", "reward", F.col("reward_claimed").alias("claimed"), (~F.col("reward").eqNullSafe(F.col("reward_claimed"))).alias("mismatch"))


def score_of(scored: DataFrame, evaluation: DataFrame) -> float:
    return (scored.agg(F.sum("reward")).first()[0] or 0) / max(1, evaluation.count())


def audit_submission(submission: DataFrame, scored: DataFrame, evaluation: DataFrame, adapter: DataFrame, seed: str, rows: int, protocol: Protocol = PROTOCOL) -> DataFrame:
    """row_id, valid of ``rows`` correct rows by a keyed hash: whether the submitted tokens are those of the adapter's answer to the prompt (adapter: prompt, tokens)."""
    pool = scored.where("reward = 1").join(submission.select("row_id", "tokens"), "row_id").select("row_id", "tokens", N.keyed_rank(seed, "legacy_audit", F.col("row_id"), protocol).alias("r"))
    chosen = pool.orderBy("r", "row_id").limit(rows)
    told = chosen.join(evaluation.select("row_id", "prompt"), "row_id", "left").join(adapter.select("prompt", F.col("tokens").alias("made")), "prompt", "left")
    return told.select("row_id", F.coalesce(F.col("tokens") == F.col("made"), F.lit(False)).alias("valid"))


def promote(score: dict, audit_valid: bool, champion: dict | None, king: DataFrame | None, rewards: DataFrame, z: float = 2.326347874, margin: float = 0.01) -> dict:
    """The decision on one candidate: score (hotkey, adapter_hash, score, valid), its rewards (pos, reward), the champion's rewards or only its score."""
    out = {"promoted": False, "reason": "candidate failed scoring or audit", "delta": None, "bound": None, "champion_id": None}
    if not (score["valid"] and audit_valid):
        return out
    if king is not None:
        both = rewards.select("pos", F.col("reward").alias("a")).join(king.select("pos", F.col("reward").alias("b")), "pos", "full_outer")
        mean, bound = I.paired_bound(N.demand(F.col("a").isNotNull() & F.col("b").isNotNull(), F.col("a") - F.col("b"), "reward vectors of different lengths"), z)
        row = both.agg(mean.alias("m"), bound.alias("l")).first()
        out |= {"delta": row.m or 0.0, "bound": row.l or 0.0}
    elif champion is not None:
        out |= dict.fromkeys(("delta", "bound"), score["score"] - (champion.get("score") or 0.0))
    out["promoted"] = (king is None and champion is None) or out["bound"] >= margin
    out["reason"] = "first champion" if king is None and champion is None else "clear improvement" if out["promoted"] else "improvement below threshold"
    if out["promoted"]:
        told = {"hotkey": score["hotkey"], "adapter_hash": score["adapter_hash"], "score": score["score"], "parent": champion.get("champion_id") if champion else None}
        out["champion_id"] = S.hash_json(told)[:16]
    return out


def weights(scores: DataFrame, audits: DataFrame, uids: DataFrame, protocol: Protocol = PROTOCOL) -> DataFrame:
    """uid, weight: the best valid and audited hotkey (score, uid, hotkey) beside uid 0. scores: hotkey, adapter_hash, score, valid, ordinal (of several reports of
    an adapter the last counts, of several adapters of a hotkey the best); audits: adapter_hash, valid, ordinal; uids: hotkey, uid."""
    last = lambda df, *cols: df.groupBy("adapter_hash").agg(F.max_by(F.struct(*cols), "ordinal").alias("x"))
    told = last(scores, "hotkey", "score", "valid").select("adapter_hash", "x.*").where("valid AND score > 0 AND hotkey IS NOT NULL")
    good = told.join(last(audits, "valid").where("x.valid"), "adapter_hash", "left_semi").groupBy("hotkey").agg(F.max("score").alias("score"))
    best = good.join(uids.where("uid > 0"), "hotkey").orderBy(F.desc("score"), "uid", "hotkey").limit(1).select("uid")
    burn = best.agg(F.when(F.count(F.lit(1)) > 0, protocol.burn_share).otherwise(1.0).alias("weight")).select(F.lit(0).cast("int").alias("uid"), "weight")
    return burn.unionByName(best.select(F.col("uid").cast("int").alias("uid"), F.lit(round(1 - protocol.burn_share, 12)).alias("weight")))
