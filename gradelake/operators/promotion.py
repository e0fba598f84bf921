"""Commitments, champions, weights and published results, as tables in and tables out.

Rows: one row a hotkey in commitments, results and carried results (commitments before ``latest_commitments`` may repeat); null flags count as false, null
scores as 0; ties are told apart as each function states, at last by hotkey. Empty tables give empty results, and all weight to uid 0. Columns that end
in an underscore are the operators' own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradelake.config import PROTOCOL, Protocol
from gradelake.functions import native as N
from gradelake.operators import integrity as I
from gradelake.operators.ordering import own_names, position, settle
from gradelake.sources.published import current, publish, versions

#: Columns of a published result and of the leaderboard, with their types.
RESULT = {
    "hotkey": "string", "uid": "int", "valid": "boolean", "status": "string", "audit_status": "string", "score": "double", "raw_score": "double", "category_scores": "map<string,double>",
    "category_rows": "map<string,long>", "final_weight": "double", "correct": "long", "rows": "long", "digest": "string", "model_repo": "string", "model_revision": "string", "commit_block": "long",
    "rollout_repo": "string", "rollout_revision": "string", "audit_block": "long", "audited_count": "long", "audit_round": "int", "audit_required_rounds": "int", "audit_total_rounds": "int",
    "audit_exact_match_ratio": "double", "blacklisted_until_block": "long", "source_window": "long", "invalid_reason": "string",
}
BOARD = ["hotkey", "uid", "status", "valid", "score", "final_weight", "digest", "model_repo", "rollout_repo", "audit_status", "audit_round", "audit_required_rounds", "audit_total_rounds", "audited_count", "invalid_reason"]


def latest_commitments(commitments: DataFrame, window: int, protocol: Protocol = PROTOCOL) -> DataFrame:
    """The latest commitment of each registered hotkey that precedes the window; of one block the first by a hash of the digest."""
    before = own_names(commitments).where(F.col("uid").isNotNull() & N.precedes(F.col("commit_block"), window, protocol))
    tie = -F.conv(F.substring(F.sha2("digest", 256), 1, 12), 16, 10).cast("long")
    best = F.max_by(F.struct("uid", "commit_block", "digest"), F.struct("commit_block", tie.alias("tie")))
    return before.groupBy("hotkey").agg(best.alias("c_")).select("hotkey", "c_.*")


def copies(commitments: DataFrame) -> DataFrame:
    """commitments with copy_of: the first committer (block, then hotkey) of the digest, null for that one itself."""
    first = commitments.groupBy("digest").agg(F.min(F.struct("commit_block", "hotkey")).alias("f_"))
    return own_names(commitments).join(first, "digest").withColumn("copy_of", F.when(F.col("f_.hotkey") != F.col("hotkey"), F.col("f_.hotkey"))).drop("f_")


def verified() -> Column:
    """Whether a result counts: valid, with a positive score and a digest."""
    return F.coalesce(F.col("valid") & (F.col("score") > 0) & F.col("digest").isNotNull(), F.lit(False))


def carry_over(results: DataFrame, carried: DataFrame, window: int) -> DataFrame:
    """What goes into the next window: each hotkey's verified result of this window, else its last one carried, if it has a positive uid; with its source_window."""
    cols = ["uid", "digest", "score", *[c for c in ("model_repo", "model_revision", "rollout_repo", "rollout_revision", "commit_block") if c in results.columns and c in carried.columns]]
    now = results.where(verified()).select("hotkey", F.struct(*cols, F.lit(window).cast("long").alias("source_window")).alias("n_"))
    old = carried.where(verified()).select("hotkey", F.struct(*cols, F.col("source_window").cast("long").alias("source_window")).alias("o_"))
    both = now.join(old, "hotkey", "full_outer").select("hotkey", F.coalesce("n_", "o_").alias("x_"), F.when(F.col("n_").isNull(), "carried").otherwise("current").alias("origin"))
    return both.select("hotkey", "x_.*", F.lit(True).alias("valid"), F.lit(True).alias("carryover"), "origin").where("uid > 0")


def winner_weights(commitments: DataFrame, results: DataFrame, carried: DataFrame | None = None, protocol: Protocol = PROTOCOL) -> DataFrame:
    """uid, weight: the burn share to uid 0, the rest to the best verified result (score, then uid, then hotkey); all to uid 0 without one.

    A result of this window comes before a carried one; it has to be of the committed digest. Copies (column copy_of) and hotkeys without a positive
    uid take no part.
    """
    field = F.struct("digest", "score")
    elig = commitments.where("uid > 0")
    if "copy_of" in commitments.columns:
        elig = elig.where("copy_of IS NULL")
    elig = elig.select("hotkey", "uid", F.col("digest").alias("own_")).join(results.where(verified()).select("hotkey", field.alias("n_")), "hotkey", "left")
    found = F.col("n_")
    if carried is not None:
        elig = elig.join(carried.where(verified()).select("hotkey", field.alias("o_")), "hotkey", "left")
        found = F.coalesce("n_", "o_")
    best = elig.select("hotkey", "uid", "own_", found.alias("x_")).where("x_.digest = own_").orderBy(F.desc("x_.score"), "uid", "hotkey").limit(1).select("uid")
    burn = best.agg(F.when(F.count(F.lit(1)) > 0, protocol.burn_share).otherwise(1.0).alias("weight")).select(F.lit(0).cast("int").alias("uid"), "weight")
    return burn.unionByName(best.select(F.col("uid").cast("int").alias("uid"), F.lit(round(1 - protocol.burn_share, 12)).alias("weight")))


def weights_due(last_block: int | None, block: int, protocol: Protocol = PROTOCOL) -> bool:
    """Whether weights are to be set again; a failed attempt leaves the last block as it was."""
    return last_block is None or block - last_block >= protocol.weight_interval


DECISION = "block long, promoted boolean, reason string, comparisons long, z double, hotkey string, digest string, delta double, bound double"
CHAMPION = "hotkey string, digest string, score_at_promotion double, last_score double, last_window long, promoted_block long, parent_digest string, delta double, bound double"


def update_champion(results: DataFrame, champions: DataFrame, block: int, window: int, rows: int, z: float, margin: float, floor: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(champions, decision): at most one promotion. results: hotkey, digest, valid, score, rows, reward_bits, commit_block; champions (CHAMPION): none or one.

    Without a champion the best score above ``floor`` is promoted (ties: earlier block, then larger hotkey). Against a champion with a result of this
    window every candidate has a paired lower bound from the two reward vectors, against an absent one an unpaired bound to its last score; z is corrected
    for the number of candidates. The best bound (then difference, earlier block, larger hotkey) is promoted if it reaches ``margin``. Reward
    vectors stay packed: their counts of set and of differing bits give mean and variance. One champion's row and the best candidate's reach the driver.
    """
    # The reasons of decisions below.
    spark = results.sparkSession
    king = champions.limit(1).first()
    good = results.where(verified() & (F.col("digest") != "") & (F.col("rows") == rows) & F.col("reward_bits").isNotNull())
    block_order = F.coalesce(F.col("commit_block"), F.lit((1 << 63) - 1))
    told = {"block": block, "promoted": False, "reason": "no eligible challenger", "comparisons": None, "z": None, "hotkey": None, "digest": None, "delta": None, "bound": None}
    champion = king.asDict() if king is not None else None
    best = None
    if king is None:
        best = good.orderBy(F.desc("score"), block_order, F.desc("hotkey")).select("hotkey", "digest", "score", F.lit(None).cast("double").alias("delta"), F.lit(None).cast("double").alias("bound")).first()
        if best is not None:
            told["promoted"] = best.score > max(0.0, floor)
            told["reason"] = "first champion" if told["promoted"] else "bootstrap score below threshold"
    else:
        candidates = settle(good.where(F.col("digest") != king.digest))
        count = candidates.count()
        told["comparisons"], told["z"] = count, I.familywise_z(z, max(1, count))
        own = good.where((F.col("hotkey") == king.hotkey) & (F.col("digest") == king.digest)).select("score", "reward_bits").first()
        if own is not None:
            champion |= {"last_score": own.score, "last_window": window}
            n = F.lit(float(rows))
            sums = I.bit_sums(I.checked_bits(F.col("reward_bits"), F.lit(rows)), I.checked_bits(F.lit(own.reward_bits), F.lit(rows)))
            scored = candidates.withColumn("s_", sums).withColumn("delta", (F.col("s_.one") - F.col("s_.two")) / n)
            spread = F.greatest(F.lit(0.0), (F.col("s_.differ") - n * F.col("delta") * F.col("delta")) / F.lit(max(1.0, rows - 1.0)))
            scored = scored.withColumn("bound", F.col("delta") - F.lit(told["z"]) * F.sqrt(spread / n) if rows > 1 else F.col("delta"))
            won, lost = "clear paired improvement", "improvement below paired confidence threshold"
        else:
            last = king.last_score if king.last_score is not None else king.score_at_promotion
            scored = candidates.withColumn("delta", F.col("score") - F.lit(last)).withColumn("bound", I.unpaired_bound(F.col("score"), F.lit(rows), F.lit(last), F.lit(rows), told["z"]))
            won, lost = "clear unpaired improvement over inactive king", "inactive-king improvement below confidence threshold"
            if last is None or not count:
                scored, told["reason"] = scored.limit(0), "current king has no reference score"
        best = scored.orderBy(F.desc("bound"), F.desc("delta"), block_order, F.desc("hotkey")).select("hotkey", "digest", "score", "delta", "bound").first()
        if best is not None:
            told |= {"delta": best.delta, "bound": best.bound, "promoted": best.bound >= margin}
            told["reason"] = won if told["promoted"] else lost
    if told["promoted"]:
        told |= {"hotkey": best.hotkey, "digest": best.digest}
        champion = {"hotkey": best.hotkey, "digest": best.digest, "score_at_promotion": best.score, "last_score": best.score, "last_window": window, "promoted_block": block, "parent_digest": king.digest if king is not None else None, "delta": best.delta, "bound": best.bound}
    names = [x.split()[0] for x in CHAMPION.split(", ")]
    return spark.createDataFrame([tuple(champion[n] for n in names)] if champion else [], CHAMPION), spark.createDataFrame([tuple(told.values())], DECISION)


def challengers(scores: DataFrame, king: DataFrame, z: float, margin: float) -> DataFrame:
    """Every challenger's unpaired lower bound against the champion on record (one row: hotkey, n, p), and whether it reaches the margin. scores: hotkey, n, p."""
    told = king.limit(1).select(F.col("hotkey").alias("king"), F.col("n").alias("kn_"), F.col("p").alias("kp_"))
    both = scores.join(F.broadcast(told), F.col("hotkey") != F.col("king"))
    bound = I.unpaired_bound(F.col("p"), F.col("n"), F.col("kp_"), F.col("kn_"), z)
    return both.select("king", "hotkey", (F.col("p") - F.col("kp_")).alias("delta"), bound.alias("bound"), (bound >= margin).alias("promoted"))


def status() -> Column:
    """The public status: carried, rewarded, valid; of what is not valid auditing, retrying or blacklisted as the audit says, else invalid."""
    valid = F.coalesce(F.col("valid"), F.lit(False))
    bad = F.when(F.col("audit_status").isin("auditing", "retrying", "blacklisted"), F.col("audit_status")).otherwise("invalid")
    return F.when(F.coalesce(F.col("carryover"), F.lit(False)), "carried").when(~valid, bad).when(F.col("final_weight") > 0, "rewarded").otherwise("valid")


def result_rows(results: DataFrame, carried: DataFrame, weights: DataFrame) -> DataFrame:
    """The published row (RESULT) of every hotkey: a result of this window, whatever its state, else the carried one; with the last weight of its uid.

    The reason of an invalid result is its own where the table has that column, else the copy it is, else that the rollout is invalid.
    """
    extra = {"carryover": "boolean", "copy_kind": "string", "copy_source": "string", "audited_rows": "array<string>"}
    kinds = {k: v for k, v in RESULT.items() if k not in ("hotkey", "status", "final_weight")} | extra
    told = F.lit("invalid_reason" in results.columns)

    def whole(df: DataFrame, name: str) -> DataFrame:
        return df.select("hotkey", F.struct(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()]).alias(name))

    both = whole(results, "n_").join(whole(carried, "o_"), "hotkey", "full_outer")
    rows = both.select("hotkey", F.col("n_").isNotNull().alias("now_"), F.coalesce("n_", "o_").alias("x_")).select("hotkey", "now_", "x_.*")
    last = weights.select("uid", F.col("weight").alias("final_weight"))
    rows = rows.join(F.broadcast(last), "uid", "left").withColumn("final_weight", F.coalesce("final_weight", F.lit(0.0)))
    rows = rows.withColumns({"valid": F.coalesce("valid", F.lit(False)), "score": F.coalesce("score", F.lit(0.0)), "audited_count": F.coalesce(F.size("audited_rows").cast("long"), "audited_count", F.lit(0).cast("long"))}).withColumn("status", status())
    copy = F.when(F.col("copy_kind").isin("model", "rollout"), F.concat(F.col("copy_kind"), F.lit(" copy"), F.coalesce(F.concat(F.lit(" of "), F.nullif("copy_source", F.lit(""))), F.lit(""))))
    reason = F.coalesce(copy, F.when(F.col("status").isin("invalid", "blacklisted"), "invalid rollout"))
    rows = rows.withColumn("invalid_reason", F.when(told & F.col("now_"), F.nullif("invalid_reason", F.lit(""))).otherwise(reason))
    return rows.select(*[F.col(c).cast(t).alias(c) for c, t in RESULT.items()])


def leaderboard(results: DataFrame, limit: int | None = None) -> DataFrame:
    """Results with their rank by weight, score and hotkey; the first ``limit`` (over 0) of them."""
    if limit is not None and limit <= 0:
        raise ValueError("the limit is positive")
    keyed = results.select("*", (-F.coalesce("final_weight", F.lit(0.0))).alias("w"), (-F.coalesce("score", F.lit(0.0))).alias("s"))
    ranked = position(keyed, "w", "s", "hotkey", name="rank").withColumn("rank", F.col("rank") + 1).drop("w", "s")
    ranked = ranked.select("rank", *[c for c in (BOARD if set(BOARD) <= set(ranked.columns) else results.columns)])
    return ranked if limit is None else ranked.where(F.col("rank") <= limit)


def cell(protocol: Protocol = PROTOCOL) -> Column:
    """A result in a few characters: who is rewarded, valid, how far an audit is."""
    score = F.format_string("%.4f", F.coalesce("score", F.lit(0.0)))
    state = F.lower(F.coalesce(F.nullif("audit_status", F.lit("")), F.nullif("status", F.lit("")), F.lit("invalid")))
    rounds = F.format_string("%d/%d", F.coalesce("audit_round", F.lit(0)), F.coalesce(F.nullif("audit_total_rounds", F.lit(0)), F.lit(protocol.total_rounds)))
    out = F.when(state == "auditing", F.concat(F.lit("AUDIT "), rounds)).when(state == "retrying", F.concat(F.lit("RETRY "), rounds)).when(state == "blacklisted", "BLACKLIST").otherwise("INVALID")
    return F.when(F.coalesce("final_weight", F.lit(0.0)) > 0, F.concat(F.lit("KING "), score)).when(F.col("valid"), F.concat(F.lit("VALID "), score)).otherwise(out)


def short(x: Column) -> Column:
    """A long name by its two ends."""
    return F.when(F.length(x) > 20, F.concat(F.left(x, F.lit(8)), F.lit("..."), F.right(x, F.lit(6)))).otherwise(x)


def consensus(views: DataFrame, validators: list[str], limit: int | None = None) -> DataFrame:
    """rank, miner, uid and a cell a validator ("-" without a row): hotkeys by how many validators reward them, hold them valid, by mean valid score, and name."""
    valid = F.coalesce(F.col("valid"), F.lit(False))
    stats = views.groupBy("hotkey").agg(
        (-F.count_if(F.col("final_weight") > 0)).alias("k"), (-F.count_if(valid)).alias("v"), (-F.coalesce(F.avg(F.when(valid, F.coalesce("score", F.lit(0.0)))), F.lit(0.0))).alias("m"),
        F.min_by("uid", F.when(F.col("uid").isNotNull(), F.col("validator"))).alias("uid"),
    )
    cells = views.select("hotkey", "validator", cell().alias("cell")).groupBy("hotkey").pivot("validator", validators).agg(F.first("cell")).na.fill("-", validators)
    ranked = position(stats.join(cells, "hotkey"), "k", "v", "m", "hotkey", name="rank").withColumn("rank", F.col("rank") + 1)
    ranked = ranked if limit is None else ranked.where(F.col("rank") <= limit)
    return ranked.select("rank", short(F.col("hotkey")).alias("miner"), "uid", *[f"`{v}`" for v in validators])


def backfill(results: DataFrame, commitments: DataFrame, cols: list[str]) -> DataFrame:
    """results whose null ``cols`` are taken from the hotkey's current commitment, where that is of the same digest."""
    now = commitments.select("hotkey", "digest", *[F.col(c).alias(f"{c}_") for c in cols])
    return results.join(now, ["hotkey", "digest"], "left").select(*[F.coalesce(c, f"{c}_").alias(c) if c in cols else F.col(c) for c in results.columns])


def export_bundle(results: DataFrame, folder: str, keep: int = 2) -> dict:
    """Publishes summary and leaderboard as Parquet and a manifest with their Merkle roots and counts, as the next version in ``folder`` (see ``published``)."""
    spark, out = results.sparkSession, {}

    def write(aside: str) -> None:
        for name, df, key in (("summary", results, "hotkey"), ("leaderboard", leaderboard(results), "rank")):
            position(df.select(*sorted(df.columns)), key).write.parquet(f"{aside}/{name}")
            out[name] = _root(spark, aside, name)
        spark.createDataFrame([(k, r, n) for k, (r, n) in out.items()], "name string, root string, n long").coalesce(1).write.json(f"{aside}/manifest")

    publish(spark, folder, write, keep)
    return out


def _root(spark: SparkSession, folder: str, name: str) -> tuple[str, int]:
    df = spark.read.parquet(f"{folder}/{name}")
    cols = [c for c in sorted(df.columns) if c != "pos"]
    return I.merkle_root(df, "pos", F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})), df.count()


def verified_bundle(spark: SparkSession, folder: str) -> str | None:
    """The folder of the newest version of a bundle whose files have the roots and counts of its manifest; None without any."""
    for version in versions(spark, folder):
        told = {x["name"]: (x["root"], x["n"]) for x in spark.read.json(f"{version}/manifest").collect()}
        if set(told) == {"summary", "leaderboard"} and all(_root(spark, version, k) == v for k, v in told.items()):
            return version
    return None


def verify_bundle(spark: SparkSession, folder: str) -> bool:
    """Whether the current version's files still have the roots and counts of its manifest."""
    now = current(spark, folder)
    return now is not None and verified_bundle(spark, folder) == now


def miner_result(spark: SparkSession, folder: str, hotkey: str) -> DataFrame:
    """The summary's row of one hotkey from the newest verified version of a bundle."""
    if (version := verified_bundle(spark, folder)) is None:
        raise ValueError("the bundle does not have its stated roots")
    return spark.read.parquet(f"{version}/summary").where(F.col("hotkey") == hotkey).drop("pos")
