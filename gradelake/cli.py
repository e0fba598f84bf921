"""Command line: ``python -m gradelake.cli <command>`` builds windows, scores bundles, shows leaderboards and checks published results."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradelake.functions import scalars
from gradelake.operators import grading, promotion, window
from gradelake.sources import artifacts, sampled

SPEC = ("name", "kind", "paths", "normalizer", "category", "verifier", "license", "size", "columns", "schema")


def source_of(spark: SparkSession, spec: dict, seed: str) -> window.Source:
    """A source of a JSON spec: seeded row groups (kind parquet, with columns) or byte blocks (kind jsonl, with the schema of its objects)."""
    if unknown := set(spec) - set(SPEC):
        raise ValueError(f"unknown fields of a source: {sorted(unknown)}")
    sampled.register(spark)

    told = spec["kind"], spec["paths"], seed, spec["name"], spec.get("columns")

    def read(first: int, last: int) -> DataFrame:
        raw = sampled.scan(spark, *told, first=first, last=last)
        if spec["kind"] == "jsonl":
            raw = raw.select(F.from_json("value", spec["schema"]).alias("x"), "block_ord", "pos").select("x.*", "block_ord", "pos")
        return raw

    return window.Source(spec["name"], spec["size"], read, lambda: sampled.blocks(*told), spec["normalizer"], spec["category"], spec["verifier"], spec.get("license"))


def cmd_window(spark: SparkSession, args: argparse.Namespace) -> None:
    seed = scalars.evaluation_seed(args.network, args.window, args.block_hash)
    specs = json.loads(artifacts.read_bytes(args.sources, 1 << 20))
    held = window.ensure_window(spark, args.out, [source_of(spark, s, seed) for s in specs], seed, args.rows)
    print(json.dumps({"seed": seed, "rows": held.count(), "root": window.root_of(held)}))


def cmd_score(spark: SparkSession, args: argparse.Namespace) -> None:
    evaluation = spark.read.parquet(f"{args.window}/rows")
    _, rollouts = artifacts.load_bundle(spark, args.bundle, evaluation)
    scored = grading.score_rollouts(evaluation, rollouts, grading.CodePoints(), args.limit)
    if args.out:
        scored.write.mode("overwrite").parquet(args.out)
    print(json.dumps({x.category or "all": x.score for x in grading.category_scores(scored).collect()}))


def cmd_export(spark: SparkSession, args: argparse.Namespace) -> None:
    state = lambda name: spark.read.parquet(f"{args.state}/{name}")
    print(json.dumps(promotion.export_bundle(promotion.result_rows(state("results"), state("carried"), state("weights")), args.out)))


def _verified(spark: SparkSession, folder: str, name: str) -> DataFrame:
    if (version := promotion.verified_bundle(spark, folder)) is None:
        raise ValueError(f"{folder} does not have its stated roots")
    return spark.read.parquet(f"{version}/{name}")


def cmd_leaderboard(spark: SparkSession, args: argparse.Namespace) -> None:
    if args.limit is not None and args.limit <= 0:
        raise ValueError("the limit is positive")
    if len(args.bundles) == 1:
        board = _verified(spark, args.bundles[0], "leaderboard").drop("pos")
        board = board if args.limit is None else board.where(F.col("rank") <= args.limit)
        board.orderBy("rank").select("rank", "uid", "hotkey", "status", "score", "final_weight").show(args.limit or 1_000, truncate=False)
        return
    views, names = None, [f"validator_{i}" for i in range(len(args.bundles))]
    for name, folder in zip(names, args.bundles, strict=True):
        part = _verified(spark, folder, "summary").withColumn("validator", F.lit(name))
        views = part if views is None else views.unionByName(part)
    promotion.consensus(views, names, args.limit).orderBy("rank").show(args.limit or 1_000, truncate=False)


def cmd_status(spark: SparkSession, args: argparse.Namespace) -> None:
    promotion.miner_result(spark, args.bundle, args.hotkey).show(vertical=True, truncate=False)


def cmd_verify(spark: SparkSession, args: argparse.Namespace) -> None:
    if not promotion.verify_bundle(spark, args.bundle):
        sys.exit("the bundle does not have its stated roots")
    print("verified")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="gradelake")
    sub = top.add_subparsers(required=True)

    def add(name: str, run: Callable, *options: tuple) -> None:
        one = sub.add_parser(name, help=(run.__doc__ or "").strip() or None)
        one.set_defaults(run=run)
        for flag, kw in options:
            one.add_argument(flag, **kw)

    need = {"required": True}
    add("window", cmd_window, ("--sources", need), ("--out", need), ("--window", need | {"type": int}), ("--block-hash", need), ("--network", {"type": int, "default": 0}), ("--rows", {"type": int}))
    add("score", cmd_score, ("--window", need), ("--bundle", need), ("--limit", {"type": int}), ("--out", {}))
    add("export", cmd_export, ("--state", need), ("--out", need))
    add("leaderboard", cmd_leaderboard, ("bundles", {"nargs": "+"}), ("--limit", {"type": int}))
    add("status", cmd_status, ("--bundle", need), ("--hotkey", need))
    add("verify", cmd_verify, ("bundle", {}))
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    args.run(spark or SparkSession.builder.appName("gradelake").getOrCreate(), args)


if __name__ == "__main__":
    main()
