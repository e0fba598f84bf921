import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gradelake import cli
from gradelake.operators import grading as G
from gradelake.operators import legacy as L
from gradelake.sources import artifacts as A
from gradelake.sources import sampled


def test_window_score_and_leaderboard(spark, tmp_path, capsys):
    (tmp_path / "raw.jsonl").write_text("".join(json.dumps({"problem": f"question {i}", "answer": str(i), "question_type": "x"}) + "\n" for i in range(300)))
    spec = {"name": "s", "kind": "jsonl", "paths": [f"{tmp_path}/raw.jsonl"], "schema": "problem string, answer string, question_type string", "normalizer": "typed_math", "category": "math", "verifier": "math_exact", "size": 300}
    (tmp_path / "sources.json").write_text(json.dumps([spec]))
    cli.main(["window", "--sources", f"{tmp_path}/sources.json", "--out", f"{tmp_path}/w", "--window", "3", "--block-hash", "ab" * 32, "--rows", "40"], spark)
    told = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert told["rows"] == 40 and len(told["root"]) == 64
    tok, rows = G.CodePoints(), spark.read.parquet(f"{tmp_path}/w/rows")
    level = F.col("reasoning_budget_tokens")
    tokens = F.concat(F.array(F.lit(tok.opening[0])), F.array_repeat(F.lit(97), level), F.array(F.lit(tok.closing[0])), F.transform(F.split(F.concat(F.lit("\\boxed{"), F.when(F.col("pos") < 30, F.col("expected")[0]).otherwise("no"), F.lit("}")), ""), F.ascii), F.array(F.lit(tok.stops[0])))
    sha, n = A.write_rollouts(rows.select("pos", F.regexp_replace("row_id", "^", "").alias("row_id"), tokens.alias("tokens")), f"{tmp_path}/b/rollouts.jsonl")
    manifest = {"hotkey": "h", "model_repo": "a/b", "model_revision": "1" * 40, "digest": "2" * 64, "window": 3, "evaluation_seed": told["seed"], "evaluation_root": told["root"], "row_count": n, "rows_sha256": sha, "base_model": "m", "base_revision": "r", "max_output_tokens": 30_000, "protocol": "p"}
    A.write_json(manifest, f"{tmp_path}/b/manifest.json")
    cli.main(["score", "--window", f"{tmp_path}/w", "--bundle", f"{tmp_path}/b"], spark)
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1]) == {"all": 0.75, "math": 0.75}
    kind = "hotkey string, uid int, valid boolean, score double, digest string, audit_status string, audit_round int, audit_total_rounds int"
    for k in range(2):
        spark.createDataFrame([("h1", 1, True, 0.5, "x", "passed", 50, 50), ("h2", 2, k == 0, 0.7, "y", "auditing", 3, 50)], kind).write.parquet(f"{tmp_path}/s{k}/results")
        spark.createDataFrame([("h3", 3, True, 0.2, "z", None, None, None)], kind).write.parquet(f"{tmp_path}/s{k}/carried")
        spark.createDataFrame([(0, 0.9), (1, 0.1)], "uid int, weight double").write.parquet(f"{tmp_path}/s{k}/weights")
        cli.main(["export", "--state", f"{tmp_path}/s{k}", "--out", f"{tmp_path}/p{k}"], spark)
        cli.main(["verify", f"{tmp_path}/p{k}"], spark)
    capsys.readouterr()
    cli.main(["leaderboard", f"{tmp_path}/p0", f"{tmp_path}/p1"], spark)
    out = capsys.readouterr().out
    assert out.index("h1") < out.index("h3") < out.index("h2") and "KING 0.5000" in out and "AUDIT 3/50" in out
    cli.main(["status", "--bundle", f"{tmp_path}/p0", "--hotkey", "h2"], spark)
    assert "valid" in capsys.readouterr().out
    with pytest.raises(ValueError):
        cli.main(["leaderboard", f"{tmp_path}/p0", "--limit", "0"], spark)
    with pytest.raises(ValueError):
        sampled.scan(spark, "csv", ["x"], "s", "n")


def test_older_protocol(spark):
    evaluation = spark.createDataFrame([(i, f"r{i}", f"p{i}", [str(i)], None) for i in range(10)], "pos long, row_id string, prompt string, expected array<string>, verifier string")
    rows = [("h", "a", i, f"r{i}", str(i if i < 7 else 99), [i, i], 1) for i in range(10)]
    submission = spark.createDataFrame(rows, "hotkey string, adapter_hash string, pos long, row_id string, answer string, tokens array<int>, reward_claimed int")
    scored = L.score_submission(submission, evaluation)
    assert L.score_of(scored, evaluation) == 0.7 and sorted(x.row_id for x in scored.where("mismatch").collect()) == ["r7", "r8", "r9"]
    answers, rollouts = L.roots(submission)
    expected = {"base_hash": "b", "evaluation_root": "e", "adapter_hash": "a"}
    head = expected | {"answer_root": answers, "rollout_root": rollouts}
    assert L.structure_faults(submission, evaluation, head, expected) == []
    assert L.structure_faults(submission.where("pos < 9"), evaluation, head | {"base_hash": "x"}, expected, {"k": b"x"}) == ["base_hash mismatch", "rows differ from the evaluation's in number or order", "answer_root mismatch", "rollout_root mismatch", "signature invalid"]
    adapter = spark.createDataFrame([(f"p{i}", [i, i] if i != 3 else [0]) for i in range(10)], "prompt string, tokens array<int>")
    audit = {x.row_id: x.valid for x in L.audit_submission(submission, scored, evaluation, adapter, "s", 20).collect()}
    assert audit == {f"r{i}": i != 3 for i in range(7)} and L.audit_submission(submission, scored, evaluation, adapter, "s", 3).count() == 3
    one = {"hotkey": "h", "adapter_hash": "a", "score": 0.7, "valid": True}
    vector = lambda xs: spark.createDataFrame(list(enumerate(xs)), "pos long, reward int")
    assert L.promote(one, True, None, None, vector([1]))["reason"] == "first champion" and not L.promote(one, False, None, None, vector([1]))["promoted"]
    assert L.promote(one, True, {"score": 0.695}, None, vector([1]))["reason"] == "improvement below threshold" and L.promote(one, True, {"score": 0.6}, None, vector([1]))["promoted"]
    won = L.promote(one, True, {"champion_id": "c"}, vector([0] * 90 + [1] * 10), vector([1] * 100))
    assert won["promoted"] and won["delta"] == pytest.approx(0.9) and len(won["champion_id"]) == 16
    with pytest.raises(PySparkException):
        L.promote(one, True, {}, vector([1]), vector([1, 0]))
    scores = spark.createDataFrame([("h", "a", 0.9, True, 0), ("h", "a", 0.4, True, 1), ("g", "b", 0.8, True, 2), ("f", "c", 0.7, True, 3)], "hotkey string, adapter_hash string, score double, valid boolean, ordinal int")
    audits = spark.createDataFrame([("a", True, 0), ("b", False, 1), ("c", True, 2)], "adapter_hash string, valid boolean, ordinal int")
    uids = spark.createDataFrame([("h", 1), ("f", 5), ("g", 2)], "hotkey string, uid int")
    assert {x.uid: x.weight for x in L.weights(scores, audits, uids).collect()} == {0: 0.9, 5: 0.1}
    assert {x.uid: x.weight for x in L.weights(scores.limit(0), audits, uids).collect()} == {0: 1.0}
