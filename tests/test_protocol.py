import random
from statistics import NormalDist

import pytest
from pyspark.errors import PySparkException

from pyspark.sql import functions as F

from gradelake.operators import grading as G
from gradelake.operators import integrity as I
from gradelake.operators import promotion as P
from gradelake.streaming import audits as A
from gradelake.streaming import rounds as S


def test_rollouts(spark):
    cases = [([5, 9], None), ([], "no_room_or_empty"), ([9, 5], "continues_after_stop"), ([5] * 10, None), ([5] * 11, "too_long"), ([5, 5], "no_terminal"), (None, "no_room_or_empty")]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t array<int>")
    got = {x.i: x.f for x in df.select("i", G.rollout_fault(F.col("t"), F.lit(100), [9, 8], F.lit(10)).alias("f")).collect()}
    assert got == {i: f for i, (_, f) in enumerate(cases)}


def test_reasoning(spark):
    cases = [([1] + [10] * 922 + [2, 7], (True, 922, [7])), ([1] + [10] * 921 + [2, 7], (False, None, None)), ([10] * 922 + [2, 7], (False, None, None)), ([1] + [10] * 1000, (False, None, None)), ([1] + [10] * 1126 + [2], (True, 1126, []))]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t array<int>")
    got = {x.i: (x.s.valid, x.s.n, x.s.answer) for x in df.select("i", G.split_reasoning(F.col("t"), [1], [2], F.lit(1024)).alias("s")).collect()}
    assert got == {i: e for i, (_, e) in enumerate(cases)}


def test_grades(spark):
    rows = [
        (0, "\\boxed{42}", ["41", "42"], "math_exact", 1), (1, "0.5", ["1/2"], "math_exact", 0), (2, "Answer: (c)", ["C"], "mcqa_letter", 1), (3, "the answer is complicated", ["C"], "mcqa_letter", 0),
        (4, '{"output": "x"}', ["y", "x"], "json_output_exact", 1), (5, " A  b", ["a B"], "label_match", 1), (6, "it is 1,000.0", ["1000"], "exact_or_numeric", 1), (7, "none", [None], "exact_or_numeric", 1), (8, None, ["42"], "math_exact", 0),
    ]
    df = spark.createDataFrame([r[:4] for r in rows], "i int, response string, expected array<string>, verifier string")
    assert {x.i: x.reward for x in G.grade(df).collect()} == {r[0]: r[4] for r in rows}
    scored = spark.createDataFrame([("a", 1), ("a", 0), ("b", 1)], "category string, reward int")
    assert sorted(map(tuple, G.category_scores(scored).collect()), key=str) == sorted([(None, 3, 2 / 3), ("a", 2, 0.5), ("b", 1, 1.0)], key=str)


def test_audit(spark):
    rows = [("r", 0, 5, 5, -0.1), ("r", 0, 5, 6, -2.0), ("r", 1, 6, 5, -0.1), ("r", 1, 6, 6, -0.3), ("r", 2, 7, 5, -0.1), ("r", 2, 7, 7, -0.6), ("q", 0, 9, 1, -1.0), ("s", 0, 3, 3, -1.0), ("s", 0, 3, 4, -1.0)]
    df = spark.createDataFrame(rows, "row_id string, position int, submitted_token int, token_id int, logprob double")
    reports = {x.row_id: x for x in G.audit_rows(G.audit_positions(df)).collect()}
    assert (reports["r"].valid, reports["r"].failure.position, reports["r"].failure.rank, reports["r"].exact, reports["r"].checked) == (False, 2, 2, 1, 3)
    assert not reports["q"].valid and reports["s"].valid and reports["s"].exact == 1
    one = G.round_valid(G.audit_rows(G.audit_positions(df.where("row_id = 's'")))).first()
    assert one.valid and not G.round_valid(G.audit_rows(G.audit_positions(df.limit(0)))).first().valid


def test_commitments_and_weights(spark):
    kind = "hotkey string, uid int, commit_block long, digest string"
    rows = [("a", 1, 35_999, "x"), ("a", 1, 36_000, "y"), ("b", 2, 100, "x"), ("c", None, 5, "z"), ("d", 4, 50, "w")]
    now = P.latest_commitments(spark.createDataFrame(rows, kind), 10)
    assert sorted((x.hotkey, x.digest) for x in now.collect()) == [("a", "x"), ("b", "x"), ("d", "w")]
    assert {x.hotkey: x.copy_of for x in P.copies(now).collect()} == {"a": "b", "b": None, "d": None}
    kind = "hotkey string, uid int, digest string, score double, valid boolean"
    results = spark.createDataFrame([("b", 2, "x", 0.5, True), ("d", 4, "other", 0.9, True), ("a", 1, "x", 0.95, False)], kind)
    assert {x.uid: round(x.weight, 9) for x in P.winner_weights(now, results).collect()} == {0: 0.9, 2: 0.1}  # neither another digest nor an invalid result wins
    assert {x.uid: x.weight for x in P.winner_weights(now, results.limit(0)).collect()} == {0: 1.0}
    old = spark.createDataFrame([("d", 4, "w", 0.8, True, 3), ("e", 5, "v", 0.7, True, 2), ("f", 0, "u", 0.9, True, 2), ("g", 7, "u", 0.9, False, 2)], kind + ", source_window long")
    assert {x.uid: round(x.weight, 9) for x in P.winner_weights(now, results.where("hotkey <> 'd'"), old).collect()} == {0: 0.9, 4: 0.1}
    assert {x.uid for x in P.winner_weights(P.copies(now).where("hotkey = 'a'"), spark.createDataFrame([("a", 1, "x", 0.5, True)], kind)).collect()} == {0}  # a copy
    got = {x.hotkey: (x.uid, x.digest, x.score, x.source_window, x.origin) for x in P.carry_over(results, old, 9).collect()}
    assert got == {"b": (2, "x", 0.5, 9, "current"), "d": (4, "other", 0.9, 9, "current"), "e": (5, "v", 0.7, 2, "carried")}


def test_champions(spark):
    n, z = 400, 2.3263478740408408
    r = random.Random(4)
    base = [r.randint(0, 1) for _ in range(n)]
    vectors = {"k": base, "a": [1 if i < 40 else x for i, x in enumerate(base)], "b": base, "c": [1 - x for x in base]}
    bits = {x.k: x.bits for x in I.pack_bits(spark.createDataFrame([(k, i, x) for k, v in vectors.items() for i, x in enumerate(v)], "k string, pos long, r int"), ["k"], "pos", "r").collect()}
    kind = "hotkey string, digest string, valid boolean, score double, rows long, reward_bits string, commit_block long"
    results = spark.createDataFrame([(k, f"d{k}", True, sum(v) / n, n, bits[k], 10) for k, v in vectors.items()] + [("z", "dz", False, 1.0, n, bits["a"], 1), ("y", "dy", True, 1.0, n - 1, bits["a"], 1)], kind)
    none = spark.createDataFrame([], P.CHAMPION)
    first, told = (x.first() for x in P.update_champion(results, none, 5, 1, n, z, 0.01))
    best = max(vectors, key=lambda k: (sum(vectors[k]), k))
    assert (first.hotkey, told.reason, first.parent_digest) == (best, "first champion", None)
    assert not P.update_champion(results, none, 5, 1, n, z, 0.01, floor=0.99)[1].first().promoted and P.update_champion(results.limit(0), none, 5, 1, n, z, 0.01)[0].count() == 0
    king = spark.createDataFrame([("k", "dk", 0.1, 0.2, 0, 1, None, None, None)], P.CHAMPION)
    after, told = (x.first() for x in P.update_champion(results, king, 7, 2, n, z, 0.01))
    d = [a - b for a, b in zip(vectors["a"], base, strict=True)]
    mean = sum(d) / n
    low = mean - NormalDist().inv_cdf(1 - (1 - NormalDist().cdf(z)) / 3) * (sum((x - mean) ** 2 for x in d) / (n - 1) / n) ** 0.5
    assert told.comparisons == 3 and told.delta == pytest.approx(mean, abs=1e-12) and told.bound == pytest.approx(low, abs=1e-12)
    assert (told.promoted, after.hotkey, after.parent_digest, after.promoted_block) == (low >= 0.01, "a", "dk", 7)
    kept, told = (x.first() for x in P.update_champion(results, king, 7, 2, n, z, 0.5))
    assert (told.promoted, told.reason, kept.hotkey, kept.last_window) == (False, "improvement below paired confidence threshold", "k", 2)
    absent = spark.createDataFrame([("q", "dq", 0.1, 0.05, 0, 1, None, None, None)], P.CHAMPION)
    after, told = (x.first() for x in P.update_champion(results, absent, 7, 2, n, z, 0.01))
    assert told.promoted and told.reason == "clear unpaired improvement over inactive king" and after.hotkey == best and told.comparisons == 4
    assert P.update_champion(results, spark.createDataFrame([("q", "dq", None, None, 0, 1, None, None, None)], P.CHAMPION), 7, 2, n, z, 0.01)[1].first().reason == "current king has no reference score"
    scores, one = spark.createDataFrame([("k", 100, 0.5), ("a", 100, 0.9)], "hotkey string, n int, p double"), spark.createDataFrame([("k", 100, 0.5)], "hotkey string, n int, p double")
    bound = P.challengers(scores, one, 2.0, 0.1).first()
    assert bound.king == "k" and P.challengers(scores, one, 2.0, bound.bound).first().promoted  # a bound equal to the margin reaches it


def test_status(spark):
    kind = "hotkey string, uid int, valid boolean, score double, digest string, audit_status string"
    rows = [("a", 1, True, 0.5, "x", "passed"), ("b", 2, True, 0.4, "x", "monitoring"), ("c", 1, False, 0.0, "x", "failed"), ("d", 3, False, 0.0, "x", "retrying"), ("e", None, False, None, None, "blacklisted"), ("f", 4, None, 0.0, "x", "auditing")]
    carried = spark.createDataFrame([("a", 1, True, 0.1, "x", None, True), ("g", 9, True, 0.3, "y", None, True)], kind + ", carryover boolean")
    got = {x.hotkey: x for x in P.result_rows(spark.createDataFrame(rows, kind), carried, spark.createDataFrame([(0, 0.9), (1, 0.1)], "uid int, weight double")).collect()}
    assert {k: x.status for k, x in got.items()} == {"a": "rewarded", "b": "valid", "c": "invalid", "d": "retrying", "e": "blacklisted", "f": "auditing", "g": "carried"}
    assert {k: x.invalid_reason for k, x in got.items() if x.invalid_reason} == {"c": "invalid rollout", "e": "invalid rollout"}
    assert list(got["a"].asDict()) == list(P.RESULT) and got["a"].score == 0.5 and got["c"].final_weight == 0.1
    with pytest.raises(ValueError):
        P.leaderboard(carried, 0)


def test_bundle(spark, tmp_path):
    results = spark.createDataFrame([(f"h{i}", i % 7 / 7, 0.1 if i == 3 else 0.0) for i in range(40)], "hotkey string, score double, final_weight double")
    P.export_bundle(results, f"{tmp_path}/b")
    assert P.verify_bundle(spark, f"{tmp_path}/b")
    first = P.current(spark, f"{tmp_path}/b")
    board = spark.read.parquet(f"{first}/leaderboard").orderBy("rank").collect()
    assert board[0].hotkey == "h3" and [x.rank for x in board] == list(range(1, 41))
    P.export_bundle(results.withColumn("score", F.lit(0.5)), f"{tmp_path}/b")
    now = P.current(spark, f"{tmp_path}/b")
    assert now != first and P.verified_bundle(spark, f"{tmp_path}/b") == now and P.miner_result(spark, f"{tmp_path}/b", "h1").first().score == 0.5
    spark.read.parquet(f"{now}/summary").where("pos <> 5").write.parquet(f"{tmp_path}/c")
    spark.read.parquet(f"{tmp_path}/c").write.mode("overwrite").parquet(f"{now}/summary")
    assert not P.verify_bundle(spark, f"{tmp_path}/b") and P.verified_bundle(spark, f"{tmp_path}/b") == first  # the version before stands in


def test_barrier(spark):
    kind = "hotkey string, round int, status string, challenge_block long"
    run = lambda rows: {x.hotkey: x.challenge_block for x in S.schedule(spark.createDataFrame(rows, kind), 100).collect()}
    assert run([("a", 30, "monitoring", None), ("b", 29, "auditing", None)]) == {"a": None, "b": 105}
    assert run([("a", 30, "monitoring", None), ("b", 30, "monitoring", None), ("c", 3, "failed", None)]) == {"a": 105, "b": 105, "c": None}
    assert run([("a", 50, "monitoring", None), ("b", 31, "monitoring", 77)]) == {"a": None, "b": 77}


def test_scoring_fails_closed(spark):
    tok = G.CodePoints()
    kind = "pos long, row_id string, prompt string, expected array<string>, verifier string, category string, reasoning_budget_tokens int, constraints array<struct<id:string,kwargs:map<string,string>>>"
    one = lambda pos, name, verifier="math_exact", category="c", told=None: (pos, name, "p", ["7"], verifier, category, 1024, told)
    say = lambda text, n=1000: [*tok.opening, *[97] * n, *tok.closing, *map(ord, text), tok.stops[0]]
    rows = [one(0, "a"), one(1, "b", "instruction_constraints", told=[("punctuation:no_comma", {})]), one(2, "c", "instruction_constraints")]
    tokens = [(0, "a", say("\\boxed{7}")), (1, "b", say("no comma")), (2, "c", say("x", 10))]
    run = lambda e, t, **kw: {x.row_id: (x.reward, x.reasoning_tokens, x.reasoning_valid) for x in G.score_rollouts(spark.createDataFrame(e, kind), spark.createDataFrame(t, "pos long, row_id string, tokens array<int>"), tok, **kw).collect()}
    assert run(rows, tokens) == {"a": (1, 1000, True), "b": (1, 1000, True), "c": (0, None, False)}
    for e, t in (
        (rows, tokens[:2]), (rows[:2], tokens), (rows, [tokens[1], tokens[0], tokens[2]]), (rows, [(0, "b", say("x")), *tokens[1:]]), ([one(0, "a", category=None), *rows[1:]], tokens),
        (rows, [(0, "a", []), *tokens[1:]]), (rows, [(0, "a", say("x")[:-1]), *tokens[1:]]), (rows, [(0, "a", [tok.stops[0], *say("x")]), *tokens[1:]]),
    ):
        if t[0][1] == "b" and len(t) == 3 and t[0][0] == 1:
            continue
        with pytest.raises(PySparkException):
            run(e, t)
    with pytest.raises(PySparkException):
        run(rows, tokens, limit=500)
    length = spark.createDataFrame([("p" * 3000, 1024)], "prompt string, reasoning_budget_tokens int")
    size = G.context_size(length, tok, 100).first()
    assert size.longest > 3000 and size.size == -(-(size.longest + 100) // 512) * 512


def test_audit_loop(spark):
    kind = "hotkey string, digest string, revision string, commit_block long, pinned_block long, challenge_block long, round int, attempts int"
    pending = spark.createDataFrame([("a", "x", "r", 1, 2, 50, 3, 1), ("b", "y", "r", 1, 2, 90, 1, 0)], kind)
    assert [x.hotkey for x in A.due(pending, 60).collect()] == ["a"]
    results = spark.createDataFrame([("a", "x", "r", True, 0.5, "monitoring"), ("b", "z", "r", True, 0.7, "passed"), ("c", "q", "r", True, 0.2, "passed")], "hotkey string, digest string, revision string, valid boolean, score double, audit_status string")
    after, told = A.retry(pending, spark.createDataFrame([("a",), ("b",)], "hotkey string"), results, 100)
    assert {x.hotkey: (x.challenge_block, x.attempts) for x in after.collect()} == {"a": (110, 2), "b": (105, 1)} and after.schema == pending.schema
    assert {x.hotkey: (x.valid, x.score, x.audit_status, x.digest) for x in told.collect()} == {"a": (True, 0.5, "retrying", "x"), "b": (False, 0.0, "retrying", "y"), "c": (True, 0.2, "passed", "q")}
    strikes = spark.createDataFrame([("a", ["1", "2"]), ("b", ["1"])], "hotkey string, keys array<string>")
    failures = spark.createDataFrame([("a", "2", "bad"), ("a", "3", "bad"), ("b", "9", "duplicate_rollout"), ("c", "1", None)], "hotkey string, key string, reason string")
    left, out = A.strike(strikes, failures, 10, duration=5)
    assert {x.hotkey: x.keys for x in left.collect()} == {"b": ["1"], "c": ["1"]} and [(x.hotkey, x.until_block, x.rounds) for x in out.collect()] == [("a", 15, 3)]
    assert [A.active(out, b).count() for b in (14, 15)] == [1, 0]
    held = spark.createDataFrame([("a", "k1", True, 0.5, "passed", None, None), ("b", "k1", True, 0.5, "passed", None, None), ("c", None, True, 0.1, "passed", None, None)], "hotkey string, rows_key string, valid boolean, score double, audit_status string, copy_kind string, copy_source string")
    got = {x.hotkey: (x.valid, x.audit_status, x.copy_source) for x in A.retract(held, spark.createDataFrame([("k1", "b")], "key string, hotkey string")).collect()}
    assert got == {"a": (False, "copied", "b"), "b": (True, "passed", None), "c": (True, "passed", None)}
    now = spark.createDataFrame([("a", "x", "r", 1), ("b", "y", "new", 1), ("d", "n", "r", 4)], "hotkey string, digest string, revision string, commit_block long")
    got = {x.hotkey: (x.revision, x.round, x.challenge_block, x.attempts) for x in A.revise(pending, now, 200).collect()}
    assert got == {"a": ("r", 3, 50, 1), "b": ("new", 1, 205, 0), "d": ("r", 1, 205, 0)}
    scored = spark.createDataFrame([(h, f"row-{i}", int(i % 3 > 0)) for h in "ab" for i in range(120)], "hotkey string, row_id string, reward int")
    seeds, done, seen = spark.createDataFrame([("a", "s1"), ("b", "s2")], "hotkey string, seed string"), None, set()
    for n in range(3):
        audited = spark.createDataFrame(sorted(seen), "hotkey string, row_id string")
        part = {tuple(x) for x in A.sample(scored, audited, seeds).collect()}
        assert not part & seen and all(int(r[4:]) % 3 for _, r in part) and len(part) == (64 if n < 2 else 32)
        seen |= part
        done = part
    assert len({r for h, r in done if h == "a"} ^ {r for h, r in done if h == "b"}) > 0
    made = spark.createDataFrame([("a", 1)], "hotkey string, window int")
    assert [tuple(x) for x in A.produced(made, spark.createDataFrame([("a", 1), ("a", 2), ("a", 2)], "hotkey string, window int")).collect()] == [("a", 2)]
