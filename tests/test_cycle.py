"""The validator's cycle against a sequential simulation in plain Python."""

import hashlib
import random
from dataclasses import replace

import pytest

from gradelake.config import PROTOCOL
from gradelake.operators import grading as G
from gradelake.streaming import audits as A
from gradelake.streaming import cycle as C

TOK = G.CodePoints()
SMALL = replace(PROTOCOL, budget_levels=(8, 16, 32, 64, 128), audit_rows=3, required_rounds=2, total_rounds=3, exact_ratio=0.9)
EVALUATION = "pos long, row_id string, prompt string, expected array<string>, verifier string, category string, reasoning_budget_tokens int"
ROWS = [(i, f"row-{i}", f"prompt {i}", [str(i)], "math_exact", "abc"[i % 3], 8) for i in range(14)]
ROOT = "root"


def say(answer, n=8):
    return [*TOK.opening, *[97] * n, *TOK.closing, *map(ord, f"\\boxed{{{answer}}}"), TOK.stops[0]]


@pytest.fixture(autouse=True)
def one_partition(spark):
    """The tables are tiny and the jobs many."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.unset("spark.sql.adaptive.enabled")


class Miner:
    def __init__(self, name, uid, block, right, digest=None, sha=None, kind="good", revision="r1"):
        self.hotkey, self.uid, self.block, self.right, self.kind, self.revision = name, uid, block, right, kind, revision
        self.digest, self.sha = digest or f"d-{name}", sha or f"s-{name}"

    def rows(self):
        out = [(self.hotkey, i, f"row-{i}", say(i if i in self.right else "no")) for i in range(len(ROWS))]
        if self.kind == "order":
            out[2], out[3] = (self.hotkey, 2, *out[3][2:]), (self.hotkey, 3, *out[2][2:])
        if self.kind == "short":
            out.pop()
        if self.kind == "twice":
            out[4] = out[5]
        if self.kind == "fault":
            out[6] = (*out[6][:3], out[6][3][:-1] + [TOK.stops[0], 97, 98])
        if self.kind == "reasoning":
            out[1] = (*out[1][:3], say(1, 3))
        return [] if self.kind == "no_bundle" else out

    def manifest(self):
        return (self.hotkey, self.digest, self.revision, 6 if self.kind == "window" else 5, "other" if self.kind == "root" else ROOT, self.sha, 0 if self.kind == "limit" else 500)


def rank(seed, row):
    return hashlib.sha256("\0".join([SMALL.domain, seed, "audit", row]).encode()).hexdigest()


def forged(miner, row):
    return miner.kind == "forged" or miner.kind == "half" and int(row[4:]) % 2


class Plain:
    """One submitter after the other, with dictionaries."""

    def __init__(self):
        self.pending, self.results, self.progress, self.audited, self.priority, self.strikes, self.blacklist = {}, {}, {}, {}, {}, {}, {}

    def audit(self, miners, block, seeds, gone=(), changed=()):
        due = {h: p for h, p in self.pending.items() if p["challenge"] <= block}
        reasons = {}
        before = dict(self.priority)
        for h, p in due.items():
            m = miners.get(h)
            if m is None or h in gone:
                reasons[h] = "commitment_disappeared"
            elif m.digest != p["digest"] or h in changed:
                reasons[h] = "commitment_changed"
            elif m.kind == "no_bundle":
                reasons[h] = "bundle_missing"
            elif m.kind in ("window", "root"):
                reasons[h] = "manifest_mismatch"
            elif m.kind in ("order", "short", "twice"):
                reasons[h] = "rows_differ"
            else:
                key = f"5:{m.sha}"
                self.priority[key] = min(self.priority.get(key, (m.block, h)), (m.block, h))
        displaced = {old[1]: (key, self.priority[key][1]) for key, old in before.items() if self.priority[key] != old}
        for h, p in due.items():
            m, source, facts = miners.get(h), None, {}
            reason = reasons.get(h)
            if reason is None:
                holder = self.priority[f"5:{m.sha}"][1]
                right = sorted(m.right - ({1} if m.kind == "reasoning" else set()))
                if holder != h:
                    reason, source = "duplicate_rollout", holder
                elif m.kind in ("fault", "limit"):
                    reason = "rollout_fault"
                elif not right:
                    reason = "no_correct_rows"
                else:
                    done = self.audited.setdefault((h, m.digest, m.revision), [])
                    left = sorted((rank(seeds[h], f"row-{i}"), f"row-{i}") for i in right if f"row-{i}" not in done) if h in seeds else []
                    chosen = [r for _, r in left[: SMALL.audit_rows]]
                    if h not in seeds:
                        reason = "seed_missing"
                    elif not chosen:
                        reason = "no_rows_left"
                    elif m.kind == "engine":
                        reason = "engine_incomplete"
            if reason in ("bundle_missing", "seed_missing", "engine_incomplete"):
                p["attempts"] += 1
                p["challenge"] = block + max(1, min(150, 5 * 2 ** min(p["attempts"] - 1, 5)))
                old = self.results.get(h, {})
                same = old.get("valid") and old["digest"] == p["digest"] and old["revision"] == p["revision"]
                self.results[h] = (old if same else {"valid": False, "score": 0.0, "digest": p["digest"], "revision": p["revision"]}) | {"audit_status": "retrying"}
                continue
            del self.pending[h]
            if reason is None:
                done += chosen
                old = self.progress.setdefault((h, m.digest, m.revision), [0, 0, 0])
                bad = [r for r in chosen if forged(m, r)]
                exact, checked = 2 * len(chosen) - len(bad), 2 * len(chosen)
                ok = not bad and exact >= SMALL.exact_ratio * checked
                old[0], old[1], old[2] = old[0] + ok, old[1] + exact, old[2] + checked
                cover = -(-len(right) // SMALL.audit_rows)
                required, total = min(SMALL.required_rounds, cover), min(SMALL.total_rounds, cover)
                full, score = ok and old[0] >= required, len(right) / len(ROWS)
                status = "failed" if not ok else "passed" if old[0] >= total else "monitoring" if old[0] >= required else "auditing"
                facts = {"raw_score": score, "correct": len(right), "audit_round": old[0], "audit_required_rounds": required, "audit_total_rounds": total, "audited_count": len(done), "exact": old[1], "checked": old[2]}
                reason = None if ok else "round_failed"
                facts |= {"valid": full, "score": score if full else 0.0, "audit_status": status}
            else:
                facts = {"valid": False, "score": 0.0, "audit_status": "copied" if source else "failed", "copy_source": source}
            self.results[h] = {"digest": p["digest"], "revision": p["revision"], "reason": reason, "audit_block": p["challenge_before"]} | facts
            if reason is not None and reason not in A.NO_STRIKE:
                keys = self.strikes.setdefault(h, set())
                keys.add(f"{p['digest']}:{p['revision']}:{p['round']}")
                if len(keys) >= 3:
                    del self.strikes[h]
                    self.blacklist[h] = block + 7200
                    self.results[h] |= {"audit_status": "blacklisted"}
        for h, (key, new) in displaced.items():
            self.results[h] = {"valid": False, "score": 0.0, "audit_status": "copied", "copy_source": new, "rows_key": key, "digest": miners[h].digest if h in miners and h not in gone else None}
            self.pending.pop(h, None)


def engine_of(miners):
    def engine(rows):
        out = []
        for r in rows.collect():
            assert r.prompt == f"prompt {r.row_id[4:]}" and r.reasoning_budget_tokens == 8 and r.tokens[0] == TOK.opening[0]
            m = miners[r.hotkey]
            if m.kind == "engine" and (m.hotkey == "b" or int(r.row_id[4:]) % 2 == 0):
                continue
            for p in range(2):
                bad = p == 1 and forged(m, r.row_id)
                out += [(r.hotkey, r.row_id, p, 7, 7, -2.0 if bad else -0.5, 2 if bad else 1), (r.hotkey, r.row_id, p, 7, 8, -1.0, 1 if bad else 2)]
        return rows.sparkSession.createDataFrame(out, "hotkey string, row_id string, position int, submitted_token int, token_id int, logprob double, rank int")

    return engine


def chain_of(spark, miners, block, seeds, gone=(), changed=(), window=5):
    now = [(m.hotkey, m.uid, m.digest + ("x" if m.hotkey in changed else ""), m.block) for m in miners.values() if m.hotkey not in gone]
    return C.Chain(
        block, window, spark.createDataFrame(now, "hotkey string, uid int, digest string, commit_block long"),
        spark.createDataFrame([(m.hotkey, m.revision if m.kind != "unpinned" else None) for m in miners.values()], "hotkey string, revision string"), spark.createDataFrame(list(seeds.items()), "hotkey string, seed string"),
    )


def bundles_of(spark, miners):
    return C.Bundles(
        spark.createDataFrame([m.manifest() for m in miners.values() if m.kind != "no_bundle"], "hotkey string, digest string, revision string, window int, evaluation_root string, rows_sha256 string, max_tokens int"),
        spark.createDataFrame([r for m in miners.values() for r in m.rows()], "hotkey string, pos long, row_id string, tokens array<int>"),
    )


FACTS = ["valid", "score", "raw_score", "correct", "digest", "revision", "audit_status", "reason", "copy_source", "audit_round", "audit_required_rounds", "audit_total_rounds", "audited_count", "exact", "checked", "audit_block"]


def state_of(spark, plain):
    """The state's tables from the dictionaries."""
    rows = {
        "pending": [(h, p["digest"], p["revision"], p["block"], 0, p["challenge"], p["round"], p["attempts"]) for h, p in plain.pending.items()],
        "priority": [(k, *v) for k, v in plain.priority.items()],
    }
    empty = C.State.empty(spark)
    return C.State(**{t: spark.createDataFrame(rows[t], C.TABLES[t]) if t in rows and rows[t] else getattr(empty, t) for t in C.TABLES})


def agree(state, plain):
    got = {r.hotkey: r for r in state.results.collect()}
    assert set(got) == set(plain.results)
    for h, want in plain.results.items():
        for c in FACTS:
            if c in want or c in ("reason",) and want["audit_status"] not in ("copied", "retrying"):
                assert got[h][c] == pytest.approx(want.get(c)) if isinstance(want.get(c), float) else got[h][c] == want.get(c), (h, c, got[h], want)
    assert {r.hotkey: (r.challenge_block, r.attempts, r.round) for r in state.pending.collect()} == {h: (p["challenge"], p["attempts"], p["round"]) for h, p in plain.pending.items()}
    assert {(r.hotkey, r.digest, r.revision): (r.rounds_passed, r.exact, r.checked) for r in state.progress.collect()} == {k: tuple(v) for k, v in plain.progress.items()}
    assert {(r.hotkey, r.row_id) for r in state.audited.collect()} == {(h, r) for (h, _, _), v in plain.audited.items() for r in v}
    assert {r.key: (r.block, r.hotkey) for r in state.priority.collect()} == plain.priority
    assert {r.hotkey: set(r["keys"]) for r in state.strikes.collect()} == plain.strikes
    assert {r.hotkey: r.until_block for r in state.blacklist.collect()} == plain.blacklist


def test_audits_against_a_sequential_simulation(spark):
    kinds = ["good", "good", "forged", "half", "order", "short", "twice", "fault", "reasoning", "window", "root", "limit", "no_bundle", "engine", "nothing"]
    r = random.Random(4)
    miners = [Miner(f"m{i}", i + 1, 100 + i, set() if k == "nothing" else set(r.sample(range(14), r.choice([2, 5, 9, 14]))) | {1, 4}, kind=k) for i, k in enumerate(kinds)]
    miners[-1].right = set()
    miners += [Miner("late", 30, 300, {1, 2}, sha="same"), Miner("early", 31, 200, {1, 2, 3, 4}, sha="same"), Miner("gone", 32, 9, {1}), Miner("changed", 33, 9, {1}), Miner("unseeded", 34, 9, {1, 2}), Miner("first", 35, 150, {5, 6}, sha="held"), Miner("waits", 36, 9, {1, 2})]
    miners = {m.hotkey: m for m in miners}
    plain = Plain()
    for h, m in miners.items():
        plain.pending[h] = {"digest": m.digest, "revision": m.revision, "block": m.block, "challenge": 900 if h == "waits" else 500, "challenge_before": 500, "round": 1, "attempts": 0}
    plain.priority = {"5:held": (170, "holder"), "5:other": (3, "x")}
    state = state_of(spark, plain)
    evaluation, told = spark.createDataFrame(ROWS, EVALUATION), set()
    for step in range(3):
        block = 500 + 100 * step
        seeds = {h: f"{h}-{step}" for h in miners if h != "unseeded" or step > 0}
        gone, changed = ({"gone"}, {"changed"}) if step == 0 else (set(), set())
        for p in plain.pending.values():
            p["challenge_before"] = p["challenge"]
        chain = chain_of(spark, miners, block, seeds, gone, changed)
        state = C.audit_due(state, chain, bundles_of(spark, miners), evaluation, ROOT, engine_of(miners), TOK, SMALL).settled()
        plain.audit(miners, block, seeds, gone, changed)
        agree(state, plain)
        told |= {x["audit_status"] for x in plain.results.values()} | {x.get("reason") for x in plain.results.values()}
        # Everyone who has an outcome but the copies is challenged again, with the next round.
        for h, m in miners.items():
            if h not in plain.pending and plain.results.get(h, {}).get("audit_status") not in ("copied", "blacklisted"):
                plain.pending[h] = {"digest": m.digest, "revision": m.revision, "block": m.block, "challenge": block + 50, "challenge_before": 0, "round": step + 2, "attempts": 0}
        state = replace(state, pending=state_of(spark, plain).pending)
    assert told >= {"passed", "monitoring", "auditing", "copied", "retrying", "blacklisted", "failed", "round_failed", "rollout_fault", "no_correct_rows", "rows_differ", "manifest_mismatch"}
    assert told >= {"duplicate_rollout", "no_rows_left", "commitment_disappeared", "commitment_changed"} and plain.results["holder"]["copy_source"] == "first"
    counts = C.status_counts(state.results).first()
    assert counts.evaluated == len(plain.results) and counts.valid == sum(bool(x["valid"]) for x in plain.results.values())
    assert counts.invalid >= sum(x["audit_status"] in ("copied", "failed", "blacklisted") for x in plain.results.values())
    last = C.latest_audited(state.results).first()
    assert last.audit_block == max(x.get("audit_block") or -1 for x in plain.results.values())


def test_whole_cycles(spark):
    """From nothing to passed results, a barrier, a model copy, a blacklist that ends, a new revision, and a new window."""
    miners = {m.hotkey: m for m in [Miner("a", 1, 10, set(range(14))), Miner("b", 2, 20, {1, 2, 3, 4, 5, 6, 7}), Miner("c", 3, 30, {1, 2}, digest="d-a"), Miner("bad", 4, 40, {1, 2, 3, 4, 5, 6}, kind="forged"), Miner("open", 5, 50, {2}, kind="unpinned")]}
    evaluation = spark.createDataFrame(ROWS, EVALUATION)
    state, window = C.State.empty(spark), None
    run = lambda state, window, block, now=5: C.cycle(state, window, chain_of(spark, miners, block, {h: f"{h}{block}" for h in miners}, window=now), bundles_of(spark, miners), evaluation, ROOT, engine_of(miners), TOK, SMALL)
    state = run(state, window, 100)
    assert {r.hotkey: (r.challenge_block, r.round) for r in state.pending.collect()} == {"a": (105, 1), "b": (105, 1), "bad": (105, 1)}
    assert {r.hotkey: (r.audit_status, r.copy_source) for r in state.results.collect()} == {"c": ("copied", "a")}
    state = run(state, 5, 110)
    got = {r.hotkey: (r.audit_status, r.valid, r.audit_round) for r in state.results.collect()}
    assert got == {"a": ("auditing", False, 1), "b": ("auditing", False, 1), "bad": ("failed", False, 0), "c": ("copied", False, None)}
    assert {r.hotkey: r.round for r in state.pending.collect()} == {"a": 2, "b": 2}
    miners["b"].kind = "engine"
    state = run(state, 5, 120)
    got = {r.hotkey: (r.audit_status, r.audit_round) for r in state.results.collect()}
    assert got["a"] == ("monitoring", 2) and got["b"][0] == "retrying"
    assert {r.hotkey for r in state.pending.collect()} == {"b"}  # a waits at the barrier
    miners["b"].kind, miners["bad"].kind, miners["bad"].revision = "good", "good", "r2"
    state = run(state, 5, 130)
    assert {r.hotkey: (r.round, r.revision) for r in state.pending.collect()} == {"bad": (1, "r2")} and "bad" not in {r.hotkey for r in state.results.collect()}
    state = run(state, 5, 140)
    state = run(state, 5, 150)
    got = {r.hotkey: (r.audit_status, r.valid) for r in state.results.collect()}
    assert got["bad"] == ("passed", True) and got["a"][0] in ("monitoring", "passed") and got["b"][0] in ("monitoring", "passed")
    state = run(state, 5, 160)
    assert {r.hotkey: r.audit_status for r in state.results.collect()} == {"a": "passed", "b": "passed", "bad": "passed", "c": "copied"}
    assert state.pending.count() == 0
    for m in miners.values():
        m.kind = "good" if m.kind != "unpinned" else m.kind
    state = run(state, 5, 200, 6)
    assert {r.hotkey: (r.score, r.source_window) for r in state.carried.collect()} == {"a": (1.0, 5), "b": (0.5, 5), "bad": (pytest.approx(6 / 14), 5)}
    assert {r.hotkey: r.round for r in state.pending.collect()} == {"a": 1, "b": 1, "bad": 1} and state.priority.count() == 0 == state.audited.count()
