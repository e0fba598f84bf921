"""Streams with keyed state against batch results and plain Python, with events out of order."""

import random
from dataclasses import replace

import pytest

from gradelake.config import PROTOCOL
from gradelake.streaming import keyed as K
from gradelake.streaming import rounds as S


@pytest.fixture(autouse=True)
def store(spark):
    K.use_store(spark)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def feed(spark, rows, kind, folder, size):
    for n in range(0, len(rows), size):
        spark.createDataFrame(rows[n : n + size], kind).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(folder)


def shuffled(rows, block, delay, r):
    """rows in an order in which none comes after one that is over ``delay`` blocks higher."""
    return sorted(rows, key=lambda x: block(x) + r.uniform(0, delay * 0.9))


def test_priorities(spark, tmp_path):
    r = random.Random(2)
    rows = [(f"k{r.randint(0, 9)}", r.randint(0, 500), f"h{r.randint(0, 5)}") for _ in range(150)] + [(None, 1, "x"), ("k0", None, "x")]
    stream = feed(spark, rows, "key string, block long, hotkey string", f"{tmp_path}/in", 40)
    query = K.run(K.priorities(stream), f"{tmp_path}/out", f"{tmp_path}/check", "update")
    query.awaitTermination(120)
    whole = S.priority(None, spark.createDataFrame([x for x in rows if None not in x], "key string, block long, hotkey string"))
    assert sorted(map(tuple, K.holders(f"{tmp_path}/out", spark).collect())) == sorted(map(tuple, whole.collect()))
    told, holder = spark.read.parquet(f"{tmp_path}/out/v=*").orderBy("batch").collect(), {}
    for x in told:  # every change names the holder before it
        assert x.displaced == holder.get(x.key)
        holder[x.key] = x.hotkey
    touched = [p["stateOperators"][0]["numRowsUpdated"] for p in query.recentProgress if p["stateOperators"]]
    assert max(touched) <= 10 and sum(touched) == len(told)  # only keys whose holder changes are written


def plain_strikes(rows, head, limit, duration):
    out, until, keys = [], {}, {}
    for block, hotkey, key in sorted({(b, h, k) for h, k, reason, b in rows if reason != "duplicate_rollout"}):
        if block > head:
            continue
        if hotkey in until and until[hotkey] <= block:
            out.append((hotkey, "released", until.pop(hotkey)))
        if hotkey in until:
            continue
        keys.setdefault(hotkey, set()).add(key)
        if len(keys[hotkey]) >= limit:
            del keys[hotkey]
            until[hotkey] = block + duration
            out.append((hotkey, "blacklisted", block))
    return sorted(out + [(h, "released", u) for h, u in until.items() if u <= head])


def test_strikes_expire_by_block_height(spark, tmp_path):
    r = random.Random(5)
    rows = [(f"h{r.randint(0, 6)}", f"k{r.randint(0, 8)}", r.choice(["bad", None, "duplicate_rollout"]), r.randint(0, 900)) for _ in range(160)] + [("z", "end", "bad", 1100)]
    stream = feed(spark, shuffled(rows, lambda x: x[3], 60, r), "hotkey string, key string, reason string, block long", f"{tmp_path}/in", 40)
    query = K.run(K.strikes(stream, 60, 3, 100), f"{tmp_path}/out", f"{tmp_path}/check")
    query.awaitTermination(180)
    got = sorted((x.hotkey, x.event, x.block) for x in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == plain_strikes(rows, 1100 - 60, 3, 100) and {x[1] for x in got} == {"blacklisted", "released"}


def test_late_commitments_go_to_the_next_window(spark, tmp_path):
    protocol = replace(PROTOCOL, window_blocks=100)
    r = random.Random(8)
    rows = []
    for _ in range(120):
        commit = r.randint(0, 780)
        rows.append((f"h{r.randint(0, 8)}", f"d{r.randint(0, 30)}", commit, commit + r.choice([0, 1, 5, 150])))
    rows += rows[:10] + [("z", "end", 1200, 1200), (None, "d", 1, 1), ("h1", None, 1, 1)]
    kind = "hotkey string, digest string, commit_block long, seen_block long"
    for name, order in (("a", sorted(rows, key=lambda x: x[3])), ("b", shuffled(rows, lambda x: x[3], 80, r))):
        stream = feed(spark, order, kind, f"{tmp_path}/{name}", 45)
        K.run(K.commitments(stream, 80, protocol), f"{tmp_path}/out-{name}", f"{tmp_path}/check-{name}").awaitTermination(180)
    told = {n: sorted((x.hotkey, x.window, x.commit_block, x.digest) for x in spark.read.parquet(f"{tmp_path}/out-{n}").collect()) for n in "ab"}
    batch = K.commitments_batch(spark.createDataFrame(rows, kind), 1200 - 80, protocol)
    assert told["a"] == told["b"] == sorted(map(tuple, batch.collect()))
    plain = []
    for h in {x[0] for x in rows if x[0] not in (None, "z")}:
        held = None
        for w in range(1, 12):
            seen = [(c, d) for hotkey, d, c, s in rows if hotkey == h and d is not None and max(c, s) < w * 100]
            if seen and max(seen) != held:
                held = max(seen)
                plain.append((h, w, *held))
    assert told["a"] == sorted(plain)
