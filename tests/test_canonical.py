import json
import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradelake.functions import canonical as C
from gradelake.functions import native as N
from gradelake.functions import scalars as S
from gradelake.operators import ordering as O
from gradelake.operators import window as W
from gradelake.streaming.health import Health, StreamHealth

KIND = "z string, a long, `odd\"key` string, nested struct<b:array<string>,a:struct<y:int,x:boolean>>, m map<string,array<long>>, none string"


def test_bytes_equal_the_drivers(spark):
    r = random.Random(4)
    hostile = ["", "\x00\x01\x1f\x7f\x80", '"\\/\b\f\n\r\t', "é😀\u2028", "\\u0041", "a" * 50, None] + ["".join(map(chr, (r.randint(0, 0x2FF) for _ in range(20)))) for _ in range(40)]
    rows = [(t, r.choice([None, -1, 1 << 62]), r.choice(hostile), r.choice([None, ([r.choice(hostile) for _ in range(r.randint(0, 3))], r.choice([None, (r.randint(0, 9), True)])), (None, (None, False))]), r.choice([None, {}, {"b": [1], "é": None, "a\n": [2, 3], "B": []}]), None) for t in hostile]
    df = spark.createDataFrame(rows, KIND)
    names = ["z", "a", 'odd"key', "nested", "m", "none"]

    def plain(row):
        z, a, odd, nested, m, none = row
        told = None if nested is None else {"b": nested[0], "a": None if nested[1] is None else dict(zip("yx", nested[1]))}
        return S.canonical_json(dict(zip(names, (z, a, odd, told, m, none)))).decode()

    got = df.select(C.row_json(df, names).alias("j")).collect()
    assert [x.j for x in got] == [plain(row) for row in rows]


def test_kinds_without_a_form(spark):
    for kind in ("double", "timestamp", "map<int,string>", "array<float>"):
        with pytest.raises(TypeError):
            C.encoded(F.col("x"), T._parse_datatype_string(kind))


def test_window_roots_tell_hostile_texts_apart(spark):
    kind = "pos long, row_id string, prompt string"
    root = lambda text: W.root_of(spark.createDataFrame([(0, "a", text)], kind))
    line = lambda text: json.dumps({"row_id": "a", "prompt": text}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    import hashlib

    for text in ("\x7f", "\x1f", 'q"\\', None):
        assert root(text) == hashlib.sha256(b"leaf:" + line(text).encode()).hexdigest()


def test_seeds_equal_the_drivers(spark):
    rows = [(" 0X" + "AB" * 32 + "\n", 3, 'h"\\', "d", "r\x01", 4), ("cd" * 32, 0, "é", "", "r", 1)]
    df = spark.createDataFrame(rows, "b string, w int, h string, d string, r string, n int")
    got = df.select(N.evaluation_seed(F.lit(7), F.col("w"), F.col("b")).alias("e"), N.audit_seed(F.lit(7), F.col("b"), F.col("h"), F.col("d"), F.col("r"), F.col("n")).alias("a")).collect()
    assert [(x.e, x.a) for x in got] == [(S.evaluation_seed(7, w, b), S.audit_seed(7, b, h, d, r, n)) for b, w, h, d, r, n in rows]
    with pytest.raises(Exception, match="32 bytes"):
        spark.createDataFrame([("0x12",)], "b string").select(N.block_hash(F.col("b"))).collect()


def test_distinct_in_order(spark):
    rows = [("b", 3), ("a", 5), ("b", 9), ("c", 1), (None, 4), ("d", 5)]
    got = O.distinct_in_order(spark.createDataFrame(rows, "k string, o int"), ["k"], "o").collect()
    assert {x.k: x.place for x in got} == {"c": 0, "b": 1, None: 2, "a": 3, "d": 4}


def test_health_matches_what_was_done(spark, tmp_path):
    health = Health(spark, f"{tmp_path}/health", "run1")
    for n in (10, 25):
        with health.stage("copy"):
            health.watch(spark.range(n), "rows").write.parquet(f"{tmp_path}/out{n}")
    with pytest.raises(ValueError, match="broken"), health.stage("score"):
        raise ValueError("broken\nsecond line")
    got = health.table().orderBy("ended").collect()
    assert [(x.run, x.stage, x.rows, x.status, x.error) for x in got] == [("run1", "copy", {"rows": 10}, "ok", None), ("run1", "copy", {"rows": 25}, "ok", None), ("run1", "score", {}, "failed", "ValueError: broken")]
    told = {x.stage: (x.runs, x.failures) for x in health.summary().collect()}
    assert told == {"copy": (2, 0), "score": (1, 1)} and health.alive(600) and not health.alive(-600)


def test_streams_report_their_batches(spark, tmp_path):
    for n in range(3):
        spark.range(n * 5, n * 5 + 5).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    listener = StreamHealth(Health(spark, f"{tmp_path}/health"))
    spark.streams.addListener(listener)
    try:
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        stream.writeStream.format("parquet").queryName("copy").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination(60)
        import time

        for _ in range(60):
            if os.path.exists(f"{tmp_path}/health") and listener.health.table().count() >= 3:
                break
            time.sleep(0.5)
    finally:
        spark.streams.removeListener(listener)
    rows = listener.health.table().where("stage = 'stream copy'").collect()
    assert sum(x.rows["input"] for x in rows) == 15 and all(x.status == "ok" for x in rows)
