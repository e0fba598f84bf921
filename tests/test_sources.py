import hashlib
import json
import os
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gradelake.functions import scalars as S2

from gradelake.operators import normalize as R
from gradelake.operators import ordering as O
from gradelake.operators import window as W
from gradelake.sources import artifacts as A
from gradelake.sources import sampled as S


def test_partial_counts():
    assert [S.partial_count(n) for n in (1, 2, 3, 10, 100)] == [1, 1, 2, 9, 90]


def test_row_groups(spark, tmp_path):
    S.register(spark)
    for k in range(3):
        pq.write_table(pa.table({"a": list(range(k * 100, k * 100 + 100)), "b": ["x"] * 100, "c": [1.5] * 100}), f"{tmp_path}/{k}.parquet", row_group_size=10)
    paths = [f"{tmp_path}/{k}.parquet" for k in range(3)]
    read = lambda seed: spark.read.format("sampled_parquet").options(paths=json.dumps(paths), seed=seed, columns='["a","b"]').load()
    df = read("s")
    assert df.columns == ["a", "b", "block_ord", "pos"]
    rows = df.collect()
    assert len(rows) == 2 * 9 * 10 and {x.pos for x in rows} == set(range(10))
    blocks = {}
    for x in rows:
        blocks.setdefault(x.block_ord, []).append(x.a)
    assert sorted(blocks) == list(range(18)) and all(sorted(v) == list(range(min(v), min(v) + 10)) for v in blocks.values())
    assert sorted(map(tuple, read("s").collect())) == sorted(map(tuple, rows)) != sorted(map(tuple, read("t").collect()))


@pytest.mark.parametrize("end", ["", "\n"])
def test_byte_blocks(spark, tmp_path, end):
    S.register(spark)
    r = random.Random(1)
    lines = [json.dumps({"i": i, "t": "é" * r.randint(0, 60)}, ensure_ascii=False) if i % 9 else r.choice(["bad", "[1]", ""]) for i in range(400)]
    raw = ("\n".join(lines) + end).encode()
    (tmp_path / "x.jsonl").write_bytes(raw)
    size = 1000
    expected = set()
    at = 0
    for line in lines:
        stop = at + len(line.encode())
        ends_block = stop if stop < len(raw) else stop - 1
        if line.startswith("{") and at // size == ends_block // size:
            expected.add((at // size, line))
        at = stop + 1
    total = -(-len(raw) // size)
    rows = spark.read.format("sampled_jsonl").options(paths=json.dumps([f"{tmp_path}/x.jsonl"]), seed="s", block=str(size)).load().collect()
    picked = [p for _, p in S.seeded_order([[f"{tmp_path}/x.jsonl", i] for i in range(total)], "s", "source", "block")[: S.partial_count(total)]]
    assert {(picked[x.block_ord], x.value) for x in rows} == {(b, line) for b, line in expected if b in picked}
    assert len(expected) > 200


TEN = "\n".join(f"{c}) option" for c in "ABCDEFGHIJ")


def test_normalizers(spark):
    math = spark.createDataFrame([("p1", "\\boxed{42}", "x"), ("p2", "notfound", "x"), ("p3", "1", " Proof "), ("p4", "", "x"), ("put your answer here", "1", "x"), ("p5", "0 or 3", None)], "problem string, answer string, question_type string")
    assert sorted((x.prompt.split("\n")[0], x.expected) for x in R.typed_math(math, "s").collect()) == [("p1", ["42"]), ("p5", ["0 or 3"])]
    old = spark.createDataFrame([("q", "\\(\\frac{1}{2}\\)", "has_answer_extracted"), ("q", "1", "no_answer_extracted")], "problem string, expected_answer string, problem_type string")
    assert [x.expected for x in R.extracted_math(old, "s").collect()] == [["\\frac{1}{2}"]]
    nested = spark.createDataFrame([((7, "q"), ("m", "5")), ((None, "r"), ("m", "6")), (None, None)], "meta_data struct<index:long,question:string>, reward_model struct<style:string,ground_truth:string>")
    assert sorted(x.row_id for x in R.nested_math(nested, "s", F.lit(3)).collect()) == ["math:s:3", "math:s:7"]
    bare = spark.createDataFrame([(f"Q\n{TEN}", "\\text{J}"), (f"Q\n{TEN}", "K"), ("Q\nA) x", "A")], "input string, expected_answer string")
    assert [x.expected for x in R.bare_mcqa(bare, "s").collect()] == [["J"]]
    ten, nine = [{c: "o"} for c in "ABCDEFGHIJ"], [{c: "o"} for c in "ABCDEFGHI"]
    kind = "responses_create_params struct<input:array<struct<role:string,content:string>>>, expected_answer string, uuid string, template_metadata struct<template_prompt:string,output_regex:string>, options array<map<string,string>>"
    lead = "Answer the following multiple choice question. Use 'A' format."
    rows = [(([("system", ""), ("user", f"{lead}\n\nQ\n{TEN}")],), "J", "u1", (f"{lead}\n\n{{problem}}", "x"), ten), (([("user", f"Q\n{TEN}")],), "J", "u2", ("", ""), nine), (None, "J", "u3", None, None)]
    got = R.declared_mcqa(spark.createDataFrame(rows, kind), "s", F.lit(1)).collect()
    assert [(x.row_id, x.prompt.startswith("Q\n")) for x in got] == [("mcqa:s:u1", True)]
    code = spark.createDataFrame([("c1", "p", "{'ground_truth': 'a\\n b'}"), ("c2", "p", "{'ground_truth': str(1)}"), ("c3", "p", "{'ground_truth': ''}"), ("c4", "p", None)], "problem_id string, prompt string, verification_info string")
    twins = spark.createDataFrame([(" p ", "1", "x"), ("p", "1", "x")], "problem string, answer string, question_type string")
    assert len({x.row_id for x in R.typed_math(twins, "s", "open").collect()}) == 1  # ids come from the cleaned question
    assert [(x.row_id, x.expected) for x in R.code_output(code, "s", F.lit(1)).collect()] == [("code:s:c1", ["a\n b"])]


def test_rollout_files(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"row-{i}", [1, 2, i]) for i in range(500)], "pos long, row_id string, tokens array<int>").repartition(5)
    path = f"{tmp_path}/out/rollouts.jsonl"
    sha, n = A.write_rollouts(rows, path)
    raw = open(path, "rb").read()
    assert n == 500 and sha == hashlib.sha256(raw).hexdigest() == A.file_sha256(path)
    assert raw == b"".join(S2.canonical_json({"row_id": f"row-{i}", "tokens": [1, 2, i]}) + b"\n" for i in range(500))
    assert sorted(map(tuple, A.load_rollouts(spark, path).collect())) == sorted((x.pos, x.row_id, x.tokens) for x in rows.collect())
    manifest = {"hotkey": "h", "model_repo": "a/b", "model_revision": "1" * 40, "digest": "2" * 64, "window": 3, "evaluation_seed": "3" * 64, "evaluation_root": "4" * 64, "row_count": 500, "rows_sha256": sha, "base_model": "m", "base_revision": "r", "max_output_tokens": 10, "protocol": "p"}
    A.write_json(manifest, f"{tmp_path}/out/manifest.json")
    told, got = A.load_bundle(spark, f"{tmp_path}/out", rows)
    assert told == manifest and got.count() == 500 and A.manifest_fault(told, manifest | {"window": 4}) == "window" and A.manifest_fault(told, manifest) is None
    with pytest.raises(ValueError):
        A.load_bundle(spark, f"{tmp_path}/out", rows.withColumn("row_id", F.lit("other")))
    for bad in (b'{"row_id":"a","tokens":[1],"x":1}', b'{"row_id":"a","row_id":"b","tokens":[1]}', b'{"row_id":"a","tokens":[true]}', b'{"row_id":"a","tokens":[-1]}', b'{"row_id":" a","tokens":[1]}', b'{"row_id":"a","tokens":[NaN]}', b"", b"[1]", b"\xff", b'{"row_id":"a","tokens":[1,2,3]}'):
        (tmp_path / "bad.jsonl").write_bytes(bad + b"\n")
        with pytest.raises(PySparkException):
            A.load_rollouts(spark, f"{tmp_path}/bad.jsonl", most=2, vocabulary=9).collect()
    for change in ({"row_count": 4}, {"window": True}, {"digest": "x"}, {"extra": 1}):
        A.write_json(manifest | change, f"{tmp_path}/m.json")
        with pytest.raises(ValueError):
            A.load_manifest(f"{tmp_path}/m.json", 500)


def test_jsonl(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n  \n{"row_id": "own", "a": 2}\n{"a": 3}')
    got = A.load_jsonl(spark, f"{tmp_path}/x.jsonl", "row_id string, a int").orderBy("line").collect()
    assert [(x.row_id, x.a) for x in got] == [("row-1", 1), ("own", 2), ("row-5", 3)]
    assert A.load_exact(spark, f"{tmp_path}/x.jsonl").count() == 3
    (tmp_path / "y.jsonl").write_text('{"a": 1}\n[2]\n')
    with pytest.raises(PySparkException):
        A.load_exact(spark, f"{tmp_path}/y.jsonl").collect()
    df = spark.createDataFrame([(1, "\u2028é", None), (0, "b", 2)], "o int, t string, n int")
    A.write_jsonl(df, "o", f"{tmp_path}/z.jsonl", ascii_only=True)
    assert (tmp_path / "z.jsonl").read_text() == '{"n": 2, "t": "b"}\n{"n": null, "t": "\\u2028\\u00e9"}\n'


def test_scalars():
    fields = {"protocol": "p1", "model_repo": "a/b", "model_revision": "1" * 40, "digest": "2" * 64, "rollout_repo": "c/d"}
    assert S2.commitment_fields(S2.commitment_bytes(fields)) == fields
    for bad in ({"p": "x"}, fields, b"{}", {**{k: fields[v] for k, v in S2.COMMITMENT.items()}, "m": "no"}, {**{k: fields[v] for k, v in S2.COMMITMENT.items()}, "p": "x" * 600}):
        with pytest.raises(ValueError):
            S2.commitment_fields(bad)
    assert S2.block_hash(" " + "AB" * 32 + "\n") == "0x" + "ab" * 32 == S2.block_hash("0X" + "ab" * 32) and S2.revision("A" * 40) == "a" * 40
    assert S2.evaluation_seed(1, 2, "0x" + "ab" * 32) == S2.evaluation_seed(1, 2, "ab" * 32) != S2.evaluation_seed(1, 3, "ab" * 32)
    for bad in ("", "0x", "g" * 64, "a" * 63):
        with pytest.raises(ValueError):
            S2.block_hash(bad)
    told = S2.sign({"a": 1}, b"key", "k")
    assert S2.signed({"a": 1}, told, {"k": b"key"}) and not S2.signed({"a": 2}, told, {"k": b"key"}) and not S2.signed({"a": 1}, told, {})


def test_window_fails_closed_and_is_reused(spark, tmp_path):
    raw = spark.createDataFrame([(f"question {i % 50}", str(i), "x", i // 10, i % 10) for i in range(100)], "problem string, answer string, question_type string, block_ord long, pos long")
    make = lambda **kw: W.Source(**({"name": "s", "size": 5, "read": lambda a, b: raw.where((F.col("block_ord") >= a) & (F.col("block_ord") < b)), "blocks": lambda: 10, "normalizer": "typed_math", "category": "c", "verifier": "math_exact"} | kw))
    held = W.ensure_window(spark, f"{tmp_path}/w", [make(), make(name="t")], "seed", 40)
    rows = held.orderBy("pos").collect()
    assert [x.pos for x in rows] == list(range(40)) and len({x.row_id for x in rows}) == 40 == len({x.prompt for x in rows})
    assert all(int(x.expected[0]) < 50 for x in rows)  # of repeated questions the first in scan order
    stamp = os.path.getmtime(f"{tmp_path}/w/rows/_SUCCESS")
    W.ensure_window(spark, f"{tmp_path}/w", [make(), make(name="t")], "seed", 40)
    assert os.path.getmtime(f"{tmp_path}/w/rows/_SUCCESS") == stamp
    assert W.ensure_window(spark, f"{tmp_path}/w", [make(), make(name="t")], "seed2", 40).count() == 40 and os.path.getmtime(f"{tmp_path}/w/rows/_SUCCESS") != stamp
    with pytest.raises(ValueError):
        W.build_window(spark, [make()], "seed", 51)
    with pytest.raises(PySparkException):
        W.build_window(spark, [make(verifier="label_match")], "seed", 5)
    few = W.select_source(make(), "seed", 15, None)
    assert {int(x.expected[0]) // 10 for x in few.collect()} <= {0, 1}  # read to the end of the block that fills the quota


def test_only_asked_blocks_are_planned(spark, tmp_path):
    S.register(spark)
    for k in range(4):
        pq.write_table(pa.table({"a": list(range(k * 100, k * 100 + 100))}), f"{tmp_path}/{k}.parquet", row_group_size=10)
    paths = [f"{tmp_path}/{k}.parquet" for k in range(4)]
    total = S.blocks("parquet", paths, "s", "n", ["a"])
    assert total == 3 * 9
    every = S.scan(spark, "parquet", paths, "s", "n", ["a"])
    part = lambda a, b: S.scan(spark, "parquet", paths, "s", "n", ["a"], a, b)
    assert [part(a, b).rdd.getNumPartitions() for a, b in ((0, 5), (5, 7), (20, 99), (0, total))] == [5, 2, 7, total]
    assert part(5, 5).count() == 0 == part(99, 200).count()
    assert sorted(map(tuple, every.collect())) == sorted(map(tuple, part(0, 11).union(part(11, total)).collect()))
    os.rename(S.seeded_order(paths, "s", "n", "file")[1], f"{tmp_path}/gone")  # the second file of the order
    assert part(0, 9).count() == 90
    with pytest.raises(Exception, match="gone|No such file|Failed to open"):
        part(0, 10).count()
    with pytest.raises(Exception, match="no range"):
        part(7, 3).count()


def test_filters_are_pushed(spark, tmp_path):
    S.register(spark)
    (tmp_path / "x.jsonl").write_text("".join(json.dumps({"i": i}) + "\n" for i in range(2000)))
    df = lambda: S.scan(spark, "jsonl", [f"{tmp_path}/x.jsonl"], "s", "n", block=1000)
    total = S.blocks("jsonl", [f"{tmp_path}/x.jsonl"], "s", "n", block=1000)
    expected = {b: sorted(x.value for x in df().collect() if x.block_ord == b) for b in range(total)}
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        for cond, chosen, planned in (("block_ord < 4", range(4), 4), ("block_ord >= 2 AND block_ord <= 3", (2, 3), 2), ("block_ord = 5", (5,), 1), ("block_ord IN (1, 3)", (1, 3), 3), ("block_ord > 18 AND pos < 0", (), total - 19), ("block_ord < 0", (), 1)):
            got = df().where(cond)
            assert sorted(x.value for x in got.collect()) == sorted(v for b in chosen for v in expected[b])
            assert got.rdd.getNumPartitions() == planned, cond
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def counted(spark, kind, paths, folder, columns=None, block=None, schema=None):
    """A source over real files that writes down every block a task opens."""

    def read(first, last):
        df = S.scan(spark, kind, paths, "seed", "s", columns, first, last, block)

        def spy(batches):
            from pyspark import TaskContext

            name = f"{folder}/{first}-{last}-{TaskContext.get().partitionId()}"
            with open(name, "a") as f:
                f.write("x")
            yield from batches

        df = df.mapInArrow(spy, df.schema)
        return df if schema is None else df.select(F.from_json("value", schema).alias("x"), "block_ord", "pos").select("x.*", "block_ord", "pos")

    return W.Source("s", 5, read, lambda: S.blocks(kind, paths, "seed", "s", columns, block), "typed_math", "c", "math_exact")


@pytest.mark.parametrize("kind", ["parquet", "jsonl"])
def test_window_opens_each_block_once_and_passes_empty_ones(spark, tmp_path, kind):
    """396 good rows in 99 scanned blocks of which many have no row; 16 blocks are not enough, further ones are read on."""
    S.register(spark)
    os.mkdir(f"{tmp_path}/seen")
    rows = [{"problem": f"question {i}", "answer": str(i), "question_type": "x"} for i in range(440)]
    if kind == "parquet":
        with pq.ParquetWriter(f"{tmp_path}/x.parquet", pa.table({k: [""] for k in rows[0]}).schema) as out:
            for k in range(110):
                part = rows[4 * k : 4 * k + 4] if k % 5 else []
                out.write_table(pa.table({c: pa.array([r[c] for r in part], pa.string()) for c in rows[0]}), row_group_size=4)
                if not part:
                    out.write_table(pa.table({c: pa.array(["proof"], pa.string()) for c in rows[0]}))
        source = counted(spark, kind, [f"{tmp_path}/x.parquet"], f"{tmp_path}/seen", columns=list(rows[0]))
    else:
        text = "".join(json.dumps(r) + "\n" + (" " * 900 + "\n" if i % 20 == 0 else "") for i, r in enumerate(rows))
        (tmp_path / "x.jsonl").write_text(text)
        source = counted(spark, kind, [f"{tmp_path}/x.jsonl"], f"{tmp_path}/seen", block=300, schema="problem string, answer string, question_type string")
    total = source.blocks()
    held = W.select_source(source, "seed", 100, None)
    assert held.count() == 100
    opened = {name: os.path.getsize(f"{tmp_path}/seen/{name}") for name in os.listdir(f"{tmp_path}/seen")}
    assert set(opened.values()) == {1}  # no block twice
    ranges = {tuple(map(int, name.split("-")[:2])) for name in opened}
    assert ranges == {(0, 16), (16, 80)} and len(opened) == 80 < total
    everything = O.two_key_dedupe(W.candidates(source.read(0, total), source), "scan", "row_id", "print")
    pool = W.up_to_quota(O.settle(everything), 100)
    best = sorted((hashlib.sha256("\0".join([W.PROTOCOL.domain, "seed", "s", x.row_id]).encode()).hexdigest(), x.row_id) for x in pool.collect())
    assert sorted(x.row_id for x in held.collect()) == sorted(r for _, r in best[:100])
    with pytest.raises(ValueError, match="usable rows"):
        W.select_source(source, "seed", 10_000, None)


@pytest.mark.parametrize("raw", [b"", b"\n", b"a", b"a\n", b"\n\n", b"a\n\nbb\r\n\xff\xc3(\n" + b"c" * 70 + b"\nd", b"x" * 100, b"y" * 64 + b"\n" + b"z" * 63 + b"\n\n"])
def test_lines_are_numbered_whatever_the_blocks(spark, tmp_path, raw):
    (tmp_path / "x").write_bytes(raw)
    expected = [x for x in enumerate(raw.split(b"\n"), 1)]
    expected = expected[:-1] if not expected[-1][1] else expected
    for block in (1, 2, 7, 64, 1000):
        got = sorted((x.line, bytes(x.value)) for x in A.numbered_lines(spark, f"{tmp_path}/x", None, block).collect())
        assert got == expected, block
    if raw:
        assert A.numbered_lines(spark, f"{tmp_path}/x", None, 7).rdd.getNumPartitions() == -(-len(raw) // 7)


def test_random_files_and_limits(spark, tmp_path, monkeypatch):
    r = random.Random(2)
    raw = b"".join(bytes(r.choice(b"ab\xe9 ") for _ in range(r.choice([0, 1, 5, 200]))) + b"\n" for _ in range(300))
    (tmp_path / "x").write_bytes(raw)
    for piece in (3, 1 << 20):
        monkeypatch.setattr(A, "PIECE", piece)
        with open(f"{tmp_path}/x", "rb") as f:
            for block in (1, 50, 333):
                ends = [(s, min(len(raw), s + block)) for s in range(0, len(raw), block)]
                lines = [list(A._block_lines(f, *e, None)) for e in ends]
                assert [x for part in lines for x in part] == raw.split(b"\n")[:-1]
                assert [A._starts(f, *e) for e in ends] == list(map(len, lines))
    assert A.numbered_lines(spark, f"{tmp_path}/x", 201, 64).count() == 300
    with pytest.raises(PySparkException):
        A.numbered_lines(spark, f"{tmp_path}/x", 200, 64).collect()
    with pytest.raises(FileNotFoundError):
        A.numbered_lines(spark, f"{tmp_path}/none")
