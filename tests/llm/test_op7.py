import hashlib
import random
import re
from collections import defaultdict

import duckdb
import numpy as np

import pyarrow as pa
import pytest

from gradelake.llm import line_dedup as L
from gradelake.llm.line_dedup import OP7_SQL, PerfectHash, Shard, dedup_lines, op7_line_dedup

SF = "/root/testdata/sf0.001"


def brute(rows, min_chars=40, min_docs=5):
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for n, (i, t) in enumerate(rows):
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add((i, n))
    low = -(2**63)
    keep = {k: max(low if i is None else i for i, _ in v) for k, v in holders.items() if len(v) >= min_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if key(x) not in keep or keep[key(x)] == (low if i is None else i)]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return out


def test_brute_force_with_odd_rows(spark):
    r = random.Random(3)
    common = ["É" * 40, "x" * 39, "The Common Line " * 3, "\x0b  the common line the common line the common line\t", "y" * 41, ""]
    rows = [(i, "\n".join(r.choice([*common, f"own line {i} " * 5]) for _ in range(r.randint(0, 9)))) for i in range(200)]
    rows += [(5, rows[5][1]), (None, "\n".join(common)), (None, None), (300, ""), (301, "long " * 30000 + "\n" + "y" * 41)]
    df = spark.createDataFrame([(i, t, "h", 1) for i, t in rows], "doc_id long, text string, h1 string, n_chars int").repartition(7)
    expected = brute(rows)
    got = sorted(((x.doc_id, x.n_lines, x.n_dropped, x.kept_sha256) for x in dedup_lines(df, digests=True).collect()), key=str)
    assert got == sorted(((i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in expected), key=str)
    kept = dedup_lines(df)
    assert kept.columns == df.columns
    assert sorted(((x.doc_id, x.text or "") for x in kept.collect()), key=str) == sorted(((i, t) for i, _, _, t in expected), key=str)
    assert dedup_lines(df.limit(0), digests=True).count() == 0


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 50_000).astype(np.uint64))
    shard = Shard.from_bytes(Shard(keys, keys * np.uint64(3), np.arange(len(keys)), np.arange(len(keys)) * 2).to_bytes())
    found, counts, keep = shard.lookup(keys, keys * np.uint64(3))
    assert found.all() and (counts == np.arange(len(keys))).all() and (keep == 2 * counts).all()
    assert sorted(shard.hash.find(keys, shard.sizes, shard.ranks)) == list(range(len(keys)))
    other = keys + np.uint64(1)
    assert not shard.lookup(np.setdiff1d(other, keys), np.setdiff1d(other, keys) * np.uint64(7))[0].any()
    assert not PerfectHash(keys[:0]).bits


def test_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    expected = sorted(con.execute(OP7_SQL).fetchall())
    assert sorted((x.doc_id, x.n_lines, x.n_dropped, x.kept_sha256) for x in op7_line_dedup(spark, SF).collect()) == expected


def test_letters_that_cancel_out_do_not_collide(spark):
    one = "a"
    while len(one) < 1024:
        one += one.translate(str.maketrans("ab", "ba"))
    two = one.translate(str.maketrans("ab", "ba"))
    rows = [(i, one) for i in range(4)] + [(9, two)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((x.doc_id, x.text) for x in dedup_lines(df).collect()) == rows


@pytest.mark.parametrize("batch_rows", [7, 400])
def test_a_portion_reads_each_shard_once(spark, monkeypatch, batch_rows):
    """An index of ten times the bytes that a worker holds: no shard is read twice for a portion, and a portion is not a segment."""
    monkeypatch.setattr(L, "SHARD_KEYS", 16)
    r = random.Random(6)
    shared = [f"a line that many documents of this corpus share, number {i}" for i in range(600)]
    rows = [(i, "\n".join([*r.sample(shared, 30), f"own {i}"])) for i in range(400)]
    folder, bits = L.build_index(spark.createDataFrame(rows, "doc_id long, text string"))
    read, real = [], L.Shard.from_bytes
    monkeypatch.setattr(L.Shard, "from_bytes", lambda raw: read.append(len(raw)) or real(raw))
    index = L.Index(folder, bits)
    index.keepers(np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits), np.zeros(1 << bits, np.uint64))
    total, shards = sum(read), len(read)
    assert bits >= 5
    monkeypatch.setattr(L, "HELD_BYTES", total // 10)
    table = pa.table({"doc_id": [i for i, _ in rows], "text": [t for _, t in rows]})
    index, got = L.Index(folder, bits), {}
    read.clear()
    held = list(L.portions(iter(table.to_batches(batch_rows)), "text", table.nbytes // 3))
    for portion in held:
        for batch, parts in L.judged(portion, index, 40):
            dropped = np.concatenate([np.bincount(lines.doc[drop], minlength=len(offsets) - 1) for _, offsets, lines, drop in parts])
            got |= dict(zip(batch.column(0).to_pylist(), dropped.tolist(), strict=True))
    assert got == {i: n for i, _, n, _ in brute(rows)} and sum(got.values()) > 1000
    assert len(read) <= len(held) * shards - (len(held) - 1)  # what is held is not read again
    assert len(held) == (1 if batch_rows == 400 else 3)
