import math
import random

import numpy as np
import pytest

from gradelake.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, label int, deviation string, n string"


def brute(rows, components=32):
    """Plain numpy and Python integers over (id, vector)."""
    fine = [(i, v) for i, v in rows if v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in fine]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(r, sums, strict=True)) for r in x]
    d = np.array([[(n * a - s) / n for a, s in zip(r, sums, strict=True)] for r in x])
    cov = d.T @ d / n
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)[:components]
    return [i for i, _ in fine], n, deviation, d @ vectors[:, order] / np.sqrt(values[order]), values[order] / np.trace(cov)


def check(spark, rows, tmp_path):
    spark.createDataFrame([(i, v, 1, "x", "y") for i, v in rows], SCHEMA).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = W.op11_embedding_whitening(spark, str(tmp_path)).collect()
    ids, n, deviation, white, explained = brute(rows)
    assert len(got) == len(ids) * white.shape[1]
    table = {(r.vec_id, r.component): r for r in got}
    sign = np.ones(white.shape[1])
    for k in range(white.shape[1]):
        far = int(np.argmax(np.abs(white[:, k])))
        sign[k] = np.sign(white[far, k]) * np.sign(table[ids[far], k + 1].whitened)
    for at, i in enumerate(ids):
        for k in range(white.shape[1]):
            r = table[i, k + 1]
            assert (r.n, r.deviation) == (n, deviation[at])
            assert abs(r.whitened - sign[k] * white[at, k]) < 1e-8
            assert abs(r.explained / explained[k] - 1) < 1e-9 and 0 <= r.identity_error < 1e-9
    return got


def test_against_brute_force(spark, tmp_path):
    r = random.Random(3)
    rows = [(i, [r.gauss(0, 0.1 + k / 10) for k in range(40)]) for i in range(300)]
    rows += [(1000 + i, v) for i, v in enumerate([None, [], [None] * 40, [math.nan] * 40, [math.inf] + [0.0] * 39, [1.0] * 39 + [None]])]
    got = check(spark, rows, tmp_path)
    assert len({x.component for x in got}) == 32


def test_hot_vector_and_repeats(spark, tmp_path):
    r = random.Random(5)
    same = [r.gauss(0, 1) for _ in range(5)]
    check(spark, [(i, same if i % 3 else [r.gauss(0, 1) for _ in range(5)]) for i in range(200)], tmp_path)


def test_given_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    ids, n, deviation, _, explained = brute(rows)
    got = W.op11_embedding_whitening(spark, sf).collect()
    assert len(got) == 32 * len(ids) and {x.n for x in got} == {n} and max(x.identity_error for x in got) < 1e-8
    assert {(x.vec_id, x.deviation) for x in got} == set(zip(ids, deviation, strict=True))
    assert all(abs(x.explained / explained[x.component - 1] - 1) < 1e-6 for x in got)


@pytest.mark.parametrize("rows", [[], [(1, None), (2, [])], [(1, [0.5, 0.25])], [(1, [0.5, 0.25])] * 3])
def test_nothing_to_whiten(spark, rows):
    df = spark.createDataFrame([(i, v, 1, "x", "y") for i, v in rows], SCHEMA)
    model = W.fit(df)
    if not any(v for _, v in rows):
        assert model is None
        return
    assert model.n == len(rows) and model.identity_error is None and model.explained == (None, None)
    got = model.transform(df).collect()
    assert [(x.vec_id, x.deviation, x.whitened) for x in got] == [(1, 0, [None, None])] * len(rows)


def test_a_dimension_without_variance_has_no_value(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0, float(i % 2)]) for i in range(6)], "vec_id long, embedding array<double>")
    model = W.fit(df)
    assert model.has_variance == (True, True, False) and model.identity_error < 1e-9
    assert all(x.whitened[2] is None and None not in x.whitened[:2] for x in model.transform(df).collect())


def test_lengths_huge_entries_and_null_ids(spark):
    rows = [(None, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [1.0, 2.0]), (4, [1.0]), (5, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    model = W.fit(df)
    assert model.n == 3 and len(model.sums) == 2
    assert sorted((x.vec_id for x in model.transform(df).collect()), key=str) == [2, 3, None]


def test_exact_squares():
    r = np.random.default_rng(1)
    for scale, n in ((100, 7), (10_000, 1_000_003), (1 << 40, 9_999_991), (1 << 61, 3)):
        x = r.integers(-scale, scale, (50, 6))
        sums = [sum(c) for c in x.T.tolist()]
        assert W.exact_sums(x) == sums
        expected = [sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist()]
        assert W.squared_lengths(x, n, sums) == expected
