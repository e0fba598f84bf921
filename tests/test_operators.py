import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gradelake.functions import answers as A
from gradelake.functions import native as N
from gradelake.operators import integrity as I
from gradelake.operators import ordering as O


def tree(payloads):
    level = [hashlib.sha256(b"leaf:" + p.encode()).digest() for p in payloads]
    while len(level) > 1:
        level = [hashlib.sha256(b"node:" + level[i] + level[min(i + 1, len(level) - 1)]).digest() for i in range(0, len(level), 2)]
    return level[0].hex() if level else hashlib.sha256(b"").hexdigest()


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 8, 9, 17, 64, 65, 100])
def test_merkle(spark, monkeypatch, n):
    monkeypatch.setattr(I, "FOLD", 3)
    df = spark.range(n).repartition(3)
    assert I.merkle_root(df, "id", F.concat(F.lit("p"), F.col("id"))) == tree([f"p{i}" for i in range(n)])


def test_two_key_dedupe(spark):
    r = random.Random(1)
    for _ in range(3):
        rows = [(i, f"a{r.randint(0, 12)}", f"b{r.randint(0, 12)}") for i in range(60)]
        seen, expected = set(), []
        for i, a, b in rows:
            if a not in seen and b not in seen:
                seen |= {a, b}
                expected.append(i)
        df = spark.createDataFrame(rows, "n long, a string, b string").repartition(3)
        assert sorted(x.n for x in O.two_key_dedupe(df, "n", "a", "b").collect()) == expected


def test_quotas(spark):
    sizes = spark.createDataFrame([("small", 1), ("medium", 2), ("large", 7)], "name string, size long")
    assert dict(O.quotas(sizes, 100).collect()) == {"small": 10, "medium": 20, "large": 70}
    odd = spark.createDataFrame([(f"s{i}", s) for i, s in enumerate([3_201_061, 99_880, 896_215, 617_020, 802_666, 60_621])], "name string, size long")
    assert [q for _, q in sorted(O.quotas(odd, 100_000).collect())] == [56_382, 1_759, 15_785, 10_868, 14_138, 1_068]


def test_bits(spark):
    r = random.Random(3)
    rows = [("g", i, r.randint(0, 1)) for i in range(29)] + [("h", i, 1) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, pos long, reward int")
    packed = I.pack_bits(df, ["g"], "pos", "reward")
    n = F.when(F.col("g") == "g", 29).otherwise(300)
    assert sorted((x.g, x.pos, x.reward) for x in I.unpack_bits(packed, ["g"], "bits", n).collect()) == sorted(rows)
    with pytest.raises(PySparkException):
        I.unpack_bits(packed, ["g"], "bits", F.lit(20)).collect()


def test_positions(spark):
    df = spark.range(1000).select(F.sha2(F.col("id").cast("string"), 256).alias("h")).repartition(7)
    got = O.position(df, "h").orderBy("h").collect()
    assert [x.pos for x in got] == list(range(1000))


@pytest.mark.parametrize(("text", "answer"), [
    ("so \\boxed{42}.", "42"), ("\\boxed{\\frac{1}{2}} and \\boxed{3", "\\frac{1}{2}"), ("FINAL: $x$", "x"), ("The answer is  7 .", "7"),
    ("<answer>a</answer> <ANSWER> b\n c </answer>", "b c"), ("<answer>open", "<answer>open"), ("proof", None), (None, None), ("", None),
    ("\\(\\displaystyle 0.5\\)", "0.5"), ("1/2", "1/2"), ("\\boxed {a{b}}", "a{b}"), ("\\[ z \\]", "z"), ("final answer: NaN", None),
])
def test_math(text, answer):
    assert A.canonical_math(text) == answer


@pytest.mark.parametrize(("text", "answer"), [
    ('x {"output": "a\\n b"}', "a\n b"), ('```json\n{"output": "q"}\n```', "q"), ('{"output": "q"}```', None), ('{"output": "q"}\n  ```  ', "q"), ('{"output": "q"} more', None), ('{"output": 1}', None),
    ('{"output": "q", "b": 1}', None), ('{"a": {"output": "q"}}', None), (None, None), ("{" * 500, None), ('{"output": "{}"}', "{}"),
])
def test_json(text, answer):
    assert A.json_output(text) == answer


def test_static_field():
    assert A.static_field("{'ground_truth': 'a\\n b'}", "ground_truth") == "a\n b"
    assert A.static_field("{'ground_truth': str(1)}", "ground_truth") is None
    assert A.static_field("{'g': 'a', 'g': 'b'}", "g") is None
    assert A.static_field("[1]", "g") is None is A.static_field("{", "g")


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="\\boxed{}$ a1", max_size=30))
def test_math_never_fails_and_is_stable(text):
    found = A.canonical_math(text)
    assert found is None or found == found.strip()


def test_native(spark):
    df = spark.createDataFrame([(" \u001c A B\u0085 ",), ("A\n",)], "t string")
    assert [x[0] for x in df.select(N.normal_answer(F.col("t"))).collect()] == ["a b", "a"]
    low, high = N.budget_bounds(F.col("id"))
    rows = spark.createDataFrame([(1024,), (16384,)], "id long").select(low, high).collect()
    assert [tuple(r) for r in rows] == [(922, 1126), (14746, 18022)]
    assert I.familywise_z(2.3263478740408408, 2) == pytest.approx(2.5758, abs=1e-4)


def test_edges(spark):
    one = spark.range(1)
    n = lambda *x: [F.lit(v) for v in x]
    assert one.select(N.detection_probability(*n(100, 10, 0))).first()[0] == 0 == one.select(N.detection_probability(*n(100, 0, 5))).first()[0]
    for bad in (N.detection_probability(*n(10, 11, 1)), N.window_of(F.lit(-1)), N.required_rounds(F.lit(0), F.lit(1), 0.1, 0.9)):
        with pytest.raises(PySparkException):
            one.select(bad).collect()
    assert one.select(N.strip(F.lit("a" + " " * 200_000 + "b"))).first()[0] == "a" + " " * 200_000 + "b"  # a long inner run costs its length once
    empty = spark.createDataFrame([("g", "")], "g string, bits string")
    assert I.unpack_bits(empty, ["g"], "bits", F.lit(0)).count() == 0
    for rows in ([("g", 0, 2)], [("g", 0, 1), ("g", 2, 1)], [("g", 0, 1), ("g", 0, 1)], [("g", 1, 1)], [("g", 0, None)]):
        with pytest.raises(PySparkException):
            I.pack_bits(spark.createDataFrame(rows, "g string, pos long, r int"), ["g"], "pos", "r").collect()
    with pytest.raises(PySparkException):
        O.quotas(spark.createDataFrame([("a", 1), ("b", 10_000)], "name string, size long"), 10).collect()
    with pytest.raises(ValueError):
        O.position(spark.createDataFrame([(1, 2)], "a int, part_ int"), "a")


def test_two_keys_with_nulls_and_reserved_keys(spark):
    rows = [(1, None, None), (2, None, None), (3, "a", None), (4, "a", "x"), (5, None, "x"), (6, "b", "x"), (7, "r", "y"), (8, "c", "s")]
    df = spark.createDataFrame(rows, "n long, a string, b string")
    reserved = spark.createDataFrame([("r", "q"), ("w", "s")], "a string, b string")
    assert sorted(x.n for x in O.two_key_dedupe(df, "n", "a", "b").collect()) == [1, 2, 3, 5, 7, 8]
    assert sorted(x.n for x in O.two_key_dedupe(df, "n", "a", "b", reserved).collect()) == [1, 2, 3, 5]


def test_top_by_rank_needs_its_second_pass(spark):
    rows = [("g", "ffffffff" + f"{i:04d}", i) for i in range(3000)] + [("h", f"{i:08x}", i) for i in range(20)]
    df = spark.createDataFrame(rows, "g string, r string, t int")
    got = O.top_by_rank(df, "g", "r", "t", spark.createDataFrame([("g", 7), ("h", 50)], "g string, quota long")).collect()
    assert sorted(x.t for x in got if x.g == "g") == list(range(7)) and len([x for x in got if x.g == "h"]) == 20


@pytest.mark.parametrize(("text", "answer"), [("42", "42"), ("\\frac{2}{4}", "1/2"), (".5", "1/2"), ("1e3", "1000"), ("<answer> 3/6 </answer>", "1/2"), ("so \\boxed{0.25} ok", "1/4"), ("the answer is 7.", "7"), ("1/0", None), ("1e99999", None), ("x", None), (None, None)])
def test_rational(text, answer):
    assert A.rational(text) == answer


def greedy(rows, reserved=()):
    """(scan, first, second): one after the other."""
    a, b, kept = {x for x, _ in reserved}, {x for _, x in reserved}, []
    for scan, x, y in sorted(rows):
        if (x is None or x not in a) and (y is None or y not in b):
            kept.append(scan)
            a.add(x)
            b.add(y)
    return kept


@pytest.mark.parametrize("most", [4, 100_000])
def test_two_keys_on_random_graphs(spark, most):
    r = random.Random(most)
    rows = [(i, r.choice([None, *range(40)]), r.choice([None, *(f"k{j}" for j in range(40))])) for i in range(60)]
    rows += [(100 + i, 1000 + (i + 1) // 2, f"c{i // 2}") for i in range(9)]  # a chain in scan order
    rows += [(200 + i, 2000, f"s{i}") for i in range(30)]  # one hot key
    df = spark.createDataFrame([(*x, "x") for x in rows], "scan long, a long, b string, node string").repartition(3)
    got = [x.scan for x in O.two_key_dedupe(df, "scan", "a", "b", most=most).collect()]
    assert sorted(got) == greedy(rows)


def test_a_chain_of_ten_thousand_rows_in_a_bounded_number_of_jobs(spark):
    rows = [(i, (i + 1) // 2, i // 2) for i in range(10_000)]
    df = spark.createDataFrame(rows, "scan long, a long, b long").repartition(4)
    context = spark.sparkContext
    context.setJobGroup("chain", "chain")
    try:
        got = [x.scan for x in O.two_key_dedupe(df, "scan", "a", "b").collect()]
        jobs = len(context.statusTracker().getJobIdsForGroup("chain"))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(got) == greedy(rows) == list(range(0, 10_000, 2))
    assert jobs < 400


def test_components(spark):
    r = random.Random(7)
    edges = [(r.randint(-50, 50), r.randint(-50, 50)) for _ in range(45)] + [(i, i + 1) for i in range(1000, 1100)] + [(5000, i) for i in range(5001, 5100)] + [(9, 9)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = sorted((root(u), root(v)))
        parent[b] = a
    got = {x.node: x.label for x in O.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: root(x) for x in parent}
    assert O.components(spark.createDataFrame([], "u long, v long")).count() == 0
