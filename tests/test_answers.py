import pyarrow as pa
from pyspark.sql import functions as F

from gradelake.functions import answers as A


def test_equal_answers_of_a_batch_are_read_once(spark):
    seen = []
    got = A.each_once(lambda v: seen.append(v) or (None if v is None else v.upper()), pa.array(["a", None, "b", "a", None], pa.string()))
    assert got.to_pylist() == ["A", None, "B", "A", None] and sorted(map(str, seen)) == ["None", "a", "b"]
    rows = [(0, ["\\boxed{1}", None, "none"]), (1, None), (2, []), (3, ["FINAL: $2$", "\\boxed{1}"]), (4, ["\\boxed{{a} } and \\boxed{open"]), (5, ["</answer><ANSWER> b </answer>"]), (6, ["<answer>x\\boxed{4}"])]
    df = spark.createDataFrame(rows, "i int, e array<string>").coalesce(1)
    want = {i: None if e is None else [A.canonical_math(v) for v in e] for i, e in rows}
    assert {x.i: x.e for x in df.select("i", A.canonical_each_udf("e").alias("e")).collect()} == want
    assert want == {0: ["1", None, None], 1: None, 2: [], 3: ["2", "1"], 4: ["{a}"], 5: ["b"], 6: ["4"]}
    assert {x.i: x.e for x in df.where("i > 1").select("i", A.canonical_each_udf("e").alias("e")).collect()} == {i: e for i, e in want.items() if i > 1}
