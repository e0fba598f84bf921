import collections
import itertools
import random
import re

import duckdb
import pytest

from gradelake.llm import filter_audit as A

DOCS = "doc_id long, text string, source string, mask int, n string"
LABELS = "doc_id long, quality int, toxic int, part string"


def brute(docs, labels):
    """Every order applied document by document."""
    least = {}
    for i, t, _ in docs:
        if i is not None and i <= least.get(t or "", i):
            least[t or ""] = i
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    failing = []
    for i, t, _ in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = "A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words)) + "C" * (100 * len(re.findall("[A-Z]", t)) > 2 * len(t))
        failing.append(f + "D" * bool(re.search(r"[#$%&*|]", t)) + "E" * (i is not None and i > least[t]))
    out, shapley = {}, collections.Counter()
    for order in map("".join, itertools.permutations("ABCDE")):
        for part in {s or "" for _, _, s in docs}:
            rows = [(i, f) for (i, _, s), f in zip(docs, failing, strict=True) if (s or "") == part]
            left = rows
            for k, f in enumerate(order):
                lost = [x for x in left if f in x[1]]
                fails = [x for x in rows if f in x[1]]
                left = [x for x in left if f not in x[1]]
                shapley[part, f] += len(lost)
                out[part, order, k + 1] = [len(left), len(lost), len(fails) - len(lost), sum(x[1] == f for x in rows), sum(x[0] in good for x in lost), sum(x[0] in toxic for x in lost)]
    return {(p, o, k): (*v, shapley[p, o[k - 1]]) for (p, o, k), v in out.items()}


def cases():
    r = random.Random(2)
    words = ["alpha", "Beta", "é", "x#y", "NO", "a|b"] + [f"w{i}" for i in range(300)]
    texts = [None, "", " \n\t", "A" * 100, " x y\x1cz\x85", "a\x0bb\x0cc\rd", "w " * 199, "w " * 200, "É" * 50 + "A", "A" * 2 + "b" * 98, "A" * 3 + "b" * 97]
    for _ in range(60):
        texts.append(" ".join(r.choice(words[: r.choice([5, 6, 150, 306])]) for _ in range(r.choice([3, 150, 200, 201, 420]))))
    docs = [(r.choice([None, *range(150)]), r.choice(texts), r.choice(["a", "b", None, "hot", "hot", "hot"])) for _ in range(220)]
    docs += docs[:20] + [(500 + i, "the same text", "hot") for i in range(100)] + [(i, "the same text", "b") for i in range(590, 610)]
    labels = [(r.choice([None, *range(200)]), r.choice([0, 1, None]), r.choice([0, 1, None])) for _ in range(150)] + [(i, 1, 1) for i in range(500, 560)]
    return docs, labels


def rows(spark, docs, labels):
    df = spark.createDataFrame([(*d, 7, "z") for d in docs], DOCS).repartition(5)
    got = A.audit(df, spark.createDataFrame([(*x, "p") for x in labels], LABELS)).collect()
    out = {(x.part, x.filter_order, x.step): tuple(x)[3:] for x in got}
    assert len(out) == len(got)
    return out


def test_against_brute_force(spark):
    docs, labels = cases()
    assert rows(spark, docs, labels) == brute(docs, labels)


@pytest.mark.parametrize("docs, labels", [([], []), ([(1, None, None)], []), ([(None, "a", "s"), (None, "a", "s")], [(None, 1, 1)])])
def test_small_tables(spark, docs, labels):
    assert rows(spark, docs, labels) == brute(docs, labels)


def test_sql(spark, tmp_path):
    docs, labels = cases()
    spark.createDataFrame([(*d, 7, "z") for d in docs], DOCS).coalesce(1).write.parquet(f"{tmp_path}/d")
    spark.createDataFrame([(*x, "p") for x in labels], LABELS).coalesce(1).write.parquet(f"{tmp_path}/l")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    con.execute(f"CREATE VIEW labels AS SELECT * FROM '{tmp_path}/l/*.parquet'")
    got = con.execute(A.OP13_SQL).fetchall()
    assert {x[:3]: x[3:] for x in got} == brute(docs, labels)


def test_words_of_long_texts(monkeypatch):
    text = (b"a bb\tccc\n" * 500 + b"x" * 3000 + b" ") * 3
    expected = A.word_counts(memoryview(text))
    monkeypatch.setattr(A, "CHUNK", 64)
    assert A.word_counts(memoryview(text)) == expected == (len(text.split()), len(set(text.split())))


def test_transform_inverts(spark):
    r = random.Random(9)
    cells = [("p", False, False, m, r.randint(1, 10**12)) for m in range(32)]
    df = spark.createDataFrame(cells, "part string, good boolean, toxic boolean, mask int, n long")
    got = A.parity_sums(df).select(A.inverted(A.F.col("sums")).alias("c")).collect()
    assert [x.c for x in got] == [[c[4] for c in cells]]
