import random
import re

import duckdb
import pytest

from gradelake.llm import quality_rules as R

SF = "/root/testdata/sf0.001"


def brute(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen = {}
    for i, g in enumerate(grams):
        seen.setdefault(g, []).append(i)
    covered = {i + k for v in seen.values() if len(v) > 1 for i in v for k in range(8)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_measures_against_brute_force(spark):
    r = random.Random(4)
    texts = [None, "", " \n\t", "a", "a " * 8, "a " * 9, "a b " * 4000, "x\x0by\x0cz\r\n", "é##|<>&$%*\n" * 5, "1\n\n1\n 1\n1 \n", "w" * 100_000]
    for _ in range(300):
        text = [r.choice(["a", "b", "c", "é", "#"]) for _ in range(r.randint(0, 60))]
        if len(text) > 10 and r.random() < 0.6:
            text += text[r.randint(0, 5) : r.randint(6, 30)]
        texts.append("".join(w + r.choice([" ", "\n", "  ", "\t"]) for w in text))
    df = spark.createDataFrame([(i, t, r.choice(["h", None]), 5) for i, t in enumerate(texts)], "doc_id long, text string, source string, n_words int")
    got = {x.doc_id: x for x in R.judge(df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        x, expected = got[i], brute(t)
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == expected, t
        assert x.base_failed == (expected[0] < 20 or 100 * expected[4] > 30 * expected[0])
    kept = R.keep_good(df)
    assert kept.columns == df.columns
    assert sorted(x.doc_id for x in kept.collect()) == sorted(i for i, x in got.items() if x.kept)
    assert R.judge(df.limit(0)).count() == 0 == R.keep_good(df.limit(0)).count()


@pytest.mark.parametrize("small", [R.SMALL_HOSTS, 0])
def test_hosts(spark, monkeypatch, small):
    monkeypatch.setattr(R, "SMALL_HOSTS", small)
    r = random.Random(1)
    fine = lambda: " ".join(f"word{r.random()}"[:9] for _ in range(30))
    rows = [(i, fine() if i % 20 else "short", f"host{i % 7}") for i in range(700)]
    rows += [(1000 + i, "# $ % & " * 3 + fine() if i % 5 else fine(), "spam") for i in range(200)]
    rows += [(2000, "$$$$$ " * 25 + fine(), "small")]
    rows = [(i, t.replace("word", "####") if h == "spam" and i % 5 else t, h) for i, t, h in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {x.doc_id: x for x in R.judge(df).collect()}
    assert all(not x.kept and x.host_rule == "symbols" for i, x in got.items() if 1000 <= i < 2000)
    assert all(x.kept == (i % 20 > 0) for i, x in got.items() if i < 1000)
    assert got[2000].host_rule is None
    assert {x.doc_id for x in R.keep_good(df).collect()} == {i for i, x in got.items() if x.kept}


def test_sql_and_plan(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    df = R.op2_quality_rules(spark, SF)
    assert sorted(map(tuple, df.collect())) == sorted(con.execute(R.OP2_SQL).fetchall())
    measured = R.measure(spark.read.parquet(f"{SF}/documents.parquet"), [])
    assert "Python" not in measured._jdf.queryExecution().executedPlan().toString()
