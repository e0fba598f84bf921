import hashlib
import math
import os
import re

import duckdb
import pytest

from gradelake.plans.catalog import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(SF, t)}.parquet'")
    return c


def plain(rows):
    return sorted((tuple(round(x, 9) if isinstance(x, float) and math.isfinite(x) else x for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = df.select(*[f"`{c}`" for c in cols]).collect()
    assert got
    if name in SQL:
        rel = con.sql(SQL[name])
        assert sorted(rel.columns) == cols
        names = ", ".join(f'"{c}"' for c in cols)
        assert plain(got) == plain(con.execute(f"SELECT {names} FROM ({SQL[name]})").fetchall())


def test_two_key_dedupe_whole_texts(spark, tmp_path):
    start = "The same twelve characters and more "
    rows = [(1, start + "a"), (2, start + "b"), (3, start.upper() + " A "), (3, "other"), (4, "other"), (4, "other"), (5, None), (6, "x" * len(start))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    ids, texts, kept = set(), set(), []
    for i, t in sorted({(i, " ".join(t.lower().split())) for i, t in rows if t is not None}, key=lambda x: (x[0], hashlib.sha256(x[1].encode()).hexdigest())):
        if i not in ids and t not in texts:
            ids.add(i)
            texts.add(t)
            kept.append(i)
    assert sorted(x.doc_id for x in QUERIES["two_key_dedupe"](spark, str(tmp_path)).collect()) == kept == [1, 2, 3, 6]


def test_merkle_root_of_documents(spark):
    sf = "/root/testdata/sf0.1"  # ten blocks of leaves
    from pyspark.sql import functions as F

    d = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted((x.doc_id, hashlib.sha256(x.j.encode()).hexdigest()) for x in d.select("doc_id", F.to_json(F.struct("doc_id", "lang", "source", "text")).alias("j")).collect())
    level = [hashlib.sha256(f"leaf:{h}".encode()).digest() for _, h in rows]
    while len(level) > 1:
        level += level[-1:] * (len(level) % 2)
        level = [hashlib.sha256(b"node:" + level[i] + level[i + 1]).digest() for i in range(0, len(level), 2)]
    got = QUERIES["merkle_root"](spark, sf).collect()
    assert [(x.root, x.rows) for x in got] == [(level[0].hex(), len(rows))]


def test_instruction_constraints(spark):
    df = QUERIES["instruction_constraints"](spark, SF)
    assert len(df.columns) == 31
    texts = dict(duckdb.connect().execute(f"SELECT doc_id, text FROM '{SF}/documents.parquet' WHERE text IS NOT NULL").fetchall())
    for x in df.where("doc_id IS NOT NULL").collect():
        t = texts[x.doc_id]
        words = re.findall("[A-Za-z0-9]+(?:'[A-Za-z0-9]+)?", t)
        assert x.punctuation_no_comma == ("," not in t) and x.length_constraints_number_words == (len(words) >= 40)
        assert x.keywords_forbidden_words == (not re.search("password|token", t.lower()))
        assert x.first_word_first_word_answer == (words[:1] != [] and words[0].lower() == "the")
        assert x.letters_letter_counting2 == (t.lower().count("e") > 9)
