"""The pipeline against a brute-force version of every stage, and its decisions on planted rows."""

import hashlib
import random

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from gradelake.llm.bpe import vocabulary
from tests.llm.test_op2 import brute as measures
from tests.llm.test_op3 import brute as groups
from tests.llm.test_op6 import brute as leaks
from tests.llm.test_op7 import brute as lines


def corpus(folder, spark):
    r = random.Random(11)
    vocab = ["".join(r.choice("abcdefghé") for _ in range(r.randint(2, 8))) for _ in range(400)]
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    items = [(i, text(r.randint(15, 30))) for i in range(8)] + [(50, None)]
    shared = [text(12) for _ in range(4)]
    rows = [(1000, None), (1001, ""), (1002, "too short")]
    for i in range(140):
        body = text(r.randint(10, 80))
        if i % 5 == 0:
            body += "\n" + r.choice(shared)
        if i % 17 == 0:
            body += "\n" + items[i % 8][1]
        if i % 23 == 0:
            body = " ".join([text(8)] * 9)
        rows.append((i, body))
    for i in range(30):
        w = rows[3 + r.randrange(140)][1].split(" ")
        w[r.randrange(len(w))] = "edited"
        rows.append((200 + i, " ".join(w)))
    rows += [(300 + i, rows[40][1]) for i in range(9)]
    r.shuffle(rows)
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(4).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, items


def test_brute_force(spark, tmp_path):
    rows, items = corpus(str(tmp_path), spark)
    good = []
    for i, t in rows:
        n_words, _, _, _, repeated = measures(t)
        if n_words >= 20 and 100 * repeated <= 30 * n_words:
            good.append((i, t))
    kept = [(i, t) for i, _, _, t in lines(good)]
    assert any(t != dict(good)[i] for i, t in kept)
    first = {i for i, _, c in groups(kept, 5, 8, 10) if i == c}
    once = [(i, t) for i, t in kept if i in first]
    found = leaks(once, items)
    clean = [(i, t) for i, t in once if not found[i]]
    assert len(rows) > len(good) > len(once) > len(clean) > 60
    public = Tokenizer.from_file(vocabulary())
    expected = []
    for i, t in clean:
        ids = public.encode(t, add_special_tokens=False).ids
        expected.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest(), ids))
    got = [(x.doc_id, x.n_tokens, x.ids_sha256, x.decoded_sha256, x.ids) for x in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(expected)


def test_stages_keep_the_columns(spark, tmp_path):
    corpus(str(tmp_path), spark)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).dtypes == docs.dtypes
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
