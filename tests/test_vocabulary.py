import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gradelake.operators import grading as G
from gradelake.sources.vocabulary import Vocabulary

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def vocabulary(spark):
    return Vocabulary(spark, PATH)


def test_texts_and_lengths_equal_the_library(spark, vocabulary):
    r, public = random.Random(3), Tokenizer.from_file(PATH)
    texts = ["", "a", "it's 12,5 %", "日本 é😀\n\ttab", "<think>x</think>", " <|endoftext|> y", None] + ["".join(chr(r.choice([r.randint(32, 126), r.randint(160, 1500)])) for _ in range(r.randint(1, 50))) for _ in range(60)]
    rows = [(i, t, None if t is None else public.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)]
    got = spark.createDataFrame(rows, "i int, t string, ids array<int>").select("i", vocabulary.text(F.col("ids")).alias("text"), vocabulary.length(F.col("t")).alias("n"))
    assert "Python" not in got.select("text")._jdf.queryExecution().executedPlan().toString()
    for x in got.collect():
        _, t, ids = rows[x.i]
        assert x.n == (None if ids is None else len(ids))
        assert x.text == (None if t is None else public.decode(ids, skip_special_tokens=True).strip())


def test_odd_ids(spark, vocabulary):
    part = vocabulary.ids("𝔘")
    assert len(part) > 1
    rows = [(0, [64, vocabulary.size]), (1, [-1]), (2, [64, None]), (3, []), (4, [64, vocabulary.stops[0], 64]), (5, part[:1] + [64])]
    got = {x.i: x.t for x in spark.createDataFrame(rows, "i int, ids array<int>").select("i", vocabulary.text(F.col("ids")).alias("t")).collect()}
    assert (got[0], got[1], got[2], got[3], got[4]) == (None, None, None, "", "aa") and got[5].endswith("a") and "�" in got[5]


def test_scores_of_a_bundle(spark, vocabulary):
    kind = "pos long, row_id string, prompt string, expected array<string>, verifier string, category string, reasoning_budget_tokens int"
    say = lambda text, n=1000: [*vocabulary.opening, *vocabulary.ids("a") * n, *vocabulary.closing, *vocabulary.ids(text), vocabulary.stops[0]]
    rows = [(i, f"r{i}", "What?", ["forty two"], "label_match", "c", 1024) for i in range(3)]
    tokens = [(0, "r0", say(" Forty  two\n")), (1, "r1", say("forty")), (2, "r2", say("forty two", 5))]
    got = G.score_rollouts(spark.createDataFrame(rows, kind), spark.createDataFrame(tokens, "pos long, row_id string, tokens array<int>"), vocabulary)
    assert {x.row_id: (x.reward, x.reasoning_tokens) for x in got.collect()} == {"r0": (1, 1000), "r1": (0, 1000), "r2": (0, None)}


def test_rollouts_are_joined_once_and_without_their_tokens(spark, vocabulary):
    """All verifiers read one written table of answers; rollouts that are not returned do not go through the join, but are still held to the protocol."""
    kind = "pos long, row_id string, prompt string, expected array<string>, verifier string, category string, reasoning_budget_tokens int"
    say = lambda text, n: [*vocabulary.opening, *vocabulary.ids("a") * n, *vocabulary.closing, *vocabulary.ids(text), vocabulary.stops[0]]
    kinds = ["label_match", "math_exact", "json_output_exact", "exact_or_numeric"]
    evaluation = spark.createDataFrame([(i, f"r{i}", "What?", ["7"], kinds[i % 4], "c", 1024) for i in range(8)], kind)
    texts = ["7", "\\boxed{7}", '{"output": "7"}', "it is 7.0"]
    rows = [(i, f"r{i}", say(texts[i % 4], 1000 if i < 5 else 900)) for i in range(8)]
    rollouts = spark.createDataFrame(rows, "pos long, row_id string, tokens array<int>")
    whole, few = (G.score_rollouts(evaluation, rollouts, vocabulary, tokens=t) for t in (True, False))
    assert "Join" not in few._jdf.queryExecution().optimizedPlan().toString()
    assert {x.row_id: (x.reward, x.reasoning_tokens) for x in few.collect()} == {f"r{i}": (1, 1000) if i < 5 else (0, None) for i in range(8)}
    assert sorted(few.collect()) == sorted(whole.drop("tokens").collect()) and {(x.row_id, tuple(x.tokens)) for x in whole.collect()} == {(i, tuple(t)) for _, i, t in rows}
    for bad in (rows[1:], [(0, "r1", rows[0][2]), *rows[1:]], [(0, "r0", rows[0][2][:-1]), *rows[1:]]):
        with pytest.raises(Exception, match="rows differ|no_terminal"):
            G.score_rollouts(evaluation, spark.createDataFrame(bad, rollouts.schema), vocabulary, tokens=False).collect()
