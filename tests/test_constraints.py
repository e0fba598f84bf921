import re

from pyspark.sql import functions as F

from gradelake.functions import native as N
from gradelake.operators.constraints import all_predicates, predicates, satisfied
from gradelake.plans.catalog import QUERIES

CASES = [
    ("keywords:forbidden_words", "A cat", {"forbidden_words": '["dog"]'}, True), ("keywords:forbidden_words", "A Dog", {"forbidden_words": '["dog"]'}, False), ("keywords:forbidden_words", "x", {}, True),
    ("keywords:existence", "the cat sat", {"keywords": '["Cat","sat"]'}, True), ("keywords:existence", "category", {"keyword": "cat"}, False), ("keywords:existence", "x", {}, True),
    ("keywords:existence", "x", {"keywords": "[]"}, False), ("keywords:existence", "x", {"keywords": '[""]'}, True), ("last_word:last_word_sent", "so it is none. None!", {}, True),
    ("keywords:word_once", "a b a", {"word": "b"}, True), ("keywords:frequency", "a.b a.b", {"keyword": "a.b", "frequency": "2", "relation": "at least"}, True),
    ("keywords:no_adjacent_consecutive", "apple cat", {}, True), ("keywords:no_adjacent_consecutive", "apple bat", {}, False),
    ("length_constraints:number_words", "one two's three", {"N": "3"}, True), ("length_constraints:number_words", "one", {"N": "x"}, False), ("length_constraints:number_words", "one", {"num_words": "2", "relation": "less than"}, True),
    ("length_constraints:number_paragraphs", "a\n\nb\n \nc", {"num_paragraphs": "3"}, True), ("length_constraints:number_sentences", "A. B! C", {"num_sentences": "2", "relation": "more than"}, True),
    ("length_constraints:nth_paragraph_first_word", "a b\n\nHello c", {"num_paragraphs": "2", "nth_paragraph": "2", "first_word": "hello"}, True),
    ("punctuation:no_comma", "a,b", {}, False), ("punctuation:punctuation_dot", "ab", {}, True), ("punctuation:punctuation_exclamation", "a!", {}, False),
    ("last_word:last_word_answer", "the End.", {"last_word": "end"}, True), ("last_word:last_word_sent", "a end. b end!", {"last_word": "END"}, True), ("last_word:last_word_sent", "", {"last_word": "x"}, False),
    ("first_word:first_word_answer", "Hi you", {"first_word": "hi"}, True), ("first_word:first_word_sent", "", {"first_word": "x"}, True), ("first_word:first_word_sent", "Hi a. No b.", {"first_word": "hi"}, False),
    ("startend:end_checker", "so it is \n", {"end_phrase": "it is"}, True), ("startend:quotation", ' "a" ', {}, True), ("startend:quotation", '"', {}, False),
    ("detectable_format:title", "<<T>>", {}, True), ("detectable_format:number_bullet_lists", "- a\n* b\n1. c", {"num_bullets": "3"}, True), ("detectable_format:number_highlighted_sections", "*a* **b** *c*", {"num_highlights": "2"}, True),
    ("detectable_content:number_placeholders", "[a] [b]", {"N": "2"}, True), ("detectable_content:postscript", "a\n P.S. b", {"postscript_marker": "P.S."}, True), ("detectable_content:postscript", "a P.S. b", {"postscript_marker": "P.S."}, False),
    ("change_case:english_capital", "ABC é", {}, True), ("change_case:english_lowercase", "", {}, False), ("letters:letter_counting", "aé1", {"N": "2"}, True), ("letters:letter_counting2", "AaB", {"letter": "a", "let_frequency": "2"}, True),
    ("paragraphs:paragraphs", "a *** b", {}, True), ("paragraphs:paragraphs", "a *** *** b", {}, False), ("paragraphs:paragraphs2", "a\n\nb", {}, True), ("count:count_unique", "a A", {}, False), ("nothing", "a", {}, False),
]


def test_cases(spark):
    df = spark.createDataFrame([(i, c, t, a) for i, (c, t, a, _) in enumerate(CASES)], "i int, c string, t string, a map<string,string>")
    got = {x.i: x.ok for x in df.select("i", satisfied(F.col("t"), F.col("c"), F.col("a")).alias("ok")).collect()}
    assert {i: ok for i, ok in got.items() if ok != CASES[i][3]} == {}
    assert len(predicates(F.col("t"), F.col("a"))) == 30 and {c for c, _, _, _ in CASES} >= set(predicates(F.col("t"), F.col("a")))


def test_all_predicates_at_once(spark):
    """Every id as a column equals the same predicate alone, and what they share is computed once a row."""
    args = {k: v for _, _, a, _ in CASES for k, v in a.items()}
    df = spark.createDataFrame([(i, c[1]) for i, c in enumerate(CASES)] + [(-1, None), (-2, "  The cat. \x85\n\n a***b *c* 　")], "i int, t string")
    a = F.create_map(*[F.lit(x) for pair in args.items() for x in pair])
    at_once = all_predicates(df, "t", a, ["i"])
    alone = df.select("i", *[F.coalesce(p, F.lit(False)).alias(k.replace(":", "_")) for k, p in predicates(F.col("t"), a).items()])
    assert sorted(at_once.collect()) == sorted(alone.collect())
    plan = QUERIES["instruction_constraints"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"regexp_extract_all\(text#\d+, \[A-Za-z0-9\]\+", plan)) == 1


def test_strip_takes_what_python_takes(spark):
    every = [chr(c) for c in range(0x3100) if chr(c).isspace()]
    texts = ["", "a", " ", "".join(every), *[f"{c}a {c} b{c}{c}" for c in every], "​a​", "\x00a "]
    got = {x.i: (x.s, x.e) for x in spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", N.strip(F.col("t")).alias("s"), N.strip_end(F.col("t")).alias("e")).collect()}
    assert got == {i: (t.strip(), t.rstrip()) for i, t in enumerate(texts)}
