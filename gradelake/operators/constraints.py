"""Instruction constraints as Column expressions: each id is a predicate over an answer and its arguments (map<string, string>; lists as JSON arrays)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradelake.functions import native as N

# Names of count relations; anything else means equality.
BELOW = ("less than", "fewer than", "below")
AT_MOST = ("at most", "no more than", "less than or equal to")
AT_LEAST = ("at least", "no less than", "greater than or equal to")
ABOVE = ("more than", "greater than", "above")


def arg(args: Column, *names: str) -> Column:
    return F.coalesce(*[args[n] for n in names])


def listed(x: Column) -> Column:
    """A JSON array's texts, or the one text; empty ones and null left out."""
    many = F.when(F.ltrim(x).startswith("["), F.from_json(x, "array<string>")).otherwise(F.array(x))
    return F.filter(F.coalesce(many, F.array().cast("array<string>")), lambda w: F.coalesce(w, F.lit("")) != "")


def compare(actual: Column, expected: Column, relation: Column) -> Column:
    target = N.numeric_value(expected).cast("long")
    rel = N.normal_answer(F.coalesce(F.nullif(relation, F.lit("")), F.lit("exactly")))
    found = F.when(rel.isin(*BELOW), actual < target).when(rel.isin(*AT_MOST), actual <= target).when(rel.isin(*AT_LEAST), actual >= target).when(rel.isin(*ABOVE), actual > target).otherwise(actual == target)
    return F.coalesce(found, F.lit(False))


def phrase_count(text: Column, phrase: Column) -> Column:
    """How often a literal phrase occurs, ignoring case, at word borders where the phrase itself ends in a letter or digit."""
    value = N.strip(F.coalesce(phrase, F.lit("")))
    quoted = F.regexp_replace(value, r"([\\.\[\]{}()*+?^$|])", r"\\$1")
    # the phrase itself is looked for before the border, which most places would have to be tried for
    left = F.when(value.rlike(r"\A[\p{L}\p{N}]"), F.concat(F.lit("(?="), quoted, F.lit(r")(?<!\w)"))).otherwise("")
    right = F.when(value.rlike(r"[\p{L}\p{N}]\z"), r"(?!\w)").otherwise("")
    return F.when(value == "", 0).otherwise(F.regexp_count(text, F.concat(F.lit("(?iuU)"), left, quoted, right)))


def same_first(text: Column, expected: Column) -> Column:
    return F.coalesce(F.lower(F.nullif(F.regexp_extract(text, N.WORD, 0), F.lit(""))) == expected, F.lit(False))


def same_last(words: Column, expected: Column) -> Column:
    return F.coalesce(F.lower(F.try_element_at(words, F.lit(-1))), F.lit("")) == expected


def parts(t: Column) -> dict[str, Column]:
    """What several predicates read of an answer. A query of many of them selects these as columns of their own first, so that each is computed once a row."""
    divided = F.when(t.contains("***"), F.split(t, r"\s?\*\*\*\s?")).otherwise(F.array(t))
    return {"low": F.lower(t), "words": N.words(t), "sentences": N.sentences(t), "paragraphs": N.paragraphs(t), "stripped": N.strip(t), "divided": divided}


def all_predicates(df: DataFrame, text: str, a: Column, keep: list[str]) -> DataFrame:
    """df's columns ``keep`` and a column for every id, with an underscore for its colon; null counts as false."""
    # a column that is read more than once stays a step of its own in the plan
    shared = df.select(*keep, F.col(text).alias("text_"), *[c.alias(f"{k}_") for k, c in parts(F.col(text)).items()])
    found = predicates(F.col("text_"), a, {k: F.col(f"{k}_") for k in parts(F.col(text))})
    return shared.select(*keep, *[F.coalesce(p, F.lit(False)).alias(name.replace(":", "_")) for name, p in found.items()])


def predicates(t: Column, a: Column, p: dict[str, Column] | None = None) -> dict[str, Column]:
    """Every id's predicate over the answer ``t`` and the arguments ``a``; p: the answer's ``parts``, where they are columns already."""
    # The patterns, bounds and relations of the constraints below.
    p = parts(t) if p is None else p
    w, rel = p["words"], a["relation"]
    low, n = p["low"], arg(a, "N")
    letters = t.rlike("[A-Za-z]")
    initials = F.filter(F.transform(w, lambda x: F.ascii(F.lower(F.left(x, F.lit(1))))), lambda c: c.between(97, 122))
    rest = F.greatest(F.size(initials) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(initials, 1, rest), F.slice(initials, 2, rest), lambda x, y: F.abs(x - y) != 1)
    last, first = N.normal_answer(arg(a, "last_word", "word")), N.normal_answer(arg(a, "first_word", "word"))
    has_last, has_first = F.coalesce(arg(a, "last_word", "word"), F.lit("")) != "", F.coalesce(arg(a, "first_word", "word"), F.lit("")) != ""
    phrase, marker, letter = arg(a, "end_phrase", "phrase", "suffix"), arg(a, "postscript_marker", "marker"), a["letter"]
    paras, sents = p["paragraphs"], p["sentences"]
    nth = N.numeric_value(a["nth_paragraph"]).cast("int")
    stripped, divided = p["stripped"], p["divided"]
    inner = F.slice(divided, 2, F.greatest(F.size(divided) - 2, F.lit(0)))
    solid = lambda parts: F.filter(parts, lambda p: N.strip(p) != "")
    wanted = arg(a, "keywords", "keyword")
    none_wanted = F.coalesce(F.ltrim(wanted).startswith("[") & (F.size(F.from_json(wanted, "array<string>")) == 0), F.lit(False))
    return {
        "keywords:forbidden_words": F.forall(listed(arg(a, "forbidden_words", "keywords", "keyword")), lambda x: ~F.contains(low, F.lower(x))),
        "keywords:existence": ~none_wanted & F.forall(listed(wanted), lambda x: phrase_count(t, x) > 0),
        "keywords:word_once": phrase_count(t, arg(a, "keyword", "word")) == 1,
        "keywords:frequency": compare(phrase_count(t, arg(a, "keyword", "word")), arg(a, "frequency", "N"), rel),
        "keywords:no_adjacent_consecutive": F.forall(pairs, lambda x: x),
        "length_constraints:number_words": compare(F.size(w), arg(a, "N", "num_words"), rel),
        "length_constraints:number_paragraphs": compare(F.size(paras), arg(a, "num_paragraphs", "N"), rel),
        "length_constraints:number_sentences": compare(F.size(sents), arg(a, "num_sentences", "N"), rel),
        "length_constraints:nth_paragraph_first_word": (F.size(paras) == N.numeric_value(a["num_paragraphs"]).cast("int")) & nth.between(1, F.size(paras)) & same_first(F.get(paras, nth - 1), first),
        "punctuation:no_comma": ~t.contains(","),
        "punctuation:punctuation_dot": ~t.contains("."),
        "punctuation:punctuation_exclamation": ~t.contains("!"),
        "last_word:last_word_answer": has_last & same_last(w, last),
        "last_word:last_word_sent": (last != "") & (F.size(sents) > 0) & F.forall(sents, lambda s: same_last(N.words(s), last)),
        "first_word:first_word_answer": same_first(t, first),
        "first_word:first_word_sent": has_first & F.forall(sents, lambda s: same_first(s, first)),
        "startend:end_checker": (F.coalesce(phrase, F.lit("")) != "") & N.strip_end(t).endswith(phrase),
        "startend:quotation": (F.length(stripped) >= 2) & stripped.startswith('"') & stripped.endswith('"'),
        "detectable_format:title": t.rlike("<<[^<>]+>>"),
        "detectable_format:number_bullet_lists": compare(F.regexp_count(t, F.lit(r"(?dm)^\s*(?:[-*+]|\d+[.)])\s+\S")), arg(a, "num_bullets", "num_bullet_lists", "N"), rel),
        "detectable_format:number_highlighted_sections": compare(F.regexp_count(t, F.lit(r"\*(?<!\*\*)[^*\n]+\*(?!\*)")), arg(a, "num_highlights", "N"), rel),
        "detectable_content:number_placeholders": compare(F.regexp_count(t, F.lit(r"\[[^\[\]]+\]")), arg(a, "num_placeholders", "N"), rel),
        "detectable_content:postscript": (F.coalesce(marker, F.lit("")) != "") & (F.regexp_count(t, F.concat(F.lit(r"(?:\A|\n)\s*"), F.regexp_replace(marker, r"([\\.\[\]{}()*+?^$|])", r"\\$1"))) > 0),
        "change_case:english_capital": letters & ~t.rlike("[a-z]"),
        "change_case:english_lowercase": letters & ~t.rlike("[A-Z]"),
        "letters:letter_counting": compare(F.length(t) - F.length(F.regexp_replace(t, r"\p{L}+", "")), arg(a, "N", "num_letters"), rel),
        "letters:letter_counting2": compare(F.when(F.length(letter) == 1, F.length(low) - F.length(F.replace(low, F.lower(letter), F.lit("")))).otherwise(0), arg(a, "let_frequency", "N"), a["let_relation"]),
        "paragraphs:paragraphs": (F.size(solid(divided)) == 2) & (F.size(solid(inner)) == F.size(inner)),
        "paragraphs:paragraphs2": F.size(solid(F.split(t, "\n\n"))) == 2,
        "count:count_unique": (F.size(w) > 0) & (F.size(w) == F.size(F.array_distinct(F.transform(w, F.lower)))),
    }


def satisfied(t: Column, name: Column, a: Column) -> Column:
    """Whether one constraint holds; an unknown id does not."""
    out = F.lit(False)
    for known, test in predicates(t, a).items():
        out = F.when(name == known, F.coalesce(test, F.lit(False))).otherwise(out)
    return out


def all_satisfied(t: Column, constraints: Column) -> Column:
    """Whether all constraints (array of id and kwargs) hold; without any the answer fails."""
    return F.coalesce((F.size(constraints) > 0) & F.forall(constraints, lambda c: satisfied(t, c["id"], c["kwargs"])), F.lit(False))
