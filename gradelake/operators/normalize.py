"""Row normalisers: raw source rows to evaluation rows (row_id, task_type, prompt, expected, verifier, source_dataset, license); what does not fit is dropped.

Where a table has them, block_ord and pos (its scan order) are carried along. Nulls in nested fields count as missing and drop the row; repeated rows
stay (the window removes them); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradelake.functions import native as N
from gradelake.functions.answers import canonical_math_udf, static_field_udf

# Protocol suffixes, templates that sources bake into prompts, and formats that contradict the protocol's.
MATH_SUFFIX = "\n\nAfter the required reasoning block, state the final answer clearly."
MCQA_SUFFIX = "\n\nAfter the required reasoning block, give the single letter of the correct option."
CODE_SUFFIX = '\n\nAfter the required reasoning block, end with a JSON object of the form {"output": "..."} holding the exact predicted output string.'
PREFIX = "Solve the following problem. Make sure to put the answer (and only answer) inside \\boxed{}."
SUFFIX = "Return your response as a json with a field 'output' that contains the predicted output string."
CONFLICT = r"(?i)last line of your response|inside \\boxed|put your (final )?answer|return your response as a json|<answer>|<think>"
OPTION = r"(?dm)^[ \t]*([A-Z])(?:[:.]|\))[ \t]+"
LETTERS = list("ABCDEFGHIJ")
WRAPPED = r"\A\\(?:text|mathrm|mathbf|mathit|boxed)\s*\{\s*([A-Za-z])\s*\}\z"
PLAIN = r"\A\$?\s*([A-Za-z])\s*\$?\s*[.)]?\z"
SCAN = ("block_ord", "pos")


def question_of(x: Column) -> Column:
    """The question without known templates; null if empty or if it still tells how to format the answer."""
    text = N.strip(F.coalesce(x, F.lit("")))
    text = F.when(text.startswith(PREFIX), N.strip(F.substr(text, F.lit(len(PREFIX) + 1)))).otherwise(text)
    text = F.when(text.endswith(SUFFIX), N.strip(F.left(text, F.length(text) - len(SUFFIX)))).otherwise(text)
    return F.when((text != "") & ~text.rlike(CONFLICT), text)


def unwrapped_letter(x: Column) -> Column:
    text = N.strip(F.coalesce(x, F.lit("")))
    wrapped = F.regexp_extract(text, WRAPPED, 1)
    plain = F.regexp_extract(text, PLAIN, 1)
    return F.upper(F.when(wrapped != "", wrapped).when(plain != "", plain))


def scan_of(df: DataFrame) -> list[str]:
    return [c for c in SCAN if c in df.columns]


def _rows(df: DataFrame, row_id: Column, task: str, prompt: Column, answer: Column, verifier: str, source: str, license: str | None) -> DataFrame:
    named = {"row_id": row_id, "task_type": F.lit(task), "prompt": prompt, "expected": F.array(answer), "verifier": F.lit(verifier), "source_dataset": F.lit(source), "license": F.lit(license).cast("string")}
    out = df.select(*[c.alias(n) for n, c in named.items()], *scan_of(df))
    return out.where(F.col("row_id").isNotNull() & F.col("prompt").isNotNull() & F.element_at("expected", 1).isNotNull())


def by_content(task: str, source: str) -> Column:
    """A row's id from its cleaned question (column q), so that equal questions have equal ids."""
    return F.concat(F.lit(f"{task}:{source}:"), N.content_id(F.col("q")))


def _math(df: DataFrame, row_id: Column, question: Column, answer: Column, source: str, license: str | None) -> DataFrame:
    df = df.select(question_of(question).alias("q"), answer.alias("a"), row_id.alias("i") if row_id is not None else F.lit(None).alias("i"), *scan_of(df)).where("q IS NOT NULL").withColumn("c", canonical_math_udf("a"))
    own = F.col("i") if row_id is not None else by_content("math", source)
    return _rows(df, own, "math", F.concat("q", F.lit(MATH_SUFFIX)), F.col("c"), "math_exact", source, license)


def extracted_math(df: DataFrame, source: str, license: str | None = None) -> DataFrame:
    """problem, expected_answer, problem_type: only answers that were extracted."""
    df = df.where("problem_type = 'has_answer_extracted'")
    return _math(df, None, F.col("problem"), F.col("expected_answer"), source, license)


def nested_math(df: DataFrame, source: str, ordinal: Column, license: str | None = None) -> DataFrame:
    """meta_data (index, question) and reward_model (ground_truth); without an index the scan's ordinal names the row."""
    own = F.coalesce(F.col("meta_data.index").cast("string"), ordinal.cast("string"))
    return _math(df, F.concat(F.lit(f"math:{source}:"), own), F.col("meta_data.question"), F.col("reward_model.ground_truth"), source, license)


def typed_math(df: DataFrame, source: str, license: str | None = None) -> DataFrame:
    """problem, answer, question_type: no proofs."""
    df = df.where(F.coalesce(F.lower(N.strip(F.col("question_type"))), F.lit("")) != "proof")
    return _math(df, None, F.col("problem"), F.col("answer"), source, license)


def _mcqa(df: DataFrame, row_id: Column | None, question: Column, answer: Column, source: str, license: str | None, declared: Column | None = None) -> DataFrame:
    own = [] if row_id is None else [row_id.alias("i")]
    df = df.select(*own, question_of(question).alias("q"), unwrapped_letter(answer).alias("a"), *([declared.alias("d")] if declared is not None else []), *scan_of(df))
    letters = F.array_sort(F.array_distinct(F.regexp_extract_all("q", F.lit(OPTION), F.lit(1))))
    wide = F.array(*map(F.lit, LETTERS))
    df = df.where((letters == wide) & F.array_contains(wide, F.col("a")))
    if declared is not None:
        df = df.where(F.col("d") == wide)
    return _rows(df, F.col("i") if own else by_content("mcqa", source), "mcqa", F.concat("q", F.lit(MCQA_SUFFIX)), F.col("a"), "mcqa_letter", source, license)


def declared_letters(options: Column) -> Column:
    """Sorted letters of options that each have exactly one filled key, a single letter; null if they do not, or repeat one."""
    filled = F.transform(options, lambda m: F.filter(F.map_entries(m), lambda e: N.strip(F.coalesce(e["value"], F.lit(""))) != ""))
    sound = F.forall(filled, lambda e: F.size(e) == 1)
    letters = F.transform(filled, lambda e: F.upper(N.strip(F.get(e, F.lit(0))["key"])))
    ok = sound & F.forall(letters, lambda x: x.rlike(r"\A[A-Z]\z")) & (F.size(F.array_distinct(letters)) == F.size(letters)) & F.size(options).between(1, 26)
    return F.when(ok, F.array_sort(letters))


def without_lead(content: Column, template: Column) -> Column:
    """The question without a rendered instruction paragraph that begins like the template."""
    head = N.strip(F.substring_index(F.substring_index(F.coalesce(template, F.lit("")), "{problem}", 1), "'", 1))
    at = F.locate("\n\n", content)
    lead = N.strip(F.left(content, at - 1))
    return F.when((F.length(head) >= 20) & (at > 0) & F.startswith(lead, F.left(head, F.lit(40))), F.substr(content, at + 2)).otherwise(content)


def declared_mcqa(df: DataFrame, source: str, ordinal: Column, license: str | None = None) -> DataFrame:
    """responses_create_params.input[].content, template_metadata, options, uuid."""
    first = F.get(F.filter(F.col("responses_create_params.input"), lambda x: F.coalesce(x["content"], F.lit("")) != ""), F.lit(0))["content"]
    own = F.coalesce(F.nullif(F.col("uuid"), F.lit("")), ordinal.cast("string"))
    return _mcqa(df, F.concat(F.lit(f"mcqa:{source}:"), own), without_lead(first, F.col("template_metadata.template_prompt")), F.col("expected_answer"), source, license, declared_letters(F.col("options")))


def bare_mcqa(df: DataFrame, source: str, license: str | None = None) -> DataFrame:
    """input, expected_answer."""
    return _mcqa(df, None, F.col("input"), F.col("expected_answer"), source, license)


def code_output(df: DataFrame, source: str, ordinal: Column, license: str | None = None) -> DataFrame:
    """problem_id, prompt, verification_info: the constant text under ground_truth, which is not empty."""
    own = F.coalesce(F.nullif(F.col("problem_id"), F.lit("")), ordinal.cast("string"))
    df = df.select(F.concat(F.lit(f"code:{source}:"), own).alias("i"), question_of(F.col("prompt")).alias("q"), static_field_udf("verification_info", F.lit("ground_truth")).alias("truth"), *scan_of(df))
    return _rows(df, F.col("i"), "code_output", F.concat("q", F.lit(CODE_SUFFIX)), F.nullif(F.col("truth"), F.lit("")), "json_output_exact", source, license)


NORMALIZERS: dict[str, Callable] = {"extracted_math": extracted_math, "nested_math": nested_math, "typed_math": typed_math, "declared_mcqa": declared_mcqa, "bare_mcqa": bare_mcqa, "code_output": code_output}
#: Normalisers that name rows by the scan's ordinal where they have no id of their own.
BY_ORDINAL = frozenset({"nested_math", "declared_mcqa", "code_output"})
