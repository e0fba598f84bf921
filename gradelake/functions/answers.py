"""Answer canonicalisers that Column expressions cannot express; Arrow-batched, on text only: nothing is evaluated."""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Callable
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Phrases before a final answer in order of preference, answers that mean none, and bounds.
MARKERS = ("final answer is", "final answer:", "the answer is", "answer is", "answer:")
NO_ANSWER = frozenset({"", "proof", "notfound", "none", "null", "nan"})
MAX_STARTS, MAX_LITERAL = 128, 64 * 1024


def boxed(text: str) -> str | None:
    """Body of the last balanced box command, from one pass that keeps the open braces of each box."""
    if "\\boxed" not in text:
        return None
    bodies: list[tuple[int, str]] = []
    open_at: list[int | None] = []
    for m in re.finditer(r"(\\boxed\s*\{)|([{}])", text):
        if m[1]:
            open_at.append(m.end())
        elif m[2] == "{":
            open_at.append(None)
        elif open_at and (start := open_at.pop()) is not None:
            bodies.append((start, text[start : m.start()]))
    # braces that close nothing outside a box do not matter to it, so a box is balanced as soon as its own brace closes
    return max(bodies)[1].strip() if bodies else None


def tagged(text: str) -> str | None:
    if "</" not in text:
        return None
    head, tag, tail = text.lower().rpartition("<answer>")
    if not tag or "</answer>" not in tail:
        return None
    start = len(head) + len(tag)
    return text[start : start + tail.index("</answer>")].strip()


def marked(text: str) -> str | None:
    low = text.lower()
    if "answer" not in low:
        return None
    at, _, marker = max((low.rfind(m), -i, m) for i, m in enumerate(MARKERS))
    return (text[at + len(marker) :].strip() or None) if at >= 0 else None


def unwrap(text: str) -> str:
    text = text.strip()
    if text.startswith(("FINAL:", "Final:", "final:")):
        text = text[6:].strip()
    for left, right in (("\\(", "\\)"), ("$", "$")):
        if len(text) >= 2 and text.startswith(left) and text.endswith(right):
            text = text[len(left) : -len(right)].strip()
            break
    return (re.sub(r"\A\\displaystyle\s*", "", text) if text.startswith("\\displaystyle") else text).rstrip(". ")


def canonical_math(value: str | None) -> str | None:
    """The final answer's text without its presentation, or None."""
    text = (value or "").strip()
    found = next((x for read in (tagged, boxed, marked) if (x := read(text)) is not None), text).strip()
    if not found:
        return None
    found = unwrap(found)
    if found.startswith("\\boxed") and (inner := boxed(found)) is not None:
        found = unwrap(inner)
    if found.startswith("\\[") and found.endswith("\\]"):
        found = found[2:-2]
    found = " ".join(found.split())
    return None if found.lower() in NO_ANSWER else found


def json_output(value: str | None) -> str | None:
    """The string under the only key ``output`` of a JSON object that ends the text; a closing code fence on a line of its own may follow."""
    text = re.sub(r"(?:\A|\n)[ \t]*```[ \t]*\Z", "", (value or "").rstrip()).rstrip()
    decoder = json.JSONDecoder()
    for at in [m.start() for m in re.finditer(r"\{", text)][: -MAX_STARTS - 1 : -1]:
        try:
            found, end = decoder.raw_decode(text, at)
        except (ValueError, RecursionError):
            continue
        if end == len(text) and isinstance(found, dict) and set(found) == {"output"} and isinstance(found["output"], str):
            return found["output"]
    return None


# Forms of numbers that are read as exact rationals.
NUMBER = re.compile(r"[+-]?(?:\d+(?:\.\d+)?|\.\d+)(?:[eE][+-]?\d+)?")
RATIO = re.compile(r"\\frac\s*\{([+-]?\d+)\}\s*\{([+-]?\d+)\}|([+-]?\d+)\s*/\s*([+-]?\d+)")
#: Digits of an exponent beyond which a number is not read: its exact value would have millions of digits.
MAX_EXPONENT = 4


def literal(text: str | None) -> Fraction | None:
    """The exact value of a text that is nothing but a number or a ratio."""
    text = unwrap(text or "")
    if m := RATIO.fullmatch(text):
        over, under = int(m[1] or m[3]), int(m[2] or m[4])
        return Fraction(over, under) if under else None
    if not NUMBER.fullmatch(text) or len(re.sub(r".*[eE][+-]?0*|\A[^eE]*\Z", "", text)) > MAX_EXPONENT:
        return None
    return Fraction(text)


def rational(value: str | None) -> str | None:
    """The final answer as n or n/d in lowest terms: of the whole text, else of its answer tag, last box, or last marker."""
    text = (value or "").strip()

    def candidate(x: str | None) -> Fraction | None:
        found = literal(x)
        return found if found is not None or x is None else literal(boxed(x))

    for read, part in ((literal, text), (candidate, tagged(text)), (literal, boxed(text)), (candidate, marked(text))):
        if part and (found := read(part)) is not None:
            return str(found)
    return None


def static_field(value: str | None, field: str) -> str | None:
    """The constant string under one unique key of a dict's text; read from the syntax tree, never evaluated."""
    if value is None or len(value) > MAX_LITERAL:
        return None
    try:
        tree = ast.parse(value, mode="eval").body
    except (SyntaxError, ValueError, MemoryError, RecursionError):
        return None
    if not isinstance(tree, ast.Dict):
        return None
    own = [v for k, v in zip(tree.keys, tree.values, strict=True) if isinstance(k, ast.Constant) and k.value == field]
    texts = [v.value for v in own if isinstance(v, ast.Constant) and isinstance(v.value, str)]
    return texts[0] if len(texts) == 1 else None


def each_once(f: Callable[[str | None], str | None], x: pa.Array) -> pa.Array:
    """f of every value; of a batch's equal values it is computed once."""
    known = x.dictionary_encode(null_encoding="encode")
    return pa.array([f(v) for v in known.dictionary.to_pylist()], pa.string()).take(known.indices)


@F.arrow_udf(T.StringType())
def canonical_math_udf(x: pa.Array) -> pa.Array:
    return each_once(canonical_math, x)


@F.pandas_udf(T.StringType())
def json_output_udf(x: pd.Series) -> pd.Series:
    return x.map(json_output, na_action=None)


@F.pandas_udf(T.StringType())
def static_field_udf(x: pd.Series, field: pd.Series) -> pd.Series:
    return pd.Series([static_field(a, b) for a, b in zip(x, field, strict=True)], dtype=object)


@F.arrow_udf(T.ArrayType(T.StringType()))
def canonical_each_udf(x: pa.Array) -> pa.Array:
    sizes = x.value_lengths()
    ends = np.cumsum(sizes.fill_null(0).to_numpy(zero_copy_only=False))
    offsets = pa.array(np.r_[0, ends].astype(np.int32), mask=np.r_[sizes.is_null().to_numpy(zero_copy_only=False), False])
    return pa.ListArray.from_arrays(offsets, each_once(canonical_math, x.flatten()))


@F.pandas_udf(T.StringType())
def rational_udf(x: pd.Series) -> pd.Series:
    return x.map(rational, na_action=None)
