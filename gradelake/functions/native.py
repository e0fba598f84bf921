"""Scalar functions as Column expressions; all stay in the JVM."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradelake.config import PROTOCOL, Protocol
from gradelake.functions.canonical import object_json

#: White space as Python's str methods see it; Java's \s is ASCII only.
WS = r"[\s\x1c-\x1f\x85\p{Z}]"
#: The characters of that class one by one, which are trimmed without a regular expression.
SPACES = "\t\n\x0b\f\r \x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
WORD = r"[A-Za-z0-9]+(?:'[A-Za-z0-9]+)?"

# Classes of suspicious prompts, first match wins.
SUSPICIOUS = (
    ("url", r"https?://|www\."),
    ("script", r"<script|</script>|javascript:"),
    ("role_injection", r"ignore (all )?(previous|above) instructions|developer message|system message"),
    ("secret_request", r"private key|api key|password|token"),
    ("file_request", r"/etc/passwd|\.ssh|powershell|cmd\.exe"),
)


# Forms in which an option letter is given, bare, wrapped or named.
BARE_LETTER = r"\A[^A-Za-z0-9]*([A-Za-z])[^A-Za-z0-9]*\z"
WRAPPED_LETTER = r"\\(?:boxed|text|mathrm)\s*\{\s*([A-Za-z])\s*\}"
NAMED_LETTER = r"(?i)\banswer\s*[:\-]?\s*\(?\s*([A-Za-z])(?![A-Za-z])"


def div(a: Column, b: Column | int) -> Column:
    """Exact integer division."""
    return F.call_function("div", a, F.lit(b) if isinstance(b, int) else b)


def demand(ok: Column, value: Column, message: str) -> Column:
    """``value`` where ``ok`` holds; anything else is an error."""
    return F.when(F.coalesce(ok, F.lit(False)), value).otherwise(F.raise_error(F.lit(message)))


def bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of ``x``, which is computed once a row however often, and in whatever loops, f uses it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def strip(x: Column) -> Column:
    return F.btrim(x, F.lit(SPACES))


def strip_end(x: Column) -> Column:
    return F.rtrim(x, F.lit(SPACES))


def collapse(x: Column) -> Column:
    return F.regexp_replace(x, f"{WS}+", " ")


def normal_answer(x: Column) -> Column:
    """Stripped, lower-cased, white space runs made one space; null counts as the word none."""
    return collapse(F.lower(strip(F.coalesce(x, F.lit("none")))))


def fingerprint(x: Column) -> Column:
    return F.sha2(F.lower(strip(collapse(x))), 256)


def content_id(x: Column) -> Column:
    return F.substring(F.sha2(x, 256), 1, 20)


def suspicious(x: Column) -> Column:
    low, out = F.lower(x), F.lit(None).cast("string")
    for name, pattern in reversed(SUSPICIOUS):
        out = F.when(low.rlike(pattern), name).otherwise(out)
    return out


def keyed_rank(seed: str, domain: str | Column, row_id: Column, protocol: Protocol = PROTOCOL) -> Column:
    """64 hex digits that order rows by a keyed hash, on any machine alike."""
    domain = F.lit(domain) if isinstance(domain, str) else domain
    parts = [F.lit(protocol.domain), F.lit("\0"), F.lit(seed), F.lit("\0"), domain, F.lit("\0"), row_id.cast("string")]
    return F.sha2(F.concat(*parts), 256)


def budget(seed: str, row_id: Column, protocol: Protocol = PROTOCOL) -> Column:
    """Level of a row: its rank modulo the number of levels; 16 leaves 1 modulo 5, so the digits' sum does."""
    levels = protocol.budget_levels
    if 15 % len(levels):
        raise ValueError("the digit sum gives the remainder only for divisors of 15")
    rank = keyed_rank(seed, "reasoning_budget", row_id, protocol)
    digits = F.aggregate(F.sequence(F.lit(1), F.lit(64)), F.lit(0), lambda a, i: a + F.conv(F.substr(rank, i, F.lit(1)), 16, 10).cast("int"))
    return F.element_at(F.array(*map(F.lit, levels)), (digits % len(levels)) + 1)


def budget_bounds(level: Column, protocol: Protocol = PROTOCOL) -> tuple[Column, Column]:
    bps = protocol.budget_tolerance_bps
    low, high = div(level.cast("long") * (10_000 - bps) + 9_999, 10_000), div(level.cast("long") * (10_000 + bps), 10_000)
    return low.cast("int"), high.cast("int")


def window_of(block: Column, protocol: Protocol = PROTOCOL) -> Column:
    """The window of a block; a negative block is an error, null stays null."""
    return F.when(block < 0, F.raise_error(F.lit("a block must not be negative")).cast("long")).otherwise(div(block.cast("long"), protocol.window_blocks))


def precedes(block: Column, window: Column | int, protocol: Protocol = PROTOCOL) -> Column:
    """Whether a block lies before the start of a window."""
    start = (F.lit(window) if isinstance(window, int) else window).cast("long") * protocol.window_blocks
    return block < start


def words(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(WORD), F.lit(0))


def sentences(x: Column) -> Column:
    return F.filter(F.transform(F.split(x, "[.!?]+"), strip), lambda s: s != "")


def paragraphs(x: Column) -> Column:
    parts = F.when(x.contains("***"), F.split(x, r"\*\*\*")).otherwise(F.split(x, rf"\n{WS}*\n"))
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def numeric_value(x: Column) -> Column:
    """The first signed decimal of a text, commas left out."""
    return F.regexp_extract(F.replace(x, F.lit(","), F.lit("")), r"-?\d+(?:\.\d+)?", 0).try_cast("double")


def close(a: Column, b: Column, tolerance: float = 1e-6) -> Column:
    return F.abs(a - b) <= F.greatest(tolerance * F.greatest(F.abs(a), F.abs(b)), F.lit(tolerance))


def mcqa_letter(x: Column) -> Column:
    """A bare letter, else the last wrapped one, else the last after the word answer."""
    text = strip(x)
    bare = F.regexp_extract(text, BARE_LETTER, 1)
    wrapped = F.regexp_extract_all(text, F.lit(WRAPPED_LETTER), F.lit(1))
    named = F.regexp_extract_all(text, F.lit(NAMED_LETTER), F.lit(1))
    found = F.when(bare != "", bare).when(F.size(wrapped) > 0, F.try_element_at(wrapped, F.lit(-1))).when(F.size(named) > 0, F.try_element_at(named, F.lit(-1)))
    return F.upper(found)


def detection_probability(population: Column, forged: Column, samples: Column) -> Column:
    """Chance that a sample without replacement meets a forged row: 0 without samples or forged rows."""
    ok = (population > 0) & forged.between(0, population) & samples.between(0, population)
    some = F.when(samples > 0, F.sequence(F.lit(0), samples - 1))
    miss = F.aggregate(some, F.lit(0.0), lambda a, i: a + F.ln((population - forged - i).cast("double")) - F.ln((population - i).cast("double")))
    chance = F.when((forged == 0) | (samples == 0), 0.0).when(samples > population - forged, 1.0).otherwise(-F.expm1(miss))
    return demand(ok, chance, "forged rows and samples lie between none and all of the population")


def required_rounds(population: Column, rows: Column, fraction: float, confidence: float) -> Column:
    """Rounds of ``rows`` samples that meet a forged ``fraction`` with the given confidence, as if drawn with replacement; at most those that cover all rows."""
    if not (0 < fraction < 1 and 0 < confidence < 1):
        raise ValueError("fraction and confidence lie between 0 and 1")
    samples = math.ceil(math.log1p(-confidence) / math.log1p(-fraction))
    up = lambda a, b: div(a.cast("long") + b - 1, b)
    return demand((population > 0) & (rows > 0), F.least(up(F.lit(samples), rows), up(population, rows)), "population and rows are positive")


def retry_delay(attempts: Column) -> Column:
    return F.least(F.lit(150), (5 * F.pow(F.lit(2), F.least(attempts - 1, F.lit(5)))).cast("int"))


def block_hash(x: Column) -> Column:
    """The one form of a block's hash, 0x and 64 lower-case hex digits; another text is an error, null stays null."""
    bare = F.regexp_replace(F.lower(strip(x)), "^0x", "")
    return F.when(x.isNotNull(), demand(bare.rlike("^[0-9a-f]{64}$"), F.concat(F.lit("0x"), bare), "a block hash has 32 bytes in hex digits"))


def evaluation_seed(network: Column, window: Column, block: Column, protocol: Protocol = PROTOCOL) -> Column:
    """The seed of a window's evaluation: the hash of the canonical JSON of its parts."""
    told = object_json(domain=(F.lit(f"{protocol.domain}/evaluation"), "string"), network=(network, "long"), window=(window, "long"), block_hash=(block_hash(block), "string"))
    return F.sha2(told, 256)


def audit_seed(network: Column, block: Column, hotkey: Column, digest: Column, revision: Column, number: Column, protocol: Protocol = PROTOCOL) -> Column:
    """The seed of an audit round."""
    parts = {"hotkey": hotkey, "digest": digest, "revision": revision, "block_hash": block_hash(block), "domain": F.lit(f"{protocol.domain}/audit")}
    told = object_json(**{k: (c, "string") for k, c in parts.items()}, network=(network, "long"), round=(number, "long"))
    return F.sha2(told, 256)
