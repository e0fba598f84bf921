"""Quality rules with host verdicts, with DataFrame expressions only.

Every document is judged by rules; a host (the document's source) collects its documents' failures of each rule. Hosts with few documents
have noisy rates, so rates are shrunk by a beta prior fitted to all hosts by their moments: a host's rate has the posterior
Beta(a + failures, b + documents - failures). A host is rejected if the posterior mean less Z standard deviations exceeds HOST_RATE for
some rule. Verdicts join back to the documents; a document is kept if it passes its base rules and its host is not rejected.

Rules: few_words (under MIN_WORDS words), repeats (over REPEAT_SHARE % of words in 8-word windows found twice or more in the text), symbols (over
SYMBOL_SHARE symbols per 100 words), dup_lines (over DUP_LINE_SHARE % of the lines with a word equal an earlier one), word_length (a mean outside
MEAN_CHARS). The first two are the base rules.

Words are runs outside ``[\\x20\\x09-\\x0D]``. Windows are compared by a 64-bit hash of their words within one document. All aggregates by host are
sums, pre-aggregated before the shuffle; a host of a third of all documents is no hot spot. Rejected hosts are broadcast up to
SMALL_HOSTS of them; more are joined with the documents of each host dealt over SALTS.

Rows: a null or empty text has no words and fails. A null source is the host ``""``. Repeated rows are judged alike, and each counts for its
host. Ties do not occur: nothing is ranked. An empty table gives an empty result. Other columns are ignored or carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradelake.llm.shared import cut, stored

MIN_WORDS, REPEAT_SHARE, WINDOW = 20, 30, 8
SYMBOL_SHARE, DUP_LINE_SHARE, MEAN_CHARS = 100, 30, (2, 15)
HOST_RATE, Z = 0.5, 2.0
SMALL_HOSTS, SALTS = 10_000, 16
SYMBOLS = "#*$%&|<>"
RULES = ("few_words", "repeats", "symbols", "dup_lines", "word_length")
_SPACES = "\t\n\u000b\f\r"


def measure(docs: DataFrame, keep: list[Column]) -> DataFrame:
    """The columns of ``keep`` with n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words of each whole text (column text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    plain = F.translate(text, _SPACES, " " * len(_SPACES))
    words = F.array_remove(F.split(plain, " "), "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, _SPACES + " ", "")) > 0)
    names = [f"k{i}" for i in range(len(keep))]
    df = docs.select(*[c.alias(n) for c, n in zip(keep, names, strict=True)], words.alias("words"), lines.alias("lines"), F.length(F.translate(text, _SPACES + " ", "")).alias("word_chars"), (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).alias("n_symbols"))
    window = lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(WINDOW)])
    hashes = F.when(F.size("words") > WINDOW, F.transform(F.sequence(F.lit(0), F.size("words") - WINDOW), window))
    counts = ["word_chars", "n_symbols"]
    df = df.select(*names, *counts, F.size("words").alias("n_words"), F.size("lines").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"), hashes.alias("hashes"))
    repeated = F.size(F.array_distinct("hashes")) < F.size("hashes")
    placed = F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    counts += ["n_words", "n_lines", "n_dup_lines"]
    df = df.select(*names, *counts, F.when(repeated, placed).alias("placed"))
    rest = F.size("placed") - 1
    pair = F.zip_with(F.slice("placed", 1, rest), F.slice("placed", 2, rest), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    starts = F.sort_array(F.array_distinct(F.flatten(F.filter(pair, lambda p: p.isNotNull()))))
    df = df.select(*names, *counts, F.when(F.col("placed").isNotNull(), starts).alias("starts"))
    rest = F.size("starts") - 1
    gaps = F.zip_with(F.slice("starts", 1, rest), F.slice("starts", 2, rest), lambda a, b: F.least(b - a, F.lit(WINDOW)))
    covered = F.aggregate(gaps, F.lit(WINDOW), lambda s, x: s + x)
    repeats = F.coalesce(F.when(F.col("starts").isNotNull(), covered), F.lit(0)).cast("long")
    # The partition's id, always at least 0, keeps later filters above these projections: below, each reference would be computed anew.
    return df.select(*names, *[F.col(c).cast("long").alias(c) for c in counts], F.when(F.spark_partition_id() >= 0, repeats).alias("n_repeat_words"))


def failures() -> dict[str, Column]:
    """Whether a measured document fails each rule."""
    n = F.col("n_words")
    low, high = MEAN_CHARS
    return {
        "few_words": n < MIN_WORDS,
        "repeats": 100 * F.col("n_repeat_words") > REPEAT_SHARE * n,
        "symbols": 100 * F.col("n_symbols") > SYMBOL_SHARE * n,
        "dup_lines": 100 * F.col("n_dup_lines") > DUP_LINE_SHARE * F.col("n_lines"),
        "word_length": (F.col("word_chars") < low * n) | (F.col("word_chars") > high * n),
    }


def host_rates(measured: DataFrame, host: str) -> DataFrame:
    """host, n and the failures f_<rule> of every host."""
    sums = [F.sum(F.when(fails, 1).otherwise(0)).alias(f"f_{rule}") for rule, fails in failures().items()]
    return measured.groupBy(F.coalesce(host, F.lit("")).alias("host")).agg(F.count(F.lit(1)).alias("n"), *sums)


def priors(hosts: DataFrame) -> dict[str, tuple[float, float]]:
    """The beta prior (a, b) of every rule: mean of all documents, variance between hosts; between 2 and 1000 documents strong. One row is collected."""
    out = []
    for rule in RULES:
        rate = F.col(f"f_{rule}") / F.col("n")
        out += [F.sum(f"f_{rule}").alias(f"s_{rule}"), F.sum(F.col("n") * rate * rate).alias(f"q_{rule}")]
    row = hosts.agg(F.sum("n").alias("n"), *out).first()
    found = {}
    for rule in RULES:
        n = row["n"] or 0
        mean = (row[f"s_{rule}"] + 0.5) / (n + 1) if n else 0.5
        spread = (row[f"q_{rule}"] / n - (row[f"s_{rule}"] / n) ** 2) if n else 0.0
        strength = min(1000.0, max(2.0, mean * (1 - mean) / spread - 1)) if spread > 0 else 1000.0
        found[rule] = (mean * strength, (1 - mean) * strength)
    return found


def rejected_hosts(hosts: DataFrame) -> DataFrame:
    """host, rule (the first that rejects it) of the hosts that are rejected."""
    rule = F.lit(None).cast("string")
    for name, (a, b) in reversed(priors(hosts).items()):
        alpha, total = F.col(f"f_{name}") + a, F.col("n") + a + b
        mean = alpha / total
        low = mean - Z * F.sqrt(mean * (1 - mean) / (total + 1))
        rule = F.when(low > HOST_RATE, name).otherwise(rule)
    return hosts.select("host", rule.alias("host_rule")).where("host_rule IS NOT NULL")


def join_hosts(df: DataFrame, host: Column, rejected: DataFrame) -> DataFrame:
    """df with host_rule, null where the host is not rejected."""
    df = df.withColumn("host", F.coalesce(host, F.lit("")))
    if rejected.count() <= SMALL_HOSTS:
        return df.join(F.broadcast(rejected), "host", "left").drop("host")
    salted = rejected.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return df.withColumn("salt", F.floor(F.rand(11) * SALTS).cast("int")).join(salted, ["host", "salt"], "left").drop("host", "salt")


def base_failed() -> Column:
    rules = failures()
    return rules["few_words"] | rules["repeats"]


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the measures, base_failed, host_rule and kept of every row."""
    counts = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
    measured = cut(measure(docs, [F.col("doc_id"), F.col("source")]).select(F.col("k0").alias("doc_id"), F.col("k1").alias("source"), *counts))
    rejected = cut(rejected_hosts(host_rates(measured, "source")))
    judged = join_hosts(measured.withColumn("base_failed", base_failed()), F.col("source"), rejected)
    return judged.select("doc_id", *counts, "base_failed", "host_rule", (~F.col("base_failed") & F.col("host_rule").isNull()).alias("kept"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The kept rows of docs with all their columns. Texts are measured once: the rows that pass their base rules wait in the shared folder for the verdicts on hosts."""
    row = F.struct(*[docs[c] for c in docs.columns])
    measured = measure(docs, [row]).withColumns({"host": F.col("k0.source"), "base_failed": base_failed()})
    fails = [F.when(test, 1).otherwise(0).alias(f"f_{rule}") for rule, test in failures().items()]
    measured = stored(measured.select("host", *fails, F.when(~F.col("base_failed"), F.col("k0")).alias("row")), "measured")
    sums = [F.sum(f"f_{rule}").alias(f"f_{rule}") for rule in RULES]
    hosts = measured.groupBy(F.coalesce("host", F.lit("")).alias("host")).agg(F.count(F.lit(1)).alias("n"), *sums)
    rejected = cut(rejected_hosts(cut(hosts)))
    judged = join_hosts(measured.where("row IS NOT NULL").select("row"), F.col("row.source"), rejected)
    return judged.where("host_rule IS NULL").select("row.*")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("n_lines", "host_rule")


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid, coalesce(source, '') AS host, coalesce(text, '') AS t,
         chr(9) || chr(10) || chr(11) || chr(12) || chr(13) AS ws FROM documents
), w AS (
  SELECT doc_id, rid, host, [x FOR x IN string_split(translate(t, ws, '     '), ' ') IF x <> ''] AS words,
         [x FOR x IN string_split(t, chr(10)) IF translate(x, ws || ' ', '') <> ''] AS lines,
         length(translate(t, ws || ' ', '')) AS word_chars, length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols
  FROM d
), u AS (SELECT rid, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM w),
g AS (
  SELECT rid, i, string_agg(word, ' ') OVER win AS k FROM u
  WINDOW win AS (PARTITION BY rid ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)
  QUALIFY count(*) OVER win = 8
), r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM g) WHERE c > 1),
c AS (SELECT rid, sum(step) AS n FROM (SELECT rid, least(8, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i) - i, 8)) AS step FROM r) GROUP BY rid),
m AS (
  SELECT doc_id, host, CAST(len(words) AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
         len(lines) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN c USING (rid)
), f AS (
  SELECT *, [n_words < 20, 100 * n_repeat_words > 30 * n_words, 100 * n_symbols > 100 * n_words, 100 * n_dup_lines > 30 * n_lines,
             word_chars < 2 * n_words OR word_chars > 15 * n_words] AS fails FROM m
), h AS (SELECT host, rule, count(*) AS n, sum(CASE WHEN fails[rule] THEN 1 ELSE 0 END) AS k FROM f, range(1, 6) x(rule) GROUP BY host, rule),
p0 AS (SELECT rule, sum(n) AS n, sum(k) AS s, sum(n * (k / n) * (k / n)) AS q FROM h GROUP BY rule),
p1 AS (SELECT rule, (s + 0.5::DOUBLE) / (n + 1) AS mean, q / n - (s / n) * (s / n) AS spread FROM p0),
p AS (SELECT rule, mean, CASE WHEN spread > 0 THEN least(1000, greatest(2, mean * (1 - mean) / spread - 1)) ELSE 1000 END AS strength FROM p1),
post AS (SELECT host, (k + mean * strength) / (n + strength) AS e, n + strength + 1 AS total FROM h JOIN p USING (rule)),
bad AS (SELECT DISTINCT host FROM post WHERE e - 2 * sqrt(e * (1 - e) / total) > 0.5)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fails[1] OR fails[2] AS base_failed,
       NOT (fails[1] OR fails[2]) AND host NOT IN (SELECT host FROM bad) AS kept
FROM f
"""
