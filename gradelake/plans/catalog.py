"""Registered queries over the driver's tables, each with its SQL where DuckDB can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradelake.config import PROTOCOL
from gradelake.functions import native as N
from gradelake.operators import constraints as C
from gradelake.operators import integrity as I
from gradelake.operators import ordering as O

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
SEED, ROWS = "ab" * 32, 120
DOMAIN = PROTOCOL.domain


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


_CLASS = "CASE " + " ".join(f"WHEN regexp_matches(lower({{0}}), '{pattern}') THEN '{name}'" for name, pattern in N.SUSPICIOUS) + " END"
_PRINT = r"sha256(lower(regexp_replace(regexp_replace({0}, '[\s\x{{1c}}-\x{{1f}}\x{{85}}\pZ]+', ' ', 'g'), '^ +| +$', '', 'g')))"
_RANK = f"sha256('{DOMAIN}' || chr(0) || '{SEED}' || chr(0) || {{0}} || chr(0) || {{1}})"
_BUDGET = "[1024, 2048, 4096, 8192, 16384][CAST(1 + list_sum([CAST('0x' || c AS INTEGER) FOR c IN string_split({0}, '')]) % 5 AS BIGINT)]"
_QUOTA = """b AS (SELECT name, size * {0} // sum(size) OVER () AS base, size * {0} % sum(size) OVER () AS rest FROM sizes),
quota AS (SELECT name, CAST(base + CASE WHEN row_number() OVER (ORDER BY rest DESC, name) <= {0} - sum(base) OVER () THEN 1 ELSE 0 END AS BIGINT) AS quota FROM b)"""


@query(f"WITH sizes AS (SELECT source AS name, count(*) AS size FROM documents GROUP BY source), {_QUOTA.format(ROWS)} SELECT name, quota FROM quota")
def quota_largest_remainder(spark, sf_dir):
    return O.quotas(docs(spark, sf_dir).groupBy(F.col("source").alias("name")).agg(F.count(F.lit(1)).alias("size")), ROWS)


@query(f"SELECT 'documents' AS tab, {_CLASS.format('text')} AS class, count(*) AS n FROM documents GROUP BY ALL UNION ALL SELECT 'pages', {_CLASS.format('html')}, count(*) FROM pages GROUP BY ALL")
def suspicious_prompt_class(spark, sf_dir):
    one = docs(spark, sf_dir).select(F.lit("documents").alias("tab"), N.suspicious(F.col("text")).alias("class"))
    two = table(spark, sf_dir, "pages").select(F.lit("pages").alias("tab"), N.suspicious(F.col("html")).alias("class"))
    return one.union(two).groupBy("tab", "class").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id FROM documents WHERE length(text) BETWEEN 1 AND 32768")
def length_filter(spark, sf_dir):
    return docs(spark, sf_dir).where(F.length("text").between(1, PROTOCOL.max_prompt)).select("doc_id")


@query(f"SELECT {_PRINT.format('text')} AS fp, min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1")
def fingerprint_dedupe(spark, sf_dir):
    return docs(spark, sf_dir).where("text IS NOT NULL").groupBy(N.fingerprint(F.col("text")).alias("fp")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


@query(f"SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {_RANK.format('source', 'doc_id')}, doc_id) AS n FROM documents) WHERE n <= 5")
def seeded_topk_per_source(spark, sf_dir):
    ranked = docs(spark, sf_dir).select("doc_id", "source", N.keyed_rank(SEED, F.col("source"), F.col("doc_id")).alias("r"))
    five = ranked.groupBy("source").agg(F.lit(5).cast("long").alias("quota"))
    return O.top_by_rank(ranked, "source", "r", "doc_id", five).select("doc_id", "source")


@query(f"SELECT doc_id, row_number() OVER (ORDER BY {_RANK.format(repr('order'), 'doc_id')}, doc_id) - 1 AS pos FROM documents")
def global_hash_order(spark, sf_dir):
    ranked = docs(spark, sf_dir).select("doc_id", N.keyed_rank(SEED, "order", F.col("doc_id")).alias("r"))
    return O.position(ranked, "r", "doc_id").select("doc_id", "pos")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts that pass the filters, one of each fingerprint."""
    good = docs(spark, sf_dir).where(F.length("text").between(1, PROTOCOL.max_prompt)).where(N.suspicious(F.col("text")).isNull())
    return good.groupBy(N.fingerprint(F.col("text")).alias("fp")).agg(F.min_by(F.struct("doc_id", "source", "lang"), "doc_id").alias("d")).select("d.*")


@query(
    f"""WITH good AS (SELECT doc_id, source, lang, {_PRINT.format("text")} AS fp FROM documents WHERE length(text) BETWEEN 1 AND 32768 AND {_CLASS.format("text")} IS NULL),
one AS (SELECT * FROM good QUALIFY row_number() OVER (PARTITION BY fp ORDER BY doc_id) = 1),
sizes AS (SELECT source AS name, count(*) AS size FROM one GROUP BY source), {_QUOTA.format(ROWS)},
picked AS (SELECT doc_id, source, lang FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {_RANK.format("source", "doc_id")}, doc_id) AS n FROM one) o JOIN quota ON name = source WHERE n <= quota)
SELECT doc_id, source, lang, {_BUDGET.format(_RANK.format(repr("reasoning_budget"), "doc_id"))} AS budget,
       row_number() OVER (ORDER BY {_RANK.format(repr("order"), "doc_id")}, doc_id) - 1 AS pos FROM picked"""
)
def evaluation_window(spark, sf_dir):
    """Filters, de-duplication, proportional quotas, keyed top-k by source, budgets and the global order. The result is bounded by ROWS."""
    one = O.settle(candidates(spark, sf_dir))
    quota = O.quotas(one.groupBy(F.col("source").alias("name")).agg(F.count(F.lit(1)).alias("size")), ROWS)
    ranked = one.withColumn("r", N.keyed_rank(SEED, F.col("source"), F.col("doc_id")))
    picked = O.top_by_rank(ranked, "source", "r", "doc_id", quota.withColumnRenamed("name", "source"))
    order = picked.select("doc_id", "source", "lang", N.budget(SEED, F.col("doc_id")).alias("budget"), N.keyed_rank(SEED, "order", F.col("doc_id")).alias("o"))
    return O.position(order, "o", "doc_id").drop("o")


@query(f"SELECT doc_id, {_BUDGET.format(_RANK.format(repr('reasoning_budget'), 'doc_id'))} AS budget FROM documents")
def reasoning_budget(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", N.budget(SEED, F.col("doc_id")).alias("budget"))


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY GROUPING SETS ((lang), (source))")
def window_histograms(spark, sf_dir):
    d = docs(spark, sf_dir).select("lang", "source")
    return d.groupingSets([[d.lang], [d.source]], d.lang, d.source).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH b AS (SELECT doc_id, {_BUDGET.format(_RANK.format(repr('reasoning_budget'), 'doc_id'))} AS level FROM documents)
SELECT doc_id, level, CAST((level * 9000 + 9999) // 10000 AS INTEGER) AS low, CAST(level * 11000 // 10000 AS INTEGER) AS high FROM b""")
def budget_bounds(spark, sf_dir):
    """Documents as rows: each one's reasoning level and its inclusive bounds."""
    level = N.budget(SEED, F.col("doc_id"))
    low, high = N.budget_bounds(F.col("level"))
    return docs(spark, sf_dir).select("doc_id", level.alias("level")).select("doc_id", "level", low.alias("low"), high.alias("high"))


@query("SELECT o_orderkey // 3600 AS win, count(*) AS n, count(*) FILTER (WHERE o_orderkey < 7200) AS before_2 FROM orders GROUP BY 1")
def block_window(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("block"))
    return o.groupBy(N.window_of(F.col("block")).alias("win")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("block") < 2 * PROTOCOL.window_blocks).alias("before_2"))


def audit_round(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """Correct rows by keyed rank, 32 a round; rounds are disjoint because a later one anti-joins the earlier."""
    pool = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id", N.keyed_rank(SEED, "audit", F.col("doc_id")).alias("r"))
    done = None
    for _ in range(n):
        part = pool if done is None else pool.join(done, "doc_id", "left_anti")
        now = part.orderBy("r", "doc_id").limit(PROTOCOL.audit_rows).select("doc_id")
        done = now if done is None else done.union(now)
    return now


_AUDIT = f"SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY {_RANK.format(repr('audit'), 'doc_id')}, doc_id) AS n FROM labels WHERE quality = 1) WHERE n "


@query(_AUDIT + "<= 32")
def audit_sample_round1(spark, sf_dir):
    return audit_round(spark, sf_dir, 1)


@query(_AUDIT + "BETWEEN 33 AND 64")
def audit_sample_round2(spark, sf_dir):
    return audit_round(spark, sf_dir, 2)


@query("SELECT round(avg(quality - toxic), 9) AS delta, round(avg(quality - toxic) - 2.3263 * sqrt(var_samp(quality - toxic) / count(*)), 9) AS bound FROM labels")
def paired_lcb(spark, sf_dir):
    delta, bound = I.paired_bound(F.col("quality") - F.col("toxic"), 2.3263)
    return table(spark, sf_dir, "labels").agg(F.round(delta, 9).alias("delta"), F.round(bound, 9).alias("bound"))


@query("SELECT conv_id, count(*) FILTER (WHERE role = 'user') AS \"user\", count(*) FILTER (WHERE role = 'assistant') AS assistant, count(*) FILTER (WHERE role = 'system') AS system FROM conversations GROUP BY conv_id")
def validator_pivot(spark, sf_dir):
    p = table(spark, sf_dir, "conversations").groupBy("conv_id").pivot("role", ["user", "assistant", "system"]).agg(F.count(F.lit(1)))
    return p.na.fill(0)


@query("SELECT event_id, count(*) OVER w AS rounds, max(value) OVER w AS best FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def audit_progress_cumulative(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "events").select("event_id", F.count(F.lit(1)).over(w).alias("rounds"), F.max("value").over(w).alias("best"))


#: Levels of the tree as lists of hex digests, each from the one below; leaves are digests of the rows' JSON.
_ROOT = """WITH RECURSIVE d AS (SELECT doc_id, sha256('{"doc_id":' || doc_id || coalesce(',"lang":' || to_json(lang), '') || coalesce(',"source":' || to_json(source), '') || coalesce(',"text":' || to_json(text), '') || '}') AS h FROM documents),
t AS (SELECT list(sha256('leaf:' || h) ORDER BY doc_id, h) AS level, count(*) AS rows FROM d
 UNION ALL SELECT [sha256('node:'::BLOB || unhex(level[2 * i + 1]) || unhex(coalesce(level[2 * i + 2], level[2 * i + 1]))) FOR i IN range((len(level) + 1) // 2)], rows FROM t WHERE len(level) > 1)
SELECT level[1] AS root, rows FROM t WHERE len(level) = 1"""


@query(_ROOT)
def merkle_root(spark, sf_dir):
    """The root over documents in doc_id order (equal ids by digest), a digest of the whole row a leaf; held against a plain tree in the tests."""
    d = docs(spark, sf_dir)
    digest = F.sha2(F.to_json(F.struct("doc_id", "lang", "source", "text")), 256)
    rows = O.settle(O.position(d.select("doc_id", digest.alias("digest")), "doc_id", "digest"))
    root = I.merkle_root(rows, "pos", F.col("digest"))
    return spark.range(1).select(F.lit(root).alias("root"), F.lit(rows.count()).cast("long").alias("rows"))


_CHANCE = """CASE WHEN forged = 0 OR samples = 0 THEN 0 WHEN samples > population - forged THEN 1
 ELSE 1 - exp(list_sum([ln(population - forged - i) - ln(population - i) FOR i IN range(samples)])) END"""


@query(f"""WITH g AS (SELECT o_custkey, count(*) AS population, count(*) FILTER (o_orderstatus = 'F') AS forged, least(count(*), 1 + o_custkey % 9) AS samples FROM orders GROUP BY o_custkey)
SELECT o_custkey, round({_CHANCE}, 8) AS p FROM g""")
def detection_probability(spark, sf_dir):
    """Customers as bundles of their orders, some of them forged: the chance that a sample meets a forged one."""
    counts = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("population"), F.count_if(F.col("o_orderstatus") == "F").alias("forged"))
    samples = F.least(F.col("population"), 1 + F.col("o_custkey") % 9)
    return counts.select("o_custkey", F.round(N.detection_probability(F.col("population"), F.col("forged"), samples), 8).alias("p"))


@query("SELECT event_id, CAST(least(150, 5 * pow(2, least(event_id % 12, 5))) AS INTEGER) AS blocks FROM events")
def retry_backoff(spark, sf_dir):
    """Events as failed attempts, the first to the twelfth: blocks until the next one."""
    return table(spark, sf_dir, "events").select("event_id", N.retry_delay(F.col("event_id") % 12 + 1).cast("int").alias("blocks"))


_W = r"regexp_extract_all(text, '[A-Za-z0-9]+(?:''[A-Za-z0-9]+)?')"


#: Arguments of every instruction constraint; counts are read as relations.
ARGUMENTS = {
    "forbidden_words": '["password", "token"]', "keywords": '["the", "on"]', "keyword": "the", "frequency": "3", "relation": "at least", "N": "40", "num_words": "40", "num_paragraphs": "1", "num_sentences": "3", "nth_paragraph": "1",
    "last_word": "the", "first_word": "the", "end_phrase": ".", "postscript_marker": "P.S.", "letter": "e", "let_frequency": "9", "let_relation": "more than", "num_bullets": "1", "num_highlights": "1", "num_placeholders": "1", "num_letters": "200",
}


@query()
def instruction_constraints(spark, sf_dir):
    """All 30 instruction constraints over documents; constraint_predicates keeps the columns of its SQL. Tests hold some against plain Python."""
    args = F.create_map(*[F.lit(x) for pair in ARGUMENTS.items() for x in pair])
    return C.all_predicates(docs(spark, sf_dir), "text", args, ["doc_id"])


@query("SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value > 0) AS valid, count(DISTINCT user_id) AS hotkeys, max(value) AS best FROM events GROUP BY event_type")
def status_counts(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 0).alias("valid"), F.count_distinct("user_id").alias("hotkeys"), F.max("value").alias("best"))


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, count(*) AS n FROM lineitem GROUP BY ALL")
def lineitem_summary(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.count(F.lit(1)).alias("n"))


from gradelake.plans import protocol  # noqa: E402, F401 (registers its queries)
