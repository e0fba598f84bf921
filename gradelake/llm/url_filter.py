"""URL filter: host and path rules, and listed canonical URLs by a blocked Bloom filter before an exact hash join.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: then up to ``?``, ``#`` or the end; null or no ``://``: both
empty. A rule (host and path) fits its host and all subdomains if the URL's path starts with the rule's; the longest fitting rule wins and
decides. Other URLs are blocked if their canonical form (host and path without a trailing slash) is listed, and allowed otherwise.

The list becomes a blocked Bloom filter: a key has all its bits in one block of 8 longs, so a probe is one lookup. It grows with the list up to
MAX_BLOCKS blocks (64 bytes each, 32 MB) and is broadcast. That holds 16 million keys at KEYS_PER_BLOCK; a longer list fills it further (at 64
million keys about a quarter of the other URLs pass), which lets more URLs pass to the exact join, and never changes a verdict. Only URLs that pass are joined, by hash, with the distinct listed ones; Spark splits a skewed side of that join.

Rows: a null URL has an empty host and path, fits no rule, and is allowed unless the empty URL is listed. Listed nulls are ignored. Repeated rows
are judged alike. Rules of one length that fit the same URL are told apart by their text. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradelake.llm.shared import cut

MAX_BLOCKS, KEYS_PER_BLOCK, WORDS, PROBES = 1 << 19, 32, 8, 4
A_Z, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")), A_Z, LOW)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    return F.concat(host, F.regexp_replace(path, r"/\z", ""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """The rule that decides and its verdict, null without one."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        own, slash, rest = rule.partition("/")
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(slash + rest)
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, what).otherwise(verdict)
    return name, verdict


def bloom(keys: DataFrame, key: str) -> tuple[DataFrame, int]:
    """(block, w0 .. w7) of a blocked Bloom filter of the distinct keys, and its number of blocks."""
    count, blocks = keys.count(), 1
    while blocks * KEYS_PER_BLOCK < count and blocks < MAX_BLOCKS:
        blocks *= 2
    words = [F.bit_or(w).alias(f"w{i}") for i, w in enumerate(masks(F.col(key)))]
    return cut(keys.groupBy(block_of(F.col(key), blocks).alias("block")).agg(*words)), blocks


def block_of(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def masks(key: Column) -> list[Column]:
    """The bits of a key in each of a block's longs: PROBES of 512, from a second hash."""
    h = F.xxhash64(key, F.lit(1))
    bit = [F.shiftrightunsigned(h, 9 * p).bitwiseAND(F.lit(511)) for p in range(PROBES)]
    out = []
    for w in range(WORDS):
        word = F.lit(0).cast("long")
        for b in bit:
            word = word.bitwiseOR(F.when(F.shiftright(b, 6) == w, _bit(b)).otherwise(F.lit(0).cast("long")))
        out.append(word)
    return out


def _bit(b: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), b.bitwiseAND(F.lit(63)).cast("int"))


def passes(key: Column) -> Column:
    """Whether a row that was joined with its block, if there is one, passes the filter."""
    hit = F.lit(True)
    for i, m in enumerate(masks(key)):
        hit = hit & (F.coalesce(F.col(f"w{i}"), F.lit(0)).bitwiseAND(m) == m)
    return hit


def filter_urls(pages: DataFrame, listed: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict of every page; ``listed`` has canonical URLs in column key."""
    listed = cut(listed.where("key IS NOT NULL").select("key").distinct())
    filled, blocks = bloom(listed, "key")
    base = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    base = base.withColumns({"rule": name, "ruled": verdict, "key": canonical(F.col("host"), F.col("path"))})
    probe = base.withColumn("block", block_of(F.col("key"), blocks)).join(F.broadcast(filled), "block", "left")
    probe = probe.withColumn("maybe", F.col("ruled").isNull() & passes(F.col("key")))
    out = ["page_id", "host", "path", "rule"]
    passed = probe.where("maybe").select(*out, "key").join(listed.withColumn("found", F.lit(True)), "key", "left").select(*out, F.when(F.col("found"), "block").otherwise("allow").alias("verdict"))
    return probe.where("NOT maybe").select(*out, F.coalesce("ruled", F.lit("allow")).alias("verdict")).union(passed)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list of this query: canonical URLs that the crawl holds more than once."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    key = canonical(host_of(F.col("url")), path_of(F.col("url")))
    listed = pages.where("url IS NOT NULL").groupBy(key.alias("key")).count().where("count > 1").select("key")
    return filter_urls(pages, listed)


OP8_SQL = r"""
WITH parsed AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)\A.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)\A.*?://[^/?#]*([^?#]*)', 1), '') AS path, url
  FROM pages
), keyed AS (
  SELECT *, host || regexp_replace(path, '/\z', '') AS key,
    CASE WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
         WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
         WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
         WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM parsed
), listed AS (SELECT key FROM keyed WHERE url IS NOT NULL GROUP BY key HAVING count(*) > 1)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN key IN (SELECT key FROM listed) THEN 'block' ELSE 'allow' END AS verdict
FROM keyed
"""
