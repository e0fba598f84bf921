import re

import duckdb
from pyspark.sql import functions as F

from gradelake.llm import url_filter as U

SF = "/root/testdata/sf0.01"


def brute(url, listed, rules=U.RULES):
    rest = (url or "").split("://", 1)
    host = path = ""
    if len(rest) == 2:
        host, path = re.match(r"([^/?#]*)([^?#]*)", rest[1], re.S).groups()
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    best = None
    for what, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        h, s, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith(s + p):
            best = (rule, what)
    key = host + (path[:-1] if path.endswith("/") else path)
    return host, path, best and best[0], best[1] if best else "block" if key in listed else "allow"


URLS = [None, "", "no scheme", "http://", "http://NET/", "http://net", "https://a.example.net/en/1?x#y", "http://a.example.net/en", "http://éX.org/fr/", "http://x.org?fr/", "http://a.com/x/", "http://a.com/x", "a://b://c/d", "http://notexample.com/de/", "http://example.com/de/#", "http://a.com/l\ni", "http://q.com/" + "z" * 100_000]


def test_brute_force(spark):
    listed = ["a.com/x", None, "a.com/x", "b://c/d", "q.com/zz", ""]
    df = spark.createDataFrame([(i, u, "r") for i, u in enumerate(URLS * 2)], "page_id long, url string, rule string")
    for keys in (listed, [], ["nowhere"] + [f"k{i}" for i in range(5000)]):
        known = spark.createDataFrame([(k,) for k in keys], "key string")
        got = {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in U.filter_urls(df, known).collect()}
        assert got == {i: brute(u, set(keys) - {None}) for i, u in enumerate(URLS * 2)}
        assert U.filter_urls(df.limit(0), known).count() == 0


def test_filter_passes_all_listed_and_few_others(spark):
    keys = spark.range(20_000).select(F.concat(F.lit("h/"), F.col("id")).alias("key"))
    filled, blocks = U.bloom(keys, "key")
    both = spark.range(40_000).select(F.concat(F.lit("h/"), F.col("id")).alias("key"), (F.col("id") < 20_000).alias("in"))
    hit = F.lit(True)
    for i, m in enumerate(U.masks(F.col("key"))):
        hit = hit & (F.coalesce(F.col(f"w{i}"), F.lit(0)).bitwiseAND(m) == m)
    rows = dict(both.withColumn("block", U.block_of(F.col("key"), blocks)).join(filled, "block", "left").groupBy("in").agg(F.avg(hit.cast("int"))).collect())
    assert rows[True] == 1 and rows[False] < 0.05


def test_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    assert sorted(map(tuple, U.op8_url_filter(spark, SF).collect()), key=str) == sorted(con.execute(U.OP8_SQL).fetchall(), key=str)
