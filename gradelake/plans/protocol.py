"""Registered queries of grading, audits, promotion and the evaluation window; each calls its operator, and its SQL states the same from scratch."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradelake.config import PROTOCOL
from gradelake.functions import native as N
from gradelake.functions.answers import rational_udf
from gradelake.operators import constraints as C
from gradelake.operators import grading as G
from gradelake.operators import integrity as I
from gradelake.operators import normalize as R
from gradelake.operators import ordering as O
from gradelake.operators import promotion as P
from gradelake.operators import window as W
from gradelake.plans.catalog import _BUDGET, _CLASS, _PRINT, _RANK, ARGUMENTS, DOMAIN, SEED, docs, query, table
from gradelake.sources.vocabulary import Vocabulary
from gradelake.streaming import audits as A
from gradelake.streaming import cycle as Y
from gradelake.streaming import rounds as S

# ---- commitments and priorities


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as commitments: every seventh customer is not registered."""
    uid = F.when(F.col("o_custkey") % 7 != 0, F.col("o_custkey").cast("int"))
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("hotkey"), uid.alias("uid"), F.col("o_orderkey").alias("commit_block"), F.concat("o_orderstatus", "o_orderpriority", F.floor(F.col("o_totalprice") / 1000).cast("string")).alias("digest"))


_ORDERS = """o AS (SELECT CAST(o_custkey AS VARCHAR) AS hotkey, CASE WHEN o_custkey % 7 <> 0 THEN CAST(o_custkey AS INTEGER) END AS uid, o_orderkey AS commit_block,
 o_orderstatus || o_orderpriority || CAST(CAST(floor(o_totalprice / 1000) AS BIGINT) AS VARCHAR) AS digest FROM orders)"""


@query(f"WITH {_ORDERS} SELECT hotkey, uid, commit_block, digest FROM o WHERE uid IS NOT NULL AND commit_block < 7200 QUALIFY row_number() OVER (PARTITION BY hotkey ORDER BY commit_block DESC, sha256(digest)) = 1")
def latest_commitment(spark, sf_dir):
    return P.latest_commitments(orders(spark, sf_dir), 2)


@query(f"WITH {_ORDERS} SELECT commit_block, hotkey, digest, nullif(first_value(hotkey) OVER (PARTITION BY digest ORDER BY commit_block, hotkey), hotkey) AS copy_of FROM o")
def copy_filter_first_committer(spark, sf_dir):
    return P.copies(orders(spark, sf_dir)).select("commit_block", "hotkey", "digest", "copy_of")


@query("SELECT (l_orderkey // 3600) || ':' || l_partkey AS key, min(l_orderkey) AS block, arg_min(CAST(l_suppkey AS VARCHAR), (l_orderkey, CAST(l_suppkey AS VARCHAR))) AS hotkey FROM lineitem GROUP BY 1")
def rollout_priority(spark, sf_dir):
    item = table(spark, sf_dir, "lineitem")
    key = F.concat(N.window_of(F.col("l_orderkey")).cast("string"), F.lit(":"), F.col("l_partkey").cast("string"))
    return S.priority(None, item.select(key.alias("key"), F.col("l_orderkey").alias("block"), F.col("l_suppkey").cast("string").alias("hotkey")))


# ---- verifiers


def graded(df: DataFrame, keys: list[str], response: Column, expected: Column, verifier: str | None) -> DataFrame:
    rows = df.select(*keys, response.alias("response"), expected.alias("expected"), F.lit(verifier).cast("string").alias("verifier"))
    return G.grade(rows).select(*keys, "reward")


@query(r"""WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 5 = 1 THEN 'no number' ELSE 'the total is ' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) END AS response,
 CAST(CAST(floor(o_totalprice) AS BIGINT) + o_orderkey % 2 AS VARCHAR) AS e FROM orders),
n AS (SELECT *, TRY_CAST(nullif(regexp_extract(response, '-?\d+(?:\.\d+)?'), '') AS DOUBLE) AS a, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(e AS DOUBLE) END AS b FROM r)
SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 1 AND b IS NOT NULL THEN CASE WHEN abs(a - b) <= greatest(1e-6 * greatest(abs(a), abs(b)), 1e-6) THEN 1 ELSE 0 END
 WHEN o_orderkey % 3 = 0 AND o_orderkey % 5 = 1 THEN 1 WHEN o_orderkey % 3 = 0 AND o_orderkey % 5 = 0 THEN 0 ELSE 0 END AS reward FROM n""")
def grade_numeric(spark, sf_dir):
    """Numbers against the first numeric expected value; null responses, and texts where either side has no number."""
    o = table(spark, sf_dir, "orders")
    five, three = F.col("o_orderkey") % 5, F.col("o_orderkey") % 3
    response = F.when(five == 0, F.lit(None)).when(five == 1, "no number").otherwise(F.concat(F.lit("the total is "), F.floor("o_totalprice").cast("string")))
    expected = F.when(three == 0, F.array(F.lit("No  Number"))).otherwise(F.array(F.lit("x"), (F.floor("o_totalprice") + F.col("o_orderkey") % 2).cast("string")))
    return graded(o, ["o_orderkey"], response, expected, None)


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 0 WHEN c_custkey % 3 = 0 THEN CAST(c_mktsegment = 'BUILDING' AS INTEGER) ELSE 1 END AS reward FROM customer")
def grade_label(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    response = F.when(F.col("c_custkey") % 5 == 0, "other").otherwise(F.concat(F.lit(" \t"), F.upper("c_mktsegment"), F.lit("\n")))
    expected = F.array(F.lit(None).cast("string"), F.when(F.col("c_custkey") % 3 == 0, "Building").otherwise(F.col("c_mktsegment")))
    return graded(c, ["c_custkey"], response, expected, "label_match")


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN 0 WHEN p_size % 10 IN (0, 1, 2) THEN 1 ELSE 0 END AS reward FROM part")
def grade_mcqa(spark, sf_dir):
    letter, form = F.char(F.lit(65) + F.col("p_size") % 10), F.col("p_partkey") % 4
    response = F.when(form == 0, F.concat(F.lit("I think the answer is (Z). Answer: ("), letter, F.lit(")"))).when(form == 1, F.concat(F.lit("so \\boxed{"), F.lower(letter), F.lit("}"))).when(form == 2, F.concat(F.lit(" ("), letter, F.lit(") "))).otherwise("the answer is complicated")
    return graded(table(spark, sf_dir, "part"), ["p_partkey"], response, F.array(F.lit(" a"), F.lit("B"), F.lit("C"), F.lit(None).cast("string")), "mcqa_letter")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 6 THEN 0 WHEN l_linenumber = 7 THEN CASE WHEN l_quantity = 7 THEN 1 ELSE 0 END
 ELSE CASE WHEN CAST(l_quantity AS BIGINT) % 3 = 0 THEN 0 ELSE 1 END END AS reward FROM lineitem""")
def grade_math_exact(spark, sf_dir):
    """Boxes, tags, markers, wrappers, refusals; the expected value is written in another way, or is another one."""
    q, n = F.col("l_quantity").cast("long").cast("string"), F.col("l_linenumber")
    say = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    response = F.when(n == 1, say("we get \\boxed{1} then \\boxed{ $", q, "$ }.")).when(n == 2, say("<answer>0</answer> <ANSWER> ", q, "\n</answer> \\boxed{9999}")).when(n == 3, say("so the final answer is  \\( ", q, " \\)"))
    response = response.when(n == 4, say("FINAL: \\displaystyle ", q)).when(n == 5, say("\\boxed{", q, " } and \\boxed{open")).when(n == 6, F.lit("not found")).otherwise("7")
    other = F.col("l_quantity").cast("long") % 3 == 0
    expected = F.array(F.lit("none"), F.when((n < 6) & other, say(q, "9")).otherwise(say("\\[ ", q, " \\]")))
    return graded(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], response, expected, "math_exact")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber IN (1, 2, 5) AND l_returnflag <> 'N' THEN 1 ELSE 0 END AS reward FROM lineitem")
def grade_json_output(spark, sf_dir):
    """Objects that end the text, also before a closing fence on a line of its own; text behind, a fence on the same line, more keys and other kinds fail."""
    n, flag = F.col("l_linenumber"), F.col("l_returnflag")
    plain = F.concat(F.lit('result {x} {"output": "'), flag, F.lit('"}'))
    forms = {1: plain, 2: F.concat(F.lit("```json\n"), plain, F.lit("\n ``` ")), 3: F.concat(plain, F.lit("```")), 4: F.concat(plain, F.lit(" and more")), 5: F.concat(F.lit('{"output": "Z"} '), plain), 6: F.concat(F.lit('{"output": "'), flag, F.lit('", "b": 1}'))}
    response = F.lit('{"output": 1}')
    for k, form in forms.items():
        response = F.when(n == k, form).otherwise(response)
    return graded(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], response, F.array(F.lit("A"), F.lit("R")), "json_output_exact")


#: Some constraints with SQL: a name, the arguments that differ from ARGUMENTS, and a predicate over the text t and its words w.
_SOME = {
    "punctuation:no_comma": "t NOT LIKE '%,%'", "punctuation:punctuation_dot": "t NOT LIKE '%.%'", "punctuation:punctuation_exclamation": "t NOT LIKE '%!%'",
    "detectable_format:title": "regexp_matches(t, '<<[^<>]+>>')", "detectable_content:number_placeholders": r"len(regexp_extract_all(t, '\[[^\[\]]+\]')) >= 1",
    "change_case:english_capital": "regexp_matches(t, '[A-Z]') AND NOT regexp_matches(t, '[a-z]')", "change_case:english_lowercase": "regexp_matches(t, '[a-z]') AND NOT regexp_matches(t, '[A-Z]')",
    "letters:letter_counting": r"len(regexp_extract_all(t, '\p{L}')) >= 40", "letters:letter_counting2": "length(t) - length(replace(lower(t), 'e', '')) > 9",
    "count:count_unique": "len(w) > 0 AND len(w) = len(list_distinct([lower(x) FOR x IN w]))", "length_constraints:number_words": "len(w) >= 40",
    "last_word:last_word_answer": "coalesce(lower(w[-1]), '') = 'the'", "first_word:first_word_answer": "coalesce(lower(w[1]), '') = 'the'",
    "keywords:forbidden_words": "NOT regexp_matches(lower(t), 'password|token')", "startend:end_checker": r"regexp_matches(t, '\.[\s\x{1c}-\x{1f}\x{85}\pZ]*$')",
    "paragraphs:paragraphs2": "len([x FOR x IN string_split(t, chr(10) || chr(10)) IF regexp_matches(x, '[^\\s\\x{1c}-\\x{1f}\\x{85}\\pZ]')]) = 2".replace("\\\\", "\\"),
    "length_constraints:number_sentences": r"len([x FOR x IN regexp_split_to_array(t, '[.!?]+') IF regexp_matches(x, '[^\s\x{1c}-\x{1f}\x{85}\pZ]')]) >= 3",
}


@query("SELECT doc_id, coalesce(k, false) AS keywords_existence, " + ", ".join(f"coalesce({sql}, false) AS {name.replace(':', '_')}" for name, sql in _SOME.items()) + rf""" FROM (SELECT doc_id, text AS t, false AS k, regexp_extract_all(text, '[A-Za-z0-9]+(?:''[A-Za-z0-9]+)?') AS w FROM documents)""")
def constraint_predicates(spark, sf_dir):
    """The library's predicates that SQL can state; existence has an empty list of keywords here, which fails."""
    args = F.create_map(*[F.lit(x) for pair in (ARGUMENTS | {"keywords": "[]"}).items() for x in pair])
    found = C.all_predicates(docs(spark, sf_dir), "text", args, ["doc_id"])
    return found.select("doc_id", *[name.replace(":", "_") for name in ("keywords:existence", *_SOME)])


@query("""SELECT doc_id, CASE WHEN text IS NULL THEN 0 WHEN doc_id % 4 = 0 THEN 0 WHEN doc_id % 4 = 1 THEN CAST(text NOT LIKE '%,%' AS INTEGER) WHEN doc_id % 4 = 2 THEN CAST(text NOT LIKE '%!%' AND regexp_matches(text, '[a-z]') AND NOT regexp_matches(text, '[A-Z]') AS INTEGER) ELSE 0 END AS reward FROM documents""")
def grade_constraints(spark, sf_dir):
    """instruction_constraints by the dispatch: no constraints, one, two, and one that is unknown beside a true one."""
    none = F.create_map().cast("map<string,string>")
    some = lambda *ids: F.array(*[F.struct(F.lit(i).alias("id"), none.alias("kwargs")) for i in ids])
    four = F.col("doc_id") % 4
    given = F.when(four == 1, some("punctuation:no_comma")).when(four == 2, some("punctuation:punctuation_exclamation", "change_case:english_lowercase")).when(four == 3, some("change_case:english_lowercase", "no:such"))
    rows = docs(spark, sf_dir).select("doc_id", F.col("text").alias("response"), F.array().cast("array<string>").alias("expected"), F.lit("instruction_constraints").alias("verifier"), given.alias("constraints"))
    return G.grade(rows).select("doc_id", "reward")


# ---- scores, bits and audits


@query("SELECT lang AS category, count(*) AS n, coalesce(sum(quality) / count(*), 0) AS score FROM labels JOIN documents USING (doc_id) GROUP BY ROLLUP (lang)")
def category_scores(spark, sf_dir):
    joined = table(spark, sf_dir, "labels").join(docs(spark, sf_dir).select("doc_id", F.col("lang").alias("category")), "doc_id")
    return G.category_scores(joined.withColumnRenamed("quality", "reward"))


@query("SELECT doc_id % 3 AS g, row_number() OVER (PARTITION BY doc_id % 3 ORDER BY doc_id) - 1 AS pos, quality AS reward FROM labels")
def reward_bits_roundtrip(spark, sf_dir):
    """Packs three groups' rewards into bits and unpacks them again."""
    labels = table(spark, sf_dir, "labels")
    rows = None
    for g in range(3):
        part = O.position(labels.where(F.col("doc_id") % 3 == g).select("doc_id", F.col("quality").alias("reward")), "doc_id").select(F.lit(g).cast("long").alias("g"), "pos", "reward")
        rows = part if rows is None else rows.union(part)
    packed = I.pack_bits(rows, ["g"], "pos", "reward").join(rows.groupBy("g").agg(F.count(F.lit(1)).alias("rows")), "g")
    return I.unpack_bits(packed, ["g"], "bits", F.col("rows"))


@query("""WITH c AS (SELECT vec_id, unnest(embedding) AS lp, unnest(range(64)) AS token FROM embeddings),
r AS (SELECT *, CASE WHEN vec_id % 3 > 0 AND token % 4 > 0 THEN CAST(token % 5 + 1 AS INTEGER) END AS given FROM c WHERE vec_id % 10 > 0 OR token <> vec_id % 64),
b AS (SELECT vec_id, arg_min(token, (-lp, token)) AS top, max(lp) AS best FROM r GROUP BY vec_id),
o AS (SELECT b.vec_id, coalesce(r.given, CASE WHEN top = b.vec_id % 64 THEN 1 END) AS rank, best - r.lp AS gap FROM b LEFT JOIN r ON r.vec_id = b.vec_id AND r.token = b.vec_id % 64)
SELECT vec_id AS row_id, rank, round(gap::DOUBLE, 5) AS gap, coalesce(rank <= 3 AND gap <= 0.25 + 1e-6, false) AS valid FROM o""")
def token_audit(spark, sf_dir):
    """Given ranks, positions without them, and every tenth position without the submitted token among its candidates."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), F.lit(0).alias("position"), (F.col("vec_id") % 64).cast("int").alias("submitted_token"), F.posexplode("embedding").alias("token_id", "logprob"))
    given = F.when((F.col("row_id") % 3 > 0) & (F.col("token_id") % 4 > 0), (F.col("token_id") % 5 + 1).cast("int"))
    found = G.audit_positions(e.where((F.col("row_id") % 10 > 0) | (F.col("token_id") != F.col("submitted_token"))).withColumn("logprob", F.col("logprob").cast("double")).withColumn("rank", given))
    return found.select("row_id", "rank", F.round("gap", 5).alias("gap"), "valid")


@query("""SELECT doc_id, CASE WHEN coalesce(length(text), 0) = 0 THEN 'no_room_or_empty' WHEN length(text) > 2000 THEN 'too_long' WHEN contains(left(text, length(text) - 1), '.') THEN 'continues_after_stop'
 WHEN length(text) < 2000 AND text NOT LIKE '%.' THEN 'no_terminal' END AS fault FROM documents""")
def rollout_bounds(spark, sf_dir):
    """Documents as code-point rollouts under a limit of 2000 tokens; the full stop is the terminal."""
    tokens = F.transform(F.split("text", ""), F.ascii)
    return docs(spark, sf_dir).select("doc_id", G.rollout_fault(F.when(F.length("text") > 0, tokens), F.lit(0), [46], F.lit(2_000)).alias("fault"))


# ---- promotion


def suppliers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(commitments, results, carried) from suppliers: some are copies, invalid, without a score or a uid, or of another digest than committed."""
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    name, digest = F.col("s_name").alias("hotkey"), F.col("s_nationkey").cast("string")
    commitments = s.select(name, (k % 60).cast("int").alias("uid"), digest.alias("digest"), F.when(k % 11 == 0, "first").alias("copy_of"))
    results = s.where("s_acctbal > 500").select(name, (k % 60).cast("int").alias("uid"), F.when(k % 5 == 0, "other").otherwise(digest).alias("digest"), ((F.col("s_acctbal") - 1_000) / 10_000).alias("score"), F.when(k % 7 != 0, k % 4 != 0).alias("valid"),
                                             F.when(k % 8 == 0, "auditing").when(k % 9 == 0, "blacklisted").alias("audit_status"), (k % 31).cast("int").alias("audit_round"), F.when(k % 16 == 0, "model").alias("copy_kind"), F.when(k % 32 == 0, "x").alias("copy_source"))
    carried = s.where("s_nationkey < 9").select(name, (k % 60).cast("int").alias("uid"), digest.alias("digest"), F.lit(0.5).alias("score"), F.lit(True).alias("valid"), F.lit(True).alias("carryover"), F.lit(4).cast("long").alias("source_window"))
    return commitments, results, carried


_SUPPLIERS = """s AS (SELECT s_suppkey AS k, s_name AS hotkey, CAST(s_suppkey % 60 AS INTEGER) AS uid, CAST(s_nationkey AS VARCHAR) AS digest, (s_acctbal - 1000) / 10000 AS score, s_acctbal, s_nationkey FROM supplier),
res AS (SELECT k, hotkey, uid, CASE WHEN k % 5 = 0 THEN 'other' ELSE digest END AS digest, score, CASE WHEN k % 7 <> 0 THEN k % 4 <> 0 END AS valid, CASE WHEN k % 8 = 0 THEN 'auditing' WHEN k % 9 = 0 THEN 'blacklisted' END AS audit_status FROM s WHERE s_acctbal > 500),
good AS (SELECT * FROM res WHERE valid AND score > 0), old AS (SELECT hotkey, uid, digest, 0.5::DOUBLE AS score FROM s WHERE s_nationkey < 9)"""
_WEIGHTS = """best AS (SELECT s.uid FROM s LEFT JOIN good g USING (hotkey) LEFT JOIN old o USING (hotkey) WHERE s.uid > 0 AND k % 11 <> 0 AND CASE WHEN g.hotkey IS NULL THEN o.digest ELSE g.digest END = s.digest
 ORDER BY CASE WHEN g.hotkey IS NULL THEN o.score ELSE g.score END DESC, s.uid, hotkey LIMIT 1),
weights AS (SELECT 0 AS uid, CASE WHEN count(*) > 0 THEN 0.9::DOUBLE ELSE 1::DOUBLE END AS weight FROM best UNION ALL SELECT uid, 0.1::DOUBLE FROM best)"""


@query(f"WITH {_SUPPLIERS.replace('s_suppkey AS k', 's_suppkey AS k').replace('SELECT k, hotkey, uid, CASE', 'SELECT k AS rk, hotkey, uid, CASE')}, {_WEIGHTS} SELECT uid, weight FROM weights")
def winner_weights(spark, sf_dir):
    return P.winner_weights(*suppliers(spark, sf_dir))


@query(f"""WITH {_SUPPLIERS} SELECT hotkey, CASE WHEN g.hotkey IS NULL THEN o.uid ELSE g.uid END AS uid, CASE WHEN g.hotkey IS NULL THEN o.digest ELSE g.digest END AS digest, CASE WHEN g.hotkey IS NULL THEN o.score ELSE g.score END AS score,
 CASE WHEN g.hotkey IS NULL THEN 4 ELSE 5 END::BIGINT AS source_window, true AS valid, true AS carryover, CASE WHEN g.hotkey IS NULL THEN 'carried' ELSE 'current' END AS origin FROM good g FULL JOIN old o USING (hotkey) WHERE CASE WHEN g.hotkey IS NULL THEN o.uid ELSE g.uid END > 0""")
def carryover_full_outer(spark, sf_dir):
    _, results, carried = suppliers(spark, sf_dir)
    return P.carry_over(results, carried, 5)


_ROWS = f"""WITH {_SUPPLIERS.replace('SELECT k, hotkey, uid, CASE', 'SELECT k AS rk, hotkey, uid, CASE')}, {_WEIGHTS},
rows AS (SELECT hotkey, CASE WHEN r.hotkey IS NULL THEN o.uid ELSE r.uid END AS uid, CASE WHEN r.hotkey IS NULL THEN o.digest ELSE r.digest END AS digest, CASE WHEN r.hotkey IS NULL THEN o.score ELSE r.score END AS score,
 CASE WHEN r.hotkey IS NULL THEN true ELSE coalesce(r.valid, false) END AS valid, r.hotkey IS NULL AS carried, audit_status, rk FROM res r FULL JOIN old o USING (hotkey)),
board AS (SELECT *, coalesce(weight, 0) AS final_weight, CASE WHEN carried THEN 'carried' WHEN NOT valid THEN coalesce(audit_status, 'invalid') WHEN coalesce(weight, 0) > 0 THEN 'rewarded' ELSE 'valid' END AS status FROM rows LEFT JOIN weights USING (uid))"""


@query(f"""{_ROWS} SELECT hotkey, uid, valid, status, score, final_weight, digest,
 CASE WHEN rk % 16 = 0 THEN 'model copy' || CASE WHEN rk % 32 = 0 THEN ' of x' ELSE '' END WHEN status IN ('invalid', 'blacklisted') THEN 'invalid rollout' END AS invalid_reason FROM board""")
def result_rows(spark, sf_dir):
    commitments, results, carried = suppliers(spark, sf_dir)
    rows = P.result_rows(results, carried, P.winner_weights(commitments, results, carried))
    return rows.select("hotkey", "uid", "valid", "status", "score", "final_weight", "digest", "invalid_reason")


@query(f"{_ROWS} SELECT row_number() OVER (ORDER BY final_weight DESC, score DESC, hotkey) AS rank, hotkey, status, score, final_weight FROM board QUALIFY rank <= 50")
def leaderboard_rank(spark, sf_dir):
    """The first fifty of the published rows."""
    commitments, results, carried = suppliers(spark, sf_dir)
    rows = P.result_rows(results, carried, P.winner_weights(commitments, results, carried))
    return P.leaderboard(rows, 50).select("rank", "hotkey", "status", "score", "final_weight")


_NAMES = ["a", "b", "c"]


@query("""WITH v AS (SELECT c_custkey, 'Customer ' || lpad(CAST(c_custkey // 2 AS VARCHAR), 14, '0') AS hotkey, ['a', 'b', 'c'][1 + c_custkey % 3] AS validator, CAST(c_custkey // 2 AS INTEGER) AS uid, floor(abs(c_acctbal)) / 10000 AS score, CASE WHEN c_custkey % 17 = 0 THEN 0.1::DOUBLE ELSE 0::DOUBLE END AS w, c_custkey % 4 > 0 AS valid,
 CASE WHEN c_custkey % 5 = 0 THEN 'auditing' WHEN c_custkey % 5 = 1 THEN 'Retrying' WHEN c_custkey % 5 = 2 THEN 'blacklisted' END AS st, c_custkey % 31 AS n FROM customer),
c AS (SELECT *, CASE WHEN w > 0 THEN 'KING ' || printf('%.4f', score) WHEN valid THEN 'VALID ' || printf('%.4f', score) WHEN st = 'auditing' THEN 'AUDIT ' || n || '/50' WHEN st = 'Retrying' THEN 'RETRY ' || n || '/50' WHEN st = 'blacklisted' THEN 'BLACKLIST' ELSE 'INVALID' END AS cell FROM v),
g AS (SELECT hotkey, min(uid) AS uid, count(*) FILTER (WHERE w > 0) AS k, count(*) FILTER (WHERE valid) AS v, coalesce(avg(score) FILTER (WHERE valid), 0) AS m,
 coalesce(max(cell) FILTER (WHERE validator = 'a'), '-') AS a, coalesce(max(cell) FILTER (WHERE validator = 'b'), '-') AS b, coalesce(max(cell) FILTER (WHERE validator = 'c'), '-') AS c FROM c GROUP BY hotkey)
SELECT row_number() OVER (ORDER BY k DESC, v DESC, m DESC, hotkey) AS rank, left(hotkey, 8) || '...' || right(hotkey, 6) AS miner, uid, a, b, c FROM g""")
def consensus_leaderboard(spark, sf_dir):
    """Customers as views of three validators, of which two know each miner."""
    k = F.col("c_custkey")
    hotkey = F.concat(F.lit("Customer "), F.lpad(N.div(k, 2).cast("string"), 14, "0"))
    state = F.when(k % 5 == 0, "auditing").when(k % 5 == 1, "Retrying").when(k % 5 == 2, "blacklisted")
    views = table(spark, sf_dir, "customer").select(hotkey.alias("hotkey"), F.element_at(F.array(*map(F.lit, _NAMES)), (k % 3 + 1).cast("int")).alias("validator"), N.div(k, 2).cast("int").alias("uid"), (F.floor(F.abs("c_acctbal")) / 10_000).alias("score"),
                                                                       F.when(k % 17 == 0, 0.1).otherwise(0.0).alias("final_weight"), (k % 4 > 0).alias("valid"), state.alias("audit_status"), F.lit(None).cast("string").alias("status"), (k % 31).cast("int").alias("audit_round"), F.lit(0).alias("audit_total_rounds"))
    return P.consensus(views, _NAMES)


_Z = 2.3263478740408408
_ZF = I.familywise_z(_Z, 4)
_VECTORS = """l AS (SELECT doc_id, quality, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM labels),
v AS (SELECT k, pos, CASE WHEN (doc_id * 7 + k) % (k * 3 + 5) = 0 THEN quality ELSE 1 - quality END AS r FROM l, range(5) t(k)), n AS (SELECT count(*) AS n FROM l)"""


def contest(spark: SparkSession, sf_dir: str, king: int) -> tuple[DataFrame, DataFrame, int]:
    """(results, champions, rows): five reward vectors over the labels, the champion holding vector ``king``; a sixth result is invalid, however good."""
    placed = O.position(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    each = placed.select("pos", "doc_id", "quality", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k"))
    rows = each.select("k", "pos", F.when((F.col("doc_id") * 7 + F.col("k")) % (F.col("k") * 3 + 5) == 0, F.col("quality")).otherwise(1 - F.col("quality")).alias("reward"))
    n = placed.count()
    packed = I.pack_bits(rows, ["k"], "pos", "reward").join(rows.groupBy("k").agg(F.avg("reward").alias("score")), "k")
    hotkey = F.concat(F.lit("h"), F.col("k"))
    results = packed.select(hotkey.alias("hotkey"), F.concat(F.lit("d"), F.col("k")).alias("digest"), F.lit(True).alias("valid"), "score", F.lit(n).cast("long").alias("rows"), F.col("bits").alias("reward_bits"), (100 - F.col("k")).cast("long").alias("commit_block"))
    bad = results.where("hotkey = 'h0'").select(F.lit("h9").alias("hotkey"), F.lit("d9").alias("digest"), F.lit(False).alias("valid"), F.lit(1.0).alias("score"), "rows", "reward_bits", "commit_block")
    champions = spark.createDataFrame([(f"h{king}", f"d{king}", 0.4, 0.45, 1, 10, None, None, None)], P.CHAMPION)
    return results.union(bad), champions, n


@query(f"""WITH {_VECTORS}, d AS (SELECT a.k, avg(a.r - b.r) AS delta, avg(a.r - b.r) - {_ZF!r} * sqrt(var_samp(a.r - b.r) / count(*)) AS bound FROM v a JOIN v b ON b.pos = a.pos AND b.k = 4 WHERE a.k <> 4 GROUP BY a.k),
best AS (SELECT * FROM d ORDER BY bound DESC, delta DESC, k DESC LIMIT 1)
SELECT bound >= 0.01 AS promoted, CASE WHEN bound >= 0.01 THEN 'clear paired improvement' ELSE 'improvement below paired confidence threshold' END AS reason, 4::BIGINT AS comparisons, CASE WHEN bound >= 0.01 THEN 'h' || k END AS hotkey, round(delta, 9) AS delta, round(bound, 9) AS bound FROM best""")
def champion_decision(spark, sf_dir):
    """Four challengers against the champion on record, by paired bounds from packed reward bits."""
    results, champions, n = contest(spark, sf_dir, 4)
    _, decision = P.update_champion(results, champions, 500, 2, n, _Z, 0.01)
    return decision.select("promoted", "reason", "comparisons", "hotkey", F.round("delta", 9).alias("delta"), F.round("bound", 9).alias("bound"))


@query(f"""WITH {_VECTORS}, p AS (SELECT k, avg(r) AS p FROM v GROUP BY k), d AS (SELECT k, p - 0.45 AS delta, p - 0.45 - {I.familywise_z(_Z, 5)!r} * sqrt(p * (1 - p) / n + 0.45 * 0.55 / n) AS bound FROM p, n),
best AS (SELECT * FROM d ORDER BY bound DESC, delta DESC, k DESC LIMIT 1)
SELECT bound >= 0.01 AS promoted, CASE WHEN bound >= 0.01 THEN 'clear unpaired improvement over inactive king' ELSE 'inactive-king improvement below confidence threshold' END AS reason, 5::BIGINT AS comparisons, CASE WHEN bound >= 0.01 THEN 'h' || k END AS hotkey, round(delta, 9) AS delta, round(bound, 9) AS bound FROM best""")
def champion_inactive_king(spark, sf_dir):
    """The champion on record has no result: unpaired bounds to its last score."""
    results, champions, n = contest(spark, sf_dir, 7)
    _, decision = P.update_champion(results, champions, 500, 2, n, _Z, 0.01)
    return decision.select("promoted", "reason", "comparisons", "hotkey", F.round("delta", 9).alias("delta"), F.round("bound", 9).alias("bound"))


# ---- protocol scalars


@query("""WITH g AS (SELECT p_brand, count(*) AS population, CAST(1 + min(p_size) % 32 AS BIGINT) AS rows FROM part GROUP BY p_brand)
SELECT p_brand, CAST(least(ceil(ceil(ln(1 - 0.9999::DOUBLE) / ln(1 - 0.01::DOUBLE)) / rows), ceil(population / rows)) AS BIGINT) AS rounds FROM g""")
def required_rounds(spark, sf_dir):
    """Brands as bundles of their parts, with samples of different sizes."""
    g = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("population"), (1 + F.min("p_size") % 32).cast("long").alias("rows"))
    return g.select("p_brand", N.required_rounds(F.col("population"), F.col("rows"), 0.01, 0.9999).alias("rounds"))


@query(f"""WITH b AS (SELECT o_orderkey, o_orderkey // 3600 AS w, '0x' || sha256(CAST(o_orderkey AS VARCHAR)) AS h, CAST(o_custkey AS VARCHAR) AS hotkey, o_orderpriority AS digest FROM orders)
SELECT o_orderkey, sha256('{{"block_hash":"' || h || '","domain":"{DOMAIN}/evaluation","network":7,"window":' || w || '}}') AS seed,
 sha256('{{"block_hash":"' || h || '","digest":' || to_json(digest) || ',"domain":"{DOMAIN}/audit","hotkey":"' || hotkey || '","network":7,"revision":"a\\"b","round":' || (o_orderkey % 30) || '}}') AS audit FROM b""")
def window_seeds(spark, sf_dir):
    """Orders as blocks: the seed of each one's window and of an audit round, from hashes in any of their forms."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    block = F.concat(F.when(k % 2 == 0, " 0X").otherwise(""), F.upper(F.sha2(k.cast("string"), 256)))
    seed = N.evaluation_seed(F.lit(7), N.window_of(k), block)
    return o.select("o_orderkey", seed.alias("seed"), N.audit_seed(F.lit(7), block, F.col("o_custkey").cast("string"), F.col("o_orderpriority"), F.lit('a"b'), k % 30).alias("audit"))


@query("SELECT o_custkey, row_number() OVER (ORDER BY min(o_orderkey), o_custkey) - 1 AS place FROM orders GROUP BY o_custkey")
def first_seen_order(spark, sf_dir):
    """Customers in the order of their first orders."""
    return O.distinct_in_order(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderkey")


@query("""WITH r AS (SELECT s_suppkey % 4 > 0 AS valid, ['auditing', 'retrying', 'monitoring', 'failed', 'blacklisted', 'passed', NULL][1 + s_suppkey % 7] AS status FROM supplier)
SELECT count(*) AS evaluated, count(*) FILTER (valid) AS valid, count(*) FILTER (NOT valid AND coalesce(status, '') IN ('auditing', 'retrying')) AS auditing,
 count(*) FILTER (coalesce(status, '') = 'monitoring' OR valid AND coalesce(status, '') = 'retrying') AS monitoring,
 count(*) FILTER (coalesce(status, '') IN ('failed', 'blacklisted') OR NOT valid AND coalesce(status, '') NOT IN ('auditing', 'retrying')) AS invalid FROM r""")
def result_status_counts(spark, sf_dir):
    """Suppliers as results: all five counters of the status line."""
    states = F.array(*map(F.lit, ["auditing", "retrying", "monitoring", "failed", "blacklisted", "passed", None]))
    return Y.status_counts(table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 4 > 0).alias("valid"), F.get(states, (F.col("s_suppkey") % 7).cast("int")).alias("audit_status")))


@query("SELECT 'h' || s_suppkey AS hotkey, s_suppkey * 7919 % 1009 AS audit_block FROM supplier WHERE s_suppkey % 5 > 0 ORDER BY audit_block DESC, hotkey LIMIT 1")
def latest_audited(spark, sf_dir):
    """The supplier whose result was audited last; every fifth was not."""
    k = F.col("s_suppkey")
    results = table(spark, sf_dir, "supplier").select(F.concat(F.lit("h"), k.cast("string")).alias("hotkey"), F.when(k % 5 > 0, k * 7_919 % 1_009).alias("audit_block"))
    return Y.latest_audited(results)


# ---- the window, scoring and the audit step


def raw_sources(spark: SparkSession, sf_dir: str) -> list[W.Source]:
    """Two sources of typed math from documents, in blocks of 32 rows: those of even and of odd ids; the second repeats every ninth of the first."""
    d = docs(spark, sf_dir).where("text IS NOT NULL")
    sizes = {"even": 2, "odd": 1}

    def read(name: str):
        part = d.where((F.col("doc_id") % 2 == 0) if name == "even" else (F.col("doc_id") % 2 == 1) | (F.col("doc_id") % 9 == 0))
        raw = part.select(F.col("text").alias("problem"), F.col("n_chars").cast("string").alias("answer"), F.when(F.col("doc_id") % 13 == 0, "Proof ").otherwise(F.col("lang")).alias("question_type"), N.div(F.col("doc_id"), 32).alias("block_ord"), (F.col("doc_id") % 32).alias("pos"))
        return lambda first, last: raw.where((F.col("block_ord") >= first) & (F.col("block_ord") < last))

    def blocks() -> int:
        return d.agg(F.coalesce(F.max(N.div(F.col("doc_id"), 32)) + 1, F.lit(0))).first()[0]

    return [W.Source(name, size, read(name), blocks, "typed_math", f"math {name}", "math_exact", "open" if name == "even" else None) for name, size in sizes.items()]


_WS = r"[\s\x{1c}-\x{1f}\x{85}\pZ]"
_WINDOW = f"""WITH d AS (SELECT doc_id, n_chars, regexp_replace(text, '^{_WS}+|{_WS}+$', '', 'g') AS q FROM documents WHERE text IS NOT NULL AND doc_id % 13 <> 0),
g AS (SELECT *, q || chr(10) || chr(10) || 'After the required reasoning block, state the final answer clearly.' AS prompt FROM d WHERE q <> '' AND NOT regexp_matches(q, '{R.CONFLICT}')),
f AS (SELECT doc_id, doc_id // 32 AS block, n_chars, prompt, {_PRINT.format('prompt')} AS fp, substr(sha256(q), 1, 20) AS cid FROM g WHERE length(prompt) <= 32768 AND {_CLASS.format('prompt')} IS NULL),
e AS (SELECT *, 'math:even:' || cid AS row_id FROM f WHERE doc_id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY fp ORDER BY block, doc_id % 32) = 1),
ec AS (SELECT block, sum(count(*)) OVER (ORDER BY block) - count(*) AS before FROM e GROUP BY block),
es AS (SELECT e.* FROM e JOIN ec USING (block) WHERE before < 40 ORDER BY {_RANK.format("'even'", 'row_id')}, row_id LIMIT 40),
o AS (SELECT *, 'math:odd:' || cid AS row_id FROM f WHERE (doc_id % 2 = 1 OR doc_id % 9 = 0) AND fp NOT IN (SELECT fp FROM es) QUALIFY row_number() OVER (PARTITION BY fp ORDER BY block, doc_id % 32) = 1),
oc AS (SELECT block, sum(count(*)) OVER (ORDER BY block) - count(*) AS before FROM o GROUP BY block),
os AS (SELECT o.* FROM o JOIN oc USING (block) WHERE before < 20 ORDER BY {_RANK.format("'odd'", 'row_id')}, row_id LIMIT 20),
w AS (SELECT row_id, prompt, CAST(n_chars AS VARCHAR) AS expected, 'even' AS source_dataset, 'open' AS license, 'math even' AS category FROM es UNION ALL SELECT row_id, prompt, CAST(n_chars AS VARCHAR), 'odd', NULL, 'math odd' FROM os)"""


@query(f"""{_WINDOW} SELECT row_number() OVER (ORDER BY {_RANK.format("'order'", 'row_id')}, row_id) - 1 AS pos, row_id, 'math' AS task_type, sha256(prompt) AS prompt_sha256, expected, 'math_exact' AS verifier, source_dataset, license, category,
 {_BUDGET.format(_RANK.format("'reasoning_budget'", 'row_id'))} AS reasoning_budget_tokens FROM w""")
def window_build(spark, sf_dir):
    """Sixty rows from two sources by the whole build: blocks, normaliser, filters, two keys, reserved keys, quotas of 40 and 20, ranks, budgets and order."""
    w = W.build_window(spark, raw_sources(spark, sf_dir), SEED, 60)
    return w.select("pos", "row_id", "task_type", F.sha2("prompt", 256).alias("prompt_sha256"), F.col("expected")[0].alias("expected"), "verifier", "source_dataset", "license", "category", "reasoning_budget_tokens")


@query(f"""{_WINDOW}, h AS (SELECT 'category' AS kind, category AS value FROM w UNION ALL SELECT 'license', coalesce(license, 'None') FROM w UNION ALL SELECT 'task_type', 'math' FROM w UNION ALL SELECT 'verifier', 'math_exact' FROM w
 UNION ALL SELECT 'budget', CAST({_BUDGET.format(_RANK.format("'reasoning_budget'", 'row_id'))} AS VARCHAR) FROM w) SELECT kind, value, count(*) AS n FROM h GROUP BY ALL""")
def window_manifest(spark, sf_dir):
    return W.histograms(W.build_window(spark, raw_sources(spark, sf_dir), SEED, 60))


def vocabulary(spark: SparkSession) -> Vocabulary:
    """The public byte-level vocabulary of the box; its path is a parameter of Vocabulary."""
    import public_tokenizers

    return Vocabulary(spark, public_tokenizers.path("byte_bpe_50k.json"))


def letters(tok: Vocabulary, text: Column) -> Column:
    """Ids of a text of printable ASCII, a token a character."""
    each = F.create_map(*[F.lit(x) for c in map(chr, range(33, 127)) for x in (c, tok.ids(c)[0])])
    return F.transform(F.split(text, ""), lambda c: F.element_at(each, c))


@query("""WITH p AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS pos, p_size FROM part)
SELECT pos, 'row-' || p_partkey AS row_id, CASE WHEN p_partkey % 3 = 0 AND p_partkey % 5 > 1 THEN 1 ELSE 0 END AS reward, CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 5 = 1 THEN NULL ELSE 1000 + p_partkey % 100 END::INTEGER AS reasoning_tokens, p_partkey % 5 > 1 AS reasoning_valid FROM p""")
def score_rollouts(spark, sf_dir):
    """Parts as rollouts of a public vocabulary: reasoning of the right length, too short, or without its opening mark; right and wrong answers."""
    tok = vocabulary(spark)
    k = F.col("p_partkey")
    placed = O.position(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey")
    row = F.concat(F.lit("row-"), k.cast("string"))
    evaluation = placed.select("pos", row.alias("row_id"), F.lit("How big?").alias("prompt"), F.array(F.col("p_size").cast("string")).alias("expected"), F.lit("math_exact").alias("verifier"), F.lit("size").alias("category"), F.lit(1024).alias("reasoning_budget_tokens"))
    fill = F.when(k % 5 == 0, 10).otherwise(1000 + k % 100).cast("int")
    opening = F.when(k % 5 == 1, F.array(F.lit(65))).otherwise(F.array(*map(F.lit, tok.opening)))
    answer = F.concat(F.lit("\\boxed{"), F.when(k % 3 == 0, F.col("p_size")).otherwise(F.col("p_size") + 1).cast("string"), F.lit("}"))
    tokens = F.concat(opening, F.array_repeat(F.lit(tok.ids("a")[0]), fill), F.array(*map(F.lit, tok.closing)), letters(tok, answer), F.array(F.lit(tok.stops[0])))
    rollouts = placed.select("pos", row.alias("row_id"), tokens.alias("tokens"))
    return G.score_rollouts(evaluation, rollouts, tok, tokens=False).select("pos", "row_id", "reward", "reasoning_tokens", "reasoning_valid")


@query("""WITH r AS (SELECT c_nationkey AS n, bool_and(c_acctbal > -990) AS a, sum(c_custkey % 7 + 190) AS e, count(*) * 197 AS c FROM customer GROUP BY 1),
x AS (SELECT *, a AND e >= 0.975 * c AS ok, CASE WHEN n % 3 > 0 THEN n * 2 END AS before, n * 40 AS correct FROM r),
g AS (SELECT *, coalesce(before, 0) + CAST(ok AS INTEGER) AS passed, least(30, (correct + 31) // 32) AS required, least(50, (correct + 31) // 32) AS total FROM x)
SELECT 'n' || n AS hotkey, passed::INTEGER AS rounds_passed, (coalesce(before, 0) * 10 + e)::BIGINT AS exact, (coalesce(before, 0) * 11 + c)::BIGINT AS checked, correct::BIGINT AS correct, CASE WHEN ok AND passed >= required THEN 0.5::DOUBLE ELSE 0::DOUBLE END AS score, ok AND passed >= required AS valid,
 CASE WHEN NOT ok THEN 'failed' WHEN passed >= total THEN 'passed' WHEN passed >= required THEN 'monitoring' ELSE 'auditing' END AS audit_status, required::INTEGER AS required, total::INTEGER AS total FROM g""")
def audit_step(spark, sf_dir):
    """Customers as row reports of the nations' bundles: some rounds fail, some pass, some complete the required or all rounds."""
    c = table(spark, sf_dir, "customer")
    hotkey = F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("hotkey")
    reports = c.select(hotkey, (F.col("c_acctbal") > -990).alias("valid"), (F.col("c_custkey") % 7 + 190).alias("exact"), F.lit(197).cast("long").alias("checked"))
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("n"))
    name, before = F.concat(F.lit("n"), F.col("n").cast("string")).alias("hotkey"), F.col("n") * 2
    progress = nation.where("n % 3 > 0").select(name, before.cast("int").alias("rounds_passed"), (before * 10).alias("exact"), (before * 11).alias("checked"))
    return A.audit_step(progress, reports, nation.select(name, (F.col("n") * 40).alias("correct"), F.lit(0.5).alias("score")), replace(PROTOCOL, exact_ratio=0.975))


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS q, l_suppkey % 9 + 1 AS d, CAST(round(l_discount * 100) AS BIGINT) AS c FROM lineitem),
f AS (SELECT *, CASE l_linenumber WHEN 1 THEN q WHEN 2 THEN -q WHEN 3 THEN c WHEN 4 THEN q * 100 WHEN 5 THEN q END AS n, CASE l_linenumber WHEN 3 THEN 100 WHEN 4 THEN 1 ELSE d END AS m FROM x)
SELECT l_orderkey, l_linenumber, CAST(n // gcd(n, m) AS VARCHAR) || CASE WHEN m // gcd(n, m) = 1 THEN '' ELSE '/' || (m // gcd(n, m)) END AS value FROM f""")
def exact_rationals(spark, sf_dir):
    """Ratios of line items in five ways of writing; the others have no number, or divide by nothing."""
    n, q, d = F.col("l_linenumber"), F.col("l_quantity").cast("long").cast("string"), (F.col("l_suppkey") % 9 + 1).cast("string")
    say = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    text = F.when(n == 1, say("\\frac{", q, "}{", d, "}")).when(n == 2, say("so \\boxed{\\frac{-", q, "}{", d, "}}")).when(n == 3, F.format_string("the answer is %.2f", "l_discount"))
    text = text.when(n == 4, say("FINAL: $", q, "e2$")).when(n == 5, say("<answer>", q, " / ", d, "</answer>")).when(n == 6, say(q, "/0")).otherwise("seven")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", rational_udf(text).alias("value"))


@query("""WITH o AS (SELECT * FROM orders) SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN coalesce(CASE WHEN o_orderkey % 5 > 0 THEN 'own' END, 'repo-' || o_custkey) WHEN o_orderkey % 5 > 0 THEN 'own' END AS model_repo FROM o""")
def metadata_backfill(spark, sf_dir):
    """Orders as results, of which a third has the digest that is committed; what they lack comes from there."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").withColumn("hotkey", k.cast("string"))
    results = o.select("o_orderkey", "hotkey", F.when(k % 3 == 0, "now").otherwise("old").alias("digest"), F.when(k % 5 > 0, "own").alias("model_repo"))
    now = o.select("hotkey", F.lit("now").alias("digest"), F.concat(F.lit("repo-"), F.col("o_custkey").cast("string")).alias("model_repo"))
    return P.backfill(results, now, ["model_repo"]).select("o_orderkey", "model_repo")


@query("""WITH h AS (SELECT l_partkey, min(l_suppkey) AS owner FROM lineitem GROUP BY 1), r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem)
SELECT l_orderkey, l_linenumber, l_suppkey = owner AS valid, CASE WHEN l_suppkey = owner THEN 0.5 ELSE 0 END::DOUBLE AS score, CASE WHEN l_suppkey = owner THEN 'passed' ELSE 'copied' END AS audit_status, CASE WHEN l_suppkey <> owner THEN 's' || owner END AS copy_source FROM r JOIN h USING (l_partkey)""")
def copy_retraction(spark, sf_dir):
    """Line items as results that passed; those whose part an earlier submitter holds by now are taken back as copies."""
    item = table(spark, sf_dir, "lineitem")
    key, hotkey = F.col("l_partkey").cast("string"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))
    held = S.priority(None, item.select(key.alias("key"), F.col("l_suppkey").alias("block"), hotkey.alias("hotkey")))
    none = F.lit(None).cast("string")
    results = item.select("l_orderkey", "l_linenumber", hotkey.alias("hotkey"), key.alias("rows_key"), F.lit(True).alias("valid"), F.lit(0.5).alias("score"), F.lit("passed").alias("audit_status"), none.alias("copy_kind"), none.alias("copy_source"))
    return A.retract(results, held).select("l_orderkey", "l_linenumber", "valid", "score", "audit_status", "copy_source")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 > 1 THEN c_custkey % 9 + 2 ELSE 1 END::INTEGER AS round, CASE WHEN c_custkey % 4 > 1 THEN 100 + c_custkey ELSE 505 END::BIGINT AS challenge_block, CASE WHEN c_custkey % 4 > 1 THEN c_custkey % 3 ELSE 0 END::INTEGER AS attempts
FROM customer WHERE c_custkey % 5 > 0""")
def revision_restart(spark, sf_dir):
    """Customers as pending audits; a quarter has a new revision, a quarter was not pending, a fifth withdrew."""
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").withColumn("hotkey", k.cast("string"))
    pending = Y.conform(c.where(k % 4 > 0).select("hotkey", F.lit("d").alias("digest"), F.lit("r").alias("revision"), k.alias("commit_block"), F.lit(7).alias("pinned_block"), (k + 100).alias("challenge_block"), (k % 9 + 2).alias("round"), (k % 3).alias("attempts")), "pending")
    now = c.where(k % 5 > 0).select("hotkey", F.lit("d").alias("digest"), F.when(k % 4 == 1, "new").otherwise("r").alias("revision"), k.alias("commit_block"))
    return A.revise(pending, now, 500).select(F.col("hotkey").cast("long").alias("c_custkey"), "round", "challenge_block", "attempts")


@query("""WITH k AS (SELECT DISTINCT o_orderkey // 3600 AS win, o_custkey FROM orders) SELECT win, o_custkey, min(o_orderkey) AS block FROM orders JOIN k USING (o_custkey)
WHERE win = 0 AND o_orderkey // 3600 = 0 AND o_custkey % 4 > 0 GROUP BY win, o_custkey""")
def priority_prune(spark, sf_dir):
    """Orders as submissions, those of the first window: of their holders those that are still committed at that block."""
    o = table(spark, sf_dir, "orders").select(N.window_of(F.col("o_orderkey")).alias("window"), F.col("o_custkey").cast("string").alias("hotkey"), F.col("o_orderkey").alias("block"))
    held = o.groupBy("window", "hotkey").agg(F.min("block").alias("block")).withColumn("key", F.concat_ws(":", "window", "hotkey"))
    now = held.where("CAST(hotkey AS BIGINT) % 4 > 0").select("hotkey", F.col("block").alias("commit_block"))
    return A.prune(held, now, 0).select(F.col("window").alias("win"), F.col("hotkey").cast("long").alias("o_custkey"), "block")


@query("SELECT DISTINCT l_suppkey AS s, l_orderkey // 3600 AS win FROM lineitem WHERE l_suppkey % 3 > 0 OR l_orderkey // 3600 > 0")
def produced_once(spark, sf_dir):
    """Suppliers and windows as wanted rollouts, without those of the first window that every third supplier has produced."""
    wanted = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s"), N.window_of(F.col("l_orderkey")).alias("win"))
    return A.produced(wanted.where("s % 3 = 0 AND win = 0").distinct(), wanted)


_SAMPLED = f"sha256('{DOMAIN}' || chr(0) || 's' || n || chr(0) || 'audit' || chr(0) || 'row-' || p_partkey)"


@query(f"""WITH m AS (SELECT n_nationkey AS n, n_nationkey % 9 AS kind FROM nation), facts AS (SELECT count(*) AS rows, count(*) FILTER (p_partkey % 3 > 0) AS correct FROM part),
ranked AS (SELECT n, kind, p_partkey, row_number() OVER (PARTITION BY n ORDER BY {_SAMPLED}, 'row-' || p_partkey) AS place FROM m, part WHERE kind IN (0, 5) AND p_partkey % 3 > 0 AND NOT (n % 5 = 0 AND p_partkey % 7 = 0)),
told AS (SELECT n, count(*) AS audited, sum(CASE WHEN kind = 5 AND p_partkey % 8 = 0 THEN 1 ELSE 2 END) AS e, 2 * count(*) AS c, count(*) FILTER (kind = 5 AND p_partkey % 8 = 0) AS bad FROM ranked WHERE place <= 32 GROUP BY n),
x AS (SELECT m.n, kind, rows, correct, audited, e, c, coalesce(bad = 0 AND e >= 0.995 * c, false) AS ok, CASE WHEN m.n % 5 = 0 THEN least(29, (correct + 31) // 32 - 1) ELSE 0 END AS before, least(30, (correct + 31) // 32) AS required, least(50, (correct + 31) // 32) AS total,
 CASE WHEN m.n % 5 = 0 THEN (SELECT count(*) FROM part WHERE p_partkey % 7 = 0) ELSE 0 END AS old FROM m LEFT JOIN told ON told.n = m.n, facts),
y AS (SELECT *, before + CAST(ok AS INTEGER) AS passed, CASE kind WHEN 0 THEN NULL WHEN 1 THEN 'duplicate_rollout' WHEN 2 THEN 'rows_differ' WHEN 4 THEN 'commitment_disappeared' WHEN 5 THEN CASE WHEN ok THEN NULL ELSE 'round_failed' END WHEN 7 THEN 'manifest_mismatch' WHEN 8 THEN 'rollout_fault' END AS reason FROM x),
z AS (SELECT *, n % 2 = 1 AND reason IN ('rows_differ', 'round_failed', 'manifest_mismatch', 'rollout_fault') AS out FROM y)
SELECT 'm' || n AS hotkey, CASE WHEN kind = 6 THEN NULL ELSE kind IN (0, 5) AND ok AND passed >= required END AS valid, CASE WHEN kind = 6 THEN NULL WHEN kind IN (0, 5) AND ok AND passed >= required THEN correct / rows ELSE 0 END::DOUBLE AS score,
 CASE WHEN kind IN (0, 5) THEN correct END::BIGINT AS correct, CASE WHEN kind = 6 THEN NULL WHEN out THEN 'blacklisted' WHEN kind = 1 THEN 'copied' WHEN kind = 3 THEN 'retrying' WHEN reason IS NOT NULL THEN 'failed' WHEN passed >= total THEN 'passed' WHEN passed >= required THEN 'monitoring' ELSE 'auditing' END AS audit_status,
 reason, CASE WHEN kind = 1 THEN 'm' || (n - 1) END AS copy_source, CASE WHEN kind IN (0, 5) THEN passed END::INTEGER AS audit_round, CASE WHEN kind IN (0, 5) THEN before * 64 + e END::BIGINT AS exact, CASE WHEN kind IN (0, 5) THEN before * 64 + c END::BIGINT AS checked,
 CASE WHEN kind IN (0, 5) THEN old + audited END::BIGINT AS audited_count, CASE WHEN kind = 3 THEN n % 2 + 1 WHEN kind = 6 THEN n % 2 END::INTEGER AS attempts, CASE WHEN kind = 3 THEN 6000 + 5 * pow(2, n % 2) WHEN kind = 6 THEN 9000 END::BIGINT AS challenge_block, CASE WHEN out THEN 6000 + 7200 END::BIGINT AS blacklisted_until_block FROM z""")
def audit_cycle(spark, sf_dir):
    """Parts as evaluation rows, nations as submitters whose bundles answer all of them: sound, copied, of other rows, unaudited by the engine, withdrawn,
    forged in places, not yet due, of another root, or broken; from validation to strikes and retries in one go."""
    protocol = replace(PROTOCOL, budget_levels=(16,))
    tok, n, k = vocabulary(spark), F.col("n"), F.col("p_partkey")
    parts = O.written(O.position(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey"))
    m = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("n"), (F.col("n_nationkey") % 9).alias("kind"))
    name = lambda prefix, of: F.concat(F.lit(prefix), of.cast("string"))
    hotkey, digest, revision, kind = name("m", n).alias("hotkey"), name("d", n).alias("digest"), F.lit("r").alias("revision"), F.col("kind")
    evaluation = parts.select("pos", name("row-", k).alias("row_id"), F.lit("How big?").alias("prompt"), F.array(F.col("p_size").cast("string")).alias("expected"), F.lit("label_match").alias("verifier"), F.lit("size").alias("category"), F.lit(16).alias("reasoning_budget_tokens"))
    stop = F.when(kind == 8, F.array().cast("array<int>")).otherwise(F.array(F.lit(tok.stops[0])))
    answer = letters(tok, (F.col("p_size") + F.when(k % 3 == 0, 1).otherwise(0)).cast("string"))
    tokens = F.concat(F.array(*map(F.lit, tok.opening)), F.array_repeat(F.lit(tok.ids("a")[0]), 16), F.array(*map(F.lit, tok.closing)), answer, stop)
    # Every submitter answers every part: a fixed number of rows a part.
    miners = F.from_json(F.lit(m.agg(F.to_json(F.sort_array(F.collect_list(F.struct("n", "kind"))))).first()[0]), "array<struct<n: long, kind: int>>")
    each = parts.withColumn("x", F.explode(miners)).select("*", "x.n", "x.kind")
    rollouts = each.select(hotkey, "pos", F.concat(F.when(kind == 2, "other-").otherwise("row-"), k.cast("string")).alias("row_id"), tokens.alias("tokens"))
    manifests = m.select(hotkey, digest, revision, F.lit(1).alias("window"), F.when(kind == 7, "other").otherwise("root").alias("evaluation_root"), name("s", F.when(kind == 1, n - 1).otherwise(n)).alias("rows_sha256"), F.lit(1_000).alias("max_tokens"))
    commitments = m.where("kind <> 4").select(hotkey, n.cast("int").alias("uid"), digest, (1_000 + n).alias("commit_block"))
    pending = m.select(hotkey, digest, revision, (1_000 + n).alias("commit_block"), F.when(kind == 6, 9_000).otherwise(5_000).alias("challenge_block"), (n % 3 + 1).alias("round"), (n % 2).alias("attempts"))
    cover = N.div(F.lit(evaluation.where("CAST(substr(row_id, 5) AS BIGINT) % 3 > 0").count()) + 31, 32)
    before = F.least(F.lit(29), cover - 1)
    progress = m.where("n % 5 = 0").select(hotkey, digest, revision, before.alias("rounds_passed"), (before * 64).alias("exact"), (before * 64).alias("checked"))
    audited = each.where("n % 5 = 0 AND p_partkey % 7 = 0").select(hotkey, digest, revision, name("row-", k).alias("row_id"))
    strikes = m.where("n % 2 = 1").select(hotkey, F.array(F.lit("x"), F.lit("y")).alias("keys"))
    given = {"pending": pending, "progress": progress, "audited": audited, "strikes": strikes}
    empty = Y.State.empty(spark)
    state = Y.State(**{t: Y.conform(given[t], t) if t in given else getattr(empty, t) for t in Y.TABLES})
    chain = Y.Chain(6_000, 1, commitments, m.select(hotkey, revision), m.select(hotkey, name("s", n).alias("seed")))

    def engine(rows: DataFrame) -> DataFrame:
        number, part = F.substr("hotkey", F.lit(2)).cast("int"), F.substr("row_id", F.lit(5)).cast("long")
        bad = (number % 9 == 5) & (part % 8 == 0) & (F.col("position") == 1)
        told = rows.where(number % 9 != 3).withColumn("position", F.explode(F.array(F.lit(0), F.lit(1))))
        return told.select("hotkey", "row_id", "position", F.lit(7).alias("submitted_token"), F.lit(7).alias("token_id"), F.lit(-0.5).alias("logprob"), F.when(bad, 5).otherwise(1).alias("rank"))

    after = Y.audit_due(state, chain, Y.Bundles(manifests, rollouts), evaluation, "root", engine, tok, protocol)
    waiting = after.pending.select("hotkey", "attempts", "challenge_block")
    cols = ["valid", "score", "correct", "audit_status", "reason", "copy_source", "audit_round", "exact", "checked", "audited_count", "blacklisted_until_block"]
    return after.results.select("hotkey", *cols).join(waiting, "hotkey", "full_outer")


#: Rows that share neither key with another stay; the others are gone through in order, with a list of the keys that are taken.
_DEDUPE = f"""WITH RECURSIVE k AS (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS id, doc_id, {_PRINT.format('text')} AS fp FROM documents WHERE text IS NOT NULL),
c AS (SELECT *, (id IS NOT NULL AND count(*) OVER (PARTITION BY id) > 1) OR count(*) OVER (PARTITION BY fp) > 1 AS shared FROM k),
r AS (SELECT doc_id, id, fp, row_number() OVER (ORDER BY doc_id, fp) AS n FROM c WHERE shared),
s AS (SELECT 0::BIGINT AS n, NULL::BIGINT AS doc_id, []::VARCHAR[] AS seen, false AS keep UNION ALL
 SELECT r.n, r.doc_id, CASE WHEN list_contains(s.seen, r.id) OR list_contains(s.seen, r.fp) THEN s.seen ELSE s.seen || [r.id, r.fp] END, NOT (list_contains(s.seen, r.id) OR list_contains(s.seen, r.fp)) FROM s JOIN r ON r.n = s.n + 1)
SELECT doc_id FROM s WHERE keep UNION ALL SELECT doc_id FROM c WHERE NOT shared"""


@query(_DEDUPE)
def two_key_dedupe(spark, sf_dir):
    """Documents by row id and by the fingerprint of the whole text, in doc_id order; rows without text have no prompt."""
    keyed = docs(spark, sf_dir).where("text IS NOT NULL").select("doc_id", N.fingerprint(F.col("text")).alias("fp")).distinct()
    return O.two_key_dedupe(keyed.withColumn("scan", F.struct("doc_id", "fp")), "scan", "doc_id", "fp").select("doc_id")
