import random
import re

import duckdb
import numpy as np
from pyspark.sql import functions as F

from gradelake.llm import jaccard_join as J
from gradelake.llm.signature_tree import Join


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def brute(rows, n, num, den):
    sets = [shingles(t, n) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            same = sets[i] and sets[j] and den * both >= num * (len(sets[i]) + len(sets[j]) - both)
            if same and label[i] != label[j]:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    least = {}
    for (i, _), x in zip(rows, label, strict=True):
        least[x] = min(least.get(x, i), i)
    return sorted((i, len(s), least[x]) for (i, _), s, x in zip(rows, sets, label, strict=True))


def corpus(seed, size):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["The", "the", "É"]
    rows, i = [(10_000, None), (10_001, ""), (10_002, " \n\t"), (10_003, "one"), (10_004, "ONE"), (10_005, "one two"), (10_006, "x " * 9000), (10_007, "x " * 8000)], 0
    shared = " ".join(r.choice(words) for _ in range(60))
    while len(rows) < size:
        text = " ".join(r.choice(words) for _ in range(r.randint(1, 120)))
        if r.random() < 0.3:
            text = shared + " " + text
        for _ in range(r.choice([1, 1, 1, 2, 5, 12])):
            w = text.split()
            for _ in range(r.randint(0, 6)):
                w[r.randrange(len(w))] = r.choice(words)
            rows.append((i, r.choice([" ", "\n "]).join(w)))
            i += 1
            if r.random() < 0.3:
                text = rows[-1][1]
    r.shuffle(rows)
    return rows


def run(spark, rows, n, num, den):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n int, rep string").repartition(5)
    members, links = J.similar_documents(df, n, num, den)
    got = sorted((x.doc_id, x.n_shingles, x.component_id) for x in members.collect())
    return df, got, links


def test_brute_force(spark):
    for seed, n, num, den in ((1, 3, 9, 10), (2, 5, 8, 10), (3, 2, 1, 2)):
        rows = corpus(seed, 350)
        df, got, _ = run(spark, rows, n, num, den)
        expected = brute(rows, n, num, den)
        assert got == expected
        assert len({c for _, _, c in expected}) < len(rows) - 50
    kept = J.one_of_each(df, 2, 1, 2)
    assert kept.columns == df.columns
    assert sorted(x.doc_id for x in kept.collect()) == sorted({c for _, _, c in expected})


def test_chunked_homes(spark, monkeypatch):
    monkeypatch.setattr(J, "CHUNK", 400)
    r = random.Random(9)
    base = [f"b{i}" for i in range(100)]
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(20, 100)] = f"z{r.random()}"
        rows.append((i, " ".join(w)))
    for n, num, den, maps in ((3, 9, 10, J.MAPS), (5, 8, 10, 16), (3, 9, 10, 16)):
        monkeypatch.setattr(J, "MAPS", maps)
        assert run(spark, rows, n, num, den)[1] == brute(rows, n, num, den)


def test_repeated_and_null_ids(spark):
    text = "a b c d e f g"
    rows = [(4, text), (4, text), (None, text), (None, "only here and nowhere else"), (9, text + " h"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    members, _ = J.similar_documents(df, 3, 8, 10)
    got = sorted(((x.doc_id, x.component_id) for x in members.collect()), key=str)
    assert got == sorted([(4, 4), (4, 4), (None, 4), (None, None), (9, 4), (None, None)], key=str)
    assert sorted((x.doc_id for x in J.one_of_each(df, 3, 8, 10).collect()), key=str) == [4, None, None, None]
    assert J.similar_documents(df.limit(0))[0].count() == 0


def test_tree_finds_all_components():
    r = np.random.default_rng(4)
    for _ in range(20):
        base = [np.unique(r.integers(0, 2**63, r.integers(5, 80)).astype(np.uint64)) for _ in range(6)]
        sets = [np.unique(np.r_[b[r.random(len(b)) > 0.04], r.integers(0, 2**63, 1).astype(np.uint64)]) for b in base for _ in range(15)]
        join = Join(sets, 8, 10)
        join.run()
        label = np.empty(len(sets), int)
        label[join.order] = join.label
        plain = list(range(len(sets)))
        for i in range(len(sets)):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if 10 * both >= 8 * (len(sets[i]) + len(sets[j]) - both) and plain[i] != plain[j]:
                    plain = [min(plain[i], plain[j]) if x in (plain[i], plain[j]) else x for x in plain]
        assert len(set(zip(label.tolist(), plain, strict=True))) == len(set(plain)) == len(set(label.tolist()))


def thue(n):
    t = "a"
    while len(t) < n:
        t += t.translate(str.maketrans("ab", "ba"))
    return t[:n]


def test_letters_that_cancel_out_do_not_collide(spark):
    one = thue(1024)
    two = one.translate(str.maketrans("ab", "ba"))
    rows = [(1, f"{one} x y"), (2, f"{two} x y"), (3, one), (4, two), (5, f"{one}  X y")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    members, _ = J.similar_documents(df, 3, 9, 10)
    assert sorted((x.doc_id, x.component_id) for x in members.collect()) == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 1)]


def test_clashing_ids_with_different_texts(spark):
    a, b, c = ("a b c d e f g h i j", "k l m n o p q r s t", "u v w x y z 1 2 3 4")
    rows = [(4, a, 1), (4, b, 2), (4, a.upper(), 3), (7, b, 4), (2, c, 5), (9, c, 6), (4, c, 7), (8, "", 8), (8, None, 9), (4, a, 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, th int").repartition(3)
    members, _ = J.similar_documents(df, 3, 8, 10)
    got = sorted((x.doc_id, x.n_shingles, x.component_id) for x in members.collect())
    assert got == sorted([(4, 8, 4), (4, 8, 4), (4, 8, 4), (4, 8, 4), (7, 8, 4), (2, 8, 2), (9, 8, 2), (4, 8, 2), (8, 0, 8), (8, 0, 8)])
    kept = J.one_of_each(df, 3, 8, 10)
    assert kept.columns == df.columns
    texts = sorted((x.doc_id, (x.text or "").lower()) for x in kept.collect())
    assert texts == sorted([(4, a), (4, b), (2, c), (8, ""), (8, "")])


def test_long_runs_of_a_token_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(J, "RUN", 8)
    monkeypatch.setattr(J, "MAPS", 16)
    monkeypatch.setattr(J, "HOT", 4)
    for seed, n, num, den in ((5, 3, 9, 10), (6, 2, 1, 2)):
        rows = corpus(seed, 250)
        assert run(spark, rows, n, num, den)[1] == brute(rows, n, num, den)


def test_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    expected = sorted(con.execute(J.OP3_SQL).fetchall())
    assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in J.op3_ngram_jaccard_join(spark, sf).collect()) == expected


def test_of_repeated_rows_the_first_by_their_other_columns_stays(spark):
    text = "one two three four five six seven eight"
    rows = [(1, text, "b", 1), (1, text, "a", 2), (1, text, "a", 1), (2, text, "a", 0), (3, "quite another text of more than five words", None, 1), (None, text, "a", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string, __one int")
    for parts in (1, 5):
        got = J.one_of_each(df.repartition(parts, "__one"))
        assert sorted(map(tuple, got.collect()), key=str) == sorted([rows[2], rows[4], rows[5]], key=str)


def test_tokens_shared_by_chance_make_no_visits(spark):
    """Documents of one vocabulary share some rare shingles each; only those that share as many as a link needs visit another home."""
    r = random.Random(11)
    words = [f"w{i}" for i in range(24)]
    rows = []
    while len(rows) < 240:
        w = [r.choice(words) for _ in range(r.randint(260, 420))]
        rows.append((len(rows), " ".join(w)))
        if len(rows) % 8 == 0:
            for _ in range(3):  # near copies on both sides of the threshold
                w = list(w)
                for _ in range(r.randint(1, 5)):
                    w[r.randrange(len(w))] = r.choice(words)
                rows.append((len(rows), " ".join(w)))
    df, got, _ = run(spark, rows, 3, 9, 10)
    assert got == brute(rows, 3, 9, 10)
    sig = J.signatures(df, 3, 9, 10, J.frequent_tokens(df, 3)).withColumn("rep", F.monotonically_increasing_id())
    assert J.visits_of(J.stored(sig, "signatures"), 9, 10).count() < len(rows)


def test_long_chains_of_links_take_few_jobs(spark):
    r = random.Random(5)
    nodes = r.sample(range(10**6), 1500)
    links = [(nodes[i], nodes[i + 1]) if r.random() < 0.5 else (nodes[i + 1], nodes[i]) for i in range(1499) if i % 500 != 499]
    links += [(x, x) for x in nodes[:20]]
    r.shuffle(links)
    df = spark.createDataFrame(links, "a long, b long").repartition(6)
    context = spark.sparkContext
    context.setJobGroup("chains", "")
    got = sorted(map(tuple, J.components(df).collect()))
    jobs = len(context.statusTracker().getJobIdsForGroup("chains"))
    context.setLocalProperty("spark.jobGroup.id", None)
    assert got == sorted((x, min(nodes[i : i + 500])) for i in (0, 500, 1000) for x in nodes[i : i + 500])
    assert jobs < 45


def test_chains_over_many_portions(spark, monkeypatch):
    monkeypatch.setattr(J, "COUNTED", 4)
    nodes = random.Random(6).sample(range(1000), 300)
    df = spark.createDataFrame([(nodes[i], nodes[i + 1]) for i in range(299) if i != 120], "a long, b long").repartition(7)
    got = sorted(map(tuple, J.components(df).collect()))
    assert got == sorted([(x, min(nodes[:121])) for x in nodes[:121]] + [(x, min(nodes[121:])) for x in nodes[121:]])


def shuffled_mb(spark):
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty()
    stages = context.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), spark.sparkContext._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size())) / 1e6


def test_rows_that_stay_are_not_shuffled(spark):
    """Of one_of_each only rows that go, repeated ones and what else passes the filter are shuffled with their texts."""
    r = random.Random(12)
    rows = [(i, " ".join(f"{r.getrandbits(200):x}" for _ in range(40)), f"{r.getrandbits(160_000):x}") for i in range(400)]
    rows += [(1000 + i, rows[i][1] + " more", "c") for i in range(8)] + [(20, rows[20][1], ""), (None, "null id", "b")]
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = spark.createDataFrame(rows, "doc_id long, text string, other string")
        before = shuffled_mb(spark)
        kept = J.one_of_each(docs).collect()
        written = shuffled_mb(spark) - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    expected = [x for x in rows[:400] if x[0] != 20] + rows[-2:]
    assert sorted(map(tuple, kept), key=str) == sorted(expected, key=str)
    assert written < sum(len(x[2]) for x in rows) / 1e6 / 4
