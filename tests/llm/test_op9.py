import math
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from gradelake.llm import ordinal_quality as Q
from gradelake.llm.textcore import mix, span_hashes

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    train = labels.where("doc_id % 4 <> 0")
    model = Q.fit(docs, train)
    assert model.cuts[0] <= model.cuts[1]
    got = {x.doc_id: x for x in Q.grade_documents(docs, model).collect()}
    held = [(x.doc_id, 0 if x.toxic else 1 if not x.quality else 2) for x in labels.where("doc_id % 4 = 0").collect()]
    good = [i for i, g in held if g == 2]
    bad = [i for i, g in held if g < 2]
    assert len(good) > 500 and len(bad) > 150
    assert sum(got[i].kept for i in good) >= 0.97 * len(good)
    assert sum(not got[i].kept for i in bad) >= 0.9 * len(bad)
    mean = [np.mean([got[i].expected_grade for i, g in held if g == k]) for k in range(3)]
    assert mean[0] < mean[1] < mean[2]


def test_features_do_not_depend_on_neighbours():
    texts = ["abcd", None, "", "abcd efgh", " \n", "É" * 5, "x" * 3, "abcd"]
    together = list(Q.features(pa.array(texts)))
    for t, (i, v) in zip(texts, together, strict=True):
        j, w = next(iter(Q.features(pa.array([t], pa.string()))))
        assert np.array_equal(i, j) and np.allclose(v, w)


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, "a b", 0), (1, "a b", 0), (2, None, 1), (None, "", 1), (3, "long " * 40_000, 2)], "doc_id long, text string, kept int")
    for rows in ([], [(1, 1, 0), (1, 0, 0), (99, 1, 1), (2, None, 0), (None, 1, 1)], [(1, 1, 0)]):
        model = Q.fit(docs, spark.createDataFrame(rows, "doc_id long, quality int, toxic int"))
        got = Q.grade_documents(docs, model).collect()
        assert len(got) == 5 and all(0 <= x.tail_prob <= 1 and x.expected_grade == pytest.approx(x.tail_prob + 1 - x.toxic_prob) for x in got)
    assert Q.grade_documents(docs.limit(0), model).count() == 0


def test_sample_is_bounded(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    assert Q.rated(docs, labels, 50).count() == 50
    n = duckdb.connect().execute(f"SELECT count(*) FROM '{SF}/labels.parquet'").fetchall()[0][0]
    assert Q.rated(docs, labels).count() == min(n, Q.SAMPLE)


def plain_features(text):
    """Buckets and weights of one text, word by word."""
    one = lambda s: int(span_hashes(np.frombuffer(s, np.uint8), np.array([0]), np.array([len(s)]), 5)[0])
    spread = lambda x: int(mix(np.array([x], np.uint64))[0])
    raw = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0d]+", raw)
    is_odd = lambda b: 33 <= b < 128 and not chr(b).isalnum()
    found, grams, shapes = set(), set(), Counter()
    for w in words:
        odd = sum(map(is_odd, w))
        core = w
        for _ in range(4):
            core = core[1:] if core and is_odd(core[0]) else core
            core = core[:-1] if core and is_odd(core[-1]) else core
        low = re.sub(rb"[A-Z]", lambda m: m[0].lower(), core)
        found.add(one(low) % Q.DIMS)
        capitals = len(re.findall(rb"[A-Z]", core))
        case = 0 if not capitals else 2 if capitals == len(core) else 1
        shapes[spread(min(odd, 4) * 1000 + min(len(core) // 4, 6) * 10 + case) % Q.DIMS] += 1
        whole = re.sub(rb"[A-Z]", lambda m: m[0].lower(), w)
        grams |= {spread(int.from_bytes(whole[i : i + Q.GRAM], "little") + (1 << 40)) % Q.DIMS for i in range(len(whole) - Q.GRAM + 1)}
    n = max(1, len(words))
    out = [(b, Q.PRESENT) for b in sorted(found)] + [(b, Q.PRESENT) for b in sorted(grams)]
    out += [(b, Q.CLASS * c / n) for b, c in sorted(shapes.items())] + [(spread(12345) % Q.DIMS, Q.CLASS * (1 - len(found) / n))]
    return out


def plain_loss(x, grades, balance, w, cuts):
    """Penalised negative log-likelihood of a dense matrix."""
    below = lambda k, s: 0.0 if k < 0 else 1.0 if k == len(cuts) else 1 / (1 + math.exp(-(cuts[k] - s)))
    loss = 0.0
    for row, g, b in zip(x, grades, balance, strict=True):
        s = float(row @ w)
        loss -= b * math.log(below(g, s) - below(g - 1, s))
    return loss / len(grades) + Q.RIDGE / 2 * float(w @ w)


def test_features_against_plain_python():
    texts = ["The CAT, (sat) on... the Mat! the cat", "", "É--è **bold** a1b2 " * 3, "x", "...", "((((((a))))))"]
    for t, (i, v) in zip(texts, Q.features(pa.array(texts)), strict=True):
        assert list(zip(i.tolist(), np.round(v, 9).tolist(), strict=True)) == [(b, round(w, 9)) for b, w in plain_features(t)], t


def test_gradient_against_differences():
    r = np.random.default_rng(1)
    x = np.where(r.random((30, 6)) < 0.5, r.random((30, 6)), 0.0)
    grades, balance, w, cuts = r.integers(0, 3, 30), r.random(30) + 0.5, r.normal(size=6), np.array([-0.4, 0.7])
    row, col = np.nonzero(x)
    whole = np.zeros(Q.DIMS)
    whole[:6] = w
    slope, rise = Q.Model.slopes(row, col, x[row, col], grades, balance, whole, cuts)
    step = 1e-6
    for k in range(6):
        d = np.eye(6)[k] * step
        assert slope[k] == pytest.approx((plain_loss(x, grades, balance, w + d, cuts) - plain_loss(x, grades, balance, w - d, cuts)) / (2 * step), abs=1e-6)
    for k in range(2):
        d = np.eye(2)[k] * step
        assert rise[k] == pytest.approx((plain_loss(x, grades, balance, w, cuts + d) - plain_loss(x, grades, balance, w, cuts - d)) / (2 * step), abs=1e-6)


def test_query_against_plain_fit(spark):
    """The whole query once more: features word by word, buckets chosen one by one, a dense fit with a derivative of its own, and scores."""
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    texts = dict(con.execute(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall())
    labels = sorted((i, 0 if t == 1 else 1 if q == 0 else 2) for i, q, t in con.execute(f"SELECT doc_id, quality, toxic FROM '{sf}/labels.parquet'").fetchall() if i in texts)
    vectors = {i: dict(Counter({}) | {}) for i in texts}
    for i, t in texts.items():
        for b, v in plain_features(t):
            vectors[i][b] = vectors[i].get(b, 0.0) + v
    rated = [(vectors[i], g) for i, g in labels]
    n, grades = len(rated), np.array([g for _, g in rated])
    have = Counter(b for x, _ in rated for b in x)
    use = []
    for b, c in have.items():
        apart = False
        for k in range(2):
            low = grades <= k
            m = int(low.sum())
            if 0 < m < n:
                own = sum(b in x for (x, _), below in zip(rated, low, strict=True) if below)
                error = math.sqrt(max(c / n * (1 - c / n), 1e-12) * n / (m * (n - m)))
                apart |= abs(own / m - (c - own) / (n - m)) > Q.APART * error or c >= n - 1
        if apart and c >= Q.SUPPORT:
            use.append(b)
    x = np.array([[np.float32(v.get(b, 0.0)) for b in use] for v, _ in rated], float)
    share = [(sum(g <= k for g in grades) + 0.5 * (k + 1)) / (n + 1.5) for k in range(2)]
    cuts, w = np.array([math.log(s / (1 - s)) for s in share]), np.zeros(len(use))
    kinds = Counter(grades.tolist())
    balance = np.array([math.sqrt(n / (len(kinds) * kinds[g])) for g in grades.tolist()])
    past, past_cuts = np.full(len(use), 1e-8), np.full(2, 1e-8)
    for _ in range(Q.STEPS):
        s = x @ w
        f = 1 / (1 + np.exp(-(cuts[None] - s[:, None])))
        f = np.c_[np.zeros(n), f, np.ones(n)]
        at = np.arange(n)
        high, low = f[at, grades + 1], f[at, grades]
        p = high - low
        by_score = balance * (high * (1 - high) - low * (1 - low)) / p
        slope = x.T @ by_score / n + Q.RIDGE * w
        rise = np.array([(-(balance * high * (1 - high) / p)[grades == k].sum() + (balance * low * (1 - low) / p)[grades == k + 1].sum()) / n for k in range(2)])
        past, past_cuts = past + slope**2, past_cuts + rise**2
        w = w - Q.RATE * slope / np.sqrt(past)
        cuts = np.sort(cuts - 0.1 * rise / np.sqrt(past_cuts))
    got = {r.doc_id: r for r in Q.op9_quality_classifier(spark, sf).collect()}
    assert set(got) == set(texts)
    for i in texts:
        s = sum(vectors[i].get(b, 0.0) * v for b, v in zip(use, w, strict=True))
        below = [1 / (1 + math.exp(-(c - s))) for c in cuts]
        assert got[i].tail_prob == pytest.approx(1 - below[1], abs=1e-4) and got[i].toxic_prob == pytest.approx(below[0], abs=1e-4)
        assert got[i].expected_grade == pytest.approx(2 - sum(below), abs=2e-4)


def test_repeated_rows_and_long_texts_stay_bounded(spark, monkeypatch):
    long = " ".join(f"word{i}" for i in range(5000))
    docs = spark.createDataFrame([(1, "a b c")] * 300 + [(2, long), (3, "d e"), (3, "f g")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 0, 1)], "doc_id long, quality int, toxic int")
    seen = []
    monkeypatch.setattr(Q, "Model", lambda texts, grades: seen.append((texts, grades)))
    Q.fit(docs, labels)
    Q.fit(docs, labels, 2)
    assert [len(x[0]) for x in seen] == [4, 2] and max(len(i) for i, _ in seen[0][0]) < 5  # no bucket has SUPPORT texts
    seen.clear()
    monkeypatch.setattr(Q, "apart", lambda counts, sizes: counts.sum(0) > 0)
    Q.fit(docs, labels)
    whole = next(Q.features(pa.array([long])))[0]
    assert max(len(i) for i, _ in seen[0][0]) == len(whole) > 4096


def test_buckets_are_told_by_counts():
    r = np.random.default_rng(4)
    grades = r.integers(0, 3, 200)
    row, col = np.nonzero(r.random((200, 50)) < np.where(grades[:, None] == 2, 0.6, 0.2))
    well = Q.Model.telling(row, col, grades)
    for b in range(50):
        has, told = np.isin(np.arange(200), row[col == b]), False
        for k in range(2):
            low = grades <= k
            p = has.mean()
            told |= abs(has[low].mean() - has[~low].mean()) > Q.APART * math.sqrt(p * (1 - p) * (1 / low.sum() + 1 / (~low).sum()))
        assert well[b] == (told and has.sum() >= Q.SUPPORT)
