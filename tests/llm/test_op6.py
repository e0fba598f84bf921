import random
import re

import numpy as np
import pytest

from gradelake.llm import decontaminate as D


def plain(s):
    b = re.sub(rb"[\x00-\x7f]", lambda m: m[0].lower() if m[0].isalnum() else b" ", s.encode())
    b = re.sub(b"\xc3([\x80-\x96\x98-\x9e])", lambda m: b"\xc3" + bytes([m[1][0] + 32]), b)
    return re.sub(b" +", b" ", b).lstrip(b" ")


def nearest(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern):
        new = [i + 1]
        for j, t in enumerate(text):
            new.append(min(row[j] + (p != t), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def brute(docs, items):
    out = {}
    for i, t in docs:
        out[i] = sorted({item for item, b in items if len(plain(b or "").rstrip(b" ")) >= D.MIN_ITEM and found(b, t or "")})
    return out


def words(r, n):
    return " ".join("".join(r.choice("abcdefgé") for _ in range(r.randint(1, 8))) for _ in range(n))


def edit(r, s, n):
    s = list(s)
    for _ in range(n):
        at = r.randrange(len(s))
        s[at : at + 1] = r.choice([[], [r.choice("xyz")], [s[at], r.choice("xyz")]])
    return "".join(s)


def test_brute_force(spark):
    r = random.Random(5)
    items = [(i, words(r, r.randint(3, 45))) for i in range(12)] + [(99, None), (98, ""), (97, "tiny"), (3, words(r, 20)), (96, "aaaaaaaa" * 9)]
    docs = [(0, None), (1, ""), (2, "aaaaaaaa" * 40), (3, items[0][1]), (4, items[0][1].upper().replace(" ", ",\n  "))]
    for i in range(5, 60):
        item = r.choice(items[:12])[1]
        piece = item[r.randint(0, 20) :] if r.random() < 0.4 else item
        docs.append((i, words(r, r.randint(0, 20)) + " " + edit(r, piece, r.randint(0, 14)) + " " + words(r, r.randint(0, 20))))
    other = random.Random(55)
    docs += [(i, words(other, other.randint(20, 60))) for i in range(100, 125)]
    docs.append((60, words(r, 3000) + " " + items[1][1]))
    expected = brute(docs[:-1], items)
    df = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, contaminated int").repartition(5)
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = D.contamination(df, bench).collect()
    got = {x.doc_id: x.item_ids for x in rows}
    assert len(rows) == len(docs) and 1 in got[60]
    assert {i: v for i, v in got.items() if i != 60} == expected
    assert 10 < sum(map(bool, expected.values())) < len(expected) - 25
    clean = D.decontaminate(df, bench)
    assert clean.columns == df.columns
    assert sorted(x.doc_id for x in clean.collect()) == sorted(i for i, v in got.items() if not v)
    assert not any(x.contaminated for x in D.contamination(df, bench.limit(0)).collect())
    assert D.contamination(df.limit(0), bench).count() == 0


def test_several_passes(spark, monkeypatch):
    r = random.Random(6)
    items = [(i, words(r, 30)) for i in range(20)]
    docs = [(i, words(r, 30) + " " + items[i % 20][1]) for i in range(40)]
    monkeypatch.setattr(D, "PASS_CHARS", 500)
    got = D.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert all(x.item_ids == [x.doc_id % 20] for x in got)


def test_alignment():
    r = random.Random(8)
    for _ in range(300):
        p = "".join(r.choice("ab") for _ in range(r.randint(5, 30)))
        t = "".join(r.choice("ab") for _ in range(r.randint(0, 5))) + edit(r, p, r.randint(0, 4))
        a, b = (np.frombuffer(x.encode(), np.uint8) for x in (p, t))
        best = nearest(p.encode(), t.encode())
        assert D.align(a, b, 0, 5, 6) >= min(best, 7)
        assert best > 3 or D.align(a, b, -len(p), len(t), 6) == best


def found(item, text):
    """Whether 50 bytes of item, from anywhere, or all of a shorter item, stand in text within 8 % edits; a plain table over all starts at once."""
    p, t = (np.frombuffer(x, np.uint8) for x in (plain(item).rstrip(b" "), plain(text)))
    spans = {min(len(p), 50), len(p) if len(p) < 100 else 50}
    for n in spans:
        at = np.arange(len(p) - n + 1)
        row, place = np.zeros((len(at), len(t) + 1), np.int16), np.arange(len(t) + 1, dtype=np.int16)
        for i in range(n):
            new = row + 1
            new[:, 1:] = np.minimum(new[:, 1:], row[:, :-1] + (p[at + i][:, None] != t))
            row = np.minimum.accumulate(new - place, axis=1) + place
        if row.min() <= n * 8 // 100:
            return True
    return False


def search(items, texts):
    raw = [x.encode() for x in texts]
    return D.Benchmark(list(enumerate(items))).find(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(x) for x in raw])])


def test_verbatim_excerpts_at_every_offset():
    r = random.Random(11)
    item = "".join(r.choice("abcdefgh ") for _ in range(300)).replace("  ", "xy").strip()
    for length in (52, 60, 90, 120):
        texts = [words(r, 9) + " " + item[s : s + length] + " " + words(r, 9) for s in range(len(item) - length + 1)]
        assert search([item], texts) == [[0]] * len(texts)
    assert not any(search([item], [words(r, 9) + " " + item[s : s + 40] + " 12345678" for s in range(200)]))


def test_edited_excerpts_at_every_offset():
    r = random.Random(12)
    items = ["".join(r.choice("abcdefgh ") for _ in range(n)).replace("  ", "xy").strip() for n in (260, 90, 75, 60, 40)]
    texts = []
    for item in items:
        length = min(len(item), 70)
        texts += [words(r, 5) + " " + edit(r, item[s : s + length], r.randint(0, 12)) + " " + words(r, 5) for s in range(len(item) - length + 1) for _ in range(1 if len(item) > 200 else 9)]
        texts += [edit(r, item, r.randint(3, 9)) for _ in range(15)]
    got = search(items, texts)
    expected = [[n for n, item in enumerate(items) if found(item, x)] for x in texts]
    assert [sorted(set(x)) for x in got] == expected
    assert 60 < sum(map(bool, expected)) < len(texts) - 60


def test_stretches_are_counted_once():
    r = random.Random(13)
    item = "".join(r.choice("abcdefgh") for _ in range(300))
    assert search([item], [item + " 1 " + item, item[:80] + " 12345678 12345678 " + item[200:], item[:80] + item[60:150]]) == [[0], [0, 0], [0]]


def test_excerpts_in_tables(spark):
    r = random.Random(14)
    items = [(i, words(r, 40)) for i in range(5)]
    docs = [(i, words(r, 20) + " " + items[i % 5][1][i : i + 70] + " " + words(r, 20), i) for i in range(60)] + [(60, None, 0), (61, words(r, 60), 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, other int").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = D.contamination(df, bench).collect()
    assert {x.doc_id: x.item_ids for x in rows} == {i: [i % 5] if i < 60 else [] for i in range(62)}
    assert all((x.contaminated, x.n_regions) == (x.doc_id < 60, int(x.doc_id < 60)) for x in rows)
    clean = D.decontaminate(df, bench)
    assert clean.columns == df.columns and sorted(x.doc_id for x in clean.collect()) == [60, 61]


def test_short_items_need_the_whole_document(spark):
    items = [(1, "Yes, it is!"), (2, "tiny"), (3, "..."), (4, "tiny"), (None, "No")]
    docs = [(1, "yes it is"), (2, " YES -- it is. "), (3, "yes it is so"), (4, "tiny"), (5, ""), (6, "..."), (7, "no"), (8, None)]
    got = D.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {x.doc_id: (x.item_ids, x.n_regions) for x in got} == {1: ([1], 1), 2: ([1], 1), 3: ([], 0), 4: ([2, 4], 2), 5: ([], 0), 6: ([], 0), 7: ([], 1), 8: ([], 0)}


def test_errors_that_the_filter_cannot_bound(spark):
    one = spark.createDataFrame([(1, "x" * 60)], "item_id long, text string")
    with pytest.raises(ValueError):
        D.decontaminate(spark.createDataFrame([(1, "x")], "doc_id long, text string"), one, errors=0.2)


def test_many_places_are_looked_at_in_portions(monkeypatch):
    r = random.Random(15)
    items = ["ab" * 60, "a" * 90, "abc" * 40, words(r, 30), "ab" * 30 + words(r, 12), "tail " + "a" * 80]
    texts = ["ab" * 300, "a" * 500 + " " + items[3], "abc" * 100 + "ab" * 100, words(r, 50), items[4], "a" * 500, "", "abd" * 200]
    whole = [sorted(x) for x in search(items, texts)]
    monkeypatch.setattr(D, "EXPANDED", 5_000)
    assert [sorted(x) for x in search(items, texts)] == whole
    assert [set(x) for x in whole] == [{n for n, item in enumerate(items) if found(item, x)} for x in texts]


def test_long_and_repeated_documents(spark):
    r = random.Random(16)
    items = [(i, words(r, 40)) for i in range(6)]
    long = words(r, 60_000) + " " + items[4][1] + " " + words(r, 60_000)
    docs = [(1, long), (1, long), (2, words(r, 120_000)), (3, items[2][1]), (3, items[2][1]), (3, "clean")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = D.contamination(df, spark.createDataFrame(items * 2, "item_id long, text string")).collect()
    assert sorted((x.doc_id, x.item_ids, x.n_regions) for x in got) == [(1, [4], 1), (1, [4], 1), (2, [], 0), (3, [], 0), (3, [2], 1), (3, [2], 1)]


def test_a_portion_reads_each_part_once(spark, monkeypatch):
    """A benchmark of many times the bytes that a worker holds, searched for in three portions of texts."""
    import pyarrow as pa

    monkeypatch.setattr(D, "PASS_CHARS", 400)
    r = random.Random(3)
    items = [(i, words(r, 20)) for i in range(60)]
    folder, parts = D.build(spark.createDataFrame(items, "item_id long, text string"), D.ERRORS)
    read, real = [], D.pickle.loads
    monkeypatch.setattr(D.pickle, "loads", lambda raw: read.append(len(raw)) or real(raw))
    D.Parts(folder, parts).find([pa.array(["x"])])
    total, there = sum(read), len(read)
    assert there >= 8
    monkeypatch.setattr(D, "HELD_BYTES", total // 4)
    docs = [(i, words(r, 30) + " " + (items[i % 60][1] if i % 3 == 0 else "") + " " + words(r, 5)) for i in range(90)]
    table = pa.table({"doc_id": [i for i, _ in docs], "text": [t for _, t in docs]})
    monkeypatch.setattr(D, "PORTION", table.column("text").nbytes // 3)
    read.clear()
    known, got = D.Parts(folder, parts), {}
    for batch, ids, _ in D.searched(iter(table.to_batches(5)), known):
        got |= dict(zip(batch.column(0).to_pylist(), map(sorted, ids), strict=True))
    assert got == {i: [i % 60] if i % 3 == 0 else [] for i, _ in docs}
    assert there <= len(read) <= 3 * there - 2  # three portions, and what is held is not read again
