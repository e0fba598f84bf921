import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from gradelake.llm import packing as P
from gradelake.llm import pieces as C
from gradelake.llm.bpe import read, vocabulary
from tests.llm.test_op4 import texts

SCHEMA = "doc_id long, text string, part int, n long, ids string"


@pytest.fixture(scope="module")
def public():
    return Tokenizer.from_file(vocabulary())


@pytest.fixture(scope="module")
def coder():
    return C.PieceCoder(read(vocabulary()))


MORE = ["it's he'll 'rest' ''s x'd'm 'S\n's 　's '", "a" * 5000 + "  " + "b'", "a\x00b \x00\x00 c", "'re", "'r", "'", "x'", " '", "l'l'll", "日本's", "\x85\x85a  b"]


@pytest.mark.parametrize("segment", [1 << 21, 64])
def test_ids_equal_the_library(coder, public, monkeypatch, segment):
    monkeypatch.setattr(C, "SEGMENT", segment)
    every = [*texts(), *MORE, None]
    for text, ids in zip(every, coder.encode(pa.array(every)), strict=True):
        assert ids.tolist() == public.encode(text or "", add_special_tokens=False).ids, text


@pytest.mark.parametrize("text", ["a" * 100_000, "é😀" * 8_000, " " * 50_000 + "end", "long words and " * 20_000, "𝔘nicode\n" * 5_000, "x1y2" * 10_000 + " <|endoftext|>" + "y " * 9_000], ids=range(6))
def test_long_texts(coder, public, monkeypatch, text):
    monkeypatch.setattr(C, "SEGMENT", 10_000)
    assert next(coder.encode(pa.array([text]))).tolist() == public.encode(text, add_special_tokens=False).ids


def test_other_files_are_refused():
    import json

    spec = json.loads(read(vocabulary()))
    with pytest.raises(ValueError):
        C.PieceCoder(json.dumps(spec | {"normalizer": {"type": "Lowercase"}}).encode())


def check(docs, got, public, size):
    """Brute force: each document's ids once, in pieces that tile it, and sequences without a gap."""
    left = {}
    for i, t in docs:
        left.setdefault(i, []).append(public.encode(t or "", add_special_tokens=False).ids + [0])
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(left)
    for i, rows in by_doc.items():
        rows = sorted(rows, key=lambda r: (r.sequence_id, r.offset))
        for ids in sorted(left[i], key=len) if len(left[i]) == 1 else left[i]:
            at = 0
            while at < len(ids):
                r = next(r for r in rows if r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes()))
                rows.remove(r)
                at += r.length
        assert not rows
    total = sum(len(ids) for many in left.values() for ids in many)
    assert sorted(by_sequence) == list(range(-(-total // size)))
    for s, rows in by_sequence.items():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at == (size if s + 1 < len(by_sequence) else total - size * s)


@pytest.mark.parametrize("size, run", [(1024, 1 << 20), (16, 100), (7, 5)])
def test_against_brute_force(spark, public, monkeypatch, size, run):
    monkeypatch.setattr(P, "RUN", run)
    monkeypatch.setattr(P, "BATCH_BYTES", 2000)
    r = random.Random(size)
    few = [None, "", *r.sample(list(texts()), 150), *MORE, "word " * 3000]
    docs = [(i if i % 9 else None, t) for i, t in enumerate(few)] + [(3, "twice"), (3, "twice")]
    df = spark.createDataFrame([(*d, 1, 2, "x") for d in docs], SCHEMA).repartition(4)
    table = P.encoded(df, vocabulary())
    got = P.pieces(table, size).collect()
    check(docs, got, public, size)
    whole = {x.sequence_id: x for x in P.sequences(table, size, 9).collect()}
    assert sorted(whole) == sorted({x.sequence_id for x in got})
    for s, x in whole.items():
        rows = sorted((p for p in got if p.sequence_id == s), key=lambda p: p.offset)
        assert x.n_tokens == sum(p.length for p in rows) and len(x.ids) == P.padded(x.n_tokens, size) and set(x.ids[x.n_tokens :]) <= {9}
        for p in rows:
            assert zlib.crc32(np.array(x.ids[p.offset : p.offset + p.length], "<u4").tobytes()) == p.ids_crc32


def test_given_table(spark, public):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(docs, P.op12_packing(spark, sf).collect(), public, 1024)


def test_empty_table(spark):
    table = P.encoded(spark.createDataFrame([], SCHEMA), vocabulary())
    assert P.pieces(table).count() == 0 == P.sequences(table).count()


def test_padding():
    assert [P.padded(n) for n in (1, 2, 3, 512, 513, 1023, 1024)] == [1, 2, 1024, 512, 1024, 1024, 1024]
