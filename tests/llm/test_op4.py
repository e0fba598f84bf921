import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from gradelake.llm.bpe import Bpe, encode_documents, vocabulary


@pytest.fixture(scope="module")
def coder():
    return Bpe(vocabulary())


@pytest.fixture(scope="module")
def public():
    return Tokenizer.from_file(vocabulary())


def texts():
    r = random.Random(7)
    alphabet = ["a", "aa", "the", " the", "ing", "'s", "'ll", "  ", "\n", "\t", " ", "　", "é", "ß", "日本", "😀", "<|endoftext|>", "<|endof", "12", "٣", "!", "...", "\x1c", "\x85", "​", "A", "zz", "\r\n", "\x00", "é"]
    yield from ["", " ", "  ", "a" * 3000, "ab" * 500, "\n" * 77, "hello world", "<|endoftext|>", "x<|endoftext|><|endoftext|> y"]
    for _ in range(1500):
        yield "".join(r.choice(alphabet) for _ in range(r.randint(1, 30)))
    for _ in range(300):
        yield "".join(chr(r.choice([r.randint(32, 126), r.randint(160, 1500), r.randint(0x4E00, 0x4F00)])) for _ in range(r.randint(1, 60)))


def test_equal_to_the_library(coder, public):
    for text in texts():
        expected = public.encode(text, add_special_tokens=False).ids
        got = np.frombuffer(coder.encode(text), "<u4")
        assert got.tolist() == expected, text
        assert coder.decode(got) == public.decode(expected, skip_special_tokens=False) == text


def test_every_prefix_has_the_greedy_encoding(coder, public):
    word = b"internationalisationaaaaaa"
    last = coder.last_tokens(word)
    for n in range(1, len(word) + 1):
        assert last[n] == public.encode(word[:n].decode(), add_special_tokens=False).ids[-1]


def test_rows(spark):
    rows = [(1, None, 5), (2, "", 6), (3, "the cat", 7), (3, "the cat", 7), (None, "x", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted(encode_documents(df, vocabulary(), ids=True).collect(), key=str)
    assert len(got) == 5
    nothing = hashlib.sha256(b"").hexdigest()
    assert all(r.n_tokens == 0 and r.ids_sha256 == nothing == r.decoded_sha256 for r in got if r.doc_id in (1, 2))
    assert all(r.decoded_sha256 == hashlib.sha256(b"the cat").hexdigest() and len(r.ids) == r.n_tokens for r in got if r.doc_id == 3)
    assert encode_documents(df.limit(0), vocabulary()).count() == 0


@pytest.mark.parametrize("text", ["a" * 20_000, "ab" * 15_000, "é😀" * 8_000, "x1y2" * 10_000, " " * 20_000 + "end", "long words and " * 20_000, "𝔘nicode\n" * 5_000, "=" * 30_001], ids=range(8))
def test_long_texts(coder, public, text):
    ids = np.frombuffer(coder.encode(text), "<u4")
    assert ids.tolist() == public.encode(text, add_special_tokens=False).ids
    assert coder.decode(ids) == public.decode(ids.tolist(), skip_special_tokens=False)
