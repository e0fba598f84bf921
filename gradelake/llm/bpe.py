"""Byte-pair encoding and decoding by per-prefix dynamic programming.

For every prefix of a piece of text exactly one vocabulary token can be the last token of the prefix's encoding. An automaton over
the vocabulary lists, at each position, all tokens that are suffixes of the prefix; a candidate is the last token if it is compatible
with the last token of the prefix before it. Following these stored tokens back from the end emits the ids, in linear time for any
length of piece. No merge queue is run over the text.

Rows: a null or empty text has no ids (digests of nothing). Equal rows give equal results, one each. Extra columns, whatever their
names, are ignored. Texts are encoded whole, in Arrow batches without any shuffle.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import regex
from pyspark.sql import DataFrame, SparkSession

from gradelake.llm.shared import release
from gradelake.llm.textcore import column

#: Pieces of at most this many characters are remembered, up to twice this many, and so many pairs of tokens (about 100 MB a
#: worker); a task forgets them at its end.
MEMO_CHARS, MEMO_SIZE, PAIRS = 48, 1 << 18, 1 << 18
#: Token ids are packed as little-endian unsigned 32-bit integers.
ID = "<u4"
#: The public byte-level pre-tokenizer's pattern, and its space characters.
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[str, int]:
    """Character that stands for each byte in byte-level vocabularies: printable ones for themselves, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def read(path: str) -> bytes:
    source, inner = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
    with source.open_input_stream(inner) as f:
        return f.read()


class Bpe:
    """Encoder and decoder for a byte-level BPE vocabulary, from a file's path or its bytes."""

    def __init__(self, vocabulary: str | bytes) -> None:
        spec = json.loads(vocabulary if isinstance(vocabulary, bytes) else read(vocabulary))
        alphabet = byte_alphabet()
        vocab = spec["model"]["vocab"]
        raw = {token: bytes(alphabet[c] for c in token) for token in vocab}
        self.bytes_of: dict[int, bytes] = {i: raw[token] for token, i in vocab.items()}
        self.special: dict[str, int] = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.rank: dict[tuple[int, int], int] = {}  # of the merge that joins two tokens
        self.made: dict[int, tuple[int, int, int]] = {}  # token -> rank, left and right of the merge that makes it
        for r, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b, c = vocab[left], vocab[right], vocab[left + right]
            self.rank.setdefault((a, b), r)
            self.made.setdefault(c, (r, a, b))
        self.piece = regex.compile(PIECE)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.memo: dict[str, bytes] = {}  # pieces met lately, and those before
        self.older: dict[str, bytes] = {}
        self.fits: dict[int, bool] = {}  # by left * 2**32 + right
        self.wholes: dict[int, bool] = {}
        self.spines: dict[tuple[int, int], list[tuple[int, float]]] = {}
        self.packed = {i: (len(raw[token]), np.array([i], ID).tobytes()) for token, i in vocab.items()}
        self.automaton = ahocorasick.Automaton()
        for token, i in vocab.items():
            if self.whole(i):
                self.automaton.add_word(raw[token].decode("latin-1"), (len(raw[token]), i))
        self.automaton.make_automaton()

    def spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """The tokens that stand at the left (1) or right (2) edge while a token is being made, each with the rank at which it ends."""
        found = self.spines.get((token, side))
        if found is None:
            found, end, now = [], float("inf"), token
            while True:
                found.append((now, end))
                if now not in self.made:
                    break
                end, now = self.made[now][0], self.made[now][side]
            self.spines[token, side] = found
        return found

    def compatible(self, left: int, right: int) -> bool:
        """Whether the encoding of the two tokens' joint text is just these two: no merge across the border fires while both of its sides stand.

        Of merges of one rank the leftmost fires first: one inside the left token comes before, one inside the right token after the border's.
        """
        key = left << 32 | right
        found = self.fits.get(key)
        if found is None:
            found = True
            for a, a_end in self.spine(left, 2):
                for b, b_end in self.spine(right, 1):
                    r = self.rank.get((a, b))
                    if r is not None and r < a_end and r <= b_end:
                        found = False
                        break
                if not found:
                    break
            if len(self.fits) > PAIRS:
                self.fits.clear()
            self.fits[key] = found
        return found

    def whole(self, token: int) -> bool:
        """Whether a token's own text is encoded as that token: only its own merge, no earlier one, crosses the border of its two halves."""
        found = self.wholes.get(token)
        if found is None:
            found = token not in self.made
            if not found:
                own, left, right = self.made[token]
                crossing = (self.rank.get((a, b), own) < min(own, a_end, b_end + 1) for a, a_end in self.spine(left, 2) for b, b_end in self.spine(right, 1))
                found = not any(crossing) and self.whole(left) and self.whole(right)
            self.wholes[token] = found
        return found

    def last_tokens(self, text: bytes) -> list[int]:
        """For each prefix of a piece (by its length) the last token of its encoding; index 0 is unused."""
        return self._last(text.decode("latin-1"))

    def _last(self, text: str) -> list[int]:
        last, fits = [-1] * (len(text) + 1), self.fits
        for at, (size, token) in self.automaton.iter(text):
            end = at + 1
            if last[end] >= 0:
                continue
            start = end - size
            if start:
                before = last[start]
                if before >= 0:
                    fit = fits.get(before << 32 | token)
                    if self.compatible(before, token) if fit is None else fit:
                        last[end] = token
            else:
                last[end] = token
        return last

    def encode_piece(self, piece: str) -> bytes:
        last = self._last(piece if piece.isascii() else piece.encode().decode("latin-1"))
        ids, end = [], len(last) - 1
        while end:
            token = last[end]
            if token < 0:
                raise ValueError(f"no token of the vocabulary ends at byte {end} of {piece[:40]!r}")
            size, packed = self.packed[token]
            ids.append(packed)
            end -= size
        ids.reverse()
        return b"".join(ids)

    def _remembered(self, piece: str) -> bytes:
        found = self.memo.get(piece)
        if found is None:
            found = self.older.get(piece) or self.encode_piece(piece)
            if len(piece) <= MEMO_CHARS:
                if len(self.memo) >= MEMO_SIZE:
                    self.memo, self.older = {}, self.memo
                self.memo[piece] = found
        return found

    def encode(self, text: str) -> bytes:
        """Packed ids of a text; strings of special tokens in it become those tokens."""
        out = []
        for part in self.cut.split(text) if self.cut and any(s in text for s in self.special) else (text,):
            if part in self.special:
                out.append(np.array([self.special[part]], ID).tobytes())
            else:
                out += map(self._remembered, self.piece.findall(part))
        return b"".join(out)

    def forget(self) -> None:
        self.memo, self.older = {}, {}
        self.fits.clear()

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")


@lru_cache(2)
def bpe(vocabulary: bytes) -> Bpe:
    return Bpe(vocabulary)


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_documents(docs: DataFrame, path: str, ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row, with the ids themselves (array) if asked for. Ties do not occur.

    The vocabulary file is read by the driver and broadcast (a few MB, as large as the file), so that executors need not have its folder."""
    shared = docs.sparkSession.sparkContext.broadcast(read(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                packed = [coder.encode(t or "") for t in column(part, "text").to_pylist()]
                arrays = [np.frombuffer(p, ID) for p in packed]
                decoded = [hashlib.sha256(coder.decode(a).encode()).hexdigest() for a in arrays]
                out = [column(part, "doc_id").cast(pa.int64()), pa.array([len(a) for a in arrays], pa.int64()), pa.array([hashlib.sha256(p).hexdigest() for p in packed]), pa.array(decoded)]
                if ids:
                    offsets = np.r_[0, np.cumsum([len(a) for a in arrays])].astype(np.int32)
                    out.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays).astype(np.int32) if arrays else [], pa.int32())))
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(out)])
        coder.forget()
        release()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA + (", ids array<int>" if ids else ""))


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary())
