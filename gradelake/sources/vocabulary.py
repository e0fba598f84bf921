"""Byte-level vocabularies from public tokenizer files: ids are decoded by Column expressions, texts are measured in Arrow batches.

The id of a token is its place in one constant array, so that decoding is a lookup by position on the JVM: no worker process and no join. Bytes that are not
UTF-8 become U+FFFD, special tokens are left out, and a list with an id that the vocabulary does not have decodes to null, as a null list does.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from gradelake.functions import native as N


@lru_cache(4)
def _encoder(raw: bytes):
    from tokenizers import Tokenizer

    return Tokenizer.from_str(raw.decode())


def _bytes_of() -> dict[str, str]:
    """Hex digits of the byte that each character of a byte-level vocabulary stands for: printable ones for themselves, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): f"{b:02x}" for b in plain} | {chr(256 + i): f"{b:02x}" for i, b in enumerate(rest)}


class Vocabulary:
    """A vocabulary from a tokenizer file; ``opening`` and ``closing`` are the ids of the reasoning marks, ``stops`` the special tokens that end a rollout."""

    def __init__(self, spark: SparkSession, path: str, opening: str = "<think>", closing: str = "</think>") -> None:
        source, inner = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
        with source.open_input_stream(inner) as f:
            raw = f.read()
        spec = json.loads(raw)
        special = {t["id"]: t["content"] for t in spec.get("added_tokens", []) if t.get("special")}
        size = max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec.get("added_tokens", []))]) + 1
        hexes, alphabet = ["" for _ in range(size)], _bytes_of()
        for token, i in spec["model"]["vocab"].items():
            hexes[i] = "".join(alphabet[c] for c in token) if i not in special else ""
        for t in spec.get("added_tokens", []):
            hexes[t["id"]] = "" if t.get("special") else t["content"].encode().hex()
        self.size, self.stops, self._hexes = size, sorted(special), ",".join(hexes)
        self._raw = spark.sparkContext.broadcast(raw)
        self._own = raw
        self.opening, self.closing = self.ids(opening), self.ids(closing)

    def ids(self, text: str) -> list[int]:
        """Ids of a text, on the driver; for the few marks and templates of a protocol."""
        return _encoder(self._own).encode(text, add_special_tokens=False).ids

    def text(self, ids: Column) -> Column:
        """The text of an array of ids."""
        hexes = F.split(F.lit(self._hexes), ",")  # one constant, folded when the query is planned
        joined = F.array_join(F.transform(ids, lambda i: F.get(hexes, i)), "")
        inside = ~F.coalesce(F.exists(ids, lambda i: i.isNull() | (i < 0) | (i >= self.size)), F.lit(True))
        return F.when(inside, N.strip(F.make_valid_utf8(F.unhex(joined).cast("string"))))

    def length(self, text: Column) -> Column:
        """How many ids a text has; null for null."""
        shared = self._raw

        @F.pandas_udf("int")
        def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            encoder = _encoder(shared.value)
            for x in parts:
                yield x.map(lambda t: None if t is None else len(encoder.encode(t, add_special_tokens=False).ids)).astype("Int32")

        return count(text)
