"""Byte-level BPE ids of many texts at once: pieces are found by array operations, and each distinct piece of a segment is encoded once.

The public byte-level pattern cuts a text into contractions, words, numbers, runs of other characters (each with one space before it) and white space.
Here the borders of all pieces of many texts come from the classes of their code points, in a few numpy passes without a regular expression; Arrow
numbers the distinct pieces, the merges run once on each, in one call, and the ids are gathered back. Texts longer than a segment are cut
where no piece can span.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken

from gradelake.llm.bpe import byte_alphabet
from gradelake.llm.textcore import SPACE, segments

OTHER, LETTER, NUMBER, WHITE = range(4)
#: Bytes of text handled together.
SEGMENT = 1 << 21


@lru_cache(1)
def kinds() -> np.ndarray:
    """The class of every code point."""
    out = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (WHITE, r"\s+")):
        for found in regex.finditer(pattern, every):
            gap = 0x800 if found.start() >= 0xD800 else 0
            out[found.start() + gap : found.end() + (0x800 if found.end() > 0xD800 else 0)] = kind
    return out


def code_points(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, and where each starts."""
    if not len(raw) or raw.max() < 0x80:
        return raw.astype(np.int32), np.arange(len(raw))
    lead = np.flatnonzero((raw & 0xC0) != 0x80)
    out = raw[lead].astype(np.int32)
    for low, high, more in ((0xC0, 0xE0, 1), (0xE0, 0xF0, 2), (0xF0, 0x100, 3)):
        at = np.flatnonzero((out >= low) & (out < high) & (raw[lead] >= low))
        value = raw[lead[at]].astype(np.int32) & (0x3F >> more)
        for k in range(1, more + 1):
            value = value << 6 | (raw[lead[at] + k] & 0x3F)
        out[at] = value
    return out, lead


def piece_starts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions at which pieces start, in texts that lie behind each other in ``raw``."""
    points, lead = code_points(raw)
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = kinds()[points]
    first = np.zeros(n + 1, bool)  # first code points of texts
    first[np.searchsorted(lead, offsets)] = True
    first = first[:n]
    run = np.r_[True, kind[1:] != kind[:-1]] | first
    begin = run.copy()
    # The last white character before other text stands alone, or belongs to that text if it is a space.
    behind = np.flatnonzero(run & (kind != WHITE) & ~first)
    behind = behind[kind[behind - 1] == WHITE]
    begin[behind - 1] = True
    begin[behind] = points[behind - 1] != 0x20
    # Contractions: an apostrophe at a piece's start and one or two letters.
    at = np.flatnonzero((points[:-1] == 0x27) & begin[:-1] & run[:-1] & (kind[1:] == LETTER) & ~first[1:])
    if len(at):
        one, two = points[at + 1], points[np.minimum(at + 2, n - 1)]
        inside = (at + 2 < n) & ~first[np.minimum(at + 2, n - 1)]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = inside & (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
        for chosen, size in ((at[short], 2), (at[long], 3)):
            begin[chosen + 1] = False
            ends = chosen + size
            begin[ends[ends < n]] = True
    return lead[begin]


class PieceCoder:
    """Encoder for a byte-level BPE file (its bytes). A file with other steps than the byte-level ones is refused."""

    def __init__(self, vocabulary: bytes) -> None:
        spec = json.loads(vocabulary)
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        plain = spec.get("normalizer") is None and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        own = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        flags = any(t.get(k) for t in spec.get("added_tokens", []) for k in ("lstrip", "rstrip", "single_word", "normalized"))
        alphabet, vocab = byte_alphabet(), model["vocab"]
        pairs = [tuple(p) if isinstance(p, list) else tuple(p.split(" ")) for p in model["merges"]]
        made = [vocab[a + b] for a, b in pairs]
        if not (plain and own) or flags or any(b <= a for a, b in zip(made, made[1:])):
            raise ValueError("only byte-level BPE files whose ids follow their merges are read")
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(alphabet[c] for c in t): i for t, i in vocab.items() if t not in self.special}
        self.merges = tiktoken.Encoding("pieces", pat_str=r"[^\x00]+|\x00", mergeable_ranks=ranks, special_tokens={})
        self.whole = tiktoken.Encoding("whole", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})
        self.between = ranks[b"\x00"]
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.largest = max([*vocab.values(), *self.special.values()])

    def distinct(self, pieces: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces behind each other, and how many each has: one call encodes them, joined by a character that none of them holds."""
        odd = pc.match_substring(pieces, "\x00")
        if pc.any(odd).as_py():
            each = [np.array(self.whole.encode_ordinary(p), np.uint32) for p in pieces.to_pylist()]
            return np.concatenate(each), np.array(list(map(len, each)), np.int64)
        joined = pc.binary_join(pa.ListArray.from_arrays([0, len(pieces)], pieces), "\x00")[0].as_py()
        ids = self.merges.encode_to_numpy(joined)
        gap = np.flatnonzero(ids == self.between)
        return np.delete(ids, gap), np.diff(np.r_[-1, gap, len(ids)]) - 1

    def _together(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a segment, and n + 1 offsets of each text's ids."""
        starts = piece_starts(raw, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        bounds = np.r_[starts, len(raw)].astype(np.int32)
        numbered = pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(raw))).dictionary_encode()
        flat, size = self.distinct(numbered.dictionary)
        codes = numbered.indices.to_numpy()
        each = size[codes]
        ends = np.cumsum(each)
        ids = flat[np.arange(int(ends[-1])) + np.repeat((np.cumsum(size) - size)[codes] - (ends - each), each)]
        return ids, np.r_[0, ends][np.searchsorted(starts, offsets)]

    def _alone(self, text: str) -> np.ndarray:
        """Ids of one text that is long or holds strings of special tokens."""
        out = []
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.special:
                out.append(np.array([self.special[part]], np.uint32))
                continue
            raw = np.frombuffer(part.encode(), np.uint8)
            for chunk in chunks(raw):
                out.append(self._together(chunk, np.array([0, len(chunk)]))[0])
        return np.concatenate(out)

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, in order; a null has none."""
        texts = texts.fill_null("").cast(pa.large_string())
        odd = np.zeros(len(texts), bool)
        for token in self.special:
            odd |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        for first, last, raw, offsets in segments(texts, SEGMENT):
            ids, ends = (None, None) if len(raw) > SEGMENT else self._together(raw, offsets)
            for k in range(first, last):
                yield self._alone(texts[k].as_py()) if ids is None or odd[k] else ids[ends[k - first] : ends[k - first + 1]]


def chunks(raw: np.ndarray) -> Iterator[np.ndarray]:
    """Parts of a long text of about a segment each, cut before a space behind a visible ASCII character: no piece spans such a place."""
    start = 0
    while start < len(raw):
        end = start + SEGMENT
        while end < len(raw):
            window = raw[end - 1 : end + 4096]
            found = np.flatnonzero((window[1:] == 0x20) & (window[:-1] < 0x7F) & (window[:-1] > 0x20) & ~SPACE[window[:-1]])
            if len(found):
                end += int(found[0])
                break
            end += 4096
        yield raw[start : min(end, len(raw))]
        start = min(end, len(raw))


@lru_cache(2)
def piece_coder(vocabulary: bytes) -> PieceCoder:
    return PieceCoder(vocabulary)
