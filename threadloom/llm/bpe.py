"""Byte-pair encoding and decoding with a contiguous rank array.

A word (a piece of the pre-tokenizer) is held as an array of part ids beside an
array of the ranks of adjacent pairs. The smallest rank is searched by a scan,
its boundary deleted and the two neighbouring ranks refreshed. Long words take
a heap over linked parts instead, with the same merges in the same order.

Null texts count as empty and give no ids. Strings of special tokens in a text
become those tokens, as the tokenizers library does by default. Rows are kept
one to one with all their columns; an output column replaces one of its name.
"""

from __future__ import annotations

import heapq
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, types as T

from .common import slices

#: Pre-tokenizer pattern of the byte-level vocabulary (fixed value).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG_WORD, CACHE_WORDS, NONE = 256, 700_000, 1 << 62


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the rest from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in shown}
    rest = [b for b in range(256) if b not in set(shown)]
    return letters | {chr(256 + k): b for k, b in enumerate(rest)}


class RankBpe:
    """A byte-level BPE vocabulary read from a tokenizers file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        suffix = spec["model"].get("end_of_word_suffix") or ""
        self.bytes_of = {i: bytes(letters[c] for c in token.removesuffix(suffix)) for token, i in vocab.items()}
        self.byte_id, self.last_id = [0] * 256, [0] * 256
        for letter, b in letters.items():
            self.byte_id[b], self.last_id[b] = vocab[letter], vocab[letter + suffix]
        self.pair: dict[int, int] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            self.pair.setdefault(vocab[a] << 20 | vocab[b], rank << 20 | vocab[a + b])
        self.chunks: dict[str, bytes] = {}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pieces = regex.compile(PIECES)
        self.cache: dict[str, bytes] = {}

    def encode_word(self, word: bytes) -> list[int]:
        parts = [self.byte_id[b] for b in word]
        parts[-1:] = [self.last_id[b] for b in word[-1:]]
        if len(parts) > LONG_WORD:
            return self._encode_long(parts)
        get = self.pair.get
        ranks = [get(a << 20 | b, NONE) for a, b in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == NONE:
                break
            at = ranks.index(least)
            parts[at] = least & 0xFFFFF
            del parts[at + 1], ranks[at]
            if at < len(ranks):
                ranks[at] = get(parts[at] << 20 | parts[at + 1], NONE)
            if at:
                ranks[at - 1] = get(parts[at - 1] << 20 | parts[at], NONE)
        return parts

    def _encode_long(self, parts: list[int]) -> list[int]:
        get, n = self.pair.get, len(parts)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(m, i, parts[i], parts[i + 1]) for i in range(n - 1) if (m := get(parts[i] << 20 | parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            m, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j < 0 or parts[j] != b:
                continue
            parts[i], parts[j], after[i] = m & 0xFFFFF, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right >= 0 and (m := get(parts[left] << 20 | parts[right])) is not None:
                    heapq.heappush(heap, (m, left, parts[left], parts[right]))
        return [p for p in parts if p >= 0]

    def pieces_packed(self, text: str) -> bytes:
        """Ids of a text by its pre-tokenizer's pieces, each encoded once and remembered."""
        words, cache = self.pieces.findall(text), self.cache
        if len(cache) > CACHE_WORDS:
            cache.clear()
        for w in words:
            if w not in cache:
                cache[w] = np.array(self.encode_word(w.encode()), np.int32).tobytes()
        return b"".join([cache[w] for w in words])

    def _words(self, text: str) -> bytes:
        """A text with single spaces and newlines only falls into chunks at them: no piece reaches over one."""
        first, *rest = parts = text.replace("\n", " \n").split(" ")
        if "" in parts or "\n" in parts or len(text.split()) != len(parts):
            return self.pieces_packed(text)
        chunks = self.chunks
        try:
            return self.pieces_packed(first) + b"".join([chunks[w] for w in rest])
        except KeyError:
            if len(chunks) > CACHE_WORDS:
                chunks.clear()
            for w in rest:
                if w not in chunks:
                    chunks[w] = self.pieces_packed(w if w[0] == "\n" else " " + w)
            return self.pieces_packed(first) + b"".join([chunks[w] for w in rest])

    def encode_packed(self, text: str | None) -> bytes:
        """Ids as native 32-bit integers."""
        if not text:
            return b""
        if not any(x in text for x in self.special):
            return self._words(text)
        return b"".join(np.int32(self.special[p]).tobytes() if p in self.special else self._words(p) for p in self.split_special.split(text) if p)

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_packed(text), np.int32).tolist()

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def vocabulary(path: str) -> RankBpe:
    return RankBpe(path)


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """Add `ids` (array<int>), and on request `decoded`, the text that these ids decode to."""
    new = [(ids, T.ArrayType(T.IntegerType(), False))] + ([(decoded, T.StringType())] if decoded else [])
    own = [f for f in df.schema.fields if f.name not in dict(new)]
    schema = T.StructType([*own, *(T.StructField(n, t) for n, t in new)])
    names = [f.name for f in own]

    def run(batches):
        bpe = vocabulary(path)
        for batch in batches:
            for part in slices(batch):
                packed = [bpe.encode_packed(t) for t in part.column(text).to_pylist()]
                ends = np.cumsum([0, *(len(p) // 4 for p in packed)], dtype=np.int32)
                flat = np.frombuffer(b"".join(packed), np.int32)
                columns = [part.column(n) for n in names] + [pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]
                if decoded:
                    whole = flat.tolist()
                    columns.append(pa.array([bpe.decode(whole[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=[*names, *dict(new)])

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add the text that `ids` decode to; null ids give an empty text."""
    own = [f for f in df.schema.fields if f.name != text]
    names = [f.name for f in own]

    def run(batches):
        bpe = vocabulary(path)
        for batch in batches:
            for part in slices(batch):
                texts = [bpe.decode(x or ()) for x in part.column(ids).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(texts, pa.string())], names=[*names, text])

    return df.mapInArrow(run, T.StructType([*own, T.StructField(text, T.StringType())]))
