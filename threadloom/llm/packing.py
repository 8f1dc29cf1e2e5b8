"""Packing into windows of equal size by the online sum-of-squares rule.

A document's tokens fill whole windows as far as they go. The rest, smaller
than a window, is placed whole: into the fill level that makes the sum over all
levels of (number of windows partially filled to it) squared least, a new
window being one of the choices. The numbers stand in an array by level. Each
task packs the rows it reads. The pieces in windows that stay open at its end, a
small remainder of a large task, go on to a second round: those of up to `fan_in`
tasks (with 1,024 open windows each 256 MB at most) are placed by the same rule
into one array, so that small tasks too fill their windows by it. What is open
after that, or beyond `max_open` windows, is poured together and cut where a
window is full. The last, partly filled window of a group is cut into lengths
that are powers of two, which need no padding. `closed_by` tells what filled a
piece's window: `document`, `rule` or `pour`.

A null text counts as empty; an empty document has the end token alone.
Repeated rows are packed each for itself, an empty table gives no pieces, and
columns other than doc_id and text are ignored. The order of rows within a task is
the table's, and the second round sorts by it, so a repeated task gives the same result.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import materialise, slices

#: Pre-tokenizer pattern of the lower-casing vocabulary (fixed value).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Texts beyond these letters go through the library whole; for these, its normalizer is str.lower.
PLAIN = re.compile("[^\t\n\r\x20-\x7e¡-įı-ſ‐-‧]")
CACHE_WORDS = 700_000
#: Marks that are a piece of their own after letters, at the end of a word.
MARKS = frozenset(".,;:!?\"')")


class WordEncoder:
    """Ids of the tokenizers library. Plain texts are cut at white space, over which no piece of its pre-tokenizer reaches, and the parts are remembered."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        suffix = model.get("end_of_word_suffix")
        #: Whether an id is the last of its piece: a token with the suffix.
        self.last = np.zeros(max(model["vocab"].values()) + 1, bool)
        self.last[[i for token, i in model["vocab"].items() if suffix and token.endswith(suffix)]] = True
        self.pieces, self.parts, self.known = regex.compile(WORDS), {}, {}

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, words: set[str]) -> None:
        """Remember the ids of words: of all their new pieces by one call of the library, with white space between them."""
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        plain, cut = [], {}
        for w in words:
            if w.isalpha():  # one piece, as is a mark after letters
                plain.append(w)
            elif w[-1] in MARKS and w[:-1].isalpha():
                cut[w] = (w[:-1], w[-1])
            else:
                cut[w] = self.pieces.findall(w)
        new = [*{p for pieces in (plain, *cut.values()) for p in pieces if p not in known}]
        if new:
            ids = self._ids(" ".join(new))
            ends = (4 * (np.flatnonzero(self.last[np.frombuffer(ids, "<u4")]) + 1)).tolist()
            if len(ends) == len(new):
                known.update((p, ids[a:b]) for p, a, b in zip(new, [0, *ends], ends))
            else:  # a vocabulary whose pieces do not end by such a token
                known.update((p, self._ids(p)) for p in new)
        parts = self.parts
        for w in plain:
            parts[w] = known[w]
        for w, pieces in cut.items():
            parts[w] = b"".join([known[p] for p in pieces])

    def packed(self, text: str | None) -> bytes:
        """Little-endian 32-bit ids."""
        if not text:
            return b""
        if PLAIN.search(text) or self.special and self.special.search(text):
            return self._ids(text)
        words, parts = text.lower().split(), self.parts
        try:
            return b"".join([parts[w] for w in words])
        except KeyError:
            if len(parts) > CACHE_WORDS:
                parts.clear()
            self._learn({w for w in words if w not in parts})
            return b"".join([parts[w] for w in words])


@lru_cache(maxsize=4)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


class SumOfSquares:
    """Open windows by fill level. A piece is (document, start, ids as bytes)."""

    def __init__(self, size: int, max_open: int):
        self.size, self.max_open = size, max_open
        self.count = np.zeros(size + 1, np.int64)
        self.open: list[list[list]] = [[] for _ in range(size)]
        self.n_open = self.pours = 0

    def level(self, length: int) -> int:
        """The level whose growth by `length` adds least to the sum of squares; 0 is a new window. Ties go to the fullest."""
        fits = self.count[1 : self.size - length + 1]
        change = 2 * (self.count[length + 1 :] - fits)
        change[fits == 0] = 1 << 40
        new = 2 * self.count[length] - 1
        if not len(change):
            return 0
        at = len(change) - 1 - int(np.argmin(change[::-1]))
        return at + 1 if change[at] <= new else 0

    def place(self, piece, length: int) -> list[list]:
        """Place one piece; returns the windows that are full by it."""
        at = self.level(length)
        if at:
            window = self.open[at].pop()
            self.count[at] -= 1
        else:
            window, self.n_open = [], self.n_open + 1
        window.append(piece)
        if at + length == self.size:
            self.n_open -= 1
            return [window]
        self.open[at + length].append(window)
        self.count[at + length] += 1
        if self.n_open > self.max_open:
            full, rest = self.pour()
            if rest:
                k = sum(len(p[2]) // 4 for p in rest)
                self.open[k].append(rest)
                self.count[k], self.n_open = 1, 1
            return full
        return []

    def pour(self) -> tuple[list[list], list]:
        """All open windows, fullest first, as one stream that is cut into full windows; and what is left."""
        full, now, left = [], [], self.size
        for level in range(self.size - 1, 0, -1):
            for window in self.open[level]:
                for doc, start, ids in window:
                    while ids:
                        part = ids[: 4 * left]
                        now.append((doc, start, part))
                        start, ids, left = start + len(part) // 4, ids[len(part) :], left - len(part) // 4
                        if not left:
                            full.append(now)
                            now, left = [], self.size
            self.open[level] = []
        self.count[:], self.n_open = 0, 0
        self.pours += 1
        return full, now


def powers_of_two(window: list) -> list[list]:
    """Cut a partly filled window into such lengths, longest first."""
    left, out = sum(len(p[2]) // 4 for p in window), []
    pieces = window[::-1]
    while left:
        want = 1 << (left.bit_length() - 1)
        left, part = left - want, []
        while want:
            doc, start, ids = pieces.pop()
            if len(ids) > 4 * want:
                pieces.append((doc, start + want, ids[4 * want :]))
                ids = ids[: 4 * want]
            part.append((doc, start, ids))
            want -= len(ids) // 4
        out.append(part)
    return out


FIELDS = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("closed_by", pa.string()), ("task", pa.int64())]
#: A piece of an open window has no sequence_id; its offset is then its place among those of its task.
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, closed_by string, task long"
#: Sequence ids: the number of the task or group above SHIFT bits, those of groups from GROUPS on.
SHIFT, GROUPS = 36, 1 << 26


class Pieces:
    """Rows of windows that leave; a piece is ((document, its tokens), start, ids)."""

    def __init__(self, first: int, task: int):
        self.next, self.task, self.rows = first << SHIFT, task, []

    def close(self, windows: list[list], by: str) -> None:
        for window in windows:
            offset = 0
            for (doc, total), start, ids in window:
                self.rows.append((doc, start, len(ids) // 4, ids, total, self.next, offset, by, self.task))
                offset += len(ids) // 4
            self.next += 1

    def leave_open(self, pieces: list) -> None:
        for at, ((doc, total), start, ids) in enumerate(pieces):
            self.rows.append((doc, start, len(ids) // 4, ids, total, None, at, None, self.task))

    def flush(self) -> pa.RecordBatch:
        cols = [*zip(*self.rows)] or [()] * len(FIELDS)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(cols, FIELDS)], names=[name for name, _ in FIELDS])


def place(state: SumOfSquares, out: Pieces, piece, length: int) -> None:
    """Place a piece by the rule. A window is closed by it unless the array was poured."""
    poured = state.pours
    full = state.place(piece, length)
    out.close(full, "rule" if state.pours == poured else "pour")


def pack(df: DataFrame, path: str, size: int = 2048, end_id: int = 1, max_open: int = 1024, fan_in: int = 32) -> DataFrame:
    """One row per piece of (doc_id, text): ids are its token ids as little-endian 32-bit integers."""

    def by_task(batches):
        task = TaskContext.get().partitionId()
        enc, state, out = encoder(path), SumOfSquares(size, max_open), Pieces(task, task)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for part in slices(batch):
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    ids = enc.packed(text) + end
                    total = len(ids) // 4
                    key, at = (doc, total), 0
                    while total - at >= size:
                        out.close([[(key, at, ids[4 * at : 4 * (at + size)])]], "document")
                        at += size
                        if len(out.rows) >= 1024:
                            yield out.flush()
                    if at < total:
                        place(state, out, (key, at, ids[4 * at :]), total - at)
                if len(out.rows) >= 1024:
                    yield out.flush()
        out.leave_open([piece for level in state.open for window in level for piece in window])
        yield out.flush()

    def by_group(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        state, out = SumOfSquares(size, max_open), Pieces(GROUPS + key[0].as_py(), -1)
        table = table.sort_by([("task", "ascending"), ("offset", "ascending")])
        for doc, start, ids, total in zip(*(table.column(c).to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens"))):
            place(state, out, ((doc, total), start, ids), len(ids) // 4)
        full, rest = state.pour()
        out.close(full + powers_of_two(rest), "pour")
        return pa.Table.from_batches([out.flush()])

    # Stored, so that texts are encoded once for both rounds; a task's open pieces are the last of its file.
    first = materialise(df.select("doc_id", "text").mapInArrow(by_task, SCHEMA), "pieces")
    groups = -(-((first.agg(F.max("task")).first()[0] or 0) + 1) // fan_in)
    left = first.where("sequence_id is null").select("*", (F.col("task") % groups).alias("group"))
    rest = left.groupBy("group").applyInArrow(by_group, SCHEMA)
    return first.where("sequence_id is not null").union(rest).drop("task")
