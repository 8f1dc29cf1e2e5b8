"""Benchmark decontamination by winnowing.

A text's words are runs of digits, letters and characters beyond ASCII, with A to
Z in lower case. An item's windows are its runs of ten words (an item of fewer is
one window). Of both sides the runs of k words are hashed, and of every w
neighbouring hashes the least (the last of equal ones) is a fingerprint: any
shared run of w + k - 1 words has the same one on both sides. With k = 5 and
w = 6 that is every window of ten words; for each shorter length that an item
has, k is half of it and w what that leaves.

Spark joins the fingerprints of documents with those of the benchmark; a bit
filter of fixed size drops most others in the task that reads the text. Hits are
extended: all windows that cover a shared fingerprint are looked up among the
benchmark's windows, by two independent 64-bit hashes of their words. Words
inside any of these windows are hit. Documents of the same words count once.
Windows that stand in the same items form one group, and documents with the same
groups share one list of items, which is hashed as a sorted stream: neither the
items of a window nor the windows of an item meet in one buffer.

Null texts and texts without words have no words and no hits. An item without
words has no window. A null item_id is no item, but its windows hit words.
Repeated rows and ids of documents get a row each; an id with several item texts
counts once. Other columns are ignored, whatever their names. An empty benchmark
hits nothing, an empty table gives no rows. Texts are taken whole, in slices of
bounded bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from .common import materialise, slices

WORDS, K = 10, 5
#: Bytes that are words in lower case; all others separate.
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
#: Bytes of a text that are words at a time.
SLICE = 1 << 20
CACHE_WORDS = 300_000
#: Bits of the filter (as a power of two): 8 MB.
FILTER_BITS = 26
#: Most rows of a side that is broadcast (some 30 bytes each); beyond it they are joined by a shuffle.
BROADCAST_ROWS = 500_000
_RNG = np.random.default_rng(13)
#: Odd multipliers by place in a run, of the two hashes.
MIX = _RNG.integers(1, 1 << 63, (2, WORDS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def scheme(length: int) -> tuple[int, int]:
    """(k, w) for windows of this many words."""
    k = min(K, (length + 1) // 2)
    return k, length - k + 1


def scramble(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Reader:
    """Texts as two arrays of word hashes."""

    def __init__(self):
        self.place: dict[bytes, int] = {}
        self.hashes = np.empty((2, CACHE_WORDS), np.uint64)

    def words(self, text: bytes | None) -> np.ndarray:
        """2 x words."""
        flat = (text or b"").translate(LOWER)
        out, at = [], 0
        while at < len(flat):
            end = at + SLICE
            if end < len(flat):
                end = flat.find(b" ", end)
                end = len(flat) if end < 0 else end
            for k in range(0, len(words := flat[at:end].split()), CACHE_WORDS // 2):
                out.append(self._look(words[k : k + CACHE_WORDS // 2]))
            at = end
        return np.concatenate(out, axis=1) if out else np.empty((2, 0), np.uint64)

    def _look(self, words: list[bytes]) -> np.ndarray:
        place = self.place
        try:
            ids = [place[w] for w in words]
        except KeyError:
            new = {w for w in words if w not in place}
            if len(place) + len(new) > CACHE_WORDS:
                place.clear()
                new = set(words)
            for w in new:
                h = xxhash.xxh3_128_intdigest(w)
                self.hashes[:, len(place)] = h & 0xFFFFFFFFFFFFFFFF, h >> 64
                place[w] = len(place)
            ids = [place[w] for w in words]
        return self.hashes[:, np.array(ids, np.int64)]


def runs(words: np.ndarray, length: int, at: np.ndarray | None = None) -> np.ndarray:
    """Hash of each run of `length` words of one hash row (of those that begin at `at`)."""
    row, w = words
    n = max(0, len(w) - length + 1)
    h = np.full(n if at is None else len(at), length, np.uint64)
    for k in range(length):
        h += MIX[row, k] * (w[k : k + n] if at is None else w[at + k])
    return scramble(h)


def of_length(length: int) -> np.uint64:
    """What tells the fingerprints of windows of this length from those of others."""
    return scramble(np.array([length], np.uint64))[0]


def fingerprints(words: np.ndarray, length: int, wanted=None) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the fingerprints of a text for windows of this many words; of those alone that are `wanted` (of hashes, booleans)."""
    k, w = scheme(length)
    h = runs((0, words[0]), k) ^ of_length(length)
    none = np.empty(0, np.int64), np.empty(0, np.uint64)
    if len(h) < w:
        return none
    if wanted is not None and not (may := wanted(h)).any():
        return none
    least = h[: len(h) - w + 1].copy()
    at = np.arange(len(least))
    for j in range(1, w):
        new = h[j : j + len(least)]
        later = new <= least
        least[later] = new[later]
        at[later] = np.flatnonzero(later) + j
    at = at[np.append(True, at[1:] != at[:-1])]  # places never fall
    at = at if wanted is None else at[may[at]]
    return at, h[at]


def windows_of(words: np.ndarray, length: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each window of `length` words that begins at `at`."""
    return tuple(runs((row, words[row]), length, at).view(np.int64) for row in (0, 1))


def items(benchmark: DataFrame) -> DataFrame:
    """item_id, length (of its windows), fp (fingerprints), a and b (hashes of its windows), as arrays."""

    def run(batches):
        reader = Reader()
        for batch in batches:
            for part in slices(batch):
                found = []
                for text in part.column("text").cast(pa.binary()).to_pylist():
                    words = reader.words(text)
                    n = min(WORDS, words.shape[1])
                    if not n:
                        found.append((0, [], [], []))
                        continue
                    found.append((n, np.unique(fingerprints(words, n)[1]).view(np.int64), *windows_of(words, n, np.arange(words.shape[1] - n + 1))))
                n, *lists = zip(*found)
                yield pa.RecordBatch.from_arrays([part.column("item_id"), pa.array(n, pa.int32()), *(pa.array(x, pa.list_(pa.int64())) for x in lists)], names=["item_id", "length", "fp", "a", "b"])

    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    return rows.mapInArrow(run, "item_id string, length int, fp array<long>, a array<long>, b array<long>")


def bit_filter(prints: DataFrame) -> np.ndarray:
    """The filter's bits, of a fixed number of bytes, from the fingerprints `fp`."""
    bit = F.col("fp").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    words = prints.groupBy(F.shiftright(bit, 6).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(fp & 63 as int))")).alias("bits"))
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    got = words.toArrow()  # at most 2^20 rows
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy()
    return out


def candidates(docs: DataFrame, lengths: list[int], bits: np.ndarray) -> DataFrame:
    """doc_id, n_words, key (of the words, null without fingerprints that pass the filter) and prints: fp, length and at of these fingerprints,
    with the first of the windows that cover each and both hashes of these windows."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    one = pa.struct([("fp", pa.int64()), ("length", pa.int32()), ("first", pa.int32()), ("a", pa.list_(pa.int64())), ("b", pa.list_(pa.int64()))])

    def wanted(h):
        place = h.view(np.int64) & ((1 << FILTER_BITS) - 1)
        return (shared.value[place >> 6] >> (place & 63)) & 1 == 1

    def passing(words):
        n = words.shape[1]
        for length in lengths:
            at, fp = fingerprints(words, length, wanted)
            k, _ = scheme(length)
            for p, f in zip(at.tolist(), fp.view(np.int64).tolist()):
                first = max(0, p + k - length)
                yield {"fp": f, "length": length, "first": first} | dict(zip("ab", (x.tolist() for x in windows_of(words, length, np.arange(first, min(p, n - length) + 1)))))

    def run(batches):
        reader = Reader()
        for batch in batches:
            for part in slices(batch):
                n, keys, prints = [], [], []
                for text in part.column("text").cast(pa.binary()).to_pylist():
                    words = reader.words(text)
                    found = [*passing(words)]
                    n.append(words.shape[1])
                    keys.append(xxhash.xxh3_128_digest(words.tobytes()) if found else None)
                    prints.append(found)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(prints, pa.list_(one))], names=["doc_id", "n_words", "key", "prints"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_words long, key binary, prints array<struct<fp: long, length: int, first: int, a: array<long>, b: array<long>>>")


def small(df: DataFrame) -> DataFrame:
    """A stored side of a join, broadcast if it has at most BROADCAST_ROWS rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def of_set(element: str, *names: str) -> list:
    """A digest of a group's distinct elements, gathered in any order: their number and two sums modulo 2 of their hashes."""
    hashes = (F.bit_xor(F.xxhash64(F.lit(k), element)).alias(n) for k, n in enumerate(names))
    return [F.count("*").alias("many"), *hashes]


def spans(prints: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The benchmark's windows that occur in the words of each key: (key, start, length, window), and (window, item_id).

    prints: key, prints; benchmark: as items() gives it. A window's number stands for all windows of the same items.
    """
    wide = benchmark.select("item_id", "length", F.explode(F.arrays_zip("a", "b")).alias("w")).select("item_id", "length", "w.a", "w.b")
    held = materialise(wide.distinct(), "item-windows")
    sets = held.where("item_id is not null").groupBy("length", "a", "b").agg(*of_set("item_id", "x", "y"))
    known = held.select("length", "a", "b").distinct().join(sets, ["length", "a", "b"], "left")
    known = materialise(known.select("length", "a", "b", F.when(F.col("many").isNotNull(), F.concat_ws("/", "many", "x", "y")).alias("window")), "windows")
    one = known.where("window is not null").groupBy("window").agg(F.min(F.struct("length", "a", "b")).alias("w")).select("window", "w.*")
    members = materialise(held.join(one, ["length", "a", "b"]).where("item_id is not null").select("window", "item_id"), "window-items")
    fps = materialise(benchmark.select(F.explode("fp").alias("fp")).distinct(), "item-fingerprints")
    each = prints.select("key", F.explode("prints").alias("p")).select("key", "p.*").join(small(fps), "fp", "left_semi")
    covering = each.select("key", "length", "first", F.posexplode(F.arrays_zip("a", "b")).alias("k", "w")).select("key", "length", (F.col("first") + F.col("k")).alias("start"), "w.a", "w.b")
    return covering.join(small(known), ["length", "a", "b"]).select("key", "start", "length", "window").distinct(), members


def item_digests(lists: DataFrame) -> DataFrame:
    """(list, n_items, items_sha256) of the distinct (list, item_id), in one pass over sorted rows."""

    def run(batches):
        now, n, digest = None, 0, None
        for batch in batches:
            done = []
            for name, item in zip(batch.column("list").to_pylist(), batch.column("item_id").to_pylist()):
                if name != now:
                    if now is not None:
                        done.append((now, n, digest.hexdigest()))
                    now, n, digest = name, 0, hashlib.sha256()
                digest.update((b"," if n else b"") + item.encode())
                n += 1
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], names=["list", "n_items", "items_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([n]), pa.array([digest.hexdigest()])], names=["list", "n_items", "items_sha256"])

    return lists.repartition("list").sortWithinPartitions("list", "item_id").mapInArrow(run, "list string, n_items long, items_sha256 string")


def scan(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every row of documents."""
    none = hashlib.sha256().hexdigest()
    bench = materialise(items(benchmark).where("length > 0"), "items")
    lengths = [r.length for r in bench.select("length").distinct().orderBy("length").collect()]  # ten at most
    every = materialise(candidates(docs, lengths, bit_filter(bench.select(F.explode("fp").alias("fp")))), "candidates")
    # Documents of the same words are looked at once.
    asked = every.where("key is not null").groupBy("key").agg(F.first("prints").alias("prints"))
    found, members = spans(asked, bench)
    found = materialise(found, "spans")
    # Words inside any window: what each adds behind the furthest end before it. A group is one document's windows.
    end = F.col("start") + F.col("length")
    before = F.max(end).over(Window.partitionBy("key").orderBy("start", "length").rowsBetween(Window.unboundedPreceding, -1))
    hit = found.select("key", F.greatest(F.lit(0), end - F.greatest("start", F.coalesce(before, F.lit(0)))).alias("fresh")).groupBy("key").agg(F.sum("fresh").cast("long").alias("n_hit"))
    groups = materialise(found.where("window is not null").select("key", "window").distinct(), "groups")
    listed = groups.groupBy("key").agg(*of_set("window", "x", "y")).select("key", F.concat_ws("/", "many", "x", "y").alias("list"))
    listed = materialise(listed, "lists")
    one = listed.groupBy("list").agg(F.min("key").alias("key"))
    lists = groups.join(one, "key").join(small(members), "window").select("list", "item_id").distinct()
    digests = item_digests(lists)
    result = materialise(hit.join(listed, "key", "left").join(digests, "list", "left").select("key", "n_hit", "n_items", "items_sha256"), "hits")
    clean = every.where("key is null").select("doc_id", "n_words", *(F.lit(None).cast(t).alias(c) for c, t in (("n_hit", "long"), ("n_items", "long"), ("items_sha256", "string"))))
    met = every.where("key is not null").select("doc_id", "n_words", "key").join(small(result), "key", "left").select(*clean.columns)
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return clean.union(met).select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.coalesce("items_sha256", F.lit(none)).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
