"""Near-duplicate documents: MinHash bands, signature and set verification, components.

A text's words are runs of bytes other than ASCII white space, with A to Z in
lower case; its set holds the distinct runs of five words (with fewer words,
the whole sequence as one). Documents with equal sets are one class at once. The
least document of each class carries 200 universal hash minima in 40 bands of
five: a pair of similarity 0.75 shares no band with a chance of 2e-5.

Within a bucket of documents that share a band nothing is paired up front. Each
member is compared with one of them, chosen anew for every bucket, so that a
group meets many of its members over its bands. Only members that are not
in one component after that are paired, and of these pairs those are left out
that cannot be similar: by the triangle inequality of the Jaccard distance, or
because too many shingles of one are in no other of these documents, or because
parity sketches of their sets differ in too many bits. So no pair
of a bucket goes unexamined, and a large group of near copies costs few pairs. Pairs whose signatures agree in under half of the
minima are not similar (the chance of such a miss is below 1e-10); the others
are confirmed on the full sets of both texts. Alternating large-star and
small-star give the components.

Texts without words (null, empty, white space) have size 0 and no links. A row
with a null doc_id has a null component and is kept. Rows that repeat a doc_id
share its component. Other columns are ignored, whatever their names. A text of
any length is taken whole, in slices of bounded bytes; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import counted, materialise, slices
from .graph import extended, open_members, open_pairs, purest_leaders, star_components

WORDS, BANDS, ROWS, SEED = 5, 40, 5, 1
LEAST_NUMERATOR = 75  # 100 * intersection >= 75 * union
LEAST_AGREEING, MARGIN = 0.5, 0.2  # the margin is over five standard deviations of an estimate
CACHE_WORDS = 500_000
#: Longs of a sketch: 2048 bits, each flipped by the shingles whose hash names it.
SKETCH = 32
#: Most document ids that are broadcast (8 bytes each); beyond it they are joined by a shuffle.
BROADCAST_IDS = 500_000
_RNG = np.random.default_rng(SEED)
#: Odd multipliers and offsets: of the words of a shingle, and of the universal hashes.
MIX = _RNG.integers(1, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FACTORS = _RNG.integers(1, 1 << 31, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = _RNG.integers(0, 1 << 62, BANDS * ROWS, dtype=np.uint64)


def scramble(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit (the finalizer of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Shingler:
    def __init__(self):
        self.cache: dict[bytes, int] = {}

    def shingles(self, text: str | None) -> np.ndarray:
        """Sorted distinct 64-bit hashes of the text's shingles."""
        words, cache = (text or "").encode("utf-8", "surrogatepass").lower().split(), self.cache
        if not words:
            return np.empty(0, np.uint64)
        try:
            ids = [cache[w] for w in words]
        except KeyError:
            if len(cache) > CACHE_WORDS:
                cache.clear()
            for w in words:
                if w not in cache:
                    cache[w] = xxhash.xxh3_64_intdigest(w)
            ids = [cache[w] for w in words]
        w = np.array(ids, np.uint64)
        n = max(1, len(w) - WORDS + 1)
        h = np.full(n, len(w) if len(w) < WORDS else WORDS, np.uint64)
        for k in range(min(WORDS, len(w))):
            h = scramble(h * MIX[k] + w[k : k + n])
        return np.unique(h)


def minima(h: np.ndarray) -> np.ndarray:
    """Minimum of each universal hash, in the upper 32 bits of a 64-bit product."""
    out = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(h), 1024):
        part = h[None, at : at + 1024] * FACTORS[:, None]
        part += OFFSETS[:, None]
        np.minimum(out, part.min(axis=1), out=out)
    return out


def band_keys(m: np.ndarray) -> np.ndarray:
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for r in range(ROWS):
        key = scramble(key * MIX[r] + m.reshape(BANDS, ROWS)[:, r])
    return key.view(np.int64)


def sketch(h: np.ndarray) -> np.ndarray:
    """The parity of the number of hashes at each of the bits."""
    odd = np.bincount((h >> np.uint64(53)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


SIGNATURES = "doc_id long, n_shingles long, digest binary, agree binary, bands array<long>, sketch array<long>"


def signatures(docs: DataFrame) -> DataFrame:
    """Minima (one byte each, for estimates), band keys and a sketch of each document, with size and digest of its set."""

    def run(batches):
        sh = Shingler()
        for batch in batches:
            for part in slices(batch):
                rows = []
                for doc, s in zip(part.column("doc_id").to_pylist(), map(sh.shingles, part.column("text").to_pylist())):
                    if len(s):
                        m = minima(s)
                        rows.append((doc, len(s), xxhash.xxh3_128_digest(s.tobytes()), (m >> np.uint64(24)).astype(np.uint8).tobytes(), band_keys(m), sketch(s)))
                    else:
                        rows.append((doc, 0, None, None, None, None))
                doc, n, dig, agree, bands, bits = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc, pa.int64()), pa.array(n, pa.int64()), pa.array(dig, pa.binary()), pa.array(agree, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))],
                    names=["doc_id", "n_shingles", "digest", "agree", "bands", "sketch"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SIGNATURES)


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) with the share of minima that agree and, unless it is too small, the sizes of the sets' intersection and union.

    texts: doc_id, text, agree. The share is corrected for minima that agree by chance in their one byte.
    """
    sides = [texts.select(F.col("doc_id").alias(k), F.col("text").alias(f"t{k}"), F.col("agree").alias(f"s{k}")) for k in "ab"]
    both = pairs.join(sides[0], "a").join(sides[1], "b")

    def run(batches):
        sh = Shingler()
        last: tuple = (None, None)
        for batch in batches:
            for part in slices(batch):
                out = []
                for ta, tb, x, y in zip(*(part.column(c).to_pylist() for c in ("ta", "tb", "sa", "sb"))):
                    share = (float((np.frombuffer(x, np.uint8) == np.frombuffer(y, np.uint8)).mean()) * 256 - 1) / 255
                    if share < LEAST_AGREEING:
                        out.append((share, None, None))
                        continue
                    if last[0] != ta:
                        last = (ta, sh.shingles(ta))
                    other = sh.shingles(tb)
                    common = len(np.intersect1d(last[1], other, assume_unique=True))
                    out.append((share, common, len(last[1]) + len(other) - common))
                share, common, union = zip(*out)
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(share), pa.array(common, pa.int64()), pa.array(union, pa.int64())], names=["a", "b", "share", "common", "union"])

    return both.mapInArrow(run, "a long, b long, share double, common long, union long")


def own_shingles(texts: DataFrame) -> DataFrame:
    """(x, u): how many shingles of x no other of these documents has."""

    def run(batches):
        sh = Shingler()
        for batch in batches:
            for part in slices(batch, 64):
                sets = [sh.shingles(t).view(np.int64) for t in part.column("text").to_pylist()]
                doc = np.repeat(part.column("doc_id").to_numpy(), [len(s) for s in sets])
                yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(np.concatenate(sets))], names=["x", "h"])

    each = texts.mapInArrow(run, "x long, h long").groupBy("h").agg(F.min("x").alias("x"), F.count("*").alias("c"))
    return each.where("c = 1").groupBy("x").agg(F.count("*").alias("u"))


def components(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    every = materialise(signatures(docs), "signatures")
    sets = every.select("doc_id", "n_shingles", "digest")
    # Documents with equal sets: one class, named by its least document.
    classes = materialise(sets.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.count("*").alias("rows")), "classes")
    reps = classes.select(F.col("rep").alias("doc_id"), "digest", F.col("n").alias("size"))
    # A document with several rows may stand for several sets: signs has a row for each.
    signs = every.join(reps, ["doc_id", "digest"], "left_semi").dropDuplicates(["doc_id", "digest"])
    member = materialise(signs.select(F.col("doc_id").alias("x"), F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket")), "bands")
    shared = member.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("bucket", "x").alias("o"), "x", "n")).alias("lead"), F.count("*").alias("c")).where("c > 1").select("bucket", F.col("lead.x").alias("leader"), F.col("lead.n").alias("ln"))
    inside = materialise(member.join(shared, "bucket"), "inside")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")

    # Texts that any comparison needs, once: those of documents that share a bucket.
    ids, have = counted(inside.select(F.col("x").alias("doc_id")).distinct(), "wanted-ids", n=F.count("*"))
    few = F.broadcast(ids) if have["n"] <= BROADCAST_IDS else ids
    texts = materialise(texts.join(few, "doc_id", "left_semi").distinct().join(signs.join(few, "doc_id", "left_semi").select("doc_id", "agree"), "doc_id"), "wanted")

    def examine(pairs: DataFrame, name: str) -> DataFrame:
        return materialise(verify(pairs, texts), name)

    is_link = f"100 * common >= {LEAST_NUMERATOR} * union"
    size_fits = lambda x, y: F.least(x, y) * 100 >= F.greatest(x, y) * LEAST_NUMERATOR
    def links_of(seen: DataFrame) -> DataFrame:
        return seen.where(is_link).select("a", "b")

    def stars(inside: DataFrame) -> DataFrame:
        return inside.where((F.col("x") != F.col("leader")) & size_fits("n", "ln")).select(F.least("leader", "x").alias("a"), F.greatest("leader", "x").alias("b")).distinct()

    def placed(inside: DataFrame, comp: DataFrame, seen: DataFrame) -> DataFrame:
        """Members with their components and bounds of the Jaccard distance to the bucket's leader."""
        exact = F.min(1 - F.col("common") / F.col("union")).alias("d")
        known = seen.groupBy(F.col("a").alias("leader"), F.col("b").alias("x")).agg(exact, F.min(1 - F.col("share")).alias("g"))
        known = known.union(known.select("x", "leader", "d", "g"))
        own, by_size = F.col("x") == F.col("leader"), 1 - F.least("n", "ln") / F.greatest("n", "ln")
        return (
            inside.join(comp.select(F.col("node").alias("x"), "component"), "x", "left")
            .withColumn("component", F.coalesce("component", "x"))
            .join(known, ["leader", "x"], "left")
            .withColumn("lo", F.when(own, 0.0).otherwise(F.coalesce("d", F.greatest(by_size, F.col("g") - MARGIN))))
            .withColumn("hi", F.when(own, 0.0).otherwise(F.coalesce("d", F.least(F.lit(1.0), F.col("g") + MARGIN), F.lit(1.0))))
            .select("bucket", "x", "n", "component", "lo", "hi")
        )

    least = LEAST_NUMERATOR / 100
    seen = examine(stars(inside), "stars")
    comp = star_components(links_of(seen).union(_rows_of_one(sets, classes)))
    # What the stars leave open: buckets whose members lie in more than one component.
    members = materialise(open_members(placed(inside, comp, seen), least), "members")
    alone = materialise(own_shingles(texts.join(members.select(F.col("x").alias("doc_id")).distinct(), "doc_id", "left_semi")), "alone")
    again = materialise(purest_leaders(members, alone, least), "again")
    seen2 = examine(stars(again).join(seen, ["a", "b"], "left_anti"), "again-verified")
    seen, comp = seen.union(seen2), extended(comp, links_of(seen2), star_components)
    members = materialise(open_members(placed(again, comp, seen), least), "members")
    bits = signs.groupBy(F.col("doc_id").alias("x")).agg(F.first("sketch").alias("sketch"), F.count("*").alias("c")).select("x", F.when(F.col("c") == 1, F.col("sketch")).alias("sketch"))
    late = examine(open_pairs(members, alone, bits, least).join(seen, ["a", "b"], "left_anti"), "rest")
    final = extended(comp, links_of(late), star_components)

    out = sets.join(classes.select("digest", "rep"), "digest", "left").join(final.select(F.col("node").alias("rep"), "component"), "rep", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _rows_of_one(sets: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between the classes of documents that have several rows with different sets."""
    twice = sets.where("digest is not null and doc_id is not null").groupBy("doc_id").agg(F.min("digest").alias("d0"), F.max("digest").alias("d1")).where("d0 <> d1").select("doc_id")
    ends = sets.join(twice, "doc_id").join(classes.select("digest", "rep"), "digest").select("doc_id", "rep").distinct()
    return ends.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
