"""Fuzzy line deduplication, in DataFrame operations only.

A line is compared in lower case without outer white space. Its shingles are
all runs of five characters, at every position; a shorter line is its own
shingle. Lines with equal compared forms are one from the start. The hashes of
a line's shingles, sorted, give a one-permutation MinHash signature: the least
hash of each of 64 equal ranges, an empty range taking the next one's. Forty
bands of six ranges each, drawn at random, let two long lines of Jaccard
similarity just 0.75 miss each other with a chance of 0.7 % (simulated; 4e-4 if
ranges were independent); shorter lines have bands of three or two.

Lines meet in a bucket by chance the more often the more there are, so a line
stays in one only beside another that sizes and signatures let be similar. Where
the least hash of a range differs, one of the sets has an element that the other
lacks, and similar sets differ in a seventh of their summed sizes at most: more
such ranges exclude a pair, of whatever length. So do, with a chance of 2e-5 for a
similar pair, more than 20 ranges by one bit each (in the bucket) or more than 29
by three (later). Two lines alone in a bucket are then a candidate pair. In a larger bucket one line
leads, every other is a candidate with it, and of the rest
only lines go on that are then in different components and that sizes, the
triangle inequality, signatures, their own shingles and sketches of their sets
do not exclude. What is left is compared on the whole sets. Union-find gives the components; the occurrence that
comes first by (doc_id, position) stays, all other lines of the component go.

Blank lines stay, in place. Null texts stay null; a text may become empty. A row
with a null doc_id is left as it is and takes no part. Rows that repeat doc_id and
text count as one document, rows of one doc_id with different texts as several, in
the order of a hash of their texts. All columns and rows are kept, whatever their names; only
`text` changes. An empty table gives an empty one. A text of any length is taken
whole. Lines and shingles are told apart by 64-bit hashes.
"""

from __future__ import annotations

import random
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import counted, discard, materialise, together
from .graph import extended, in_blocks, open_members, open_pairs, purest_leaders, union_find

WIDTH = 5
LEAST = 0.75
#: White space around a line.
BLANKS = " \t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0               　"
#: Lines of up to SHORT shingles band by pairs of ranges, those from FEW to LONG by triples, those from LONG * LEAST on by sixes: similar lines have one kind in common.
FEW, SHORT, LONG = 6, 16, 128
#: Longs of a sketch: 2048 bits, each flipped by the shingles whose hash names it.
SKETCH = 32
RANGES = 64
SIGNS = ("s0", "s1", "s2", "s3")
#: Ranges in which two similar lines may differ, as seen by one bit of the least hash and by three.
DIFFER_BIT, DIFFER = 20, 29
_RNG = random.Random(7)
PAIRS, TRIPLES, SIXES = ([_RNG.sample(range(RANGES), k) for _ in range(n)] for k, n in ((2, 14), (3, 24), (6, 40)))
SPANS = [(0, SHORT, PAIRS), (FEW, LONG, TRIPLES), (int(LONG * LEAST), 1 << 30, SIXES)]
#: Shares of the bands that are looked through one after the other, so that only one lies in shuffle files.
PASSES = 8
ORDERS = [_RNG.getrandbits(63) for _ in range(4)]
#: Most keys that are broadcast (8 bytes each); beyond it they are joined by a shuffle.
BROADCAST_KEYS = 500_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value made once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def runs(line: Column) -> Column:
    """64-bit hashes of a line's shingles, in order; one that repeats is there again."""
    step, size = F.lit(4), F.lit(4 * WIDTH)  # UTF-32: four bytes a character, so that each is found at once
    every = let(F.encode(line, "UTF-32"), lambda b: F.transform(F.sequence(F.lit(1), F.octet_length(b) - size + 1, step), lambda i: F.xxhash64(F.substring(b, i, size))))
    return F.when(F.length(line) < WIDTH, F.array(F.xxhash64(line))).otherwise(every)


def shingles(line: Column) -> Column:
    """Distinct 64-bit hashes of a line's shingles."""
    return F.array_distinct(runs(line))


def occurrences(docs: DataFrame) -> DataFrame:
    """Non-blank lines of documents with an id: doc_id, digest (of the text), pos, line (compared form), h."""
    whole = docs.where("doc_id is not null").withColumn("digest", F.xxhash64("text"))
    lines = whole.select("doc_id", "digest", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.select("doc_id", "digest", "pos", F.lower(F.btrim("line", F.lit(BLANKS))).alias("line")).where("line <> ''").withColumn("h", F.xxhash64("line"))


def distinct_lines(docs: DataFrame) -> DataFrame:
    """One row per compared form: h, line, its first occurrence (doc_id, digest, pos) and the number of its occurrences."""
    return occurrences(docs).groupBy("h").agg(F.min("line").alias("line"), F.min(F.struct("doc_id", "digest", "pos")).alias("first"), F.count("*").alias("c"))


def signatures(lines: DataFrame) -> DataFrame:
    """h, n (the number of shingles), the least hash of each range, and one bit of each in `bits` (none of an empty range)."""
    rank = lambda x: F.shiftright(x, 58)  # noqa: E731  64 ranges, -32 to 31
    sets = lines.select("h", F.sort_array(shingles(F.col("line"))).alias("s"))
    # The first hash of each range: its leading bits differ from those of the hash before it.
    heads = F.filter("s", lambda x, i: F.shiftrightunsigned(x.bitwiseXOR(F.get("s", i - 1)), 58) != 0)
    firsts = sets.select("h", F.size("s").alias("n"), F.concat(F.slice("s", 1, 1), heads).alias("f"))
    # Of each, 31 bits fill the ranges after its predecessor's up to its own, and those of the least the ranges after the last.
    part = lambda x: x.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")
    fill = F.transform("f", lambda x, i: F.array_repeat(part(x), (rank(x) - F.coalesce(rank(F.get("f", i - 1)), F.lit(-33))).cast("int")))
    tail = F.array_repeat(part(F.get("f", F.lit(0))), (31 - rank(F.element_at("f", -1))).cast("int"))
    one = F.lit(1).cast("bigint")
    bits = F.aggregate("f", F.lit(0).cast("bigint"), lambda t, x: t.bitwiseOR(F.call_function("shiftleft", x.bitwiseAND(one), F.shiftrightunsigned(x, 58).cast("int"))))
    return firsts.select("h", "n", F.concat(F.flatten(fill), tail).alias("least"), bits.alias("bits"))


def band_keys(signed: DataFrame, k: int, *carry: str) -> DataFrame:
    """h and the key of each of a line's bands in pass k, as `bucket`, with further columns of signed."""
    wide = [(j, low, high, probe) for j, (low, high, probe) in enumerate((low, high, probe) for low, high, probes in SPANS for probe in probes)]
    most = max(len(x[3]) for x in wide)
    probe = lambda j, low, high, at: F.struct(F.lit(j).alias("j"), F.lit(low).alias("low"), F.lit(high).alias("high"), *(F.lit(at[i] if i < len(at) else -1).alias(f"p{i}") for i in range(most)))
    each = signed.select("h", "n", "least", *(c for c in carry if c != "n"), F.inline(F.array(*(probe(*x) for x in wide[k::PASSES])))).where("n between low and high")
    key = F.xxhash64("j", *(F.get("least", F.col(f"p{i}")) for i in range(most)))  # no range is null, and is left out
    return each.select("h", key.alias("bucket"), *carry)


def signs_of(signed: DataFrame) -> DataFrame:
    """h, n and s0 to s3: four bits of each range's least hash, the first of them set, or none where a range has none."""
    # A filled range repeats the next one's; a line with one filled range shows none.
    least = lambda k: F.slice("round", k, RANGES // len(SIGNS))
    four = lambda x, y: F.when(x != y, F.lit(8).bitwiseOR(F.shiftrightunsigned(x, 1).bitwiseAND(F.lit(7)))).otherwise(0)
    packed = lambda k: F.aggregate(F.zip_with(least(k), least(k + 1), four), F.lit(0).cast("bigint"), lambda t, x: F.shiftleft(t, 4).bitwiseOR(x.cast("bigint")))
    signed = signed.select("h", "n", F.concat("least", F.slice("least", 1, 1)).alias("round"))
    return signed.select("h", "n", *(packed(w * RANGES // len(SIGNS) + 1).alias(s) for w, s in enumerate(SIGNS)))


def sized(na: Column, nb: Column, differ: Column, most: int) -> Column:
    """Whether lines of na and nb shingles whose signatures differ in so many ranges may be similar; signs_of errs by one at most."""
    share = F.lit((1 - LEAST) / (1 + LEAST))
    return (F.least(na, nb) >= F.greatest(na, nb) * LEAST - 1e-9) & (differ <= F.least(F.lit(most), F.floor((na + nb) * share + 1e-9) + 1))


def agree(ends: tuple[str, str]) -> Column:
    """Whether sizes and signatures of two lines let them be similar; columns n and s0 to s3 carry the names of the ends."""
    a, b = ends

    def differ(s: str) -> Column:
        x = F.col(s + a).bitwiseXOR(F.col(s + b))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        return F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseAND(F.lit(0x1111111111111111)))

    return sized(F.col("n" + a), F.col("n" + b), reduce(lambda p, q: p + q, map(differ, SIGNS)), DIFFER)


def few(keys: DataFrame, count: int) -> DataFrame:
    """For a join: stored keys, broadcast if there are at most BROADCAST_KEYS."""
    return F.broadcast(keys) if count <= BROADCAST_KEYS else keys


def line_sets(ends: DataFrame, lines: DataFrame) -> DataFrame:
    """Compared forms (h, line, n) of the lines in `ends` (h, n: the size of its set, distinct): shorter than their sets, which are made where they are needed."""
    ends, have = counted(ends, "ends", rows=F.count("*"))
    sets = materialise(lines.select("h", "line").join(few(ends, have["rows"]), "h"), "line-sets")
    discard(ends)
    return sets


def sketches(elements: DataFrame) -> DataFrame:
    """(x, sketch) of the lines whose shingle hashes are in elements (h, e)."""
    at, bit = F.shiftrightunsigned("e", 6).bitwiseAND(F.lit(SKETCH - 1)), F.expr("shiftleft(1L, cast(e & 63 as int))")
    flips = (F.bit_xor(F.when(at == k, bit).otherwise(F.lit(0).cast("bigint"))).alias(f"w{k}") for k in range(SKETCH))
    return elements.groupBy(F.col("h").alias("x")).agg(*flips).select("x", F.array(*(f"w{k}" for k in range(SKETCH))).alias("sketch"))


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs of line hashes (a, b) with d, the exact Jaccard distance of their shingle sets."""
    both = pairs
    for k in "ab":
        both = both.join(sets.select(F.col("h").alias(k), F.col("line").alias("l" + k), F.col("n").alias("n" + k)), k)
    common = both.select("a", "b", (F.col("na") + F.col("nb")).alias("n"), F.size(F.array_intersect(runs(F.col("la")), runs(F.col("lb")))).alias("c"))
    return common.select("a", "b", (1 - F.col("c") / (F.col("n") - F.col("c"))).alias("d"))


def buckets(signed: DataFrame) -> list[DataFrame]:
    """Members of buckets that have one beside them which may be similar (bucket, x, leader, c: the number of such members), by pass."""
    inside = []
    near = sized(F.col("u.n"), F.col("v.n"), F.bit_count(F.col("u.bits").bitwiseXOR(F.col("v.bits"))), DIFFER_BIT)
    for k in range(PASSES):
        # Keys are made once and go to their bucket: both sides of the join are one shuffle, which a repartition of our own would
        # make two of. What meets by chance ends here.
        member = band_keys(signed, k, "n", "bits")
        several = member.alias("u").join(member.alias("v").hint("shuffle_hash"), (F.col("u.bucket") == F.col("v.bucket")) & (F.col("u.h") != F.col("v.h")) & near, "left_semi")
        # Every other pass has an order of its own, so that a group meets several leaders.
        turn, whole = F.col("h").bitwiseXOR(F.lit(ORDERS[k % len(ORDERS)])), Window.partitionBy("bucket")
        inside.append(materialise(several.select("bucket", F.col("h").alias("x"), F.min(turn).over(whole).bitwiseXOR(F.lit(ORDERS[k % len(ORDERS)])).alias("leader"), F.count("*").over(whole).alias("c")), "inside"))
    return inside


def components(lines: DataFrame) -> DataFrame:
    """(node, component) of the lines (h, line, distinct) that have near copies."""
    signed = materialise(signatures(lines), "signatures")
    parts = buckets(signed)
    several = together(parts)
    met, have = counted(several.select(F.col("x").alias("h")).distinct(), "met", rows=F.count("*"))
    signs = materialise(signs_of(signed.join(few(met, have["rows"]), "h", "left_semi")), "signs")
    discard(signed, met)

    def end(k: str) -> DataFrame:
        return signs.select(F.col("h").alias(k), *(F.col(c).alias(c + k) for c in ("n", *SIGNS)))

    def links(seen: DataFrame) -> DataFrame:
        return seen.where(F.col("d") <= 1 - LEAST).select("a", "b")

    def placed(inside: DataFrame, comp: DataFrame, seen: DataFrame) -> DataFrame:
        """Members with their components and bounds of the Jaccard distance to the bucket's leader."""
        exact = seen.select(F.col("a").alias("leader"), F.col("b").alias("x"), "d").union(seen.select("b", "a", "d"))
        leads = F.col("x") == F.col("leader")
        return (
            inside.join(comp.select(F.col("node").alias("x"), "component"), "x", "left")
            .join(exact, ["leader", "x"], "left")
            .join(signs.withColumnRenamed("h", "x"), "x")
            .select("bucket", "x", "n", *SIGNS, F.coalesce("component", "x").alias("component"), F.when(leads, 0.0).otherwise(F.coalesce("d", F.lit(0.0))).alias("lo"), F.when(leads, 0.0).otherwise(F.coalesce("d", F.lit(1.0))).alias("hi"))
        )

    stars = several.where("x <> leader").select(F.least("leader", "x").alias("a"), F.greatest("leader", "x").alias("b")).distinct()
    first = materialise(stars.join(end("a"), "a").join(end("b"), "b").where(agree(("a", "b"))).select("a", "b", "na", "nb"), "stars")
    sets = line_sets(first.select(F.inline(F.array(*(F.struct(F.col(k).alias("h"), F.col("n" + k).alias("n")) for k in "ab")))).distinct(), lines)
    seen = materialise(verify(first.select("a", "b"), sets), "stars-verified")
    discard(first, sets)
    comp = union_find(links(seen))
    inside = several.where("c > 2").select("bucket", "x", "leader")  # two lines alone in a bucket are compared by now
    where = materialise(placed(inside, comp, seen), "placed")
    discard(*parts)
    members = materialise(open_members(where, LEAST), "members")
    discard(where)
    # Of these, the lines to which the signature of one in another component comes near.
    u, v = (members.select("bucket", F.col("x").alias(k), *(F.col(c).alias(c + k) for c in ("component", "n", *SIGNS, "lo", "hi"))) for k in "ab")
    u, v = in_blocks(u, v, members)
    v = v.withColumnsRenamed({c: f"{c}b" for c in ("bucket", "row", "column")})
    near = reduce(lambda p, q: p & q, (F.col(c) == F.col(f"{c}b") for c in ("bucket", "row", "column"))) & (F.col("componenta") != F.col("componentb")) & agree(("a", "b"))
    left = u.join(v, near, "left_semi").select("bucket", F.col("a").alias("x"), *(F.col(c + "a").alias(c) for c in members.columns[2:])).distinct()
    left = materialise(left, "open")
    discard(members)
    sets = line_sets(left.select(F.col("x").alias("h"), "n").distinct(), lines)
    each = sets.select("h", F.explode(shingles(F.col("line"))).alias("e"))
    alone = materialise(each.groupBy("e").agg(F.min("h").alias("x"), F.count("*").alias("c")).where("c = 1").groupBy("x").agg(F.count("*").alias("u")), "alone")
    bits = materialise(sketches(each), "sketches")
    again = materialise(purest_leaders(left, alone, LEAST), "again")
    discard(left)
    fits = again.where((F.col("x") != F.col("leader")) & (F.least("n", "ln") >= F.greatest("n", "ln") * LEAST - 1e-9))
    fits = fits.select(F.least("leader", "x").alias("a"), F.greatest("leader", "x").alias("b")).distinct()
    seen2 = materialise(verify(fits.join(seen, ["a", "b"], "left_anti"), sets), "again-verified")
    both, comp = seen.union(seen2), extended(comp, links(seen2), union_find)
    where = materialise(placed(again.select("bucket", "x", "leader"), comp, both), "placed")
    rest = open_pairs(open_members(where, LEAST), alone, bits, LEAST, carry=SIGNS, also=agree(("a", "b")))
    rest = materialise(rest.join(both, ["a", "b"], "left_anti"), "rest")
    final = extended(comp, links(verify(rest, sets)), union_find)
    discard(signs, seen, seen2, alone, bits, again, where, rest, sets)
    return final


def dropped(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, drop): the positions of the lines of each document that an earlier line stands for, stored."""
    lines = materialise(distinct_lines(docs), "lines")
    comp = components(lines)
    known = lines.select("h", "first", "c").join(comp.select(F.col("node").alias("h"), "component"), "h", "left").where("c > 1 or component is not null")
    known = materialise(known.select("h", "first", F.coalesce("component", "h").alias("component")), "known")
    discard(lines, comp)
    keeper = known.groupBy("component").agg(F.min("first").alias("keeper"))
    of_line, have = counted(known.join(keeper, "component").select("h", "keeper"), "keepers", n=F.count("*"))
    discard(known)
    at = occurrences(docs).select("doc_id", "digest", "pos", "h").join(few(of_line, have["n"]), "h")
    gone = at.where(F.struct("doc_id", "digest", "pos") != F.col("keeper"))
    out = materialise(gone.groupBy("doc_id", "digest").agg(F.collect_set("pos").alias("drop")), "dropped")
    discard(of_line)
    return out


def without(text: Column, drop: Column) -> Column:
    """The text less the lines at these positions."""
    stay = lambda parts: F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), drop)
    return let(F.split(text, "\n"), lambda parts: F.array_join(F.transform(stay(parts), lambda i: F.get(parts, i)), "\n"))


def dedup(docs: DataFrame) -> DataFrame:
    """All rows with `text` less the lines that go."""
    own = docs.columns
    rows = docs.select(F.struct(*own).alias("__own"), F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__digest"))
    gone = dropped(docs.select("doc_id", "text")).select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest"), F.col("drop").alias("__drop"))
    text = F.when(F.col("__drop").isNull(), F.col("__own.text")).otherwise(without(F.col("__own.text"), F.col("__drop")))
    return rows.join(gone, ["__id", "__digest"], "left").select(*(text.alias(c) if c == "text" else F.col("__own")[c].alias(c) for c in own))
