"""Line deduplication against all pairs of a small corpus."""

import numpy as np
from pyspark.sql import functions as F, types as T

from threadloom.llm import lines

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("drop", T.StringType()), T.StructField("h", T.LongType())])


def by_force(texts):
    """Texts after deduplication by all pairs of distinct lines."""
    at = [(k, i, x.strip(lines.BLANKS).lower()) for k, t in enumerate(texts) if t is not None for i, x in enumerate(t.split("\n"))]
    forms = list(dict.fromkeys(x for _, _, x in at if x))
    w = lines.WIDTH
    vocabulary, sets = {}, []
    for x in forms:
        sets.append({vocabulary.setdefault(s, len(vocabulary)) for s in ([x] if len(x) < w else [x[i : i + w] for i in range(len(x) - w + 1)])})
    root = list(range(len(forms)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    holders = {}
    for i, s in enumerate(sets):
        common = {}
        for e in s:
            for j in holders.setdefault(e, []):
                common[j] = common.get(j, 0) + 1
            holders[e].append(i)
        for j, c in common.items():
            if c >= lines.LEAST * (len(s) + len(sets[j]) - c):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    component = {x: find(i) for i, x in enumerate(forms)}
    seen, out = set(), []
    for k, t in enumerate(texts):
        if t is None:
            out.append(None)
            continue
        kept = []
        for x in t.split("\n"):
            form = x.strip(lines.BLANKS).lower()
            if form and component[form] in seen:
                continue
            if form:
                seen.add(component[form])
            kept.append(x)
        out.append("\n".join(kept))
    return out


def corpus(rng, n):
    """Lines of many kinds and lengths with changed copies: prose, Chinese, addresses, tables."""
    words = ["".join(rng.choice(list("abcdefghijklmnop"), rng.integers(2, 9))) for _ in range(400)]
    pool = []
    for _ in range(n):
        kind = rng.integers(0, 6)
        if kind == 0:
            x = "".join(chr(0x4E00 + c) for c in rng.integers(0, 900, rng.integers(3, 120)))
        elif kind == 1:
            x = "https://www.example.com/" + "/".join(rng.choice(words, rng.integers(1, 5)))
        elif kind == 2:
            x = "\t".join(rng.choice(words, rng.integers(1, 20)))
        else:
            x = " ".join(rng.choice(words, rng.integers(1, 90)))
        pool.append(x)
        for _ in range(rng.integers(0, 4) if rng.random() < 0.4 else 0):
            y = list(x)
            for _ in range(rng.integers(1, 4)):
                y[rng.integers(0, len(y))] = rng.choice(list("xyz "))
            pool.append("".join(y))
    rng.shuffle(pool)
    return pool


def test_equals_all_pairs(spark):
    rng = np.random.default_rng(11)
    base = " ".join(f"w{x}" for x in rng.integers(0, 500, 60))
    family = []  # one group of near copies, each changed for itself
    for _ in range(40):
        w = base.split()
        for i in rng.integers(0, 60, 3):
            w[i] = f"v{rng.integers(0, 10**6)}"
        family.append(" ".join(w))
    pool = corpus(rng, 1500) + family + ["   ", "\t", "", "é", "　padded line of text　", "padded line of text", "x" * 30000, "x" * 29000 + "y" * 50] + ["one very common line"] * 300
    rng.shuffle(pool)
    texts = ["\n".join(pool[i : i + 7]) for i in range(0, len(pool), 7)] + [None, ""]
    rows = spark.createDataFrame([(k, t, "own", -k) for k, t in enumerate(texts)], SCHEMA)
    out = lines.dedup(rows.repartition(5)).orderBy("doc_id").collect()
    want = by_force(texts)
    assert [r.doc_id for r in out] == list(range(len(texts))) and all(r.drop == "own" and r.h == -r.doc_id for r in out)
    wrong = [k for k, (r, t) in enumerate(zip(out, want)) if r.text != t]
    assert len(wrong) <= 2, (len(wrong), len(texts))  # what banding misses


def test_lines_that_differ_late_stay(spark):
    texts = ["https://www.example.com/a/one", "https://www.example.com/b/two?x=99", "data:image/png;base64,AAAA", "data:image/png;base64,ZZZZ"]
    rows = spark.createDataFrame([(k, t, "own", k) for k, t in enumerate(texts)], SCHEMA)
    assert [r.text for r in lines.dedup(rows).orderBy("doc_id").collect()] == texts


def test_repeated_and_empty(spark):
    t = "the same line stands here twice\nand a second line follows it"
    rows = spark.createDataFrame([(1, t, None, 0), (1, t, None, 0), (None, t, None, 0), (2, t, None, 0)], SCHEMA)
    got = sorted((r.doc_id or -1, r.text) for r in lines.dedup(rows).collect())
    assert got[0] == (-1, t) and got[1] == got[2] and got[3] == (2, "")
    assert lines.dedup(rows.where(F.lit(False))).schema == rows.schema


def test_a_pass_makes_its_keys_once(spark):
    base = "the quick brown fox jumps over the lazy dog and goes on to sleep under an old oak tree until evening comes"
    forms = [base, base + "!", base + " x", "an entirely different line that resembles nothing else at all", "short one", "short ones"]
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(forms)], "h long, line string")
    signed = lines.materialise(lines.signatures(rows), "signatures")
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    parts = lines.buckets(signed)
    assert store.executionsCount() - before == lines.PASSES  # one query a pass, and nothing is broadcast
    keys = [(r.bucket, r.h) for k in range(lines.PASSES) for r in lines.band_keys(signed, k).collect()]
    held = {}
    for bucket, h in keys:
        held.setdefault(bucket, set()).add(h)
    several = {b: m for b, m in held.items() if len(m) > 1}
    every = lines.together(parts)
    got = {}
    for r in every.collect():
        got.setdefault(r.bucket, set()).add(r.x)
        assert r.c == len(several[r.bucket]) and r.leader in several[r.bucket]
    assert got == several and {0, 1, 2} in several.values()
    assert every._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1  # all passes by one scan
    lines.discard(signed, *parts)


def test_sizes_come_with_the_lines(spark):
    forms = ["abcdeabcde", "abcdeabcdf", "abcd", "x" * 40, "x" * 50]  # shingles that repeat, and too short for one
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(forms)], "h long, line string")
    sets = [({x[i : i + 5] for i in range(len(x) - 4)} or {x}) for x in forms]
    ends = spark.createDataFrame([(k, len(s)) for k, s in enumerate(sets)], "h long, n int")
    pairs = spark.createDataFrame([(a, b) for a in range(5) for b in range(a + 1, 5)], "a long, b long")
    found = lines.verify(pairs, lines.line_sets(ends, rows)).collect()
    assert len(found) == 10 and all(abs(r.d - (1 - len(sets[r.a] & sets[r.b]) / len(sets[r.a] | sets[r.b]))) < 1e-12 for r in found)


def words(rng, k):
    return " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(k))


def test_a_bucket_keeps_no_lines_that_meet_by_chance(spark, monkeypatch):
    rng = np.random.default_rng(3)
    forms = [words(rng, k) for k in (3, 8, 8, 12, 12, 20, 20, 40, 40, 80)]
    forms.append(forms[-1].replace("a", "e", 3))
    signed = lines.materialise(lines.signatures(spark.createDataFrame(list(enumerate(forms)), "h long, line string")), "signatures")
    keyed = lines.band_keys
    # Every key is the same: all lines meet in one bucket, as with very many lines in that of a few ranges.
    monkeypatch.setattr(lines, "band_keys", lambda *a: keyed(*a).withColumn("bucket", F.lit(1).cast("bigint") * F.signum(F.abs("h") + 1).cast("bigint")))
    parts = lines.buckets(signed)
    assert {r.x for r in lines.together(parts).collect()} == {9, 10}
    lines.discard(signed, *parts)


def test_signatures_exclude_no_similar_lines_of_any_length(spark):
    rng = np.random.default_rng(4)
    forms, pairs = [], []
    for n in [*range(5, 40), *range(40, 400, 9)]:
        x = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz "), n))
        for y in (x[: -max(1, (n - 4) // 5)], "z" + x[1:], x[: n // 2] + "q" + x[n // 2 + 1 :], x + x[:2]):
            a, b = ({s[i : i + 5] for i in range(len(s) - 4)} or {s} for s in (x, y))
            if len(a & b) >= lines.LEAST * len(a | b):
                pairs.append((len(forms), len(forms) + 1))
            forms += [x, y]
    signed = lines.signatures(spark.createDataFrame(list(enumerate(forms)), "h long, line string"))
    signs = lines.signs_of(signed).join(signed.select("h", "bits"), "h").toPandas().set_index("h")
    u, v = (spark.createDataFrame(signs.loc[[p[i] for p in pairs]].reset_index(drop=True).add_suffix(k).assign(i=range(len(pairs)))) for i, k in ((0, "a"), (1, "b")))
    near = lines.sized(F.col("na"), F.col("nb"), F.bit_count(F.col("bitsa").bitwiseXOR(F.col("bitsb"))), lines.DIFFER_BIT)
    got = u.join(v, "i").select(F.count("*"), F.count_if(lines.agree(("a", "b"))), F.count_if(near)).first()
    assert len(pairs) > 100 and tuple(got) == (len(pairs),) * 3
