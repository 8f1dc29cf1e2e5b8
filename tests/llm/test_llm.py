
import numpy as np
import pytest
import public_tokenizers
from pyspark.sql import functions as F, types as T
from tokenizers import Tokenizer

from threadloom.llm import ann, bpe, graph, language, licenses, lines, minhash, mtree, packing, quality, sharding

BYTES, WORDS = (str(public_tokenizers.path(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
ODD = [None, "", " ", "a", "<|endoftext|>x<|endoftext|>", "ΣΑΣ İ ’s ﬁ é\x1c x", "'S 'll don't!!'s  \n\n  a\t", "日本語 👩‍👩‍👧", "x" * 3000, "ab" * 700 + " é" * 300, "a \n b\nc", "﻿\x85 a"]


def docs(spark, texts, **extra):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("score", T.StringType())])
    return spark.createDataFrame([(k, t, "own") for k, t in enumerate(texts)], schema)


def prose(rng, n):
    return " ".join(f"w{x}" for x in rng.integers(0, 500, n))


def test_bpe_equals_the_library(spark):
    t = Tokenizer.from_file(BYTES)
    out = bpe.encode(docs(spark, ODD), BYTES, decoded="decoded")
    for r in bpe.decode(out, BYTES, text="again").collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == t.decode(ids, skip_special_tokens=False) == r.again and r.score == "own"
    assert bpe.encode(docs(spark, []), BYTES).count() == 0


def test_packing_covers_every_id_once(spark):
    rng = np.random.default_rng(0)
    texts = ODD + [prose(rng, n) for n in rng.integers(1, 1500, 40)] + ["w " * 9000]
    t = Tokenizer.from_file(WORDS)
    whole = {k: np.array(t.encode(x or "", add_special_tokens=False).ids + [1], "<u4") for k, x in enumerate(texts)}
    rows = packing.pack(docs(spark, texts).repartition(3), WORDS, 2048, max_open=8).collect()
    seen, fill = {k: np.zeros(len(v), int) for k, v in whole.items()}, {}
    for r in rows:
        own = whole[r.doc_id][r.start : r.start + r.length]
        assert bytes(r.ids) == own.tobytes() and r.doc_tokens == len(whole[r.doc_id])
        seen[r.doc_id][r.start : r.start + r.length] += 1
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all((v == 1).all() for v in seen.values())
    for pieces in fill.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048 and at & (at - 1) == 0
    assert packing.pack(docs(spark, []), WORDS).count() == 0


def test_small_tasks_close_windows_by_the_rule(spark):
    rng = np.random.default_rng(5)
    rows = docs(spark, [prose(rng, n) for n in rng.integers(1, 120, 4000)])

    def closed(tasks):
        packed = packing.pack(rows.repartition(tasks), WORDS, 2048)
        return {r.closed_by: r.windows for r in packed.groupBy("closed_by").agg(F.countDistinct("sequence_id").alias("windows")).collect()}

    one, many = closed(1), closed(24)
    assert many["rule"] >= 0.9 * one["rule"] and many["rule"] >= 2 * many["pour"], (one, many)


def test_blocks_meet_every_pair_of_a_bucket_once(spark, monkeypatch):
    monkeypatch.setattr(graph, "BLOCK", 7)
    members = spark.range(50).select((F.col("id") % 3 == 0).cast("int").alias("bucket"), F.col("id").alias("x"))
    u, v = (members.select("bucket", F.col("x").alias(k)) for k in "ab")
    u, v = graph.in_blocks(u, v, members)
    pairs = [(r.a, r.b) for r in u.join(v, ["bucket", "row", "column"]).collect()]
    assert len(pairs) == len(set(pairs)) == 17**2 + 33**2


def test_sum_of_squares_rule():
    state = packing.SumOfSquares(10, 100)
    for k, n in enumerate([4, 4, 2]):
        full = state.place((k, 0, b"1234" * n), n)
    assert full and [p[0] for p in full[0]] == [0, 1, 2] and state.n_open == 0


def test_shards_are_even_and_slots_gapless(spark):
    rows = sharding.shards(docs(spark, ["x"] * 1001).repartition(7), 8, seed=3).collect()
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert len(rows) == 1001 and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == [*range(len(s))] for s in slots.values())
    assert sharding.shards(docs(spark, []), 8).count() == 0


@pytest.mark.parametrize("groups", [4096, 2])
def test_shuffle_is_uniform(spark, monkeypatch, groups):
    """Over many seeds every source partition is spread evenly over shards, and the first rows over the slots."""
    monkeypatch.setattr(sharding, "MAX_GROUPS", groups)
    d = spark.range(0, 60, 1, 5).withColumnRenamed("id", "doc_id")
    met, slot_sum, runs = np.zeros((5, 4)), np.zeros(60), 12
    for seed in range(runs):
        rows = sharding.shards(d, 4, seed=seed).collect()
        assert sorted(r.doc_id for r in rows) == [*range(60)] and sorted((r.shard, r.slot) for r in rows) == [(s, k) for s in range(4) for k in range(15)]
        for r in rows:
            met[r.doc_id // 12, r.shard] += 1
            slot_sum[r.doc_id] += r.slot
    # Hypergeometric cells of mean 3 a run: variance 12 * 1/4 * 3/4 * 48/59 a run.
    chi = ((met - 3 * runs) ** 2).sum() / (runs * 12 * 3 / 16 * 48 / 59)
    assert 2 < chi < 45  # about 20 cells, 12 of them free
    assert abs(slot_sum.reshape(5, 12).mean(axis=1) / runs - 7).max() < 1.5


def test_large_hypergeometric_draws():
    rng = np.random.default_rng(0)
    x = np.array([sharding.hypergeometric(rng, 3 * 10**9, 7 * 10**9, 10**6) for _ in range(300)])
    assert abs(x.mean() - 3e5) < 200 and 300 < x.std() < 620


def test_quality_and_language(spark):
    rng = np.random.default_rng(1)
    good = [". ".join(prose(rng, 9).capitalize() for _ in range(5)) + ".\nand " + prose(rng, 12) for _ in range(60)]
    bad = ["$$$ ### " * 20 + "\n" + "BUY!! " * 30 for _ in range(60)]
    d = docs(spark, good + bad)
    labels = d.select("doc_id", (F.col("doc_id") < 60).cast("int").alias("quality"))
    model = quality.fit(d, labels, steps=60)
    out = quality.score(docs(spark, good[:5] + bad[:5] + ODD), model).orderBy("doc_id").collect()
    assert [r.predicted for r in out[:10]] == [1] * 5 + [0] * 5 and all(0 <= r.score <= 1 for r in out)
    assert quality.fit(d, labels.where("false")).known is False
    p, pair = quality.marginals(np.array([0.3, -1.0, 2.0]), np.array([3]), np.array([[0.5, -0.2], [0.1, 0.4]]))
    total, good_mass = 0.0, np.zeros(3)
    for y in np.ndindex(2, 2, 2):
        s = np.exp(np.dot(y, [0.3, -1.0, 2.0]) + sum([[0.5, -0.2], [0.1, 0.4]][a][b] for a, b in zip(y, y[1:])))
        total, good_mass = total + s, good_mass + s * np.array(y)
    assert np.allclose(p, good_mass / total) and np.isclose(pair.sum(), 2)
    en, de = ["the cat and the dog " * 5, "this is what they said " * 4], ["der hund und die katze " * 5, "das ist was sie sagten " * 4]
    rows = spark.createDataFrame([(k, t, "en" if t in en else "de") for k, t in enumerate((en + de) * 10)], "doc_id long, text string, lang string")
    m = language.fit(rows)
    got = language.predict(docs(spark, ["the dog said", "der hund und", None, "123 !!"]), m).orderBy("doc_id").collect()
    assert [r.lang_pred for r in got] == ["en", "de", "und", "und"] and got[2].score == 0
    assert language.predict(docs(spark, ["x"]), language.fit(rows.where("false"))).first().lang_pred == "und"


def components_by_force(sets, least):
    ids = [*sets]
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in ids}


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_near_duplicates_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    base = prose(rng, 150).split()
    texts = [None, "", "  ", "one two", "one TWO", prose(rng, 60)] + [prose(rng, 80) for _ in range(10)]
    for k in range(60):  # one group of copies, each changed for itself, up to beyond the limit
        w = [*base]
        for at in rng.integers(0, 150, rng.integers(0, 12)):
            w[at] = f"z{k}x{at}"
        texts.append(" ".join(w))
    texts += [texts[20]] * 5
    want = components_by_force({k: shingle_set(t) for k, t in enumerate(texts)}, 75)
    rows = {r.doc_id: r for r in minhash.components(docs(spark, texts)).collect()}
    assert {k: r.component_id for k, r in rows.items()} == want
    assert all(r.kept == (r.component_id == k) and r.n_shingles == len(shingle_set(texts[k])) for k, r in rows.items())
    assert minhash.components(docs(spark, [])).count() == 0


def test_repeated_and_null_ids(spark):
    t = " ".join(f"a{k}" for k in range(50))
    rows = spark.createDataFrame([(1, t), (1, t + " b"), (2, t + " b"), (None, t), (3, t)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in minhash.components(rows).collect())
    assert got == [(-1, -1, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False)]
    assert {r.text for r in lines.dedup(rows).where("doc_id is null").collect()} == {t}


def test_components(spark):
    e = spark.createDataFrame([(k + 1, k) for k in range(40)] + [(100, 101), (101, 102), (200, 150), (7, 7)], "a long, b long")
    for f in (graph.star_components, graph.union_find):
        got = {r.node: r.component for r in f(e).collect()}
        assert {got[k] for k in range(41)} == {0} and got[102] == 100 and got[200] == got[150] == 150
        assert f(e.where("false")).count() == 0


def test_line_dedup(spark):
    rng = np.random.default_rng(3)
    long = prose(rng, 60)
    near = long.replace(long.split()[30], "changed", 1)
    texts = [f"first\n{long}\n\n", f"{near}\nsecond line of two", "FIRST\n  " + long, None, "", "unlike anything else here", "second line of two\nsecond line of two"]
    got = [r.text for r in lines.dedup(docs(spark, texts)).orderBy("doc_id").collect()]
    assert got == [texts[0], "second line of two", "", None, "", "unlike anything else here", ""]
    assert lines.dedup(docs(spark, [])).count() == 0


def test_lines_are_compared_in_every_character(spark):
    a, b = "https://www.example.com/alpha/one.html", "https://www.example.org/zzz"
    han = "".join(chr(0x4E00 + 7 * k) for k in range(60))
    words = "the committee will publish its annual findings before winter and every member receives one printed copy by ordinary mail"
    near = words.replace("every", "each")
    texts = [a, b, han, han[:20] + han[40:][::-1], words, near, "abc", "abd"]
    got = [r.text for r in lines.dedup(docs(spark, texts)).orderBy("doc_id").collect()]
    assert got == [a, b, *texts[2:5], "", "abc", "abd"]


def embeddings(spark, x):
    return spark.createDataFrame([(k, v) for k, v in enumerate(x)], "vec_id long, embedding array<double>")


def test_vector_searches_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 16))
    x[40:140] = x[40]
    rows = [v.tolist() for v in x] + [None, [0.0] * 16, [float("nan")] * 16, [1.0] * 15 + [None], [1.0]]
    df = embeddings(spark, rows)
    got = ann.search(df, F.col("vec_id") % 20 == 0, k=20).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = 0
    for q in range(0, 300, 20):
        s = x @ x[q]
        s[q] = -np.inf
        order = np.lexsort((np.arange(300), -np.round(s, 9)))[:20]
        hits += len({*order.tolist()} & {v for _, v, _ in by[q]})
        assert [r for r, _, _ in sorted(by[q])] == [*range(1, 21)]
    assert hits / (15 * 20) >= 0.9
    y = np.floor(np.array([v for v in rows[:300]] + [[0.0] * 16]) * 256).astype(int)
    ids = np.array([*range(300), 301])
    want = set()
    for q in [i for i in ids if i % 50 == 0]:
        s = (y @ y[ids.tolist().index(q)]).astype(float)
        s[ids == q] = -np.inf
        for rank, k in enumerate(np.lexsort((ids, -s))[:5], 1):
            want.add((int(q), rank, int(ids[k]), int(s[k])))
    assert {tuple(r) for r in mtree.top_k(df, F.col("vec_id") % 50 == 0, k=5, pivots=4, region_rows=64).collect()} == want
    assert ann.search(df.where("false"), F.col("vec_id") % 20 == 0).count() == 0 == mtree.top_k(df.where("false"), F.col("vec_id") % 50 == 0).count()


def test_neighbours_among_equal_vectors(spark, monkeypatch):
    """A third of all rows share a vector, over many blocks: their neighbours are the smallest ids, and all queries together keep their recall."""
    monkeypatch.setattr(ann, "BLOCK", 64)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(1500, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[::3] = x[0]
    by = {}
    for r in ann.search(embeddings(spark, x.tolist()), F.col("vec_id") % 20 == 0, k=20).collect():
        by.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    group, hits = np.arange(0, 1500, 3), 0
    for q in range(0, 1500, 20):
        found = [v for _, v in sorted(by[q])]
        s = np.round(x @ x[q], 9)
        s[q] = -np.inf
        want = np.lexsort((np.arange(1500), -s))[:20].tolist()
        if q % 3 == 0:
            assert found == [g for g in group.tolist() if g != q][:20] == want
        hits += len({*found} & {*want})
    assert hits / (75 * 20) >= 0.9


def test_tree_search_over_many_regions(spark, monkeypatch):
    """Pivots that grow with the table, parts with several lots of queries, distances in small steps, every row a query."""
    monkeypatch.setattr(mtree, "QUERY_ROWS", 7)
    monkeypatch.setattr(mtree, "PIVOT_ROWS", 16)
    monkeypatch.setattr(mtree, "PIVOTS", (2, 64))
    monkeypatch.setattr(mtree, "PIVOT_NUMBERS", 200)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 8)) + rng.integers(0, 3, size=(400, 1)) * 2
    x[100:130] = x[100]
    got = {}
    for r in mtree.top_k(embeddings(spark, x.tolist()), F.col("vec_id") >= 0, k=3, region_rows=10).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    y = np.floor(x * 256).astype(int)
    for q in range(400):
        s = (y @ y[q]).astype(float)
        s[q] = -np.inf
        assert sorted(got[q]) == [(n, int(k), int(s[k])) for n, k in enumerate(np.lexsort((np.arange(400), -s))[:3], 1)]


def test_licences(spark):
    files = spark.createDataFrame(
        [("a/LICENSE", "Released under the MIT License."), ("a/b/c.py", "code"), ("a/x/LICENSE.txt", "Licensed under the Apache License, Version 2.0."), ("a/x/y/d.py", None), ("e.py", "code"), ("f.py", "# Licensed under CC BY-NC 4.0.\ncode"), (None, "code")],
        "path string, text string",
    )
    got = {r.path: (r.license, r.license_from, r.license_dir) for r in licenses.scan(files, F.col("path")).collect()}
    assert got["a/b/c.py"] == ("MIT", "inherited", "a") and got["a/x/y/d.py"] == ("Apache-2.0", "inherited", "a/x")
    assert got["e.py"] == (None, None, None) == got[None] and got["f.py"][:2] == ("CC-BY-NC-4.0", "own")


def test_licences_inside_lines_and_whole(spark):
    bsd = next(t for n, t in reversed(licenses.TEMPLATES) if n == "BSD-3-Clause").replace("the copyright holder nor", "Foo Inc. nor")
    noise = " ".join(f"w{k}" for k in range(60))
    texts = {
        "MIT": "// Copyright 2020 The Foo Authors. All rights reserved. Released under the MIT License, see the file in the project root for details.",
        "Apache-2.0": f"{noise} Licensed under the Apache License, Version 2.0 {noise}",
        "CC-BY-4.0": "Distributed under CC BY 4.0.",
        "BSD-3-Clause": f"{noise}\n{bsd}\n{noise}",
        None: "it was released under the name of Foo\ndas Haus mit dem Hund und der Garten mit der Katze",
    }
    files = spark.createDataFrame([(n, t) for n, t in texts.items()], "want string, text string")
    got = licenses.scan(files, F.lit(None).cast("string")).collect()
    assert [r.license for r in got] == [r.want for r in got] and len(got) == 5


def test_registered_licences_inherit(spark):
    from threadloom.llm import queries

    rows = queries.op9_licenses(spark, "/root/testdata/sf0.01").where("license_from = 'inherited'").select("license", "license_dir").collect()
    assert rows and all(r.license and r.license_dir.startswith("src") for r in rows)


def test_near_dedup_keeps_null_ids(spark):
    import corpus_pipeline

    t = " ".join(f"a{k}" for k in range(50))
    rows = spark.createDataFrame([(1, t), (2, t), (None, t)], "doc_id long, text string")
    assert sorted(r.doc_id or -1 for r in corpus_pipeline.near_dedup(spark, rows, "").collect()) == [-1, 1]


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    src = "/root/testdata/sf0.001"
    out = corpus_pipeline.run(spark, src).toPandas()
    fill = out.groupby("sequence_id").length.sum()
    assert ((fill == 2048) | (fill & (fill - 1) == 0)).all() and len(out)
    assert len(corpus_pipeline.STAGES) == 5
