"""Product codes, whitening and decontamination against brute force, with odd rows."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

from threadloom.llm import ann, codes, whitening, winnowing

VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.StringType()), T.StructField("code", T.StringType()), T.StructField("row", T.StringType())])


def vectors(spark, rows):
    return spark.createDataFrame([(k, v, lab, "own", "own") for k, v, lab in rows], VECTORS)


def odd_rows(rng, n, dim):
    rows = [(int(k), rng.normal(0, 0.4, dim).astype(np.float32).tolist(), ["a", "b", None][k % 3]) for k in range(n)]
    same = rows[3][1]
    rows += [(n + k, same, "a") for k in range(60)] + [rows[5], rows[5], (None, rows[7][1], "b"), (6, [-9.5] * dim, None)]
    return rows, rows + [(900, None, "a"), (901, [None] * dim, "a"), (902, [float("nan")] * dim, "a"), (903, [float("inf")] + same[1:], "b"), (904, same[1:], "a"), (905, [], None)]


def test_product_codes_equal_plain_rounds(spark):
    rng = np.random.default_rng(1)
    good, rows = odd_rows(rng, 400, 10)
    got = codes.compress(vectors(spark, rows).repartition(5)).collect()
    assert len(got) == len(good)
    v = np.floor(np.array([r[1] for r in good]).astype(np.float32).astype(float) * 1024).astype(np.int64)
    least = {}
    for (k, _, _), x in zip(good, v.tolist()):
        if k is not None:
            least[k] = min(least.get(k, x), x)
    start = np.array([least[k] for k in sorted(least)][:256])
    cuts = [(0, 2), (2, 5), (5, 7), (7, 10)]
    books = [start[:, a:b].copy() for a, b in cuts]
    for turn in range(5):
        found = []
        for (a, b), book in zip(cuts, books):
            d = ((v[:, None, a:b] - book[None]) ** 2).sum(axis=2)
            at = d.argmin(axis=1)
            found.append((at, d[np.arange(len(v)), at]))
            if turn < 4:
                for e in set(at):
                    book[e] = v[at == e, a:b].sum(axis=0) // (at == e).sum()
    error = sum(e for _, e in found)
    of_label = {lab: int(sum(e for e, r in zip(error, good) if r[2] == lab)) for lab in ("a", "b", None)}
    digest = hashlib.sha256(",".join(str(x) for b in books for x in b.reshape(-1)).encode()).hexdigest()
    want = [(r[0], r[2], "".join(f"{at[k]:02x}" for at, _ in found), int(error[k]), of_label[r[2]], digest) for k, r in enumerate(good)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert codes.compress(vectors(spark, [])).collect() == []
    assert codes.compress(vectors(spark, [(None, [1.0] * 8, "a")])).collect() == []
    with pytest.raises(Exception, match="2\\^18"):
        codes.compress(vectors(spark, [(1, [1e30] * 8, "a")]))


def test_cover_trees_keep_their_invariants_and_assign_exactly():
    rng = np.random.default_rng(2)
    for x in (rng.integers(-500, 500, (300, 3)), np.concatenate([rng.integers(0, 9, (200, 4)) + 4000 * k for k in range(4)]), np.array([[5, 5]])):
        x, many = np.unique(x, axis=0, return_counts=True)
        t = codes.CoverTree(x, many)
        d = np.sqrt(codes.squares(t.x, t.x))
        span = d[0].max(initial=0)
        over = np.arange(len(x))
        for i in range(len(t.nets) - 2, -1, -1):
            over = t.up[i][over]
            n, reached = t.nets[i], np.zeros(t.nets[i])
            np.maximum.at(reached, over, d[over, np.arange(len(x))])
            assert np.allclose(reached, t.radii[i]) and (np.bincount(over, t.weight, minlength=n) == t.counts[i]).all()
            apart = d[:n, :n][~np.eye(n, dtype=bool)]
            covered = d[:n, n:].min(axis=0)
            assert not len(covered) or not len(apart) or apart.min() >= covered.max()  # a net: apart by what it covers
        assert span == d[0].max(initial=0)
        book = np.concatenate([x[:: max(1, len(x) // 20)], x[:1]])
        entry, sums, counts = t.assign(book)
        assert (entry == codes.squares(x, book).argmin(axis=1)).all() and counts.sum() == many.sum() and (sums.sum(axis=0) == (x * many[:, None]).sum(axis=0)).all()
    far = np.array([[1 << 28, -(1 << 28)], [-(1 << 28), 1 << 28]])
    assert codes.squares(far, far)[0, 1] == 2 * (1 << 29) ** 2


def test_whitening_equals_numpy(spark):
    rng = np.random.default_rng(3)
    good, rows = odd_rows(rng, 300, 6)
    x = np.floor(np.array([r[1] for r in good]).astype(np.float32).astype(float) * 64).astype(np.int64) + 1_000_000
    got = whitening.components(vectors(spark, rows).repartition(5), 4).collect()
    n, s = len(x), x.sum(axis=0)
    assert len(got) == 4 * n and {r.n for r in got} == {n} and got[0].identity_error < 1e-9
    e, a = np.linalg.eigh(np.cov(x.T, bias=True))
    e, a = e[::-1][:4], a[:, ::-1][:, :4]
    w = np.abs((x - s / n) @ a / np.sqrt(e))
    deviation = ((n * x - s) ** 2).sum(axis=1)
    want = sorted((repr(r[0]), c + 1, int(deviation[k]), w[k, c]) for k, r in enumerate(good) for c in range(4))
    for r, (k, c, dev, v) in zip(sorted(got, key=lambda r: (repr(r.vec_id), r.component, r.deviation, abs(r.whitened))), sorted(want)):
        assert (repr(r.vec_id), r.component, r.deviation) == (k, c, dev) and abs(abs(r.whitened) - v) < 1e-6
        assert abs(r.explained - e[c - 1] / np.cov(x.T, bias=True).trace()) < 1e-9
    assert whitening.components(vectors(spark, [])).collect() == []
    flat = whitening.components(vectors(spark, [(k, [1.0, float(k), 2.0], None) for k in range(5)]), 3).collect()
    assert all(r.whitened == 0 for r in flat if r.component > 1) and flat[0].identity_error < 1e-9
    assert {r.whitened for r in whitening.components(vectors(spark, [(1, [1.0, 2.0], None)])).collect()} == {0.0}


WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words(text):
    return WORD.findall(bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()))


def by_hand(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(10, len(w))
        for k in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[k : k + n]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                at = windows.get(tuple(w[k : k + n]))
                if at is not None:
                    hit.update(range(k, k + n))
                    found |= {str(i) for i in at if i is not None}
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def leak_tables(spark, docs, items):
    shape = "doc_id long, text string, n_words string, key string"
    return spark.createDataFrame([(k, t, "own", "own") for k, t in docs], shape), spark.createDataFrame([(k, t, "own") for k, t in items], "item_id long, text string, fp string")


def test_decontamination_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    prose = lambda n, many=50: " ".join(f"w{x}" for x in rng.integers(0, many, n))
    base = prose(60)
    items = [(1, base), (2, base), (10, " ".join(base.split()[20:40]).upper()), (None, prose(15)), (3, None), (4, " .. "), (5, "Été zwei"), (6, "solo"), (7, prose(5, 9)), (1, prose(30)), (8, "a " * 40)]
    doc = [prose(200, 12) for _ in range(30)]
    docs = [(k, t) for k, t in enumerate(doc)] + [(100, None), (101, ""), (102, "..!"), (None, base), (103, base), (103, base), (104, "x " + base + " y " + items[3][1]), (105, "été, ZWEI. solo"), (106, "a " * 25)]
    docs += [(200 + k, " ".join(base.split()[k : k + 10])) for k in range(0, 50, 7)] + [(300, " ".join(base.split()[3:12])), (301, base.replace(" ", "\x00-")), (302, "日本 " * 12 + base), (303, prose(40) + " " + " ".join(base.split()[5:16]) + " " + prose(40))]
    got = winnowing.scan(*leak_tables(spark, docs, items)).collect()
    assert sorted(map(tuple, got), key=repr) == by_hand(docs, items)
    assert winnowing.scan(*leak_tables(spark, [], items)).collect() == []
    assert sorted(map(tuple, winnowing.scan(*leak_tables(spark, docs[:5], [])).collect()), key=repr) == by_hand(docs[:5], [])


def test_long_texts_are_words_in_slices(monkeypatch):
    text = ("Ab, cé 12\n" * 400).encode()
    whole = winnowing.Reader().words(text)
    monkeypatch.setattr(winnowing, "SLICE", 37)
    monkeypatch.setattr(winnowing, "CACHE_WORDS", 4)
    assert (winnowing.Reader().words(text) == whole).all() and whole.shape == (2, 1200)


def test_every_shared_window_shares_a_fingerprint():
    rng = np.random.default_rng(6)
    for length in range(1, 11):
        for _ in range(40):
            w = rng.integers(0, 1 << 62, (2, length), dtype=np.uint64)
            lead, tail = (rng.integers(0, 1 << 62, (2, n), dtype=np.uint64) for n in rng.integers(0, 30, 2))
            both = [set(winnowing.fingerprints(x, length)[1].tolist()) for x in (w, np.concatenate([lead, w, tail], axis=1))]
            assert both[0] & both[1]


def test_every_vector_of_a_repeated_id_is_a_candidate(spark):
    rng = np.random.default_rng(9)
    rows = [(k % 40, rng.normal(size=6).tolist()) for k in range(100)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    found = ann.search(df, F.col("vec_id") % 20 == 1, k=200, window=1.0).collect()
    for q in (1, 21):
        asks = [np.array(v) for k, v in rows if k == q]
        want = sorted((-max(float(np.dot(a, v)) for a in asks), k) for k, v in rows if k != q)
        got = sorted((r.rank, r.vec_id, r.score) for r in found if r.query_id == q)
        assert [k for _, k in want] == [k for _, k, _ in got] and [r for r, _, _ in got] == list(range(1, len(want) + 1))
        np.testing.assert_allclose([-s for s, _ in want], [s for _, _, s in got], atol=1e-12)
