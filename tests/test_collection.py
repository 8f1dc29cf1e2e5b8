import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.operators import vectors
from threadloom.operators.collection import Collection
from threadloom.sources.store import Conflict, shared_folder

SHAPE = "id string, kind string, text string, text_hash string, embedding array<float>, chat_id string, sender_name string, local_date string"


def rows(spark, data):
    return spark.createDataFrame([(i, "message", t, t, [float(x) for x in e] if e is not None else None, c, "s", "2024-01-01") for i, t, e, c in data], SHAPE)


def held(c):
    return {(r.collection, r.model, r.id): r.text for r in c.rows().collect()}


def test_upsert_replaces_and_writes_touched_buckets_only(spark):
    c = Collection(spark, shared_folder(spark), 32)
    c.upsert(rows(spark, [(str(k), f"t{k}", [k, 1], "c") for k in range(600)]), "chat", "m")
    before = c._state()[1]["at"]
    touched = c.upsert(rows(spark, [("5", "new", [0, 1], "c"), ("601", "more", [0, 1], "c"), ("5", "new", [0, 1], "c")]), "chat", "m")
    after = c._state()[1]["at"]
    assert 1 <= len(touched) <= 2 and {b for b in after if after[b] != before[b]} == set(map(str, touched))
    got = held(Collection(spark, c.store.path))
    assert len(got) == 601 and c.rows().count() == 601 and got["chat", "m", "5"] == "new" and got["chat", "m", "7"] == "t7"
    c.upsert(rows(spark, [("5", "other", [1, 1], "c")]), "chat", "n")
    assert c.rows().count() == 602
    c.remove(spark.createDataFrame([("chat", "m", "message", "5"), ("chat", "m", "message", "none")], "collection string, model string, kind string, id string"))
    c.reset("chat", "n")
    assert held(c).keys() == got.keys() - {("chat", "m", "5")}
    c.tidy()
    assert c.rows().count() == 600


def test_empty_unkeyed_and_crossing_writes(spark):
    c = Collection(spark, shared_folder(spark), 4)
    assert c.rows().count() == 0 and c.upsert(rows(spark, []), "chat", "m") == [] and c.reset("chat", "m") == []
    assert c.build_cells("chat", "m") == 0 and c.search([1.0, 0.0], "chat", "m").count() == 0
    with pytest.raises(ValueError):
        c.upsert(rows(spark, [(None, "t", [1, 0], "c")]), "chat", "m")
    version, state = c._state()
    c.upsert(rows(spark, [("1", "t", [1, 0], "c")]), "chat", "m")
    with pytest.raises(Conflict):
        c._change(version, state, c._shaped(rows(spark, [("2", "t", [1, 0], "c")]), "chat", "m"))
    assert set(held(c)) == {("chat", "m", "1")}
    c.remove(c.rows())
    assert c.rows().count() == 0


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(24, 12))
    data = [(f"{k:05d}", f"t{k}", centres[k % 24] + rng.normal(size=12) * 0.05, f"c{k % 5}") for k in range(2400)]
    data += [(f"same{k}", "x", centres[0], "c1") for k in range(300)]  # ties
    data += [("zero", "x", [0] * 12, "c1"), ("null", "x", None, "c1"), ("short", "x", [1, 2], "c1"), ("nan", "x", [float("nan")] * 12, "c1")]
    return data, centres


def test_cells_give_the_rows_of_a_scan(spark, clustered):
    data, centres = clustered
    c = Collection(spark, shared_folder(spark), 8)
    c.upsert(rows(spark, data), "chat", "m")
    assert c.build_cells("chat", "m", 24) > 1
    good = rows(spark, [r for r in data if r[0] not in ("zero", "null", "short", "nan")]).cache()

    def same(own, query, top, **where):
        kept = own.where(F.col("chat_id") == where["chat_id"]) if where else own
        want = [(r.id, r.score) for r in vectors.nearest(kept, query, top).collect()]
        assert [(r.id, r.score) for r in c.search(query, "chat", "m", top, **where).collect()] == want

    queries = [centres[0].tolist(), (centres[3] + 0.02).tolist(), (centres[5] + centres[9]).tolist(), np.ones(12).tolist()]
    for query in queries:
        same(good, query, 7)
    same(good, queries[0], 400)
    same(good, queries[1], 5, chat_id="c2")
    same(good, queries[1], 5000)
    read, of = c.cells_read(queries[1], "chat", "m", 10)
    assert 0 < read < of / 2
    assert [r.id for r in c.search([1.0, 2.0], "chat", "m", 3).collect()] == ["short"]
    # Rows written since count too, and the cells' rows of their buckets do not.
    c.upsert(rows(spark, [("00003", "now", -centres[3], "c3"), ("more", "now", centres[3], "c3")]), "chat", "m")
    later = good.where("id <> '00003'").unionByName(rows(spark, [("00003", "now", -centres[3], "c3"), ("more", "now", centres[3], "c3")]))
    same(later, queries[1], 9)
    c.build_cells("chat", "m", 24)
    same(later, queries[1], 9)


def test_messages_and_windows(spark):
    m = spark.createDataFrame([(f"m{k}", "c", "s", k, k * 60, "2024-01-01", "10:00", f"words {k % 3}", "text") for k in range(7)], "id string, chat_id string, sender_name string, seq long, ts long, local_date string, local_time string, text string, msg_type string")
    c, bag = Collection(spark, shared_folder(spark), 4), vectors.HashedBag(16)
    assert c.index_messages(m, bag) and c.index_messages(m, bag) == []
    for size, stride in ((2, 1), (3, 2)):
        c.index_windows(m, bag, mode="mean", size=size, stride=stride)
        index = vectors.index_messages(m, vectors.empty_index(spark), bag)
        want = vectors.index_windows(m, index, bag, mode="mean", size=size, stride=stride)
        assert {(r.id, r.text_hash, tuple(r.embedding)) for r in c.rows().collect()} == {(r.id, r.text_hash, tuple(r.embedding)) for r in want.collect()}
    with pytest.raises(ValueError):
        c.index_windows(m, bag, mode="other")


def test_windows_are_made_once_and_rows_grouped_only_for_repeated_keys(spark, monkeypatch):
    m = spark.createDataFrame([(f"m{k}", f"c{k % 3}", "s", k, k * 60, "2024-01-01", "10:00", f"words {k % 7}", "text") for k in range(60)], "id string, chat_id string, sender_name string, seq long, ts long, local_date string, local_time string, text string, msg_type string")
    c, bag, made, make = Collection(spark, shared_folder(spark), 4), vectors.HashedBag(16), spark.sparkContext.accumulator(0), vectors.window_documents
    c.index_messages(m, bag)
    c.index_windows(m, bag, mode="mean", size=2, stride=1)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    monkeypatch.setattr(vectors, "window_documents", lambda *a: (d := make(*a)).mapInArrow(counted, d.schema))
    c.index_windows(m, bag, mode="mean", size=3, stride=2)
    windows = c.rows().where("kind = 'window'").count()
    assert made.value == windows > 0 and c.store._names("staged") == []
    # Whole rows are grouped, by a sort, only if a key repeats.
    once, twice = rows(spark, [("1", "a", [1, 0], "c"), ("2", "b", [1, 0], "c")]), rows(spark, [("1", "a", [1, 0], "c"), ("1", "b", [1, 0], "c")])
    plan = lambda r: c._one_a_key(c._shaped(r, "chat", "m").withColumn("bucket", c._bucket(c._state()[1])))._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan(once) and "Aggregate" in plan(twice)


def test_a_large_bucket_is_written_by_several_tasks(spark):
    rng = np.random.default_rng(2)
    size = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes", None)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        c = Collection(spark, shared_folder(spark), 1)
        c.upsert(rows(spark, [(str(k), f"t{k}", rng.normal(size=32), "c") for k in range(4000)]).repartition(4), "chat", "m")
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", size) if size else spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    (at,) = c._state()[1]["at"].values()
    assert len([n for n in c.store._names(f"{at}/bucket=0") if n.endswith(".parquet")]) > 1 and c.rows().count() == 4000


def test_means_of_few_equal_mean_pool(spark):
    rng = np.random.default_rng(5)
    data = [(f"w{k // 3}", k % 3, [float(x) for x in rng.normal(size=8)]) for k in range(300)] + [("zero", 0, [0.0] * 8), ("zero", 1, [0.0] * 8), ("none", 0, []), ("gone", 0, None), ("one", 0, [3.0, 4.0])]
    few = spark.createDataFrame(data, "id string, pos int, embedding array<float>").repartition(5)
    got, want = ({r.id: r.embedding for r in f.collect()} for f in (vectors.mean_of_few(few), vectors.mean_pool(few, "id")))
    assert got.keys() == want.keys() and len(got) == 102 and all(np.allclose(got[k], want[k], rtol=0, atol=1e-7) for k in want)
    # No buffer of a vector summary for every window.
    assert "metrics" not in (plan := vectors.mean_of_few(few)._jdf.queryExecution().optimizedPlan().toString()) and "collect_list" in plan
    with pytest.raises(Exception, match="differ in length"):
        vectors.mean_of_few(spark.createDataFrame([("a", 0, [1.0]), ("a", 1, [1.0, 2.0])], few.schema)).collect()
