import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from threadloom.functions import text as fx
from threadloom.operators import fulltext, phrases, search
from threadloom.operators.fulltext import FullText
from threadloom.sources.store import Conflict, shared_folder

SHAPE = "id string, chat_id string, sender_name string, seq long, ts long, local_date string, local_time string, text string, msg_type string"
QUERIES = ("the", "the cat", "rat", "Perché", "don't panic", "the the", "nothing here", "!!", "mat_rat dog", "a")


@pytest.fixture(scope="module")
def messages(spark):
    rng = np.random.default_rng(0)
    words = np.array("the the the a a cat sat on mat rat dog perche panic don t mat_rat Perché DON'T é".split())
    rows = [(f"{k:04d}", f"c{k % 3}", f"s{k % 2}", k, 1000 - k, f"2024-0{1 + k % 9}-1{k % 7}", "10:00", " ".join(rng.choice(words, rng.integers(0, 40))), "text" if k % 5 else "system") for k in range(700)]
    rows += [("empty", "c0", None, 900, 5, "2024-01-01", "10:00", None, "text"), ("marks", "c0", None, 901, 6, "", "10:00", "... !", "text")]
    return spark.createDataFrame(rows, SHAPE).cache()


def same(index, rows, queries=QUERIES[1:4], sought=("the cat", "the the the")):
    for query in queries:
        for where in ({}, {"chat_id": "c1", "date_from": "2024-03-01"}):
            got = [(r.id, round(r.score, 9)) for r in fulltext.keyword_search(index, rows, query, 30, **where).collect()]
            want = [(r.id, round(r.score, 9)) for r in search.keyword_search(rows, query, 30, **where).collect()]
            assert got == want, (query, where)
    for phrase in sought:
        assert index.timeline(phrase).collect() == phrases.timeline(rows, phrase).collect(), phrase
        assert index.evidence(rows, phrase, 9, chat_id="c2").collect() == phrases.evidence(rows, phrase, 9, chat_id="c2").collect()


def test_index_answers_as_a_scan_does(spark, messages):
    path = shared_folder(spark)
    index = FullText(spark, path, 16)
    index.add(messages.where("seq < 300"))
    index.add(messages.where("seq >= 300"), replace=False)
    same(FullText(spark, path), messages, QUERIES, ("the cat", "The CAT sat", "the the the", "a", "", "mat rat", "on the dog a"))
    assert FullText(spark, path).totals()[0] == 702


def test_upkeep(spark, messages, monkeypatch):
    index = FullText(spark, shared_folder(spark), 8)
    assert index.search("the").collect() == [] and index.phrase("the").count() == 0
    index.add(messages)
    gone = messages.where("seq % 4 = 1")
    index.remove(gone.select("id"))
    left = messages.join(gone, "id", "left_anti")
    monkeypatch.setattr(fulltext, "MANY", 20)  # bounds of blocks are used
    monkeypatch.setattr(fulltext, "FIRST_BLOCKS", 2)
    same(index, left)
    changed = messages.where("seq % 7 = 2").withColumn("text", F.lit("the cat sat on a new mat"))
    index.add(changed)
    index.add(gone.where("seq < 50"))
    last = gone.where("seq < 50")
    now = left.join(changed.select("id"), "id", "left_anti").unionByName(changed.join(last.select("id"), "id", "left_anti")).unionByName(last).cache()
    same(index, now)
    before = index.version
    index.merge()
    assert len(index.state["segments"]) == 1 and index.version == before + 1
    same(index, now)
    assert index.vacuum() > 0
    same(FullText(spark, index.store.path), now)


def test_query_reads_its_tokens_only(spark, messages):
    index = FullText(spark, shared_folder(spark), 64)
    index.add(messages)
    every, one = index._blocks(), index._blocks(["dog"])
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan and "EqualTo(token,dog)" in plan.replace("In(token, [dog])", "EqualTo(token,dog)")
    assert len(one.select("token", "bucket", F.input_file_name().alias("f")).select("f").distinct().collect()) < len(every.select(F.input_file_name().alias("f")).distinct().collect())
    assert {r.token for r in one.select("token").collect()} == {"dog"}


def test_two_writers_conflict(spark, messages):
    path = shared_folder(spark)
    a, b = FullText(spark, path), FullText(spark, path)
    a.add(messages.limit(3))
    with pytest.raises(Conflict):
        b.add(messages.limit(2))
    assert FullText(spark, path).totals()[0] == 3 and FullText(spark, path).vacuum() == 2


def test_tokens_are_counted_as_made(spark):
    odd = [None, "", "...", "a b", "Perché è", "e\u0301te\u0301 \u0301 x\u0301", "\u0301a", "İstanbul ΣΑΣ", "日本 12_34", "a\ue000b", "👍 ok"]
    rows = spark.createDataFrame([(t,) for t in odd], "text string").select("text", F.size(fx.search_tokens(F.col("text"))).alias("n"), fx.token_count(F.col("text")).alias("c")).collect()
    assert [r.c for r in rows] == [r.n for r in rows]


def test_postings_are_grouped_for_a_merge_and_cut_for_blocks(spark):
    schema = "token string, id string, seq long, len int, tf int, at array<int>"
    rows = [(f"t{k % 7}", f"{k:04d}", k, 9, 1 + k % 2, [k, 3][: 1 + k % 2]) for k in range(700)]
    whole = spark.createDataFrame(rows, schema).coalesce(1).mapInArrow(fulltext._together, f"task int, token string, {fulltext.LISTS}").collect()
    assert len(whole) == 7
    for r in whole:
        own = [x for x in rows if x[0] == r.token]
        assert r.ids == [x[1] for x in own] and r.tfs == [x[4] for x in own] and r["at"] == [p for x in own for p in x[5]]
    batch = pa.RecordBatch.from_arrays([pa.array([[1] * n for n in (3, 0, 5, 30, 2)], pa.list_(pa.int32()))], names=["ids"])
    assert [[len(x) for x in p.column("ids").to_pylist()] for p in fulltext._slices([batch], "ids", 8)] == [[3, 0, 5], [30], [2]]
