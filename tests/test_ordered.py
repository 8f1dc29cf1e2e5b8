"""Scans over blocks against windows over whole chats, with blocks so small that every edge occurs."""

import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from threadloom.operators import ordered, stats, windows

SHAPE = "id string, chat_id string, sender_name string, seq long, ts long, ts_local string, local_date string, text string, msg_type string"


@pytest.fixture(scope="module")
def messages(spark):
    rng = np.random.default_rng(3)
    rows, seq = [], 0
    for chat, n in (("a", 90), ("b", 1), ("c", 37), ("d", 2), ("e", 5), ("f", 70)):
        at = 0
        for _ in range(n):
            at += int(rng.choice([0, 5, 3000, 9000]))
            rows.append((f"m{seq}", chat, [None, "x", "y"][int(rng.integers(0, 3))], seq, at, f"t{at}", "2024-01-01", f"text {seq}", ["text", "text", "system"][int(rng.integers(0, 3))]))
            seq += 1
    return spark.createDataFrame(rows, SHAPE).repartition(3).cache()


@pytest.fixture(params=[3, 16, 8192])
def block(request, monkeypatch):
    monkeypatch.setattr(ordered, "BLOCK", request.param)
    monkeypatch.setattr(ordered, "GROUP", 4)
    return request.param


def test_numbers_have_no_gaps(messages):
    rows = ordered.numbered(messages).orderBy("g").collect()
    assert [r.g for r in rows] == [*range(205)]
    assert [(r.chat_id, r.ts, r.seq) for r in rows] == sorted((r.chat_id, r.ts, r.seq) for r in rows)


def test_gaps_and_sessions(messages, block):
    talk = messages.where("msg_type <> 'system'")
    w = Window.partitionBy("chat_id").orderBy("ts", "seq")
    want = talk.withColumns({"gap": F.col("ts") - F.lag("ts").over(w), "previous": F.lag("sender_name").over(w)}).where("gap is not null").select("id", "gap", "previous")
    assert sorted(map(tuple, stats.consecutive(messages).select("id", "gap", "previous").collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    marked = talk.withColumn("fresh", F.when(F.lag("ts").over(w).isNull() | (F.col("ts") - F.lag("ts").over(w) > 3600), 1).otherwise(0)).withColumn("no", F.sum("fresh").over(w))
    by = marked.groupBy("chat_id", "no").agg(F.count("*").alias("n"), F.min("ts").alias("low"), F.max("ts").alias("high"), F.min_by("sender_name", F.struct("ts", "seq")).alias("who"))
    by = by.withColumn("gap", F.col("low") - F.lag("high").over(Window.orderBy("chat_id", "no"))).select("chat_id", "no", "n", "low", "high", F.coalesce("who", F.lit("")), "gap")
    got = stats.sessions(messages).select("chat_id", "session_no", "messages", "start_ts", "end_ts", "starter", "gap_before_sec")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, by.collect()), key=repr)
    assert stats.sessions(messages.where("false")).collect() == []


@pytest.mark.parametrize(("size", "stride"), [(3, 2), (2, 5), (1, 1)])
def test_windows(messages, block, size, stride):
    chats = {}
    for r in sorted(messages.collect(), key=lambda r: (r.chat_id, r.ts, r.seq)):
        chats.setdefault(r.chat_id, []).append(r.id)
    want = []
    for ids in chats.values():
        n = len(ids)
        starts = {0} if n <= size else {*range(0, n - size + 1, stride), n - size}
        want += [tuple(ids[a : a + size]) for a in starts]
    got = windows.conversation_windows(messages, size, stride)
    assert sorted(tuple(r.members) for r in got.collect()) == sorted(want)


def test_no_window_over_a_chat(messages):
    for df in (stats.consecutive(messages), windows.conversation_windows(messages)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "block" in plan and "windowspecdefinition(chat_id" not in plan
