import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.functions import text as fx
from threadloom.operators import filters, phrases, search, stats, topics, vectors, windows
from threadloom.plans import agent, tools

SHAPE = "id string, chat_id string, sender_name string, seq long, ts long, ts_local string, local_date string, local_time string, text string, msg_type string"
BASE = 1700002800  # 2023-11-14 23:00:00 UTC


def messages(spark, rows):
    from datetime import datetime, timezone

    out = []
    for k, (offset, who, text, *kind) in enumerate(rows):
        at = datetime.fromtimestamp(BASE + offset, timezone.utc)
        out.append((f"{k + 1:016x}", "c", who, k, BASE + offset, f"{at:%Y-%m-%d %H:%M:%S}", f"{at:%Y-%m-%d}", f"{at:%H:%M}", text, kind[0] if kind else "text"))
    return spark.createDataFrame(out, SHAPE)


@pytest.fixture(scope="module")
def five(spark):
    return messages(spark, [(0, "A", "ciao bello"), (60, "B", "ciao!"), (120, "A", "😀😀 http://x.y/bello"), (100000, "B", "pizza domani sera"), (100060, "A", "vediamo")]).cache()


def test_durations_and_bars(spark):
    rows = spark.createDataFrame([(0.4,), (59.0,), (60.0,), (75.0,), (3599.0,), (7230.0,), (90000.0,), (None,)], "s double")
    shown = rows.select(fx.human_seconds(F.col("s")).alias("h"), fx.clock(F.col("s")).alias("c"), fx.bar(F.col("s"), F.lit(120.0), 4).alias("b")).collect()
    assert [r.h for r in shown] == ["0s", "59s", "1.0m", "1.3m", "60.0m", "2.0h", "1.0d", None]
    assert [r.c for r in shown] == ["0s", "59s", "1m00s", "1m15s", "59m59s", "2h00m", "25h00m", None]
    assert [r.b for r in shown[:4]] == ["", "██", "██", "██"]
    assert rows.select(fx.bar(F.lit(3), F.lit(0)).alias("b")).first().b == ""


def test_per_sender(five):
    rows = stats.per_sender(five).collect()
    assert [(r.sender_name, r.messages) for r in rows] == [("A", 3), ("B", 2)] and rows[0].share == pytest.approx(0.6)


def test_response_times(five, spark):
    r = {x.variant: x for x in stats.response_times(five).collect()}
    assert (r["any"]["count"], r["any"].median, r["reply"]["count"], r["reply-session"]["count"]) == (4, 60, 4, 3)
    empty = stats.response_times(five.where("false")).collect()
    assert len(empty) == 3 and all(x["count"] == 0 for x in empty)
    ten = messages(spark, [(sum(range(k + 1)), "A", "x") for k in range(11)])
    assert {x.variant: x.p90 for x in stats.response_times(ten).collect()}["any"] == 10


def test_frequencies(five):
    assert [tuple(r) for r in stats.word_frequency(five).collect()][:2] == [("ciao", 2), ("bello", 1)]
    assert [tuple(r) for r in stats.emoji_frequency(five).collect()] == [("😀", 2)]


def test_sessions(five):
    a, b = stats.sessions(five).orderBy("start_ts").collect()
    assert (a.messages, a.starter, a.gap_before_sec, b.starter, b.gap_before_sec) == (3, "A", None, "B", 99880)
    assert stats.sessions(five).agg(F.sum("messages")).first()[0] == 5


def test_volume_and_hours(five):
    assert [tuple(r) for r in stats.volume(five).collect()] == [("2023-11", 5)]
    assert {r.hour: r["count"] for r in stats.hours(five).collect()} == {23: 3, 2: 2}


def test_repeated_phrases(spark):
    m = messages(spark, [(k * 60, "A", "zuppa calda molto buona davvero") for k in range(6)])
    found = {r.phrase: r["count"] for r in phrases.repeated_phrases(m).collect()}
    assert found == {"zuppa calda molto buona": 6, "calda molto buona davvero": 6}
    assert phrases.repeated_phrases(m, min_count=7).count() == 0
    assert [tuple(r) for r in phrases.timeline(m, "Molto buona").collect()] == [("2023-11", 6)]
    assert phrases.evidence(m, "calda molto", top=2).count() == 2
    assert phrases.timeline(m, "").count() == 0


def test_search_and_context(five):
    assert [r.id for r in search.keyword_search(five, "CIAO bello").collect()] == ["0000000000000001"]
    assert search.keyword_search(five, "!!").count() == 0
    near = search.context(five, "0000000000000003", 1, 1).collect()
    assert [r.seq for r in near] == [1, 2, 3] and search.context(five, "nope").count() == 0
    got = search.resolve(five, ["0000000000000002", "ffffffffffffffff"]).collect()
    assert [r.found for r in got] == [True, False]
    assert search.extract_ids("see [0000000000000002] and 0000000000000002-1") == ["0000000000000002", "0000000000000002-1"]


def test_windows(five):
    found = windows.conversation_windows(five, 2, 3).orderBy("start_ts").collect()
    assert [(r.start_id[-1], r.end_id[-1]) for r in found] == [("1", "2"), ("4", "5")]
    assert windows.conversation_windows(five.limit(1), 6, 3).count() == 1


def test_index(spark, five):
    class Counting(vectors.HashedBag):
        pass

    bag = Counting(16)
    index = vectors.index_messages(five, vectors.empty_index(spark), bag).cache()
    assert index.count() == 5 and vectors.pending(vectors.message_documents(five), index, "chat", bag.model).count() == 0
    both = vectors.index_windows(five, index, bag, mode="mean", size=2, stride=1)
    assert both.count() == 5 + 4
    best = vectors.semantic_search(index, bag, "pizza domani sera", top=1).first()
    assert "pizza" in best.text
    assert vectors.reset(both, "chat", bag.model).count() == 0
    with pytest.raises(ValueError):
        vectors.index_windows(five, index, bag, mode="other")


def test_density_clusters():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 0.05, (30, 3)), rng.normal(3, 0.05, (40, 3)), rng.normal(0, 9, (3, 3)) + 40])
    labels = topics.density_clusters(x, 5)
    assert len(set(labels[:30])) == len(set(labels[30:70])) == 1 and labels[0] != labels[30] and labels[0] >= 0 and (labels[70:] == -1).all()
    assert (topics.density_clusters(x[:1], 5) == -1).all()


class Scripted:
    """A model that says, turn by turn, what it is given."""

    def __init__(self, *turns):
        self.turns, self.offered = list(turns), []

    def reply(self, entries, offered):
        self.offered.append(len(offered))
        yield from self.turns.pop(0)


PIZZA = agent.Request("keyword_search", '{"query": "pizza"}')


def test_agent(five):
    ctx = tools.ToolContext(five)
    out = agent.answer_question("pizza?", ctx, Scripted([PIZZA], ["domani ", "[0000000000000004]"]))
    assert out["answer"] == "domani [0000000000000004]" and out["steps"] == [{"tool": "keyword_search", "arguments": {"query": "pizza"}}]
    assert [c["id"] for c in out["citations"]] == ["0000000000000004"] == [c["id"] for c in out["sources"]]
    model = Scripted([PIZZA], ["forced"])
    talk = agent.Dialogue("?", ctx, rounds=1).run(model)
    assert talk.answer == "forced" and model.offered == [8, 0]
    assert [m["role"] for m in agent.chat_log(talk.entries)] == ["system", "user", "assistant", "tool", "user", "assistant"]
    assert talk.report()["citations"] == talk.report()["sources"] != []
    assert agent.Request("x", "[1]").read() == agent.Request("x", "{").read() == {}


def test_answers_stream(five):
    ctx = tools.ToolContext(five)
    assert [e.kind for e in agent.stream_answer("?", ctx, Scripted(["x", "y"]))] == ["step_start", "token", "token", "done"]
    kinds = [e.kind for e in agent.stream_answer("?", ctx, Scripted([PIZZA], ["x"]), rounds=1)]
    assert kinds == ["step_start", "tool_call", "tool_result", "final", "token", "done"]

    class Slow(Scripted):
        def reply(self, entries, offered):
            yield "first"
            raise RuntimeError("gone")

    events = agent.stream_answer("?", ctx, Slow())
    assert [next(events).kind, next(events).data["text"]] == ["step_start", "first"]  # out before the model has ended
    assert [(e.kind, e.data["message"]) for e in events] == [("error", "gone")]


def test_tools(five):
    ctx = tools.ToolContext(five)
    use = lambda *a: tools.use(ctx, *a).value
    for request in (("nothing", {}), ("keyword_search", {"wrong": 1}), ("keyword_search", {}), ("keyword_search", {"query": "a", "top": "many"})):
        assert "error" in use(*request)
    assert use("get_stats", {"metric": "nope"})["valid"]
    assert use("get_stats", {"metric": "sessions"})["session_count"] == 2
    assert use("phrase_timeline", {"phrase": "ciao", "date_from": "2023-11-01"})["total"] == 2
    assert use("get_context", {"message_id": "x"})["messages"] == []
    assert len(tools.schemas()) == 8
    found = tools.use(ctx, "keyword_search", {"query": "pizza", "chat_id": None})
    assert found.count == len(found.messages) == 1 and tools.use(ctx, "get_stats", {"metric": "time_of_day"}).count > 0


def test_filters(five):
    n = lambda **where: filters.select_messages(five, **where).count()
    some = five.first()
    assert n() == 5 == n(chat_id="", sender=None) and n(chat_id="other") == 0
    assert n(sender=some.sender_name) == five.where(five.sender_name == some.sender_name).count()
    assert n(date_from=some.local_date, date_to=some.local_date) == five.where(five.local_date == some.local_date).count()
    assert n(types=()) == 0 and n(exclude=("text",)) == 0 and n(types=("text",), exclude=("text",)) == 5


def test_registered_emoji_frequency_reads_its_table(spark, tmp_path):
    from threadloom.plans import catalog

    rows = [(1, 0, "user", "a 😀😀 b"), (1, 1, "assistant", "👍🏽 👨‍👩‍👧 😀"), (2, 0, "user", None)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    assert [tuple(r) for r in catalog.QUERIES["emoji_frequency_conversations"](spark, str(tmp_path)).collect()][0] == ("😀", 3)
