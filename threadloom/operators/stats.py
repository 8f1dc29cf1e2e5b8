"""Statistics over messages (chat_id, sender_name, seq, ts, ts_local, local_date, local_time, text, msg_type)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as fx
from ..schema import NOT_TALK, TEXT_TYPES
from ..sources.store import stored
from . import ordered
from .filters import select_messages


def per_sender(messages: DataFrame, **where) -> DataFrame:
    """Per name: messages, share, chars, words, average length, first and last day; names merge across chats."""
    rows = select_messages(messages, types=TEXT_TYPES, **where).where("sender_name is not null")
    words = F.size(fx.all_words(F.col("text")))
    by = rows.groupBy("sender_name").agg(
        F.count("*").alias("messages"), F.sum(F.length("text")).alias("chars"), F.sum(words).cast("long").alias("words"), F.min("local_date").alias("first_date"), F.max("local_date").alias("last_date")
    )
    total = by.agg(F.sum("messages").alias("total"))  # one row
    return by.join(F.broadcast(total)).select("sender_name", "messages", (F.col("messages") / F.col("total")).alias("share"), "chars", "words", (F.col("chars") / F.col("messages")).alias("avg_chars"), "first_date", "last_date").orderBy(F.desc("messages"), "sender_name")


def spans(messages: DataFrame, **where) -> DataFrame:
    """Per name: messages, and as text the time from its first to its last one and a bar beside the busiest name's."""
    rows = select_messages(messages, types=TEXT_TYPES, **where).where("sender_name is not null")
    by = rows.groupBy("sender_name").agg(F.count("*").alias("messages"), (F.max("ts") - F.min("ts")).alias("seconds"))
    most = by.agg(F.max("messages").alias("most"))  # one row
    shown = by.join(F.broadcast(most))
    return shown.select("sender_name", "messages", fx.human_seconds(F.col("seconds")).alias("span"), fx.clock(F.col("seconds")).alias("clock"), fx.bar(F.col("messages"), F.col("most")).alias("bar"))


def consecutive(messages: DataFrame, **where) -> DataFrame:
    """Every message with the gap and the sender before it in its chat."""
    rows = ordered.with_previous(ordered.numbered(select_messages(messages, exclude=NOT_TALK, **where)), "ts", "sender_name")
    return rows.where("not first").withColumns({"gap": F.col("ts") - F.col("previous_ts"), "previous": F.col("previous_sender_name")}).drop("previous_ts", "previous_sender_name", "first", "g", "block").where("gap is not null")


def response_times(messages: DataFrame, session_gap: int = 3600, **where) -> DataFrame:
    """Gaps between consecutive messages: any, with a change of sender, and those within a session. Always three rows."""
    pairs = consecutive(messages.select("chat_id", "sender_name", "ts", "seq", "local_date", "msg_type"), **where).where("gap >= 0").withColumn("reply", ~F.col("sender_name").eqNullSafe(F.col("previous")))
    variants = F.array(F.lit("any"), F.when(F.col("reply"), "reply"), F.when(F.col("reply") & (F.col("gap") <= session_gap), "reply-session"))
    each = pairs.select("gap", F.explode(F.filter(variants, lambda v: v.isNotNull())).alias("variant"))
    # Ranks by counts of equal gaps: no group's values are gathered in one task.
    counts = each.groupBy("variant", "gap").agg(F.count("*").alias("c"))
    w = Window.partitionBy("variant").orderBy("gap")
    up = counts.withColumns({"upto": F.sum("c").over(w), "n": F.sum("c").over(Window.partitionBy("variant"))})
    at = lambda k: F.min(F.when(F.col("upto") > k, F.col("gap")))  # noqa: E731  the k-th value from 0
    n = F.col("n")
    stats = up.groupBy("variant").agg(
        F.sum("c").alias("count"),
        (F.sum(F.col("gap") * F.col("c")) / F.sum("c")).alias("mean"),
        ((at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2).alias("median"),
        at(F.least(n - 1, F.floor(n * F.lit(0.9)))).cast("double").alias("p90"),
        F.min("gap").cast("double").alias("min_gap"),
        F.max("gap").cast("double").alias("max_gap"),
    )
    names = messages.sparkSession.createDataFrame([("any",), ("reply",), ("reply-session",)], "variant string")
    return names.join(stats, "variant", "left").na.fill(0)


def word_frequency(messages: DataFrame, top: int = 40, min_len: int = 3, stop_words: bool = True, **where) -> DataFrame:
    rows = select_messages(messages, types=TEXT_TYPES, **where)
    words = rows.select(F.explode(fx.frequency_words(F.col("text"), min_len, stop_words)).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "word").limit(top)


def emoji_frequency(messages: DataFrame, top: int = 30, **where) -> DataFrame:
    rows = select_messages(messages, exclude=NOT_TALK, **where)
    return rows.select(F.explode(fx.emojis(F.col("text"))).alias("emoji")).groupBy("emoji").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "emoji").limit(top)


def sessions(messages: DataFrame, gap: int = 3600, **where) -> DataFrame:
    """Runs of messages in a chat without a gap over `gap` seconds. The silence before is that since the session before, across chats."""
    rows = select_messages(messages, exclude=NOT_TALK, **where).select("chat_id", "sender_name", "seq", "ts", "ts_local")
    rows = ordered.with_previous(ordered.numbered(rows), "ts")
    fresh = F.col("first") | F.coalesce(F.col("ts") - F.col("previous_ts") > gap, F.lit(True))
    known = ordered.running_count(rows, fresh, "session")
    grouped = known.groupBy("session").agg(
        F.first("chat_id").alias("chat_id"), F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.min_by("ts_local", "g").alias("start_local"), F.max_by("ts_local", "g").alias("end_local"),
        F.count("*").alias("messages"), F.coalesce(F.min_by("sender_name", "g"), F.lit("")).alias("starter"), F.min_by("previous_ts", "g").alias("last_end"),
    )
    # The message before a session ends the one before it; before a chat's first stands the last of the chat before.
    grouped = stored(grouped, "sessions")
    opening = grouped.groupBy(F.col("chat_id").alias("__chat")).agg((F.min("session") - 1).alias("__before"))
    out = grouped.join(ordered.small(opening), F.col("chat_id").eqNullSafe(F.col("__chat"))).withColumn("session_no", F.col("session") - F.col("__before"))
    return out.select("chat_id", "session_no", "start_ts", "end_ts", "start_local", "end_local", "messages", "starter", (F.col("end_ts") - F.col("start_ts")).alias("duration_sec"), (F.col("start_ts") - F.col("last_end")).alias("gap_before_sec"))


def session_starters(found: DataFrame) -> DataFrame:
    by = found.groupBy("starter").agg(F.count("*").alias("sessions"))
    total = by.agg(F.sum("sessions").alias("total"))
    return by.join(F.broadcast(total)).select("starter", "sessions", (F.col("sessions") / F.col("total")).alias("share")).orderBy(F.desc("sessions"), "starter")


def longest_sessions(found: DataFrame, top: int = 5) -> DataFrame:
    return found.orderBy(F.desc("messages"), "chat_id", "session_no").limit(top)


def longest_silences(found: DataFrame, top: int = 5) -> DataFrame:
    return found.where("gap_before_sec is not null").orderBy(F.desc("gap_before_sec"), "chat_id", "session_no").limit(top)


def volume(messages: DataFrame, bucket: str = "month", **where) -> DataFrame:
    rows = select_messages(messages, exclude=("system",), **where)
    return rows.groupBy(fx.period(F.col("local_date"), bucket).alias("period")).agg(F.count("*").alias("count")).orderBy("period")


def hours(messages: DataFrame, **where) -> DataFrame:
    rows = select_messages(messages, exclude=("system",), **where)
    return rows.groupBy(fx.hour(F.col("local_time")).alias("hour")).agg(F.count("*").alias("count")).orderBy("hour")


def weekdays(messages: DataFrame, **where) -> DataFrame:
    rows = select_messages(messages, exclude=("system",), **where)
    return rows.groupBy(fx.weekday(F.col("local_date")).alias("weekday")).agg(F.count("*").alias("count")).orderBy("weekday")


def type_breakdown(messages: DataFrame) -> DataFrame:
    return messages.groupBy("msg_type").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "msg_type")


def top_senders(messages: DataFrame, top: int = 25) -> DataFrame:
    return messages.where("sender_name is not null").groupBy("sender_name").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "sender_name").limit(top)


def speaks_of_group() -> Column:
    """Whether a message is a system notice about a group."""
    return (F.col("msg_type") == "system") & (F.lower("text").contains("group") | F.lower("text").contains("gruppo"))


def list_chats(messages: DataFrame, timezone: str = "UTC") -> DataFrame:
    """Chats with counts and days; a chat is a group with more than two senders or a system notice that speaks of one."""
    by = messages.groupBy("chat_id").agg(F.count("*").alias("messages"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.countDistinct("sender_name").alias("senders"), F.max(speaks_of_group().cast("int")).alias("notice"))
    return shown_chats(by, timezone)


def shown_chats(by: DataFrame, timezone: str = "UTC") -> DataFrame:
    """Chats as they are listed, from a row of counts each."""
    day = lambda c: F.coalesce(F.when(F.col(c) != 0, F.date_format(F.from_utc_timestamp(F.timestamp_seconds(c), timezone), "yyyy-MM-dd")), F.lit(""))
    return by.select("chat_id", "messages", ((F.col("senders") > 2) | (F.coalesce("notice", F.lit(0)) == 1)).alias("is_group"), "first_ts", "last_ts", day("first_ts").alias("first"), day("last_ts").alias("last")).orderBy(F.desc("messages"), "chat_id")


def senders(messages: DataFrame) -> DataFrame:
    return messages.where("sender_id is not null").groupBy("sender_id", "chat_id").agg(F.first("sender_name").alias("name"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("messages"))


def samples(messages: DataFrame, per_type: int = 3) -> DataFrame:
    w = Window.partitionBy("msg_type").orderBy("seq", "chat_id")
    return messages.withColumn("n", F.row_number().over(w)).where(F.col("n") <= per_type).select("msg_type", "n", "text")
