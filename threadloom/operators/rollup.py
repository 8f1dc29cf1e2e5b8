"""Roll-ups of an archive that are kept: partial states per load, merged when read.

A state is a row per chat, sender, type, day and hour: how many messages, characters and words, whether a
notice speaks of a group, and the first and last second. Counts add up and bounds merge, so that the
statistics below follow from the states of all loads without the messages, filters by chat, sender and day
included. `refresh` reads only the loads that came since, and names them in the manifest with their states
(sources.store): a load counts once, also where a refresh was lost or two ran at once. An archive only adds
messages, so no state is ever taken back. Medians of gaps and word counts do not follow from such states.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as fx
from ..schema import MESSAGES, TEXT_TYPES
from ..sources.store import Store, write
from .filters import select_messages
from .ingest import Archive
from .stats import speaks_of_group

BY = ("chat_id", "sender_id", "sender_name", "msg_type", "local_date", "hour")
#: How each value of a state merges.
MERGED = {"messages": F.sum, "chars": F.sum, "words": F.sum, "first_ts": F.min, "last_ts": F.max, "notice": F.max}
STATE = "chat_id string, sender_id string, sender_name string, msg_type string, local_date string, hour int, messages long, chars long, words long, first_ts long, last_ts long, notice int"


def states_of(messages: DataFrame) -> DataFrame:
    """The states of messages."""
    rows = messages.withColumn("hour", fx.hour(F.col("local_time")))
    return rows.groupBy(*BY).agg(
        F.count("*").alias("messages"), F.sum(F.length("text")).alias("chars"), F.sum(F.size(fx.all_words(F.col("text"))).cast("long")).alias("words"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.max(speaks_of_group().cast("int")).alias("notice"),
    )


class Rollup:
    """Kept statistics of the archive, in a store of their own."""

    def __init__(self, archive: Archive, path: str):
        self.archive, self.spark, self.store = archive, archive.spark, Store(archive.spark, path)

    def refresh(self) -> int:
        """Take in the loads that came since; returns how many. Raises Conflict where another refresh has done so in between."""
        version, state = self.store.read()
        new = sorted(set(self.archive.store.read()[1].get("messages", [])) - set(state.get("loads", [])))
        if new:
            folder = self.store.new_folder("states")
            read = self.spark.read.schema(MESSAGES).parquet(*map(self.archive.store.folder, new))
            write(states_of(read), self.store.folder(folder))
            self.store.commit(version, {"loads": [*state.get("loads", []), *new], "states": [*state.get("states", []), folder]})
        return len(new)

    def merge(self) -> None:
        """One folder of states, a row per key, in place of those of each refresh."""
        version, state = self.store.read()
        if len(state.get("states", [])) > 1:
            folder = self.store.new_folder("states")
            write(self.states().groupBy(*BY).agg(*(how(c).alias(c) for c, how in MERGED.items())), self.store.folder(folder))
            self.store.commit(version, state | {"states": [folder]})

    def tidy(self) -> int:
        """Delete states that the last version does not need; nobody may read or write meanwhile."""
        return self.store.vacuum(("states",), set(self.store.read()[1].get("states", [])))

    def states(self) -> DataFrame:
        folders = self.store.read()[1].get("states", [])
        return self.spark.read.schema(STATE).parquet(*map(self.store.folder, folders)) if folders else self.spark.createDataFrame([], STATE)

    def _counted(self, by: Column, name: str, **where) -> DataFrame:
        return select_messages(self.states(), exclude=("system",), **where).groupBy(by.alias(name)).agg(F.sum("messages").alias("count")).orderBy(name)

    def per_sender(self, **where) -> DataFrame:
        """As stats.per_sender."""
        by = select_messages(self.states(), types=TEXT_TYPES, **where).where("sender_name is not null").groupBy("sender_name")
        each = by.agg(*(F.sum(c).alias(c) for c in ("messages", "chars", "words")), F.min("local_date").alias("first_date"), F.max("local_date").alias("last_date"))
        total = each.agg(F.sum("messages").alias("total"))  # one row
        share, mean = F.col("messages") / F.col("total"), F.col("chars") / F.col("messages")
        return each.join(F.broadcast(total)).select("sender_name", "messages", share.alias("share"), "chars", "words", mean.alias("avg_chars"), "first_date", "last_date").orderBy(F.desc("messages"), "sender_name")

    def volume(self, bucket: str = "month", **where) -> DataFrame:
        """As stats.volume."""
        return self._counted(fx.period(F.col("local_date"), bucket), "period", **where)

    def hours(self, **where) -> DataFrame:
        """As stats.hours."""
        return self._counted(F.col("hour"), "hour", **where)

    def weekdays(self, **where) -> DataFrame:
        """As stats.weekdays."""
        return self._counted(fx.weekday(F.col("local_date")), "weekday", **where)

    def type_breakdown(self) -> DataFrame:
        """As stats.type_breakdown."""
        return self.states().groupBy("msg_type").agg(F.sum("messages").alias("count")).orderBy(F.desc("count"), "msg_type")

    def top_senders(self, top: int = 25) -> DataFrame:
        """As stats.top_senders."""
        return self.states().where("sender_name is not null").groupBy("sender_name").agg(F.sum("messages").alias("count")).orderBy(F.desc("count"), "sender_name").limit(top)

    def senders(self) -> DataFrame:
        """As stats.senders."""
        return self.states().where("sender_id is not null").groupBy("sender_id", "chat_id").agg(F.first("sender_name").alias("name"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.sum("messages").alias("messages"))

    def chats(self) -> DataFrame:
        """Per chat: messages, first_ts, last_ts, senders and whether a notice speaks of a group, for stats.shown_chats."""
        return self.states().groupBy("chat_id").agg(F.sum("messages").alias("messages"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.countDistinct("sender_name").alias("senders"), F.max("notice").alias("notice"))
