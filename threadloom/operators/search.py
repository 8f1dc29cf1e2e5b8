"""Keyword search by bm25, context around a message, and citations."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

from ..functions import text as fx
from .filters import condition

K1, B = 1.2, 0.75
ID = re.compile(r"\b([0-9a-f]{16}(?:-\d+)?)\b")


def keyword_search(messages: DataFrame, query: str, top: int = 20, **where) -> DataFrame:
    """Messages that hold every word of the query, best bm25 first; a word that splits into tokens must match as a run.

    Statistics are those of all messages, whatever the filter.
    """
    words = re.findall(r"\w+", query)
    rows = messages.withColumn("tokens", fx.search_tokens(F.col("text"))).withColumn("run", F.concat(F.lit(" "), F.array_join("tokens", "  "), F.lit(" ")))
    if not words:
        return rows.where("false").select(*messages.columns, F.lit(0.0).alias("score"))
    # Every token has spaces of its own on both sides, so that neighbours that are equal count each.
    wants = [F.concat(F.lit(" "), F.array_join(fx.search_tokens(F.lit(w)), "  "), F.lit(" ")) for w in words]
    times = [F.when(F.trim(w) == "", 0).otherwise(F.size(F.split("run", F.concat(F.lit("\\Q"), w, F.lit("\\E")), -1)) - 1) for w in wants]
    counted = rows.withColumns({f"f{k}": t for k, t in enumerate(times)} | {"len": F.size("tokens")})
    totals = counted.agg(F.count("*").alias("N"), F.avg("len").alias("avg_len"), *(F.count(F.when(F.col(f"f{k}") > 0, 1)).alias(f"n{k}") for k in range(len(words))))  # one row
    hits = counted.where(" and ".join(f"f{k} > 0" for k in range(len(words)))).where(condition(exclude=(), **where)).join(F.broadcast(totals))
    score = F.lit(0.0)
    for k in range(len(words)):
        raw = F.ln((F.col("N") - F.col(f"n{k}") + 0.5) / (F.col(f"n{k}") + 0.5))
        idf = F.when(raw <= 0, 1e-6).otherwise(raw)
        f = F.col(f"f{k}")
        score = score - idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    return hits.withColumn("score", score).select(*messages.columns, "score").orderBy("score", "seq").limit(max(1, min(top, 100)))


def context(messages: DataFrame, message_id: str, before: int = 5, after: int = 5) -> DataFrame:
    """The messages around one, in order; the message itself is always among them. Empty if there is none of that id."""
    before, after = max(0, min(before, 25)), max(0, min(after, 25))
    anchor = messages.where(F.col("id") == message_id).select(F.col("chat_id").alias("c"), F.col("ts").alias("t"), F.col("seq").alias("s")).limit(1)
    near = messages.join(F.broadcast(anchor), F.col("chat_id") == F.col("c"))
    here, there = F.struct("ts", "seq"), F.struct(F.col("t").alias("ts"), F.col("s").alias("seq"))
    past = near.where(here <= there).orderBy(F.desc("ts"), F.desc("seq")).limit(before + 1)
    return past.union(near.where(here > there).orderBy("ts", "seq").limit(after)).drop("c", "t", "s").orderBy("ts", "seq")


def extract_ids(answer: str | None) -> list[str]:
    return [*dict.fromkeys(ID.findall(answer or ""))]


def resolve(messages: DataFrame, ids: list[str]) -> DataFrame:
    """Citations in the order of ids; ids that are no message are not found."""
    wanted = messages.sparkSession.createDataFrame([*enumerate(ids)], "position int, id string")
    # The ids, a few, go to the messages; what comes back is as small, so no message is shuffled.
    hits = messages.join(F.broadcast(wanted.select("id").distinct()), "id", "left_semi").select("id", F.col("local_date").alias("date"), F.col("local_time").alias("time"), F.col("sender_name").alias("sender"), "text", F.lit(True).alias("hit"))
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return wanted.join(hits, "id", "left").select("position", "id", *map(blank, ("date", "time", "sender", "text")), F.coalesce("hit", F.lit(False)).alias("found")).orderBy("position")
