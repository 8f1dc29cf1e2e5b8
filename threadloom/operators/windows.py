"""Sliding windows of consecutive messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import text as fx
from . import ordered


def conversation_windows(messages: DataFrame, size: int = 6, stride: int = 3) -> DataFrame:
    """Windows of `size` messages of a chat at every `stride`-th, one that ends with the last, and one of a short chat whole."""
    item = F.struct("id", "ts", "local_date", fx.message_document(F.col("sender_name"), F.col("text")).alias("doc"))
    rows = ordered.placed(ordered.numbered(messages.select("chat_id", "ts", "seq", item.alias("m"))))
    starts = ((F.col("at") % stride == 0) & (F.col("at") <= F.col("n") - size)) | (F.col("at") == F.col("n") - size) | ((F.col("n") <= size) & (F.col("at") == 0))
    # A frame may reach into the next block, of which as many rows are copied, and into the next chat, whose rows go again.
    frame = Window.partitionBy("block").orderBy("g").rowsBetween(0, size - 1)
    rows = ordered.in_blocks(rows, after=size - 1).withColumn("ms", F.collect_list("m").over(frame)).where(starts & F.col("own"))
    rows = rows.withColumn("ms", F.slice("ms", 1, F.least(F.lit(size), F.col("n")).cast("int")))
    first, last = F.col("ms")[0], F.element_at("ms", -1)
    return rows.select(
        F.concat("chat_id", F.lit(":w:"), first["id"], F.lit("_"), last["id"]).alias("id"), "chat_id", first["id"].alias("start_id"), last["id"].alias("end_id"), first["ts"].alias("start_ts"), last["ts"].alias("end_ts"),
        first["local_date"].alias("start_date"), last["local_date"].alias("end_date"), F.size("ms").alias("messages"), F.transform("ms", lambda m: m["id"]).alias("members"), F.array_join(F.transform("ms", lambda m: m["doc"]), "\n").alias("text"),
    )
