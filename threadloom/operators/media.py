"""Voice notes: find their files, transcribe them, lay the texts over the messages."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as fx
from ..schema import TRANSCRIPTS


#: Most files that are read by their names.
LISTED = 10_000


class TranscriptionEngine(Protocol):
    name: str
    model: str

    def transcribe(self, content: bytes) -> tuple[str, str, float]:
        """Text, language and duration in seconds."""


def media_index(spark: SparkSession, roots: list[str]) -> DataFrame:
    """name, path of all files under the roots; the least path stands for a name. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load([*dict.fromkeys(roots)]).select("path")
    return files.withColumn("name", fx.unquote(F.element_at(F.split("path", "/"), -1))).groupBy("name").agg(F.min("path").alias("path"))


def _pattern(path: str) -> str:
    """A path as a pattern that matches it alone."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


def voice_messages(messages: DataFrame, chat_id: str | None = None) -> DataFrame:
    rows = messages.where("msg_type = 'voice'")
    return rows.where(F.col("chat_id") == chat_id) if chat_id else rows


def transcribe_pending(messages: DataFrame, transcripts: DataFrame, roots: list[str], engine: TranscriptionEngine, chat_id: str | None = None, limit: int | None = None, overwrite: bool = False, dry_run: bool = False) -> DataFrame:
    """message_id, status (transcribed, skipped, missing, failed) and the transcript's columns. `limit` comes before the rest."""
    spark = messages.sparkSession
    rows = voice_messages(messages, chat_id).select(F.col("id").alias("message_id"), "media_ref", "ts", "seq")
    rows = rows.orderBy("ts", "seq").limit(limit) if limit else rows
    files = media_index(spark, roots)
    exact, decoded = files.select(F.col("name").alias("media_ref"), F.col("path").alias("p1")), files.select(F.col("name").alias("plain"), F.col("path").alias("p2"))
    found = rows.withColumn("plain", fx.unquote(F.col("media_ref"))).join(exact, "media_ref", "left").join(decoded, "plain", "left").withColumn("path", F.coalesce("p1", "p2"))
    done = transcripts.select("message_id", F.lit(True).alias("done"))
    found = found.join(done, "message_id", "left").withColumn("status", F.when(F.lit(not overwrite) & F.col("done"), "skipped").when(F.col("path").isNull(), "missing").otherwise("transcribed"))
    blank = found.select("message_id", "status", F.col("path").alias("media_file"), *(F.lit(None).cast(t).alias(n) for n, t in (("text", "string"), ("language", "string"), ("duration_sec", "double"))))
    if dry_run:
        return blank
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for m, path, content in zip(part["message_id"], part["media_file"], part["content"]):
                try:
                    out.append((m, "transcribed", path, *engine.transcribe(bytes(content))))
                except Exception as error:  # noqa: BLE001  one bad file must not end the others
                    out.append((m, "failed", path, str(error), None, None))
            yield pd.DataFrame(out, columns=["message_id", "status", "media_file", "text", "language", "duration_sec"])

    waiting = blank.where("status = 'transcribed'").select("message_id", "media_file")
    wanted = [r.media_file for r in waiting.select("media_file").distinct().limit(LISTED + 1).collect()]
    if not wanted:
        return blank
    # Only files that are waiting are read, while their names can be listed; beyond that all files under the roots are read and joined.
    source = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    contents = source.load([_pattern(p) for p in wanted] if len(wanted) <= LISTED else [*dict.fromkeys(roots)]).select(F.col("path").alias("media_file"), "content")
    todo = waiting.join(contents, "media_file")
    return blank.where("status <> 'transcribed'").unionByName(todo.mapInPandas(run, blank.schema))


def store(transcripts: DataFrame, results: DataFrame, engine: TranscriptionEngine, created_at: int = 0) -> DataFrame:
    """The transcripts with the new ones in place of older ones."""
    new = results.where("status = 'transcribed'").select("message_id", "media_file", F.lit(engine.name).alias("engine"), F.lit(engine.model).alias("model"), "language", "duration_sec", "text", F.lit(created_at).cast("long").alias("created_at"))
    return transcripts.join(new.select("message_id"), "message_id", "left_anti").unionByName(new).select(*TRANSCRIPTS.fieldNames())


def effective(messages: DataFrame, transcripts: DataFrame, apply: bool = True) -> DataFrame:
    """Messages with transcripts as their text; types stay."""
    if not apply:
        return messages
    said = transcripts.select(F.col("message_id").alias("id"), F.col("text").alias("said"))
    return messages.join(said, "id", "left").withColumn("text", F.coalesce("said", "text")).select(*messages.columns)
