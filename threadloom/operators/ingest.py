"""Incremental loading of exported chats into stored tables, by calls or as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..schema import MESSAGES, RUNS
from ..sources import export
from ..sources.store import Conflict, Store, write


def stable_ids(rows: DataFrame) -> DataFrame:
    """Add `id`: 16 hex digits of a SHA-1 over chat, time, sender, text and raw lines; the n-th repeat within a file gets `-n`.

    So what two overlapping files both hold has the same ids in both.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    base = F.substring(F.sha1(F.concat_ws("|", *map(blank, ("chat_id", "ts", "sender_name", "text", "raw_line")))), 1, 16)
    again = F.row_number().over(Window.partitionBy("source_file", "base").orderBy("line_no")) - 1
    return rows.withColumn("base", base).withColumn("again", again).withColumn("id", F.when(F.col("again") > 0, F.concat_ws("-", "base", "again")).otherwise(F.col("base"))).drop("base", "again")


def flagged(lines: DataFrame, runs: DataFrame, known: DataFrame, timezone: str = "Europe/Rome", chat_id: str | None = None, force: bool = False, ingested_at: int = 0) -> DataFrame:
    """The messages of numbered lines with `added`: whether they are new.

    Files whose name and bytes are in the ledger are skipped unless forced. A message whose id is known is not new, and one that several files hold is so once, in the first of them.
    """
    if not force:
        lines = lines.join(runs.where("status = 'done'").select("source_file", "file_hash"), ["source_file", "file_hash"], "left_anti")
    parsed = stable_ids(export.parse(lines, timezone, chat_id)).withColumn("ingested_at", F.lit(ingested_at).cast("long"))
    met = parsed.join(known.select("id", F.lit(True).alias("known")).distinct(), "id", "left")
    first = Window.partitionBy("id").orderBy("source_file", "line_no")
    return met.withColumn("added", F.col("known").isNull() & (F.row_number().over(first) == 1)).drop("known")


def ledger_of(rows: DataFrame) -> DataFrame:
    """A ledger row per file of flagged messages."""
    counts = rows.groupBy("source_file", "file_hash", "chat_id").agg(F.sum("n_lines").alias("total_lines"), F.count("*").alias("parsed"), F.count_if("added").alias("inserted"), F.count_if(~F.col("added")).alias("skipped"), F.sum(F.col("n_lines") - 1).alias("continuations"))
    return counts.withColumn("status", F.lit("done")).select(*RUNS.fieldNames())


def additions(lines: DataFrame, runs: DataFrame, known: DataFrame, timezone: str = "Europe/Rome", chat_id: str | None = None, force: bool = False, ingested_at: int = 0) -> tuple[DataFrame, DataFrame]:
    """The messages that numbered lines add to the known ones, and a ledger row per file, by the rules of `flagged`."""
    rows = flagged(lines, runs, known, timezone, chat_id, force, ingested_at)
    return rows.where("added").select(*MESSAGES.fieldNames()), ledger_of(rows)


class Archive:
    """Messages and the ledger of their files in a store: a load is seen whole or not at all.

    A load parses its files once, into a folder of its own, counts from there, and commits messages, ledger rows and the
    number of its batch in one manifest. What a lost load has written is not read; `tidy` deletes it. Loads that run or
    have failed stand in the manifest too. Where another load has added messages in between, Conflict is raised and
    nothing of this one counts.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.store = spark, Store(spark, path)

    def _read(self, state: dict, kind: str, schema) -> DataFrame:
        folders = [self.store.folder(f) for f in state.get(kind, [])]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def messages(self) -> DataFrame:
        return self._read(self.store.read()[1], "messages", MESSAGES)

    def runs(self) -> DataFrame:
        return self._read(self.store.read()[1], "runs", RUNS)

    def unfinished(self) -> dict[str, dict]:
        """Loads that run (or were lost) and that have failed: status, source and error by their number."""
        return self.store.read()[1].get("loads", {})

    def _note(self, load: str, **entry: str) -> None:
        """Put the load's state into the next manifest; whoever commits at the same time comes before or after."""
        while True:
            version, state = self.store.read()
            try:
                self.store.commit(version, state | {"loads": state.get("loads", {}) | {load: entry}})
                return
            except Conflict:
                continue

    def load(self, lines: DataFrame, timezone: str = "Europe/Rome", chat_id: str | None = None, force: bool = False, ingested_at: int = 0, source: str = "", batch: tuple[str, int] | None = None) -> DataFrame:
        """Add numbered lines; returns the ledger rows of the files that were not there. A batch (of a stream, by number) that is in already adds nothing."""
        _, state = self.store.read()
        if batch and state.get("batches", {}).get(batch[0], -1) >= batch[1]:
            return self.spark.createDataFrame([], RUNS)
        number = uuid.uuid4().hex
        self._note(number, status="running", source=source)
        try:
            return self._load(number, state, flagged(lines, self._read(state, "runs", RUNS), self._read(state, "messages", MESSAGES), timezone, chat_id, force, ingested_at), batch)
        except Exception as error:
            self._note(number, status="failed", source=source, error=f"{type(error).__name__}: {error}"[:1000])
            raise

    def _load(self, number: str, before: dict, rows: DataFrame, batch: tuple[str, int] | None) -> DataFrame:
        staged, added, runs = (f"{kind}/part={number}" for kind in ("staged", "messages", "runs"))
        write(rows.select(*MESSAGES.fieldNames(), "file_hash", "n_lines", "added"), self.store.folder(staged))
        parsed = self.spark.read.schema(rows.select(*MESSAGES.fieldNames(), "file_hash", "n_lines", "added").schema).parquet(self.store.folder(staged))
        write(ledger_of(parsed), self.store.folder(runs))
        done = self.spark.read.schema(RUNS).parquet(self.store.folder(runs))
        found = not done.isEmpty()
        if found:
            write(parsed.where("added").select(*MESSAGES.fieldNames()), self.store.folder(added))
        while True:
            version, state = self.store.read()
            if state.get("messages", []) != before.get("messages", []):
                raise Conflict("another load has added messages: read again and repeat")
            after = state | {"loads": {k: v for k, v in state.get("loads", {}).items() if k != number}}
            if found:
                after |= {"messages": [*state.get("messages", []), added], "runs": [*state.get("runs", []), runs]}
            if batch:
                after |= {"batches": state.get("batches", {}) | {batch[0]: batch[1]}}
            try:
                self.store.commit(version, after)
                break
            except Conflict:
                continue
        self.store.delete(staged)
        return done

    def tidy(self) -> int:
        """Delete what no manifest names, also of loads that were lost; none may run meanwhile."""
        version, state = self.store.read()
        self.store.commit(version, state | {"loads": {k: v for k, v in state.get("loads", {}).items() if v["status"] != "running"}})
        return self.store.vacuum(("staged", "messages", "runs"), {*state.get("messages", []), *state.get("runs", [])})


def ingest(spark: SparkSession, path: str, store: str, timezone: str = "Europe/Rome", chat_id: str | None = None, force: bool = False, ingested_at: int = 0) -> DataFrame:
    """Add the files at `path` to the archive at `store`; returns a ledger row per new file."""
    return Archive(spark, store).load(export.read_lines(spark, path), timezone, chat_id, force, ingested_at, path)


def follow(spark: SparkSession, landing: str, store: str, checkpoint: str, timezone: str = "Europe/Rome", chat_id: str | None = None, files: int = 1000, **trigger) -> StreamingQuery:
    """A stream that adds the files that arrive in `landing`, at most so many a batch; by default it ends when it has taken all.

    A file's name is read once: a later export of a chat comes under a new name. The archive keeps the last batch of the
    stream, known by its checkpoint, so that one that is repeated after a failure adds nothing twice and loses nothing.
    """
    archive = Archive(spark, store)

    def take(rows: DataFrame, batch: int) -> None:
        archive.load(export.number(rows), timezone, chat_id, source=landing, batch=(checkpoint, batch))

    lines = export.raw_lines(spark.readStream.option("maxFilesPerTrigger", files), landing)
    return lines.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
