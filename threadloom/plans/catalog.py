"""Queries over the driver's tables and the SQL that says the same.

Adapters give the tables the shape of messages: an event is a message of its
user in the chat of its type; a conversation is a chat with roles as senders; a
document is a message in the chat of its source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import text as fx
from ..operators import collection, density, filters, fulltext, ingest, media, ordered, phrases, rollup, search, stats, topics, vectors, windows
from ..schema import MESSAGES, RUNS, STOP_WORDS, TRANSCRIPTS
from ..sources import export
from ..sources.store import shared_folder, stored
from ..streaming import incremental
from . import tools

GAP = 1800


def _read(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def events(spark: SparkSession, d: str) -> DataFrame:
    e = _read(spark, d, "events")
    at = F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    return e.select(
        F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("chat_id"), F.col("user_id").cast("string").alias("sender_name"), F.col("event_id").alias("seq"), at.alias("ts"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts_local"), F.date_format("ts", "yyyy-MM-dd").alias("local_date"), F.date_format("ts", "HH:mm").alias("local_time"), F.col("props").alias("text"), F.lit("text").alias("msg_type"),
    )


def conversations(spark: SparkSession, d: str) -> DataFrame:
    c = _read(spark, d, "conversations")
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("conv_id") % 90).cast("int")), "yyyy-MM-dd")
    return c.select(
        F.concat_ws("-", F.lpad(F.col("conv_id").cast("string"), 8, "0"), "turn").alias("id"), F.lpad(F.col("conv_id").cast("string"), 8, "0").alias("chat_id"), F.col("role").alias("sender_name"), F.col("turn").alias("seq"), (F.col("turn") * 60).alias("ts"),
        F.concat(day, F.lit(" 00:00:00")).alias("ts_local"), day.alias("local_date"), F.lit("00:00").alias("local_time"), "text", F.lit("text").alias("msg_type"),
    )


def documents(spark: SparkSession, d: str) -> DataFrame:
    t = _read(spark, d, "documents")
    return t.select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("chat_id"), F.col("lang").alias("sender_name"), F.col("doc_id").alias("seq"), F.col("doc_id").alias("ts"), F.lit("2024-01-01").alias("local_date"), F.lit("00:00").alias("local_time"), "text", F.lit("text").alias("msg_type"))


def embedded(spark: SparkSession, d: str) -> DataFrame:
    e = _read(spark, d, "embeddings")
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("vec_id") % 300).cast("int")), "yyyy-MM-dd")
    t = _read(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    return e.join(t, "vec_id").select(F.col("vec_id").alias("id"), F.col("label").cast("int").alias("label"), "embedding", "text", day.alias("start_date"))


def exported(spark: SparkSession, d: str) -> DataFrame:
    """Conversations written out as the numbered lines of export files, one file each."""
    c = _read(spark, d, "conversations").withColumn("day", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("conv_id") % 90).cast("int")))
    header = F.concat(F.date_format("day", "dd/MM/yyyy"), F.lit(", 00:"), F.lpad((F.col("turn") % 60).cast("string"), 2, "0"), F.lit(" - "), "role", F.lit(": "))
    lines = c.select(F.lpad(F.col("conv_id").cast("string"), 8, "0").alias("source_file"), "turn", F.posexplode(F.split(F.concat(header, F.coalesce("text", F.lit(""))), "\n")).alias("pos", "value"))
    number = F.row_number().over(Window.partitionBy("source_file").orderBy("turn", "pos")).cast("long")
    return lines.select("source_file", F.lit("").alias("file_hash"), number.alias("line_no"), "value")


#: What events say as lines of an export, by event_id % 9; numbers 6 and 7 have no sender.
BODIES = [
    "{props}", "<Media omessi>", "IMG-20240101-WA0001.jpg (file allegato)", "PTT-20240101-WA0002.opus (file attached)", "This message was deleted",
    "{props} <This message was edited>", "{notice}", "Missed voice call", "<posizione>",
]


def exported_events(spark: SparkSession, d: str) -> DataFrame:
    """Events written out as export lines of all kinds, a file per event type, with twelve-hour clocks; notices in the file `error` speak of a group."""
    e = _read(spark, d, "events")
    notice = F.when(F.col("event_type") == "error", "u0 created group x").otherwise("Messages are encrypted")
    said = [F.replace(F.replace(F.lit(b), F.lit("{props}"), F.col("props")), F.lit("{notice}"), notice) for b in BODIES]
    kind = F.col("event_id") % len(BODIES)
    body = F.element_at(F.array(*said), (kind + 1).cast("int"))
    sender = F.when(kind.isin(6, 7), "").otherwise(F.concat(F.lit("u"), (F.col("user_id") % 2).cast("string"), F.lit(": ")))
    value = F.concat(F.date_format("ts", "dd/MM/yy, hh:mm:ss a"), F.lit(" - "), sender, body)
    lines = e.select("event_id", F.col("event_type").alias("chat_id"), value.alias("value"))
    # A file is as long as its event type has events: its lines are numbered over ranges of them.
    placed = ordered.placed(ordered.numbered(lines, "chat_id", "event_id"))
    return placed.select(F.concat("chat_id", F.lit(".txt")).alias("source_file"), F.lit("").alias("file_hash"), (F.col("at") + 1).alias("line_no"), "value")


def mixed(spark: SparkSession, d: str) -> DataFrame:
    """Messages of all types: the exported events, parsed in Rome's time and with ids."""
    return ingest.stable_ids(export.parse(exported_events(spark, d), "Europe/Rome"))


def overlapping(spark: SparkSession, d: str) -> DataFrame:
    """Two exports of each conversation: one up to turn 3, and a later one from turn 2 on."""
    c = _read(spark, d, "conversations").withColumn("day", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("conv_id") % 90).cast("int")))
    header = F.concat(F.date_format("day", "dd/MM/yyyy"), F.lit(", 00:"), F.lpad((F.col("turn") % 60).cast("string"), 2, "0"), F.lit(" - "), "role", F.lit(": "))
    of = F.explode(F.filter(F.array(F.when(F.col("turn") <= 3, "a"), F.when(F.col("turn") >= 2, "b")), lambda x: x.isNotNull()))
    lines = c.withColumn("of", of).select(F.concat("of", F.lit("/"), F.lpad(F.col("conv_id").cast("string"), 8, "0"), F.lit(".txt")).alias("source_file"), "turn", F.posexplode(F.split(F.concat(header, F.coalesce("text", F.lit(""))), "\n")).alias("pos", "value"))
    number = F.row_number().over(Window.partitionBy("source_file").orderBy("turn", "pos")).cast("long")
    return lines.select("source_file", F.lit("").alias("file_hash"), number.alias("line_no"), "value")


def rounded(df: DataFrame, *names: str, to: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, to) for n in names})


EV = """ev AS (SELECT CAST(event_id AS VARCHAR) AS id, event_type AS chat_id, CAST(user_id AS VARCHAR) AS sender_name, event_id AS seq, CAST(floor(epoch(ts)) AS BIGINT) AS ts,
 strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts_local, strftime(ts, '%Y-%m-%d') AS local_date, strftime(ts, '%H:%M') AS local_time, CAST(ts AS DATE) AS d FROM events)"""
CV = """cv AS (SELECT lpad(CAST(conv_id AS VARCHAR), 8, '0') || '-' || turn AS id, lpad(CAST(conv_id AS VARCHAR), 8, '0') AS chat_id, role AS sender_name, turn AS seq, turn * 60 AS ts,
 strftime(DATE '2024-01-01' + CAST(conv_id % 90 AS INTEGER), '%Y-%m-%d') AS local_date, text FROM conversations)"""
SESSIONS = f"""WITH {EV}, m AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > {GAP} THEN 1 ELSE 0 END AS fresh FROM ev WINDOW w AS (PARTITION BY chat_id ORDER BY ts, seq)),
 n AS (SELECT *, sum(fresh) OVER (PARTITION BY chat_id ORDER BY ts, seq) AS k FROM m),
 g AS (SELECT chat_id, CAST(k AS BIGINT) AS session_no, min(ts) AS start_ts, max(ts) AS end_ts, min(ts_local) AS start_local, max(ts_local) AS end_local, count(*) AS messages, arg_min(sender_name, seq) AS starter FROM n GROUP BY chat_id, k),
 s AS (SELECT *, end_ts - start_ts AS duration_sec, start_ts - lag(end_ts) OVER (ORDER BY chat_id, session_no) AS gap_before_sec FROM g)"""
WORDS = "regexp_extract_all(lower(regexp_replace(text, 'https?://\\S+|www\\.\\S+', ' ', 'gi')), '[0-9a-zàáèéìíòóùúâêîôûäëïöüç'']+')"
STOP = "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(STOP_WORDS)) + ")"
FTS = f"list_filter(regexp_split_to_array(translate(lower(coalesce(text, '')), '{fx.ACCENTED}', '{fx.PLAIN}'), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"
PHRASE = "the of"
GRAMS = f"""WITH {CV}, w AS (SELECT sender_name, local_date, list_filter(regexp_extract_all(lower(text), '[0-9a-zàáèéìíòóùúâêîôûäëïöüç'']+'), lambda x: length(x) >= 2)[1:40] AS w FROM cv),
 e AS (SELECT sender_name, local_date, n, unnest([w[i:i + n - 1] FOR i IN range(1, len(w) - n + 2)]) AS g FROM w, (VALUES (2), (3), (4)) v(n) WHERE len(w) >= n),
 c AS (SELECT g, n, count(*) AS count, min(local_date) AS first, max(local_date) AS last FROM e WHERE len(list_filter(g, lambda x: length(x) >= 3 AND x NOT IN {STOP})) > 0 GROUP BY g, n HAVING count(*) >= 3)"""

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(
    f"""WITH {EV}, p AS (SELECT sender_name, ts - lag(ts) OVER w AS gap, lag(sender_name) OVER w AS prev FROM ev WINDOW w AS (PARTITION BY chat_id ORDER BY ts, seq)),
 v AS (SELECT 'any' AS variant, gap FROM p WHERE gap >= 0 UNION ALL SELECT 'reply', gap FROM p WHERE gap >= 0 AND sender_name IS DISTINCT FROM prev UNION ALL SELECT 'reply-session', gap FROM p WHERE gap >= 0 AND gap <= {GAP} AND sender_name IS DISTINCT FROM prev)
 SELECT variant, count(*) AS count, round(avg(gap), 6) AS mean, CAST(median(gap) AS DOUBLE) AS median, CAST(list_sort(list(gap))[least(count(*) - 1, CAST(floor(0.9 * count(*)) AS BIGINT)) + 1] AS DOUBLE) AS p90, CAST(min(gap) AS DOUBLE) AS min_gap, CAST(max(gap) AS DOUBLE) AS max_gap FROM v GROUP BY variant"""
)
def response_times(spark, d):
    return rounded(stats.response_times(events(spark, d), GAP), "mean")


@query(
    f"""WITH {CV} SELECT sender_name, count(*) AS messages, round(count(*) / sum(count(*)) OVER (), 6) AS share, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(len(regexp_extract_all(text, '(?i)[0-9a-zàáèéìíòóùúâêîôûäëïöüç'']+'))) AS BIGINT) AS words,
 round(sum(length(text)) / count(*), 6) AS avg_chars, min(local_date) AS first_date, max(local_date) AS last_date FROM cv GROUP BY sender_name"""
)
def per_sender(spark, d):
    return rounded(stats.per_sender(conversations(spark, d)), "share", "avg_chars")


@query(SESSIONS + " SELECT * FROM s")
def sessions(spark, d):
    return stats.sessions(events(spark, d), GAP)


@query(SESSIONS + " SELECT starter, count(*) AS sessions, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM s GROUP BY starter")
def session_starters(spark, d):
    return rounded(stats.session_starters(stats.sessions(events(spark, d), GAP)), "share")


@query(SESSIONS + " SELECT * FROM s WHERE gap_before_sec IS NOT NULL ORDER BY gap_before_sec DESC, chat_id, session_no LIMIT 5")
def longest_silences(spark, d):
    return stats.longest_silences(stats.sessions(events(spark, d), GAP))


@query(SESSIONS + " SELECT * FROM s ORDER BY messages DESC, chat_id, session_no LIMIT 5")
def longest_sessions(spark, d):
    return stats.longest_sessions(stats.sessions(events(spark, d), GAP))


for _bucket, _format in (("day", "%Y-%m-%d"), ("week", "%Y-W%W"), ("month", "%Y-%m"), ("year", "%Y")):
    QUERIES[f"volume_{_bucket}"] = lambda spark, d, b=_bucket: stats.volume(events(spark, d), b)
    ORACLE_SQL[f"volume_{_bucket}"] = f"SELECT strftime(ts, '{_format}') AS period, count(*) AS count FROM events GROUP BY 1"


@query("SELECT CAST(hour(ts) AS INTEGER) AS hour, count(*) AS count FROM events GROUP BY 1")
def time_of_day_hours(spark, d):
    return stats.hours(events(spark, d))


@query("SELECT CAST(dayofweek(ts) AS INTEGER) AS weekday, count(*) AS count FROM events GROUP BY 1")
def time_of_day_weekdays(spark, d):
    return stats.weekdays(events(spark, d))


@query(f"SELECT word, count(*) AS count FROM (SELECT unnest({WORDS}) AS word FROM documents) WHERE length(word) >= 3 AND word NOT IN {STOP} GROUP BY word ORDER BY count DESC, word LIMIT 40")
def word_frequency(spark, d):
    return stats.word_frequency(documents(spark, d))


@query(f"SELECT word, count(*) AS count FROM (SELECT unnest({WORDS}) AS word FROM conversations) WHERE length(word) >= 2 GROUP BY word ORDER BY count DESC, word LIMIT 100")
def word_frequency_all(spark, d):
    return stats.word_frequency(conversations(spark, d), top=100, min_len=2, stop_words=False)


@query("SELECT msg_type, count(*) AS count FROM (SELECT 'text' AS msg_type FROM events) GROUP BY 1")
def type_breakdown(spark, d):
    return stats.type_breakdown(events(spark, d))


@query(f"WITH {EV} SELECT sender_name, count(*) AS count FROM ev GROUP BY 1 ORDER BY count DESC, sender_name LIMIT 25")
def top_senders(spark, d):
    return stats.top_senders(events(spark, d))


@query(f"""WITH {EV}, b AS (SELECT sender_name, count(*) AS messages, max(ts) - min(ts) AS s FROM ev GROUP BY 1), t AS (SELECT *, max(messages) OVER () AS most FROM b)
 SELECT sender_name, messages,
 CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN (((s * 20 + 60) // 120) // 10) || '.' || (((s * 20 + 60) // 120) % 10) || 'm'
  WHEN s < 86400 THEN (((s * 20 + 3600) // 7200) // 10) || '.' || (((s * 20 + 3600) // 7200) % 10) || 'h'
  ELSE (((s * 20 + 86400) // 172800) // 10) || '.' || (((s * 20 + 86400) // 172800) % 10) || 'd' END AS span,
 CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN (s // 60) || 'm' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') || 's'
  ELSE (s // 3600) || 'h' || lpad(CAST((s // 60) % 60 AS VARCHAR), 2, '0') || 'm' END AS clock,
 repeat('█', CAST(round_even(messages / most * 24, 0) AS INTEGER)) AS bar FROM t""")
def spans(spark, d):
    return stats.spans(events(spark, d))


@query(f"""WITH {EV} SELECT chat_id, count(*) AS messages, count(DISTINCT sender_name) > 2 AS is_group, min(ts) AS first_ts, max(ts) AS last_ts, min(local_date) AS first, max(local_date) AS last FROM ev GROUP BY chat_id""")
def list_chats(spark, d):
    return stats.list_chats(events(spark, d))


@query("""WITH b AS (SELECT role || '|' || text AS k, conv_id, turn, substr(sha1(role || '|' || text), 1, 16) AS base FROM conversations), n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY conv_id, turn) - 1 AS again FROM b)
 SELECT conv_id, turn, CASE WHEN again > 0 THEN base || '-' || again ELSE base END AS id FROM n""")
def stable_ids(spark, d):
    base = F.substring(F.sha1(F.concat_ws("|", "role", "text")), 1, 16)
    rows = _read(spark, d, "conversations").withColumn("base", base)
    again = F.row_number().over(Window.partitionBy("base").orderBy("conv_id", "turn")) - 1
    return rows.withColumn("again", again).select("conv_id", "turn", F.when(F.col("again") > 0, F.concat_ws("-", "base", "again")).otherwise(F.col("base")).alias("id"))


EX = """l AS (SELECT lpad(CAST(conv_id AS VARCHAR), 8, '0') AS chat_id, turn, role, coalesce(text, '') AS text, DATE '2024-01-01' + CAST(conv_id % 90 AS INTEGER) AS day, lpad(CAST(turn % 60 AS VARCHAR), 2, '0') AS minute,
 CAST(len(string_split(coalesce(text, ''), chr(10))) AS BIGINT) AS n_lines FROM conversations),
 ex AS (SELECT chat_id, role AS sender_name, CAST(1 + coalesce(sum(n_lines) OVER (PARTITION BY chat_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS line_no, n_lines, CAST(epoch(day) AS BIGINT) + 60 * (turn % 60) AS ts,
 strftime(day, '%Y-%m-%d') AS local_date, '00:' || minute AS local_time, text, strftime(day, '%d/%m/%Y') || ', 00:' || minute || ' - ' || role || ': ' || text AS raw_line FROM l)"""


@query(f"WITH {EX} SELECT chat_id, sender_name, line_no, n_lines, ts, local_date, local_time, text, raw_line, 'text' AS msg_type FROM ex")
def export_messages(spark, d):
    """Parsing, folding and classification of exported lines."""
    found = export.parse(exported(spark, d), "UTC")
    return found.select("chat_id", "sender_name", "line_no", "n_lines", "ts", "local_date", "local_time", "text", "raw_line", "msg_type")


@query(f"WITH {EX} SELECT sender_name, n_lines, ts, local_date, local_time, text, raw_line FROM ex")
def export_files(spark, d):
    """Export files in the shared folder, each of many conversations, read by ranges of bytes."""
    folder = shared_folder(spark)
    lines = exported(spark, d).repartitionByRange("source_file").sortWithinPartitions("source_file", "line_no")
    lines.select(F.coalesce("value", F.lit(""))).write.text(folder)
    return export.parse(export.read_lines(spark, folder), "UTC").select("sender_name", "n_lines", "ts", "local_date", "local_time", "text", "raw_line")


@query(f"WITH {EX} SELECT sender_name, local_date, count(*) AS messages, CAST(sum(n_lines) AS BIGINT) AS lines FROM ex GROUP BY sender_name, local_date")
def stream_landing(spark, d):
    """Export files that a stream takes from a landing folder into an archive."""
    landing, archive, checkpoint = (shared_folder(spark) for _ in range(3))
    lines = exported(spark, d).repartitionByRange("source_file").sortWithinPartitions("source_file", "line_no")
    lines.select(F.coalesce("value", F.lit(""))).write.text(landing)
    ingest.follow(spark, landing, archive, checkpoint, "UTC").awaitTermination()
    held = ingest.Archive(spark, archive).messages()
    return held.groupBy("sender_name", "local_date").agg(F.count("*").alias("messages"), F.sum(F.size(F.split("raw_line", "\n"))).alias("lines"))


@query(f"""WITH {EX}, b AS (SELECT chat_id, line_no, substr(sha1(concat_ws('|', chat_id, ts, sender_name, text, raw_line)), 1, 16) AS base FROM ex), n AS (SELECT *, row_number() OVER (PARTITION BY chat_id, base ORDER BY line_no) - 1 AS again FROM b)
 SELECT chat_id, line_no, CASE WHEN again > 0 THEN base || '-' || again ELSE base END AS id FROM n""")
def export_ids(spark, d):
    return ingest.stable_ids(export.parse(exported(spark, d), "UTC")).select("chat_id", "line_no", "id")


@query(f"WITH {EX} SELECT chat_id AS source_file, CAST(sum(n_lines) AS BIGINT) AS lines, count(*) AS messages, CAST(sum(n_lines - 1) AS BIGINT) AS continuations FROM ex GROUP BY chat_id")
def export_counts(spark, d):
    return export.parse_stats(export.parse(exported(spark, d), "UTC"))


MX = """mx AS (SELECT event_id, event_type AS chat_id, event_id % 9 AS k, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS line_no, CAST(floor(epoch(ts)) AS BIGINT) - 3600 AS ts, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts_local,
 strftime(ts, '%Y-%m-%d') AS local_date, strftime(ts, '%H:%M') AS local_time, strftime(ts, '%d/%m/%y, %I:%M:%S %p') AS stamp, CASE WHEN event_id % 9 NOT IN (6, 7) THEN 'u' || user_id % 2 END AS sender_name,
 ['text', 'media', 'image', 'voice', 'deleted', 'edited', 'system', 'call', 'location'][event_id % 9 + 1] AS msg_type, CASE event_id % 9 WHEN 2 THEN 'IMG-20240101-WA0001.jpg' WHEN 3 THEN 'PTT-20240101-WA0002.opus' END AS media_ref,
 CASE event_id % 9 WHEN 0 THEN props WHEN 1 THEN '<Media omessi>' WHEN 2 THEN 'IMG-20240101-WA0001.jpg (file allegato)' WHEN 3 THEN 'PTT-20240101-WA0002.opus (file attached)' WHEN 4 THEN 'This message was deleted' WHEN 5 THEN props
  WHEN 6 THEN CASE event_type WHEN 'error' THEN 'u0 created group x' ELSE 'Messages are encrypted' END WHEN 7 THEN 'Missed voice call' ELSE '<posizione>' END AS text FROM events),
 mi AS (SELECT *, substr(sha1(concat_ws('|', chat_id, ts, coalesce(sender_name, ''), text, raw_line)), 1, 16) AS base FROM (SELECT *, stamp || ' - ' || coalesce(sender_name || ': ', '') || text || CASE k WHEN 5 THEN ' <This message was edited>' ELSE '' END AS raw_line FROM mx)),
 mm AS (SELECT *, CASE WHEN again > 0 THEN base || '-' || again ELSE base END AS id FROM (SELECT *, row_number() OVER (PARTITION BY chat_id, base ORDER BY line_no) - 1 AS again FROM mi))"""


@query(f"WITH {MX} SELECT id, chat_id, line_no, ts, ts_local, local_date, local_time, sender_name, msg_type, media_ref, text, raw_line FROM mm")
def export_kinds(spark, d):
    """All kinds of lines: twelve-hour clocks, local time to UTC, types, senders, attachments, ids."""
    return mixed(spark, d).select("id", "chat_id", "line_no", "ts", "ts_local", "local_date", "local_time", "sender_name", "msg_type", "media_ref", "text", "raw_line")


@query(f"WITH {MX} SELECT msg_type, count(*) AS count FROM mx GROUP BY 1")
def kinds_breakdown(spark, d):
    return stats.type_breakdown(mixed(spark, d))


@query(f"WITH {MX} SELECT msg_type, CAST(n AS INTEGER) AS n, text FROM (SELECT *, row_number() OVER (PARTITION BY msg_type ORDER BY line_no, chat_id) AS n FROM mx) WHERE n <= 3")
def kinds_preview(spark, d):
    return stats.samples(mixed(spark, d))


MX_PER_SENDER = f"WITH {MX} SELECT sender_name, count(*) AS messages, round(count(*) / sum(count(*)) OVER (), 6) AS share, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(len(regexp_extract_all(text, '(?i)[0-9a-zàáèéìíòóùúâêîôûäëïöüç'']+'))) AS BIGINT) AS words, round(sum(length(text)) / count(*), 6) AS avg_chars, min(local_date) AS first_date, max(local_date) AS last_date FROM mx WHERE msg_type IN ('text', 'edited') AND sender_name IS NOT NULL GROUP BY sender_name"


@query(MX_PER_SENDER)
def kinds_per_sender(spark, d):
    """Only text and edited messages count."""
    return rounded(stats.per_sender(mixed(spark, d)), "share", "avg_chars")


MX_VOLUME = f"WITH {MX} SELECT strftime(CAST(local_date AS DATE), '%Y-W%W') AS period, count(*) AS count FROM mx WHERE msg_type <> 'system' AND chat_id = 'click' AND sender_name = 'u1' GROUP BY 1"


@query(MX_VOLUME)
def kinds_volume(spark, d):
    """No system rows, one chat, one sender."""
    return stats.volume(mixed(spark, d), "week", chat_id="click", sender="u1")


MX_CHATS = f"WITH {MX} SELECT chat_id, count(*) AS messages, count(DISTINCT sender_name) > 2 OR bool_or(msg_type = 'system' AND contains(lower(text), 'group')) AS is_group, min(ts) AS first_ts, max(ts) AS last_ts, strftime(make_timestamp((min(ts) + 3600) * 1000000), '%Y-%m-%d') AS first, strftime(make_timestamp((max(ts) + 3600) * 1000000), '%Y-%m-%d') AS last FROM mx GROUP BY chat_id"


@query(MX_CHATS)
def kinds_chats(spark, d):
    """A chat of two is a group where a system notice says so."""
    return stats.list_chats(mixed(spark, d), "Europe/Rome")


@query(f"WITH {MX} SELECT chat_id || '::' || sender_name AS sender_id, chat_id, sender_name AS name, sender_name AS cut, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS messages FROM mx WHERE sender_name IS NOT NULL GROUP BY chat_id, sender_name")
def kinds_senders(spark, d):
    return stats.senders(mixed(spark, d)).withColumn("cut", fx.sender_name(F.col("sender_id")))


@query(f"WITH {MX} SELECT CAST(hour(CAST(ts_local AS TIMESTAMP)) AS INTEGER) AS hour, count(*) AS count FROM mx WHERE msg_type <> 'system' GROUP BY 1")
def kinds_hours(spark, d):
    return stats.hours(mixed(spark, d))


@query(f"WITH {MX} SELECT id, msg_type, CASE WHEN msg_type = 'voice' AND line_no % 2 = 0 THEN 'said ' || id ELSE text END AS text FROM mm")
def transcripts_effective(spark, d):
    """Transcripts of every second voice note lie over the messages' texts."""
    m = mixed(spark, d)
    said = media.voice_messages(m).where("line_no % 2 = 0").select(F.col("id").alias("message_id"), F.lit("transcribed").alias("status"), F.col("media_ref").alias("media_file"), F.lit("it").alias("language"), F.lit(1.0).alias("duration_sec"), F.concat(F.lit("said "), "id").alias("text"))

    class Engine:
        name, model = "table", "none"

    return media.effective(m, media.store(spark.createDataFrame([], TRANSCRIPTS), said, Engine)).select("id", "msg_type", "text")


OV = """ov AS (SELECT f || '/' || lpad(CAST(conv_id AS VARCHAR), 8, '0') || '.txt' AS source_file, lpad(CAST(conv_id AS VARCHAR), 8, '0') AS chat_id, f, turn, CAST(len(string_split(coalesce(text, ''), chr(10))) AS BIGINT) AS n_lines
 FROM conversations, (VALUES ('a'), ('b')) v(f) WHERE CASE f WHEN 'a' THEN turn <= 3 ELSE turn >= 2 END)"""


LEDGER = f"WITH {OV} SELECT source_file, chat_id, CAST(sum(n_lines) AS BIGINT) AS total_lines, count(*) AS parsed, count(*) FILTER (f = 'a' OR turn > 3) AS inserted, count(*) FILTER (f = 'b' AND turn <= 3) AS skipped, CAST(sum(n_lines - 1) AS BIGINT) AS continuations, 'done' AS status FROM ov GROUP BY source_file, chat_id"


@query(LEDGER)
def load_overlapping(spark, d):
    """The ledger of a load of two overlapping exports of each conversation: what both hold comes in once."""
    return ingest.additions(overlapping(spark, d), spark.createDataFrame([], RUNS), spark.createDataFrame([], MESSAGES), "UTC")[1].drop("file_hash")


@query(LEDGER)
def load_staged(spark, d):
    """The ledger of an archive after a load of the earlier exports and one of all."""
    lines = overlapping(spark, d)
    archive = ingest.Archive(spark, shared_folder(spark))
    archive.load(lines.where("source_file like 'a/%'"), "UTC")
    archive.load(lines, "UTC")
    return archive.runs().drop("file_hash")


@query(f"WITH {OV} SELECT chat_id, count(*) AS messages FROM ov WHERE f = 'a' OR turn > 3 GROUP BY chat_id")
def load_staged_messages(spark, d):
    """What the archive holds of each chat: every message once."""
    lines = overlapping(spark, d)
    archive = ingest.Archive(spark, shared_folder(spark))
    archive.load(lines.where("source_file like 'a/%'"), "UTC")
    archive.load(lines, "UTC")
    return archive.messages().groupBy("chat_id").agg(F.count("*").alias("messages"))


@query(f"WITH {OV} SELECT source_file, chat_id, count(*) AS messages FROM ov WHERE f = 'b' AND turn > 3 GROUP BY source_file, chat_id")
def load_later(spark, d):
    """A later load: the earlier exports are in the ledger and their messages known, so only what is new in the later ones comes in."""
    lines = overlapping(spark, d)
    early = lines.where("source_file like 'a/%'")
    known, runs = ingest.additions(early, spark.createDataFrame([], RUNS), spark.createDataFrame([], MESSAGES), "UTC")
    return ingest.additions(lines, runs, known, "UTC")[0].groupBy("source_file", "chat_id").agg(F.count("*").alias("messages"))


@query("""WITH q AS (SELECT list_transform(range(64), lambda i: CASE WHEN i % 3 = 0 THEN 1.0 ELSE -0.5 END) AS q), e AS (SELECT CAST(vec_id AS VARCHAR) AS id, strftime(DATE '2024-01-01' + CAST(vec_id % 300 AS INTEGER), '%Y-%m-%d') AS date, coalesce(lang, '') AS sender, trim(text, ' ') AS t,
 round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])), 4) AS score, source FROM embeddings JOIN documents ON vec_id = doc_id, q)
 SELECT id, date, sender, CASE WHEN length(t) > 400 THEN substr(t, 1, 399) || '…' ELSE t END AS text, score FROM e WHERE sender = 'en' AND date >= '2024-02-01' AND date <= '2024-09-30' ORDER BY score DESC, id LIMIT 12""")
def semantic_search(spark, d):
    """Search of an index with a filter by sender and days; texts are clipped."""

    class Fixed:
        model = "m"

        def embed(self, texts):
            return [[-0.5 if i % 3 else 1.0 for i in range(64)] for _ in texts]

    rows = embedded(spark, d).join(_read(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang", "source"), "id")
    index = rows.select(F.col("id").cast("string").alias("id"), F.lit("message").alias("kind"), "text", F.lit("m").alias("model"), "embedding", F.col("source").alias("chat_id"), F.col("lang").alias("sender_name"), F.col("start_date").alias("local_date"))
    return vectors.semantic_search(index, Fixed(), "any", 12, sender="en", date_from="2024-02-01", date_to="2024-09-30")


@query(
    f"""WITH e AS (SELECT CAST(label AS INTEGER) AS label, vec_id, strftime(DATE '2024-01-01' + CAST(vec_id % 300 AS INTEGER), '%Y-%m-%d') AS day, text FROM embeddings JOIN documents ON vec_id = doc_id), w AS (SELECT label, unnest({WORDS}) AS term FROM e), t AS (SELECT label, term, count(*) AS tf FROM w WHERE length(term) >= 3 AND term NOT IN {STOP} GROUP BY label, term),
 x AS (SELECT *, count(*) OVER (PARTITION BY term) AS df FROM t), m AS (SELECT sum(tf) / count(DISTINCT label) AS mean FROM t), r AS (SELECT label, term, row_number() OVER (PARTITION BY label ORDER BY tf * ln(1 + mean / df) DESC, term DESC) AS rank FROM x, m),
 b AS (SELECT label, string_agg(term, ' ' ORDER BY rank) AS terms FROM r WHERE rank <= 5 GROUP BY label), n AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id % 7, vec_id) AS r FROM e),
 g AS (SELECT label, string_agg(CAST(vec_id AS VARCHAR), ' ' ORDER BY r) AS examples FROM n WHERE r <= 3 GROUP BY label)
 SELECT label, count(*) AS size, min(day) AS start_date, max(day) AS end_date, any_value(terms) AS terms, any_value(examples) AS examples FROM e JOIN b USING (label) JOIN g USING (label) GROUP BY label"""
)
def topic_summary(spark, d):
    """Size, days, terms and nearest examples per cluster, with the tables' labels as clusters and vec_id % 7 as the distance to the centre."""
    rows = embedded(spark, d).withColumn("to_centre", (F.col("id") % 7).cast("double"))
    found = topics.summary(rows, 5)
    return found.select("label", "size", "start_date", "end_date", F.array_join("terms", " ").alias("terms"), F.array_join(F.transform("examples", lambda x: x["id"].cast("string")), " ").alias("examples"))


@query(SESSIONS + " SELECT chat_id, start_ts, end_ts, messages FROM s")
def watermarked_sessions(spark, d):
    """The sessions of a stream, over a table."""
    return incremental.stream_sessions(events(spark, d), GAP)


@query("SELECT event_type AS chat_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS count FROM events GROUP BY 1, 2")
def watermarked_volume(spark, d):
    return incremental.stream_volume(events(spark, d))


@query("SELECT strftime(ts, '%Y-W%W') AS period, count(*) AS count FROM events WHERE event_type = 'click' GROUP BY 1")
def tool_stats(spark, d):
    """A report of the statistics tool, by name and JSON arguments."""
    got = tools.use(tools.ToolContext(events(spark, d)), "get_stats", {"metric": "volume", "bucket": "week", "chat_id": "click"})
    return spark.createDataFrame([(r["period"], r["count"]) for r in got.value["rows"]], "period string, count long")


@query("""SELECT id, chat_id, local_date, sender_name FROM (SELECT CAST(event_id AS VARCHAR) AS id, event_type AS chat_id, strftime(ts, '%Y-%m-%d') AS local_date, CAST(user_id AS VARCHAR) AS sender_name FROM events)
 WHERE chat_id = 'click' AND local_date >= '2024-01-05' AND local_date <= '2024-01-20' AND sender_name <> ''""")
def filtered_messages(spark, d):
    """The common filter by chat and dates."""
    return filters.select_messages(events(spark, d), chat_id="click", date_from="2024-01-05", date_to="2024-01-20").select("id", "chat_id", "local_date", "sender_name")


@query("SELECT doc_id, sha1(text) AS text_hash FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents o WHERE o.doc_id = d.doc_id AND o.doc_id % 3 = 0)")
def pending_documents(spark, d):
    rows = documents(spark, d).select("id", F.lit("message").alias("kind"), "text", "seq")
    index = rows.where("seq % 3 = 0").select("id", "kind", F.sha1("text").alias("text_hash"), F.lit("chat").alias("collection"), F.lit("m").alias("model"))
    return vectors.pending(rows, index, "chat", "m").select(F.col("seq").alias("doc_id"), "text_hash")


@query(GRAMS + " SELECT array_to_string(g, ' ') AS phrase, CAST(n AS INTEGER) AS n, CAST(count AS BIGINT) AS count, first, last, CAST(date_diff('day', CAST(first AS DATE), CAST(last AS DATE)) AS INTEGER) AS span_days FROM c")
def ngrams(spark, d):
    return phrases.repeated_phrases(conversations(spark, d), 3, top=None, suppress=False).drop("senders")


@query(
    GRAMS
    + """, sub AS (SELECT g[i:i + k - 1] AS g, max(count) AS over_count FROM c, (VALUES (2), (3)) v(k), (VALUES (1), (2), (3)) u(i) WHERE k < n AND i + k - 1 <= n GROUP BY 1)
 SELECT array_to_string(c.g, ' ') AS phrase, CAST(c.n AS INTEGER) AS n, CAST(c.count AS BIGINT) AS count, first, last, CAST(date_diff('day', CAST(first AS DATE), CAST(last AS DATE)) AS INTEGER) AS span_days FROM c LEFT JOIN sub ON c.g = sub.g WHERE over_count IS NULL OR over_count < count"""
)
def ngrams_suppressed(spark, d):
    return phrases.repeated_phrases(conversations(spark, d), 3, top=None).drop("senders")


def _bm25(table: str) -> str:
    return f"""WITH t AS (SELECT doc_id, {FTS} AS k FROM {table}), c AS (SELECT doc_id, len(k) AS len, len(list_filter(k, lambda x: x = 'the')) AS f0, len(list_filter(k, lambda x: x = 'and')) AS f1 FROM t),
 s AS (SELECT count(*) AS n, avg(len) AS a, count(*) FILTER (f0 > 0) AS n0, count(*) FILTER (f1 > 0) AS n1 FROM c),
 r AS (SELECT doc_id, -(CASE WHEN ln((n - n0 + 0.5) / (n0 + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - n0 + 0.5) / (n0 + 0.5)) END * f0 * 2.2 / (f0 + 1.2 * (0.25 + 0.75 * len / a)) + CASE WHEN ln((n - n1 + 0.5) / (n1 + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - n1 + 0.5) / (n1 + 0.5)) END * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * len / a))) AS score FROM c, s WHERE f0 > 0 AND f1 > 0)
 SELECT CAST(doc_id AS VARCHAR) AS id, round(score, 9) AS score FROM r ORDER BY r.score, doc_id LIMIT 20"""


def _evidence(table: str) -> str:
    return f"WITH t AS (SELECT doc_id, text, ' ' || array_to_string({FTS}, ' ') || ' ' AS k FROM {table}) SELECT CAST(doc_id AS VARCHAR) AS id, substr(text, 1, 300) AS text FROM t WHERE contains(k, ' {PHRASE} ') ORDER BY doc_id LIMIT 15"


TIMELINE = f"WITH {CV}, t AS (SELECT local_date, ' ' || array_to_string({FTS}, ' ') || ' ' AS k FROM cv) SELECT strftime(CAST(local_date AS DATE), '%Y-%W') AS period, count(*) AS count FROM t WHERE contains(k, ' {PHRASE} ') GROUP BY 1"


@query(_bm25("documents"))
def keyword_search_bm25(spark, d):
    return rounded(search.keyword_search(documents(spark, d), "the and", 20).select("id", "score"), "score", to=9)


@query(_evidence("documents"))
def phrase_evidence(spark, d):
    return phrases.evidence(documents(spark, d), PHRASE).select("id", "text")


@query(TIMELINE)
def phrase_timeline(spark, d):
    return phrases.timeline(conversations(spark, d), PHRASE, "week")


def indexed(spark: SparkSession, *loads: DataFrame) -> fulltext.FullText:
    """A stored full-text index that these loads have been added to, one after the other."""
    index = fulltext.FullText(spark, shared_folder(spark))
    for k, load in enumerate(loads):
        index.add(load, replace=k > 0)
    return index


@query(_bm25("documents"))
def indexed_keyword_search(spark, d):
    """bm25 by a stored index of two loads."""
    m = documents(spark, d)
    index = indexed(spark, m.where("seq % 2 = 0"), m.where("seq % 2 = 1"))
    return rounded(fulltext.keyword_search(index, m, "the and", 20).select("id", "score"), "score", to=9)


@query(_bm25("(SELECT CASE WHEN doc_id % 5 = 0 THEN 'the and ' || text ELSE text END AS text, doc_id FROM documents WHERE doc_id % 3 <> 1)"))
def indexed_after_changes(spark, d):
    """A third of the messages has been removed, every fifth replaced, and the segments are merged."""
    m = documents(spark, d)
    index = indexed(spark, m)
    index.remove(m.where("seq % 3 = 1").select("id"))
    index.add(m.where("seq % 3 <> 1 and seq % 5 = 0").withColumn("text", F.concat(F.lit("the and "), "text")))
    index.merge()
    return index.search("the and", 20).select("id", F.round("score", 9).alias("score"))


@query(_evidence("documents"))
def indexed_phrase_evidence(spark, d):
    """A phrase by positions."""
    m = documents(spark, d)
    return indexed(spark, m.where("seq < 100"), m.where("seq >= 100")).evidence(m, PHRASE).select("id", "text")


@query(TIMELINE)
def indexed_phrase_timeline(spark, d):
    return indexed(spark, conversations(spark, d)).timeline(PHRASE, "week")


@query(
    f"""WITH {CV}, n AS (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY ts, seq) - 1 AS a, count(*) OVER (PARTITION BY chat_id) AS n FROM cv),
 s AS (SELECT chat_id, a, n FROM n WHERE (a % 2 = 0 AND a <= n - 3) OR a = n - 3 OR (n <= 3 AND a = 0))
 SELECT s.chat_id, min_by(n.id, n.a) AS start_id, max_by(n.id, n.a) AS end_id, CAST(count(*) AS INTEGER) AS messages, string_agg(n.sender_name || ': ' || n.text, chr(10) ORDER BY n.a) AS text FROM s JOIN n ON n.chat_id = s.chat_id AND n.a BETWEEN s.a AND s.a + 2 GROUP BY s.chat_id, s.a"""
)
def sliding_windows(spark, d):
    return windows.conversation_windows(conversations(spark, d), 3, 2).select("chat_id", "start_id", "end_id", "messages", "text")


@query(f"WITH {EV}, a AS (SELECT chat_id AS c, ts AS t, seq AS s FROM ev WHERE id = '500'), p AS (SELECT id, ts FROM ev, a WHERE chat_id = c AND (ts, seq) <= (t, s) ORDER BY ts DESC, seq DESC LIMIT 6), q AS (SELECT id, ts FROM ev, a WHERE chat_id = c AND (ts, seq) > (t, s) ORDER BY ts, seq LIMIT 5) SELECT * FROM p UNION ALL SELECT * FROM q")
def context_window(spark, d):
    return search.context(events(spark, d), "500").select("id", "ts")


def _cosine(a: str, b: str) -> str:
    return f"list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"


@query(f"SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT q.vec_id AS query_id, e.vec_id AS id, round({_cosine('q.embedding', 'e.embedding')}, 4) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_cosine('q.embedding', 'e.embedding')}, 4) DESC, e.vec_id) AS rank FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id < 5) q WHERE e.vec_id <> q.vec_id) WHERE rank <= 8")
def semantic_topk(spark, d):
    rows = _read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return vectors.top_per_query(rows.where("id < 5").select(F.col("id").alias("query_id"), F.col("embedding").alias("query")), rows, 8)


@query(f"SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT q.vec_id AS query_id, e.vec_id AS id, round({_cosine('q.embedding', 'e.embedding')}, 4) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_cosine('q.embedding', 'e.embedding')}, 4) DESC, e.vec_id) AS rank FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q WHERE e.vec_id <> q.vec_id) WHERE rank <= 8")
def semantic_topk_all(spark, d):
    rows = _read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return vectors.top_per_query_in_blocks(rows.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query")), rows, 8)


@query("WITH s AS (SELECT label, k, sum(CAST(embedding[k] AS DOUBLE)) AS v FROM embeddings, range(1, 65) r(k) GROUP BY label, k) SELECT label, CAST(k - 1 AS INTEGER) AS k, round(v / sqrt(sum(v * v) OVER (PARTITION BY label)), 4) AS v FROM s")
def mean_pool(spark, d):
    pooled = vectors.mean_pool(_read(spark, d, "embeddings"), "label")
    return pooled.select("label", F.posexplode("embedding").alias("k", "v")).select("label", "k", F.round(F.col("v").cast("double"), 4).alias("v"))


@query(
    f"""WITH w AS (SELECT label, unnest({WORDS}) AS term FROM embeddings JOIN documents ON vec_id = doc_id), t AS (SELECT label, term, count(*) AS tf FROM w WHERE length(term) >= 3 AND term NOT IN {STOP} GROUP BY label, term),
 x AS (SELECT *, count(*) OVER (PARTITION BY term) AS df FROM t), m AS (SELECT sum(tf) / count(DISTINCT label) AS mean FROM t), r AS (SELECT label, term, tf * ln(1 + mean / df) AS weight FROM x, m)
 SELECT CAST(label AS INTEGER) AS label, CAST(rank AS INTEGER) AS rank, term, round(weight, 6) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY weight DESC, term DESC) AS rank FROM r) WHERE rank <= 8"""
)
def ctfidf_terms(spark, d):
    return rounded(topics.terms(embedded(spark, d)), "weight")


@query("""WITH e AS (SELECT label, strftime(DATE '2024-01-01' + CAST(vec_id % 300 AS INTEGER), '%Y-%m') AS period FROM embeddings JOIN documents ON vec_id = doc_id), t AS (SELECT label FROM e GROUP BY label ORDER BY count(*) DESC, label LIMIT 5)
 SELECT CAST(label AS INTEGER) AS label, period, count(*) AS count FROM e WHERE label IN (SELECT label FROM t) GROUP BY label, period""")
def topic_evolution(spark, d):
    return topics.evolution(embedded(spark, d), "month", 5)


@query("SELECT CAST(p AS INTEGER) AS position, v.id, coalesce(lang, '') AS sender, coalesce(text, '') AS text, doc_id IS NOT NULL AS found FROM (VALUES (0, '7'), (1, 'missing'), (2, '3')) v(p, id) LEFT JOIN documents ON CAST(doc_id AS VARCHAR) = v.id")
def citations_resolve(spark, d):
    return search.resolve(documents(spark, d), ["7", "missing", "3"]).select("position", "id", "sender", "text", "found")


@query("SELECT emoji, count FROM (VALUES ('😀', CAST(3 AS BIGINT)), ('👍🏽', CAST(1 AS BIGINT)), ('👨‍👩‍👧', CAST(1 AS BIGINT))) v(emoji, count)")
def emoji_frequency(spark, d):
    rows = spark.createDataFrame([("c", "2024-01-01", "a 😀😀 b", "text"), ("c", "2024-01-01", "👍🏽 👨‍👩‍👧 😀", "text")], "chat_id string, local_date string, text string, msg_type string")
    return stats.emoji_frequency(rows)


@query()
def emoji_frequency_conversations(spark, d):
    return stats.emoji_frequency(conversations(spark, d))


@query("""WITH e AS MATERIALIZED (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)),
 d AS (SELECT a.vec_id, list_distance(a.u, b.u) AS d FROM e a, e b) SELECT CAST(vec_id AS VARCHAR) AS id, round(list_sort(list(d))[5], 4) AS core FROM d GROUP BY vec_id""")
def topic_core_distances(spark, d):
    """What density clustering rests on: the distance of every vector to its fifth nearest, itself the first."""
    rows = ordered.numbered(_read(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), "embedding"), "id")
    points = stored(density.reduced(rows, 64), "reduced")
    return rows.join(density.core_distances(points, points.count(), 5), "g").select("id", F.round("core", 4).alias("core"))


@query()
def topic_clusters(spark, d):
    rows = embedded(spark, d).withColumn("id", F.col("id").cast("string")).drop("label")
    return topics.summary(topics.cluster(rows, 5))


@query()
def indexed_windows(spark, d):
    """Messages and mean-pooled windows, indexed by the offline embedder."""
    m, bag = conversations(spark, d), vectors.HashedBag(32)
    index = vectors.index_messages(m, vectors.empty_index(spark), bag)
    return vectors.index_windows(m, index, bag, mode="mean", size=3, stride=2).select("id", "kind", "text_hash", "embedding")


def vector_rows(spark: SparkSession, d: str, word: str) -> DataFrame:
    """Embeddings as rows of a vector collection: chats are labels, and texts are a word and the id."""
    text = F.concat(F.lit(word), F.col("vec_id").cast("string"))
    return _read(spark, d, "embeddings").select("vec_id", F.col("vec_id").cast("string").alias("id"), F.lit("message").alias("kind"), text.alias("text"), F.sha1(text).alias("text_hash"), "embedding", F.col("label").cast("string").alias("chat_id"))


@query("""SELECT CAST(vec_id AS VARCHAR) AS id, 'chat' AS collection, CASE WHEN vec_id % 5 = 3 THEN 'new ' ELSE 'old ' END || vec_id AS text, CAST(label AS VARCHAR) AS chat_id, round(CAST(embedding[1] AS DOUBLE) * CASE WHEN vec_id % 5 = 3 THEN -1 ELSE 1 END, 4) AS e FROM embeddings WHERE vec_id % 7 <> 2
 UNION ALL SELECT CAST(vec_id AS VARCHAR), 'keep', 'old ' || vec_id, CAST(label AS VARCHAR), round(CAST(embedding[1] AS DOUBLE), 4) FROM embeddings""")
def collection_rows(spark, d):
    """A stored collection after two loads, of which the later one replaces some rows and adds others, a removal, and the reset of another model."""
    held = collection.Collection(spark, shared_folder(spark), 16)
    old, new = vector_rows(spark, d, "old "), vector_rows(spark, d, "new ").withColumn("embedding", F.transform("embedding", lambda x: -x))
    held.upsert(old.where("vec_id % 10 <> 3"), "chat", "m")
    held.upsert(old, "keep", "m")
    held.upsert(old, "chat", "other")
    held.upsert(new.where("vec_id % 5 = 3"), "chat", "m")
    held.remove(old.where("vec_id % 7 = 2").withColumns({"collection": F.lit("chat"), "model": F.lit("m")}))
    held.reset("chat", "other")
    return held.rows().select("id", "collection", "text", "chat_id", F.round(F.col("embedding")[0].cast("double"), 4).alias("e"))


@query(
    f"""WITH {CV}, n AS (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY ts, seq) - 1 AS a, count(*) OVER (PARTITION BY chat_id) AS n FROM cv),
 s AS (SELECT chat_id, a, n FROM n WHERE (a % 2 = 0 AND a <= n - 3) OR a = n - 3 OR (n <= 3 AND a = 0))
 SELECT s.chat_id || ':w:' || min_by(n.id, n.a) || '_' || max_by(n.id, n.a) AS id, CAST(count(*) AS INTEGER) AS members, sha1(string_agg(n.sender_name || ': ' || n.text, chr(10) ORDER BY n.a)) AS text_hash FROM s JOIN n ON n.chat_id = s.chat_id AND n.a BETWEEN s.a AND s.a + 2 GROUP BY s.chat_id, s.a"""
)
def collection_windows(spark, d):
    """Windows of three messages take the place of the windows of two that were stored before; their vectors are means of the messages'."""
    held, m, bag = collection.Collection(spark, shared_folder(spark), 16), conversations(spark, d), vectors.HashedBag(32)
    held.index_messages(m, bag)
    held.index_windows(m, bag, mode="mean", size=2, stride=1)
    held.index_windows(m, bag, mode="mean", size=3, stride=2)
    return held.rows().where("kind = 'window' and size(embedding) = 32").select("id", F.size("members").alias("members"), "text_hash")


@query(f"""WITH q AS (SELECT embedding AS q FROM embeddings ORDER BY vec_id LIMIT 1), e AS (SELECT CAST(vec_id AS VARCHAR) AS id, CASE WHEN vec_id % 11 = 0 THEN 'new ' ELSE 'old ' END || vec_id AS text, round({_cosine('embedding', 'q')} * CASE WHEN vec_id % 11 = 0 THEN -1 ELSE 1 END, 4) AS score FROM embeddings, q)
 SELECT id, text, score FROM e ORDER BY score DESC, id LIMIT 50""")
def collection_search(spark, d):
    """Exact search by cells, of which rows have been replaced since."""
    held = collection.Collection(spark, shared_folder(spark), 16)
    held.upsert(vector_rows(spark, d, "old "), "chat", "m")
    held.build_cells("chat", "m")
    held.upsert(vector_rows(spark, d, "new ").where("vec_id % 11 = 0").withColumn("embedding", F.transform("embedding", lambda x: -x)), "chat", "m")
    asked = _read(spark, d, "embeddings").orderBy("vec_id").first().embedding
    return held.search([float(x) for x in asked], "chat", "m", 50).select("id", "text", "score")


def kept(spark: SparkSession, d: str) -> rollup.Rollup:
    """Statistics of an archive that the exported events came into by three loads, the last of which holds all files, kept after each."""
    lines, archive = exported_events(spark, d), ingest.Archive(spark, shared_folder(spark))
    states, part = rollup.Rollup(archive, shared_folder(spark)), F.pmod(F.xxhash64("source_file"), F.lit(3))
    for these in (part == 0, part == 1, F.lit(True)):
        archive.load(lines.where(these), "Europe/Rome")
        states.refresh()
    return states


@query(MX_PER_SENDER)
def kept_per_sender(spark, d):
    return rounded(kept(spark, d).per_sender(), "share", "avg_chars")


@query(MX_CHATS)
def kept_chats(spark, d):
    return stats.shown_chats(kept(spark, d).chats(), "Europe/Rome")


@query(MX_VOLUME)
def kept_volume(spark, d):
    return kept(spark, d).volume("week", chat_id="click", sender="u1")
