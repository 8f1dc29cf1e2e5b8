"""Exported chats: text files to message rows.

Files are read by ranges of bytes, so that one of any size spreads over all
tasks, and numbered by line: what precedes a range in its file follows from a
row per range. A line that begins with a date and a time opens a message, other
lines continue it. Messages are put together in blocks of BLOCK line numbers;
only those that may reach over a block's edge meet in a second step. Only the
first line of a message decides its type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .store import stored

# The grammar of a line and the phrases of the export format.
LINE = r"(?Us)^(\d{1,2}/\d{1,2}/\d{2,4}),?\s+(\d{1,2}:\d{2}(?::\d{2})?)\s*([AaPp]\.?\s?[Mm]\.?)?\s*[-–]\s*(.*)$"
CALL = r"(?iu)^(?:chiamata|videochiamata|voice call|video call|missed voice call|missed video call|hai perso una|hai effettuato una|ha effettuato una|ha avviato una|call ended)"
DELETED = r"(?iu)questo messaggio (?:è|e) stato eliminato|this message was deleted|messaggio eliminato"
EDITED = r"(?iuU)\s*[<(]?(?:questo messaggio è stato modificato|this message was edited)[>)]?\s*$"
OMITTED = r"(?iu)^<(media|allegato|allegati|image|video|audio|document|gif|sticker|contact|posizione)(?:\s*omess[oi])*>$"
ATTACHED = r"(?iu)((?:IMG|VID|AUD|PTT|STK|DOC|GIF|PHOTO|VIDEO)-\d{8}-WA\d+\.[A-Za-z0-9]+)\s*\((?:file allegato|file attached|allegato)\)"
EXTENSIONS = {"voice": "opus ogg m4a aac amr", "image": "jpg jpeg png webp heic gif", "video": "mp4 mov 3gp mkv webm", "document": "pdf doc docx xls xlsx ppt pptx txt zip"}
CHAT_NAME = r"(?iu)^(?:chat whatsapp con|whatsapp chat with|whatsapp chat -|chat whatsapp -)\s*"


#: Line numbers of a block, and how far the numbers of neighbouring lines may lie apart.
BLOCK, STEP = 8192, 64


def raw_lines(reader, path: str) -> DataFrame:
    """source_file, at (where the range of bytes begins) and value of every line, by spark.read or spark.readStream; bad bytes become U+FFFD."""
    name = F.try_url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return reader.format("text").load(path).select(name.alias("source_file"), F.col("_metadata.file_block_start").alias("at"), F.make_valid_utf8("value").alias("value"))


def number(raw: DataFrame) -> DataFrame:
    """source_file, file_hash, line_no and value of raw lines, stored.

    A range's lines are in order within a task, which `g` keeps; the ranges of a file follow each other by where they begin.
    The hash is one of all numbered lines, whatever the ranges were: the same lines in the same order have the same.
    """
    held = stored(raw.withColumn("g", F.monotonically_increasing_id()), "lines")
    file = Window.partitionBy("source_file").orderBy("at")  # a row per range
    ranges = held.groupBy("source_file", "at").agg(F.min("g").alias("low"), F.count("*").alias("n"))
    ranges = stored(ranges.select("source_file", "at", (F.sum("n").over(file) - F.col("n") - F.col("low") + 1).alias("shift")), "ranges")
    lines = held.join(ranges, ["source_file", "at"]).select("source_file", (F.col("g") + F.col("shift")).alias("line_no"), "value")
    parts = [F.bit_xor(F.xxhash64(F.lit(k), "line_no", "value")) for k in range(4)]
    hashes = stored(lines.groupBy("source_file").agg(F.concat(*(F.lpad(F.hex(p), 16, "0") for p in parts)).alias("file_hash")), "hashes")
    return lines.join(hashes, "source_file").select("source_file", "file_hash", "line_no", "value")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """source_file, file_hash, line_no, value of every line of every file."""
    return number(raw_lines(spark.read, path))


def chat_id_of(path: Column) -> Column:
    name = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    return F.trim(F.regexp_replace(F.regexp_replace(F.try_url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))), CHAT_NAME, ""), r"\s+", " "))


def _stamp() -> Column:
    """Local date and time of a header line, or null where they are not valid: such a line continues the message before it."""
    part = lambda s, sep, k: F.get(F.split(F.col(s), sep), k).cast("int")
    year, digits = part("d", "/", 2), F.length(F.get(F.split("d", "/"), 2))
    year = F.when(digits == 4, year).when((digits == 2) & (year < 69), year + 2000).when(digits == 2, year + 1900)
    hour, pm = part("t", ":", 0), F.lower(F.substring("ap", 1, 1))
    hour = F.when(pm == "", hour).when(hour.between(1, 12), F.when(pm == "p", hour % 12 + 12).otherwise(hour % 12))
    return F.try_make_timestamp_ntz(year, part("d", "/", 1), part("d", "/", 0), hour, part("t", ":", 1), F.coalesce(part("t", ":", 2), F.lit(0)).cast("decimal(16,6)"))


def _media(name: Column) -> Column:
    ext, prefix = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1)), F.upper(F.regexp_extract(name, "^([A-Za-z]+)-", 1))
    has = lambda kind: ext.isin(*EXTENSIONS[kind].split())
    return (
        F.when((prefix == "PTT") | has("voice"), "voice").when(has("image") | prefix.isin("IMG", "PHOTO"), "image").when(has("video") | (prefix == "VID"), "video")
        .when(prefix == "GIF", "gif").when(prefix == "STK", "sticker").when(has("document"), "document").otherwise("media")
    )


def parse(lines: DataFrame, timezone: str = "Europe/Rome", chat_id: str | None = None) -> DataFrame:
    """Messages of numbered lines, as schema.MESSAGES without id and ingested_at; one system row per file takes what comes before the first stamp.

    Numbers begin at 1 and rise by STEP at most; an empty table gives an empty one. A message is one row, however many lines it has.
    """
    cut = {n: F.regexp_extract("value", LINE, k) for k, n in enumerate(("d", "t", "ap", "rest"), 1)}
    rows = lines.withColumns(cut).withColumn("local", F.when(F.col("d") != "", _stamp()))
    head = F.col("local").isNotNull()
    rows = rows.withColumn("block", F.floor((F.col("line_no") - 1) / BLOCK)).withColumn("opens", F.when(head, F.col("line_no")))
    block = Window.partitionBy("source_file", "block")
    upto = block.orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"start": F.max("opens").over(upto), "last": F.max("opens").over(block), "end": F.max("line_no").over(block)})
    # A block that ends before its last numbers is its file's last.
    goes_on = (F.col("end") > (F.col("block") + 1) * BLOCK - STEP) & F.col("start").eqNullSafe(F.col("last"))
    edge = goes_on | ((F.col("block") > 0) & F.col("start").isNull())
    first = lambda c: F.min_by(c, "line_no")
    body = F.when(head, F.col("rest")).otherwise(F.col("value"))

    def folded(some: DataFrame, *by: str) -> DataFrame:
        return some.groupBy("source_file", "file_hash", *by).agg(
            F.min("line_no").alias("line_no"), F.count("*").alias("n_lines"), first("local").alias("local"), first(body).alias("rest"),
            F.array_sort(F.collect_list(F.struct("line_no", "value"))).alias("all"),
        ).drop("block")

    # Lines of the one or two messages of a block that may reach over its edges.
    on_edge = rows.where(edge).withColumn("start", F.last("start", ignorenulls=True).over(Window.partitionBy("source_file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)))
    fold = folded(rows.where(~edge), "block", "start").union(folded(on_edge, "start"))
    joined = lambda skip: F.array_join(F.transform(F.slice("all", 1 + skip, F.greatest(F.size("all") - skip, F.lit(0))), lambda s: s["value"]), "\n")
    at = F.instr("rest", ": ")
    name = F.trim(F.substring("rest", F.lit(1), at - 1))
    named = F.col("start").isNotNull() & (at > 0) & (F.length(name) > 0) & (F.length(name) <= 60)
    call = F.col("start").isNotNull() & F.col("rest").rlike(CALL)
    fold = fold.withColumn("sender_name", F.when(named & ~call, name)).withColumn("said", F.when(named & ~call, F.substring("rest", at + 2, F.length("rest"))).otherwise(F.col("rest")))
    omitted, attached = F.lower(F.regexp_extract(F.trim("said"), OMITTED, 1)), F.regexp_extract("said", ATTACHED, 1)
    kind = (
        F.when(call, "call").when(F.col("sender_name").isNull(), "system")
        .when(omitted.isin("media", "allegato", "allegati"), "media").when(omitted == "posizione", "location").when(omitted != "", omitted)
        .when(attached != "", _media(attached)).when(F.col("said").rlike(DELETED), "deleted").when(F.col("said").rlike(EDITED), "edited").otherwise("text")
    )
    said = F.when(F.col("msg_type") == "edited", F.regexp_replace("said", EDITED, "")).otherwise(F.col("said"))
    more = F.when(F.size("all") > 1, F.concat(said, F.lit("\n"), joined(1))).otherwise(said)
    chat = F.lit(chat_id) if chat_id else chat_id_of(F.col("source_file"))
    utc = F.unix_timestamp(F.to_utc_timestamp(F.col("local").cast("timestamp"), timezone))
    text_of = lambda fmt: F.coalesce(F.date_format("local", fmt), F.lit(""))
    return fold.withColumn("msg_type", kind).select(
        chat.alias("chat_id"), F.when(F.col("sender_name").isNotNull(), F.concat(chat, F.lit("::"), "sender_name")).alias("sender_id"), "sender_name", F.col("line_no").alias("seq"),
        F.coalesce(utc, F.lit(0)).alias("ts"), text_of("yyyy-MM-dd HH:mm:ss").alias("ts_local"), text_of("yyyy-MM-dd").alias("local_date"), text_of("HH:mm").alias("local_time"),
        more.alias("text"), joined(0).alias("raw_line"), "msg_type", F.lit(None).cast("string").alias("reply_to_id"), F.when(attached != "", attached).alias("media_ref"), "source_file", "line_no", "file_hash", "n_lines",
    )


def parse_stats(parsed: DataFrame) -> DataFrame:
    """Per file: lines, messages, continuations; the stray lines before the first stamp are no message."""
    real = F.col("ts_local") != ""
    return parsed.groupBy("source_file").agg(F.sum("n_lines").alias("lines"), F.sum(real.cast("int")).alias("messages"), F.sum(F.col("n_lines") - 1).alias("continuations"))
