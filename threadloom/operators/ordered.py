"""Neighbours in a long order without a task that holds a whole chat.

Rows are range-partitioned and sorted by (chat_id, ts, seq) and stored with a
gapless number `g`: the number of a task's first row follows from the row counts
of the tasks before it, one row a task. Equal runs of numbers are blocks, and
what a window function needs from beyond a block's edge is copied over it, a few
rows per block. So lags, sums and frames run over blocks of a fixed size, however
long a chat is, and sums over whole chats follow from a row per block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.store import stored

#: Rows of a block.
BLOCK = 8192
#: Blocks whose sums are added up by one task.
GROUP = 4096
#: Most rows of a side that is broadcast (some 30 bytes each); beyond it they are joined by a shuffle.
BROADCAST_ROWS = 500_000


def small(df: DataFrame) -> DataFrame:
    """A side of a join, broadcast if it has at most BROADCAST_ROWS rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """The rows, stored, with `g`: their place in the order, from 0."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = order or ("chat_id", "ts", "seq")
    held = stored(rows.repartitionByRange(tasks, *keys).sortWithinPartitions(*keys).withColumn("g", F.monotonically_increasing_id()), "numbered")
    task, place = F.shiftright("g", 33), F.col("g").bitwiseAND(F.lit((1 << 33) - 1))
    base, starts = 0, []
    for r in held.groupBy(task.alias("task")).count().orderBy("task").collect():  # a row per task
        starts.append((r.task, base - (r.task << 33)))
        base += r["count"]
    shift = rows.sparkSession.createDataFrame(starts, "__task long, __shift long")
    return held.join(F.broadcast(shift), task == F.col("__task")).withColumn("g", F.col("g") + F.col("__shift")).drop("__task", "__shift")


def in_blocks(rows: DataFrame, before: int = 0, after: int = 0) -> DataFrame:
    """Rows with `block` and `own`; of the rows around a block the last `before` and the first `after` are in it too, not its own."""
    if max(before, after) > BLOCK:
        raise ValueError(f"no more than {BLOCK} rows can be copied over an edge")
    at, block = F.pmod("g", F.lit(BLOCK)), F.floor(F.col("g") / BLOCK)
    of = F.filter(F.array(block, F.when(at >= BLOCK - before, block + 1), F.when(at < after, block - 1)), lambda b: b >= 0)
    return rows.withColumn("block", F.explode(of)).withColumn("own", F.col("block") == block)


def over_block() -> Window:
    return Window.partitionBy("block").orderBy("g")


def with_previous(rows: DataFrame, *columns: str) -> DataFrame:
    """Numbered rows with the columns of the row before each, as previous_*, and `first`: whether it opens its chat."""
    before = {f"previous_{c}": F.lag(c).over(over_block()) for c in ("chat_id", *columns)}
    wide = in_blocks(rows, before=1).withColumns(before).where("own").drop("own")
    return wide.withColumn("first", (F.col("g") == 0) | ~F.col("chat_id").eqNullSafe(F.col("previous_chat_id"))).drop("previous_chat_id")


def running_count(rows: DataFrame, flag: Column, name: str) -> DataFrame:
    """Rows (g, block) with how many rows up to each have the flag, in the whole order."""
    local = rows.withColumn(name, F.sum(flag.cast("long")).over(over_block()))
    sums = local.groupBy("block").agg(F.max(name).alias("s")).withColumn("group", F.floor(F.col("block") / GROUP))
    inside = Window.partitionBy("group").orderBy("block")
    sums = stored(sums.withColumns({"upto": F.sum("s").over(inside) - F.col("s")}), "block-sums")
    # A row per GROUP * BLOCK rows.
    groups = sums.groupBy("group").agg(F.sum("s").alias("t")).withColumn("under", F.sum("t").over(Window.orderBy("group")) - F.col("t")).select("group", "under")
    base = sums.join(groups, "group").select("block", (F.col("upto") + F.col("under")).alias("__base"))
    return local.join(small(base), "block").withColumn(name, F.col(name) + F.col("__base")).drop("__base")


def placed(rows: DataFrame) -> DataFrame:
    """Numbered rows with `at`, their place in their chat from 0, and `n`, its number of rows."""
    chats = stored(rows.groupBy(F.col("chat_id").alias("__chat")).agg(F.min("g").alias("__first"), F.count("*").alias("n")), "chats")
    return rows.join(small(chats), F.col("chat_id").eqNullSafe(F.col("__chat"))).withColumn("at", F.col("g") - F.col("__first")).drop("__chat", "__first")
