"""Repeated phrases, their timeline and their evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as fx
from ..schema import STOP_WORDS, TEXT_TYPES
from .filters import select_messages


def _grams(words: Column, n: int) -> Column:
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(words, i, n))


def _meaningful(gram: Column) -> Column:
    return F.exists(gram, lambda w: (F.length(w) >= 3) & ~w.isin(*sorted(STOP_WORDS)))


def repeated_phrases(messages: DataFrame, min_count: int = 5, max_n: int = 4, top: int | None = 50, suppress: bool = True, **where) -> DataFrame:
    """Runs of 2 to max_n words that occur min_count times: phrase, n, count, first, last, span_days, senders.

    A phrase goes if a longer phrase contains it and is at least as frequent.
    """
    rows = select_messages(messages, types=TEXT_TYPES, **where).select("sender_name", "local_date", fx.phrase_words(F.col("text")).alias("w"))
    grams = F.concat(*(_grams(F.col("w"), n) for n in range(2, max_n + 1)))
    each = rows.select("sender_name", "local_date", F.explode(F.filter(grams, _meaningful)).alias("g"))
    # Per sender first: partial sums shrink a frequent phrase before it is dealt out by itself.
    per = each.groupBy("g", "sender_name").agg(F.count("*").alias("c"), F.min("local_date").alias("f"), F.max("local_date").alias("l"))
    totals = per.groupBy("g").agg(F.sum("c").alias("count"), F.min("f").alias("first"), F.max("l").alias("last")).where(F.col("count") >= min_count)
    if suppress:
        parts = totals.where(F.size("g") > 2).select("count", F.explode(F.concat(*(F.when(F.size("g") > n, _grams(F.col("g"), n)).otherwise(F.array().cast("array<array<string>>")) for n in range(2, max_n)))).alias("g"))
        covered = parts.groupBy("g").agg(F.max("count").alias("over"))
        totals = totals.join(covered, "g", "left").where("over is null or over < count").drop("over")
    best = Window.partitionBy("g").orderBy(F.desc("c"), "sender_name")
    named = per.where("coalesce(sender_name, '') <> ''").withColumn("r", F.row_number().over(best)).where("r <= 5")
    whom = named.groupBy("g").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "sender_name", "c"))), lambda s: F.struct(s["sender_name"].alias("name"), s["c"].alias("count"))).alias("senders"))
    span = F.coalesce(F.datediff(F.try_to_date("last", "yyyy-MM-dd"), F.try_to_date("first", "yyyy-MM-dd")), F.lit(0))
    out = totals.join(whom, "g", "left").select(F.array_join("g", " ").alias("phrase"), F.size("g").alias("n"), "count", "first", "last", span.alias("span_days"), "senders")
    out = out.orderBy(F.desc("count"), F.desc("n"), "phrase")
    return out.limit(top) if top else out


def contains_phrase(text: Column, phrase: str) -> Column:
    """Whether the text's tokens hold the phrase's tokens in one run; an empty phrase is in nothing."""
    run = F.concat(F.lit(" "), F.array_join(fx.search_tokens(text), " "), F.lit(" "))
    want = F.array_join(fx.search_tokens(F.lit(phrase)), " ")
    return (want != "") & F.contains(run, F.concat(F.lit(" "), want, F.lit(" ")))


def timeline(messages: DataFrame, phrase: str, bucket: str = "month", **where) -> DataFrame:
    """Messages, not occurrences, that hold the phrase, by period."""
    rows = select_messages(messages, exclude=(), **where).where(contains_phrase(F.col("text"), phrase))
    return rows.groupBy(fx.period(F.col("local_date"), bucket, week="-").alias("period")).agg(F.count("*").alias("count")).orderBy("period")


def evidence(messages: DataFrame, phrase: str, top: int = 15, **where) -> DataFrame:
    """The first messages that hold the phrase."""
    rows = select_messages(messages, exclude=(), **where).where(contains_phrase(F.col("text"), phrase)).orderBy("ts", "seq").limit(max(1, min(top, 100)))
    return rows.select("id", F.col("local_date").alias("date"), F.col("local_time").alias("time"), F.coalesce("sender_name", F.lit("")).alias("sender"), F.substring("text", 1, 300).alias("text"))
