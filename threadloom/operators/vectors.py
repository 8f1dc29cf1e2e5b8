"""A vector index of messages and windows, and search in it."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window, functions as F

from ..functions import text as fx
from ..schema import INDEXABLE_TYPES, VECTORS
from ..sources.store import stored
from . import filters
from .windows import conversation_windows


class Embedder(Protocol):
    model: str

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashedBag:
    """Offline default: words hashed into dimensions, of length one. The same everywhere."""

    def __init__(self, dim: int = 64):
        self.dim, self.model = dim, f"hashed-bag-{dim}"

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dim))
        for row, t in zip(out, texts):
            for w in re.findall(r"\w+", t.lower()):
                row[zlib.crc32(w.encode()) % self.dim] += 1
        return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).tolist()


def empty_index(spark) -> DataFrame:
    return spark.createDataFrame([], VECTORS)


def message_documents(messages: DataFrame, chat_id: str | None = None, types: tuple[str, ...] = INDEXABLE_TYPES) -> DataFrame:
    rows = filters.select_messages(messages, chat_id=chat_id, types=types)
    return rows.select("id", F.lit("message").alias("kind"), fx.message_document(F.col("sender_name"), F.col("text")).alias("text"), "chat_id", "sender_name", "local_date")


def window_documents(messages: DataFrame, size: int = 6, stride: int = 3, chat_id: str | None = None, types: tuple[str, ...] = INDEXABLE_TYPES) -> DataFrame:
    found = conversation_windows(filters.select_messages(messages, chat_id=chat_id, types=types), size, stride)
    return found.select("id", F.lit("window").alias("kind"), "text", "chat_id", "start_date", "end_date", "members")


def pending(candidates: DataFrame, index: DataFrame, collection: str, model: str) -> DataFrame:
    """Candidates whose id is not indexed with this text by this model in this collection."""
    done = index.where((F.col("collection") == collection) & (F.col("model") == model)).select("kind", "id", "text_hash")
    return candidates.withColumn("text_hash", F.sha1("text")).join(done, ["kind", "id", "text_hash"], "left_anti")


def embed_distinct(rows: DataFrame, embedder: Embedder, batch: int = 64) -> DataFrame:
    """Add `embedding`; every distinct text is embedded once."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for at in range(0, len(part), batch):
                own = part.iloc[at : at + batch]
                yield own.assign(embedding=embedder.embed(own["text"].tolist()))

    texts = rows.select("text_hash", "text").groupBy("text_hash").agg(F.min("text").alias("text"))
    vectors = texts.mapInPandas(run, "text_hash string, text string, embedding array<float>").drop("text")
    return rows.join(vectors, "text_hash")


def upsert(index: DataFrame, rows: DataFrame, collection: str, model: str) -> DataFrame:
    """The index with rows added; a row replaces the one of its collection, model, kind and id."""
    key = ["collection", "model", "kind", "id"]
    new = rows.withColumns({"collection": F.lit(collection), "model": F.lit(model)})
    return index.join(new.select(*key), key, "left_anti").unionByName(new, allowMissingColumns=True).select(*VECTORS.fieldNames())


def index_messages(messages: DataFrame, index: DataFrame, embedder: Embedder, collection: str = "chat", limit: int | None = None, **which) -> DataFrame:
    todo = pending(message_documents(messages, **which), index, collection, embedder.model)
    todo = todo.orderBy("id").limit(limit) if limit else todo
    return upsert(index, embed_distinct(todo, embedder), collection, embedder.model)


def vanished(index: DataFrame, found: DataFrame, collection: str) -> DataFrame:
    """Keys of indexed windows that are not among the windows found, of the chats of those."""
    old = index.where((F.col("kind") == "window") & (F.col("collection") == collection))
    return old.join(found.select("chat_id").distinct(), "chat_id", "left_semi").join(found.select("id"), "id", "left_anti").select("collection", "kind", "id")


def window_vectors(todo: DataFrame, index: DataFrame, embedder: Embedder, collection: str, mode: str) -> DataFrame:
    """Windows with `embedding`, by the model or as the mean of their indexed messages' vectors."""
    if mode == "model":
        return embed_distinct(todo, embedder)
    members = index.where((F.col("kind") == "message") & (F.col("collection") == collection) & (F.col("model") == embedder.model)).select(F.col("id").alias("member"), "embedding")
    return todo.join(mean_of_few(todo.select("id", F.posexplode("members").alias("pos", "member")).join(members, "member")), "id")


def index_windows(messages: DataFrame, index: DataFrame, embedder: Embedder, collection: str = "chat", mode: str = "model", size: int = 6, stride: int = 3, chat_id: str | None = None) -> DataFrame:
    """Windows, embedded by the model or as the mean of their messages' vectors. Windows that no longer exist go."""
    if mode not in ("model", "mean"):
        raise ValueError(f"mode must be 'model' or 'mean', not {mode!r}")
    found = stored(window_documents(messages, size, stride, chat_id), "windows")  # made once, asked for several times
    index = index.join(vanished(index, found, collection), ["collection", "kind", "id"], "left_anti").select(*VECTORS.fieldNames())
    todo = pending(found, index, collection, embedder.model)
    return upsert(index, window_vectors(todo, index, embedder, collection, mode), collection, embedder.model)


def mean_pool(rows: DataFrame, *by: str) -> DataFrame:
    """Sum of `embedding` per group, scaled to length one; a zero vector stays."""
    # One buffer of sums per group and task, instead of a row per number.
    sums = Summarizer.sum(array_to_vector(F.col("embedding").cast("array<double>")))
    whole = rows.where("size(embedding) > 0").groupBy(*by).agg(vector_to_array(sums).alias("e"))
    norm = F.sqrt(F.aggregate("e", F.lit(0.0), lambda a, x: a + x * x))
    return whole.select(*by, F.transform("e", lambda x: F.when(norm > 0, x / norm).otherwise(x).cast("float")).alias("embedding"))


def mean_of_few(rows: DataFrame) -> DataFrame:
    """mean_pool by id for many groups of a few rows each (id, pos, embedding): a window's vectors are put side by side and added in order.

    A buffer of sums pays where a group has many rows; here each would be made, written and merged for two or three.
    """
    whole = rows.where("size(embedding) > 0").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "embedding"))).alias("v"))
    first = F.col("v")[0]["embedding"]
    add = lambda a, x: F.when(F.size(a) == F.size(x["embedding"]), F.zip_with(a, x["embedding"], lambda p, q: p + q.cast("double"))).otherwise(F.raise_error(F.lit("vectors of a window differ in length")).cast("array<double>"))
    sums = whole.select("id", F.aggregate("v", F.array_repeat(F.lit(0.0), F.size(first)), add).alias("e"))
    sums = sums.select("id", "e", F.sqrt(F.aggregate("e", F.lit(0.0), lambda a, x: a + x * x)).alias("norm"))
    return sums.select("id", F.when(F.col("norm") > 0, F.transform("e", lambda x: x / F.col("norm"))).otherwise(F.col("e")).cast("array<float>").alias("embedding"))


def reset(index: DataFrame, collection: str, model: str) -> DataFrame:
    return index.where(~((F.col("collection") == collection) & (F.col("model") == model)))


def nearest(rows: DataFrame, vector: list[float], top: int = 10, decimals: int = 4) -> DataFrame:
    """Exact cosine search: rows with `score`, best first, ties by id."""
    query = F.array(*(F.lit(float(x)) for x in vector))
    return rows.withColumn("score", F.round(fx.cosine(F.col("embedding"), query), decimals)).where("score is not null").orderBy(F.desc("score"), "id").limit(top)


def semantic_search(index: DataFrame, embedder: Embedder, query: str, top: int = 8, kind: str = "message", clamp: bool = True, **where) -> DataFrame:
    rows = filters.vectors(index.where(F.col("model") == embedder.model), kind=kind, **where)
    found = nearest(rows, embedder.embed([query])[0], max(1, min(top, 50)) if clamp else top)
    return found.select("id", F.coalesce("local_date", F.lit("")).alias("date"), F.coalesce("sender_name", F.lit("")).alias("sender"), fx.clip(F.col("text")).alias("text"), "score")


def top_per_query(queries: DataFrame, rows: DataFrame, top: int) -> DataFrame:
    """Exact top-k for a small stated set of query vectors, which is broadcast."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    pairs = rows.join(F.broadcast(queries), F.col("id") != F.col("query_id"))
    return pairs.select("query_id", "id", F.round(fx.cosine(F.col("embedding"), F.col("query")), 4).alias("score")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


#: Rows and queries of a block of `top_per_query_in_blocks`.
ROW_BLOCK, QUERY_BLOCK = 8192, 2048


def top_per_query_in_blocks(queries: DataFrame, rows: DataFrame, top: int) -> DataFrame:
    """top_per_query for any number of queries: every block of rows meets every block of queries in a task. Rows without a cosine take no part."""
    rows, queries = rows.where("id is not null and embedding is not null"), queries.where("query_id is not null and query is not null")
    blocks, parts = max(1, -(-rows.count() // ROW_BLOCK)), max(1, -(-queries.count() // QUERY_BLOCK))
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    have = rows.select("id", "embedding", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), all_of(parts).alias("part"))
    ask = queries.select("query_id", "query", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int").alias("part"), all_of(blocks).alias("block"))
    have, ask = have.toDF(*have.columns), ask.toDF(*ask.columns)  # columns of their own on either side

    def compare(asks: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": np.zeros(0, np.int64), "id": np.zeros(0, np.int64), "score": np.zeros(0)})]
        if len(asks) and len(some):
            unit = lambda c: (x := np.stack(c.to_numpy()).astype(float)) / np.linalg.norm(x, axis=1, keepdims=True)
            with np.errstate(all="ignore"):
                d, q, ids, own = unit(some["embedding"]), unit(asks["query"]), some["id"].to_numpy(), asks["query_id"].to_numpy()
            for at in range(0, len(q), 256):
                mine = own[at : at + 256]
                s = q[at : at + 256] @ d.T
                s = np.copysign(np.floor(np.abs(s) * 1e4 + 0.5) / 1e4, s)
                s[np.isnan(s) | (ids[None, :] == mine[:, None])] = -np.inf
                least = np.partition(s, -top, axis=1)[:, -top] if s.shape[1] > top else np.full(len(s), -np.inf)
                row, col = np.nonzero((s >= least[:, None]) & (s > -np.inf))
                order = np.lexsort((ids[col], -s[row, col], row))
                row, col = row[order], col[order]
                kept = np.arange(len(row)) - np.searchsorted(row, row) < top
                row, col = row[kept], col[kept]
                out.append(pd.DataFrame({"query_id": mine[row], "id": ids[col], "score": s[row, col] + 0.0}))
        return pd.concat(out)

    met = ask.groupBy("block", "part").cogroup(have.groupBy("block", "part")).applyInPandas(compare, "query_id long, id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
