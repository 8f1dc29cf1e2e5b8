"""A stored full-text index of messages: postings with positions, in segments.

Every load adds a segment. Its postings lie in blocks of up to 128, clustered by
token in buckets of a hash, so that a query reads the buckets and row groups of
its tokens only; a block keeps its number of postings, the highest frequency and
the shortest length in it, which bound the bm25 score of all it holds. Positions
are differences. A segment also has a row per message with its length and what
filters ask for. Removals are kept beside the segments and hold for those before
them; `merge` writes one segment of all that lives. A version of the index is a
manifest (sources.store), so readers never see half a load.

Postings are put together in the task that reads the messages, some hundreds of
thousands of tokens a row, and dealt by bucket and a share of these tasks, so that a token
that is everywhere fills many blocks in many tasks. Ids are unique: adding a known one replaces it.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text as fx
from ..sources.store import Store, write
from .filters import condition
from .search import B, K1

BLOCK = 128
#: Tokens of messages, and postings, that a worker groups at a time.
TOKENS, POSTINGS = 1 << 19, 1 << 18
#: Bytes that Spark hands to a worker at a time, so that one takes no more memory for longer messages or larger tables.
BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20)
#: Postings of a token side by side: ids, seqs, lengths and frequencies of the messages, and all positions one after the other.
LISTS = "ids array<string>, seqs array<long>, lens array<int>, tfs array<int>, at array<int>"
BLOCKS = f"token string, n int, max_tf int, min_len int, {LISTS}"
#: What a message's row holds beside its length.
MESSAGE = ("id", "seq", "ts", "chat_id", "sender_name", "local_date", "msg_type")
#: Postings of a token from which on bounds of blocks are used: below, reading all is as cheap.
MANY, FIRST_BLOCKS = 64 * BLOCK, 64


def bucket_of(token: str, buckets: int) -> int:
    return zlib.crc32(token.encode()) % buckets


def tokens_of(spark: SparkSession, text: str) -> list[str]:
    return spark.range(1).select(fx.search_tokens(F.lit(text)).alias("t")).first().t


def _cut(values: pa.Array, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def _postings(batches):
    """Rows (id, seq, tokens) to a row per token and some thousand messages, with differences of positions; `task` tells where they come from."""
    task = TaskContext.get().partitionId()
    for batch in batches:
        sizes = np.diff(batch.column("tokens").offsets.to_numpy())
        cuts = np.searchsorted(np.cumsum(sizes), np.arange(TOKENS, sizes.sum() + TOKENS, TOKENS)) + 1
        for low, high in zip([0, *cuts], cuts):
            part = batch.slice(low, max(0, high - low))
            lists = part.column("tokens")
            coded = lists.flatten().dictionary_encode()
            if not len(coded):
                continue
            code, size = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.diff(lists.offsets.to_numpy())
            doc = np.repeat(np.arange(part.num_rows), size)
            place = np.arange(len(code)) - np.repeat(np.cumsum(size) - size, size)
            key = code * part.num_rows + doc
            order = np.argsort(key, kind="stable")
            key, place = key[order], place[order]
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))  # of each posting
            step = np.diff(place, prepend=0)
            step[first] = place[first]
            doc, code = doc[order][first], code[order][first]
            own, tf = pa.array(doc), np.diff(np.append(first, len(key)))
            head = np.flatnonzero(np.append(True, code[1:] != code[:-1]))  # of each token
            ends = np.append(head, len(code))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(head), task, np.int32)), coded.dictionary.take(pa.array(code[head])), _cut(part.column("id").take(own), ends), _cut(part.column("seq").take(own), ends),
                    _cut(pa.array(size[doc], pa.int32()), ends), _cut(pa.array(tf, pa.int32()), ends), _cut(pa.array(step, pa.int32()), np.append(first, len(key))[ends]),
                ],
                names=["task", "token", "ids", "seqs", "lens", "tfs", "at"],
            )


def _slices(batches, lists: str, most: int):
    """Batches in parts of rows whose lists hold at most `most` entries, but for single rows."""
    for batch in batches:
        upto, low = np.cumsum(np.diff(batch.column(lists).offsets.to_numpy())), 0
        while low < batch.num_rows:
            high = max(low + 1, int(np.searchsorted(upto, (upto[low - 1] if low else 0) + most, "right")))
            yield batch.slice(low, high - low)
            low = high


def _blocks(batches):
    """Rows sorted by token, with lists of postings, to blocks of one token each."""
    for batch in _slices(batches, "ids", POSTINGS):
        if not batch.num_rows:
            continue
        many = np.diff(batch.column("ids").offsets.to_numpy())
        code = np.repeat(batch.column("token").dictionary_encode().indices.to_numpy(zero_copy_only=False), many)
        token = np.repeat(np.arange(batch.num_rows), many)
        first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
        run = np.arange(len(code)) - np.repeat(first, np.diff(np.append(first, len(code))))
        first = np.flatnonzero(run % BLOCK == 0)
        ends = np.append(first, len(code))
        flat = {c: batch.column(c).flatten() for c in ("ids", "seqs", "lens", "tfs", "at")}
        tf, size = flat["tfs"].to_numpy(), flat["lens"].to_numpy()
        places = np.append(0, np.cumsum(tf))[ends]
        yield pa.RecordBatch.from_arrays(
            [batch.column("token").take(pa.array(token[first])), pa.array(np.diff(ends), pa.int32()), pa.array(np.maximum.reduceat(tf, first)), pa.array(np.minimum.reduceat(size, first)), *(_cut(v, places if c == "at" else ends) for c, v in flat.items())],
            names=["token", "n", "max_tf", "min_len", "ids", "seqs", "lens", "tfs", "at"],
        )


def _apart(batches):
    """Blocks (token, no, lists) to a row per posting with its positions."""
    for batch in _slices(batches, "ids", POSTINGS):
        many = np.diff(batch.column("ids").offsets.to_numpy())
        own = pa.array(np.repeat(np.arange(batch.num_rows), many))
        tf = batch.column("tfs").flatten()
        at = _cut(batch.column("at").flatten(), np.append(0, np.cumsum(tf.to_numpy())))
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(own) for c in ("token", "no")), *(batch.column(c).flatten() for c in ("ids", "seqs", "lens")), tf, at], names=["token", "no", "id", "seq", "len", "tf", "at"])


def _together(batches):
    """Rows per posting to a row per token and some POSTINGS of them, with lists."""
    task = TaskContext.get().partitionId()

    def grouped(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(parts)
        columns = {c: whole.column(c).combine_chunks() for c in ("token", "id", "seq", "len", "tf", "at")}
        coded = columns["token"].dictionary_encode()
        code = coded.indices.to_numpy()
        order = np.argsort(code, kind="stable")
        code = code[order]
        head = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
        ends = np.append(head, len(code))
        ids, seqs, lens, tfs, at = (columns[c].take(pa.array(order)) for c in ("id", "seq", "len", "tf", "at"))
        places = np.append(0, np.cumsum(tfs.to_numpy()))[ends]
        lists = [*(_cut(v, ends) for v in (ids, seqs, lens, tfs)), _cut(at.flatten(), places)]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(head), task, np.int32)), coded.dictionary.take(pa.array(code[head])), *lists], names=["task", "token", "ids", "seqs", "lens", "tfs", "at"])

    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held, n = [*held, batch], n + batch.num_rows
        if n >= POSTINGS:
            yield grouped(held)
            held, n = [], 0
    if held:
        yield grouped(held)


def _runs(n: int, offsets: list[list[int]]):
    """Rows with the positions p0, p1, ... of n tokens to the number of places where all stand at their offsets; rows without go."""

    def decoded(lists):
        sizes, step = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy().astype(np.int64)
        total = np.cumsum(step)
        start = np.cumsum(sizes) - sizes
        return np.repeat(np.arange(len(sizes)), sizes), total - np.repeat(total[start] - step[start] if len(step) else total[:0], sizes)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            found = None
            for k in range(n):
                doc, place = decoded(batch.column(f"p{k}"))
                for off in offsets[k]:
                    keys = (doc << 32) + place - off
                    keys = keys[place >= off]
                    found = keys if found is None else np.intersect1d(found, keys, assume_unique=True)
            times = np.bincount(found >> 32, minlength=batch.num_rows)
            some = pa.array(np.flatnonzero(times))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(some) for c in ("id", "no", "seq", "len")), pa.array(times[times > 0], pa.int32())], names=["id", "no", "seq", "len", "f"])

    return run


class FullText:
    """The index in the folder `path`."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.store = spark, Store(spark, path)
        self.version, state = self.store.read()
        self.state = state or {"buckets": buckets, "next": 1, "segments": [], "removed": []}

    # Writing.

    def _write(self, postings: DataFrame, messages: DataFrame) -> dict:
        """A segment that is not committed yet. messages: MESSAGE and len."""
        no, buckets = self.state["next"], self.state["buckets"]
        tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        bucket = F.pmod(F.crc32(F.col("token").cast("binary")), F.lit(buckets)).cast("int")
        # As many shares of a bucket as make all tasks busy, so that no token belongs to one of them.
        share = F.pmod(F.hash("task"), F.lit(max(1, tasks))).cast("int") if buckets < 4 * tasks else F.lit(0)
        dealt = postings.repartition(tasks, bucket, share).withColumn("bucket", bucket).sortWithinPartitions("bucket", "token")
        names = {k: self.store.new_folder(k) for k in ("postings", "messages")}
        blocks = dealt.drop("task", "bucket").mapInArrow(_blocks, BLOCKS)
        name, most = BATCH_BYTES
        before = self.spark.conf.get(name, None)
        self.spark.conf.set(name, most)
        try:
            write(blocks.withColumn("bucket", bucket).sortWithinPartitions("bucket", "token"), f"{self.store.folder(names['postings'])}/no={no}", "bucket")
        finally:
            if before is None:
                self.spark.conf.unset(name)
            else:
                self.spark.conf.set(name, before)
        write(messages, f"{self.store.folder(names['messages'])}/no={no}")
        count = self.spark.read.parquet(f"{self.store.folder(names['messages'])}/no={no}").agg(F.count("*").alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("t")).first()
        return names | {"no": no, "docs": count.n, "tokens": count.t}

    def _commit(self, state: dict) -> None:
        self.version, self.state = self.store.commit(self.version, state), state

    def add(self, messages: DataFrame, replace: bool = True) -> None:
        """Index these messages; a known id is replaced. With replace=False ids must be new, and nothing that is stored is read."""
        rows = messages.where("id is not null")
        size = fx.token_count(F.col("text")).alias("len")
        segment = self._write(rows.select("id", F.col("seq").cast("long").alias("seq"), fx.search_tokens(F.col("text")).alias("tokens")).mapInArrow(_postings, f"task int, token string, {LISTS}"), rows.select(*MESSAGE, size))
        state = dict(self.state)
        if replace and self.state["segments"]:
            known = self.messages().join(messages.select("id"), "id", "left_semi")
            state["removed"] = self.state["removed"] + self._removal(known.select("id"))
        self._commit(state | {"next": self.state["next"] + 1, "segments": self.state["segments"] + [segment]})

    def _removal(self, ids: DataFrame) -> list[dict]:
        name = self.store.new_folder("removed")
        last = self.state["next"] - 1
        write(ids.distinct(), f"{self.store.folder(name)}/upto={last}")
        gone = self.messages().join(self.spark.read.parquet(self.store.folder(name)), "id", "left_semi").agg(F.count("*").alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("t")).first()
        return [{"name": name, "docs": gone.n, "tokens": gone.t}] if gone.n else []

    def remove(self, ids: DataFrame) -> None:
        """Messages with these ids (a column `id`) go."""
        if self.state["segments"] and (more := self._removal(ids.select("id").where("id is not null"))):
            self._commit(self.state | {"removed": self.state["removed"] + more})

    def merge(self) -> None:
        """One segment of all that lives, without what was removed."""
        if len(self.state["segments"]) > 1 or self.state["removed"]:
            each = self._each(self._blocks()).select("token", "id", "seq", "len", "tf", "at")
            segment = self._write(each.mapInArrow(_together, f"task int, token string, {LISTS}"), self.messages().select(*MESSAGE, "len"))
            self._commit(self.state | {"next": self.state["next"] + 1, "segments": [segment], "removed": []})

    def vacuum(self) -> int:
        used = {s[k] for s in self.state["segments"] for k in ("postings", "messages")} | {r["name"] for r in self.state["removed"]}
        return self.store.vacuum(("postings", "messages", "removed"), used)

    # Reading.

    def _table(self, kind: str, schema: str) -> DataFrame:
        paths = [self.store.folder(s[kind]) for s in self.state["segments"]]
        if not paths:
            return self.spark.createDataFrame([], schema + ", no int")
        return self.spark.read.option("basePath", self.store.folder(kind)).schema(schema + ", no int").parquet(*paths)

    def _live(self, rows: DataFrame) -> DataFrame:
        """Rows (id, no) of messages that are not removed."""
        for r in self.state["removed"]:
            gone = self.spark.read.schema("id string, upto int").parquet(self.store.folder(r["name"]))
            gone = gone.select(F.col("id").alias("__id"), "upto")
            rows = rows.join(gone, (F.col("id") == F.col("__id")) & (F.col("no") <= F.col("upto")), "left_anti")
        return rows

    def messages(self) -> DataFrame:
        """A row per living message: MESSAGE, len and the number of its segment."""
        return self._live(self._table("messages", "id string, seq long, ts long, chat_id string, sender_name string, local_date string, msg_type string, len int"))

    def _blocks(self, tokens: list[str] | None = None) -> DataFrame:
        rows = self._table("postings", BLOCKS + ", bucket int")
        if tokens is None:
            return rows
        return rows.where(F.col("bucket").isin(sorted({bucket_of(t, self.state["buckets"]) for t in tokens})) & F.col("token").isin(tokens))

    def _each(self, blocks: DataFrame, positions: bool = True) -> DataFrame:
        """Living postings of blocks."""
        if positions:
            return self._live(blocks.select("token", "no", "ids", "seqs", "lens", "tfs", "at").mapInArrow(_apart, "token string, no int, id string, seq long, len int, tf int, at array<int>"))
        names = {"id": "ids", "seq": "seqs", "len": "lens", "tf": "tfs"}
        return self._live(blocks.select("token", "no", F.inline(F.arrays_zip(*(F.col(c).alias(n) for n, c in names.items()))).alias(*names)))

    def totals(self) -> tuple[int, float]:
        """Living messages and their mean length in tokens."""
        net = lambda k: sum(s[k] for s in self.state["segments"]) - sum(r[k] for r in self.state["removed"])
        return net("docs"), net("tokens") / max(1, net("docs"))

    def frequencies(self, tokens: list[str]) -> dict[str, int]:
        """In how many living messages each token stands: from the blocks' heads, unless messages were removed."""
        blocks = self._blocks(tokens)
        rows = self._each(blocks, False).select("token", F.lit(1).alias("n")) if self.state["removed"] else blocks.select("token", "n")
        return dict.fromkeys(tokens, 0) | {r.token: r.c for r in rows.groupBy("token").agg(F.sum("n").alias("c")).collect()}

    def runs(self, tokens: list[str]) -> DataFrame:
        """id, no, seq, len and f, how often the tokens stand one after the other; the rarest leads."""
        places: dict[str, list[int]] = {}
        for k, t in enumerate(tokens):
            places.setdefault(t, []).append(k)
        if len(tokens) == 1:
            return self._each(self._blocks(tokens), False).select("id", "no", "seq", "len", F.col("tf").alias("f"))
        count = self.frequencies([*places])
        order = sorted(places, key=lambda t: (count[t], t))
        rows = None
        for k, t in enumerate(order):
            own = self._each(self._blocks([t])).select("id", "no", *(("seq", "len") if not k else ()), F.col("at").alias(f"p{k}"))
            rows = own if rows is None else rows.join(own, ["id", "no"])
        return rows.mapInArrow(_runs(len(order), [places[t] for t in order]), "id string, no int, seq long, len int, f int")

    def search(self, query: str, top: int = 20, **where) -> DataFrame:
        """id, seq and score of the messages that hold every word of the query, best bm25 first; a word that splits into tokens
        must stand as a run. Statistics are those of all living messages, whatever the filter."""
        top = max(1, min(top, 100))
        terms = [tokens_of(self.spark, w) for w in re.findall(r"\w+", query)]
        n, mean = self.totals()
        none = self.spark.createDataFrame([], "id string, seq long, score double")
        if not terms or not n or not all(terms):
            return none
        found = [self.runs(t) for t in terms]
        single = self.frequencies([t[0] for t in terms if len(t) == 1])
        count = [single[t[0]] if len(t) == 1 else f.count() for t, f in zip(terms, found)]
        if not all(count):
            return none
        weight = [max(w, 1e-6) if (w := float(np.log((n - c + 0.5) / (c + 0.5)))) > 0 else 1e-6 for c in count]

        def part(k: int, f: Column, size: Column) -> Column:
            return weight[k] * f * (K1 + 1) / (f + K1 * (1 - B + B * size / mean))

        lead = min(range(len(terms)), key=lambda k: (count[k], k))

        def scored(leading: DataFrame) -> DataFrame:
            # One shuffle brings a message's terms together.
            rows = [(leading if k == lead else f).select("id", "no", "seq", "len", F.lit(k).alias("k"), "f") for k, f in enumerate(found)]
            whole = rows[0]
            for r in rows[1:]:
                whole = whole.union(r)
            whole = whole.groupBy("id", "no", "seq", "len").agg(*(F.max(F.when(F.col("k") == k, F.col("f"))).alias(f"f{k}") for k in range(len(terms))))
            whole = whole.where(" and ".join(f"f{k} is not null" for k in range(len(terms))))
            if any(where.values()):
                whole = whole.join(self.messages().where(condition(exclude=(), **where)).select("id"), "id", "left_semi")
            score = F.lit(0.0)
            for k in range(len(terms)):
                score = score - part(k, F.col(f"f{k}"), F.col("len"))
            return whole.select("id", "seq", score.alias("score")).orderBy("score", "seq").limit(top)

        leading = found[lead]
        if len(terms[lead]) == 1 and count[lead] > MANY:
            # Blocks whose bound stays behind the last of `top` messages found in the most promising blocks cannot hold a better one.
            blocks = self._blocks(terms[lead])
            bound = part(lead, F.col("max_tf"), F.col("min_len"))
            rest = sum(w * (K1 + 1) for k, w in enumerate(weight) if k != lead)
            first = self._each(blocks.orderBy(F.desc(bound)).limit(FIRST_BLOCKS), False).select("id", "no", "seq", "len", F.col("tf").alias("f"))
            best = [r.score for r in scored(first).collect()]
            if len(best) == top:
                leading = self._each(blocks.where(bound + rest >= -max(best) - 1e-9), False).select("id", "no", "seq", "len", F.col("tf").alias("f"))
        return scored(leading)

    def phrase(self, text: str) -> DataFrame:
        """Rows of the living messages that hold the text's tokens in one run; an empty phrase is in nothing."""
        tokens = tokens_of(self.spark, text)
        if not tokens or not self.state["segments"]:
            return self.messages().where("false")
        return self.messages().join(self.runs(tokens).select("id", "no"), ["id", "no"], "left_semi")

    def timeline(self, text: str, bucket: str = "month", **where) -> DataFrame:
        """Messages, not occurrences, that hold the phrase, by period: from the index alone."""
        rows = self.phrase(text).where(condition(exclude=(), **where))
        return rows.groupBy(fx.period(F.col("local_date"), bucket, week="-").alias("period")).agg(F.count("*").alias("count")).orderBy("period")

    def evidence(self, messages: DataFrame, text: str, top: int = 15, **where) -> DataFrame:
        """The first messages that hold the phrase; of `messages` only these are fetched."""
        hits = self.phrase(text).where(condition(exclude=(), **where)).orderBy("ts", "seq").limit(max(1, min(top, 100)))
        rows = fetch(messages, [r.id for r in hits.select("id").collect()]).orderBy("ts", "seq")
        return rows.select("id", F.col("local_date").alias("date"), F.col("local_time").alias("time"), F.coalesce("sender_name", F.lit("")).alias("sender"), F.substring("text", 1, 300).alias("text"))


def fetch(messages: DataFrame, ids: list[str]) -> DataFrame:
    """The messages of at most a hundred hits: their ids go to the scan as a filter."""
    return messages.where(F.col("id").isin(ids)) if ids else messages.where("false")


def keyword_search(index: FullText, messages: DataFrame, query: str, top: int = 20, **where) -> DataFrame:
    """search.keyword_search through the index: messages with `score`, best first."""
    hits = index.search(query, top, **where).collect()  # a hundred at most
    scores = index.spark.createDataFrame([(r.id, r.score) for r in hits], "id string, score double")
    return fetch(messages, [r.id for r in hits]).join(F.broadcast(scores), "id").select(*messages.columns, "score").orderBy("score", "seq")
