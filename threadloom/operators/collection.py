"""A stored vector collection: rows in buckets of a key hash, and cells for exact search.

A row's key is (collection, model, kind, id). Its hash gives a bucket, and a bucket
is one folder: an upsert or a removal writes the touched buckets anew, with the
rows of them that stay, and commits the folders of all buckets in one manifest
(sources.store). So untouched buckets are not read, readers see one version, and
of two writers at once the later one raises Conflict. Keys are unique, so a bucket
holds about rows / buckets; choose `buckets` for some hundred megabytes each.

`build_cells` adds an inverted file of one collection and model: coarse centroids,
every row under its nearest one with the angle between both, sorted by that angle.
By the triangle inequality of angles a cell of radius r whose centroid is at angle
a from the query holds nothing nearer than a - r, and a row at angle b from the
centroid is not nearer than |a - b|. So search reads the nearest cells for a first
k-th score and then those that may hold a row as good: the same rows as a scan.
Rows that have no angle (zero, null or non-finite components, another length) lie
in a cell of their own that is always read. Buckets written since are scanned.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as fx
from ..schema import VECTORS
from ..sources.store import Store, write
from . import filters, vectors

KEY = ("collection", "model", "kind", "id")
#: Centroids at most, which the driver holds, and rows a centroid of the sample that they are fitted to.
CELLS, SAMPLE = 1024, 256
#: Rows without an angle.
APART = -1
CELL_ROWS = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in VECTORS) + ", bucket int, angle double, cell int"
#: Scores are compared after rounding to four decimals; angles carry an error of their own near 0.
SCORE_SLACK, ANGLE_SLACK = 6e-5, 1e-6


class Collection:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 256):
        """`buckets` counts for a new collection; one that exists keeps its own."""
        self.spark, self.store, self.wanted = spark, Store(spark, path), buckets

    def _state(self) -> tuple[int, dict]:
        version, state = self.store.read()
        return version, state or {"buckets": self.wanted, "at": {}, "cells": {}}

    def _bucket(self, state: dict):
        return F.pmod(F.xxhash64(*KEY), F.lit(state["buckets"])).cast("int")

    def _read(self, state: dict, only=None) -> DataFrame:
        paths = [self.store.folder(f"{f}/bucket={b}") for b, f in state["at"].items() if only is None or b in only]
        return self.spark.read.schema(VECTORS).parquet(*paths) if paths else vectors.empty_index(self.spark)

    def rows(self) -> DataFrame:
        """All rows of the last version."""
        return self._read(self._state()[1])

    def _stage(self, rows: DataFrame, state: dict) -> tuple[str, DataFrame]:
        """Rows with their bucket, written once: vectors are made once, and the buckets that rows touch are known before any is read."""
        name, rows = self.store.new_folder("staged"), rows.withColumn("bucket", self._bucket(state))
        write(rows, self.store.folder(name))
        return name, self.spark.read.schema(rows.schema).parquet(self.store.folder(name))

    def _change(self, version: int, state: dict, new: DataFrame | None = None, gone: DataFrame | None = None) -> list[int]:
        """Put new rows in place of those with their keys and remove the keys of `gone`; returns the buckets that were written."""
        staged = []
        try:
            for part in (new, gone):
                staged.append(self._stage(part, state) if part is not None else None)
            new, gone = (s and s[1] for s in staged)
            if new is not None and not new.where("kind is null or id is null").isEmpty():
                raise ValueError("a row needs a kind and an id")
            keys = [part.select("bucket", *KEY) for part in (new, gone) if part is not None]
            keys = keys[0] if len(keys) == 1 else keys[0].unionByName(keys[1])
            touched = {str(r.bucket) for r in keys.select("bucket").distinct().collect()}  # as many as buckets at most
            if not touched:
                return []
            after = self._read(state, touched).withColumn("bucket", self._bucket(state)).join(keys, ["bucket", *KEY], "left_anti")
            if new is not None:
                after = after.unionByName(self._one_a_key(new))
            folder = self.store.new_folder("rows")
            # A bucket goes to as many tasks as its bytes need, so that tasks do not grow with the collection.
            write(after.select("bucket", *VECTORS.fieldNames()).hint("rebalance", "bucket"), self.store.folder(folder), "bucket")
            filled = {n.split("=")[1] for n in self.store._names(folder) if n.startswith("bucket=")}
            at = {b: f for b, f in state["at"].items() if b not in touched} | {b: folder for b in filled}
            self.store.commit(version, state | {"at": at})
            return sorted(map(int, touched))
        finally:
            for s in filter(None, staged):
                self.store.delete(s[0])

    @staticmethod
    def _one_a_key(new: DataFrame) -> DataFrame:
        """Of several new rows with one key the one with the greatest text hash, so that a repeated task writes the same. Whole rows are grouped only if a key repeats."""
        if new.groupBy("bucket", *KEY).count().where("count > 1").isEmpty():
            return new.select("bucket", *VECTORS.fieldNames())
        rest = [c for c in VECTORS.fieldNames() if c not in KEY]
        best = F.max(F.struct(F.coalesce("text_hash", F.lit("")), *rest)).alias("r")
        return new.groupBy("bucket", *KEY).agg(best).select("bucket", *KEY, *(f"r.{c}" for c in rest))

    def upsert(self, rows: DataFrame, collection: str, model: str) -> list[int]:
        """Add rows; one replaces the row of its key. Returns the buckets that were written."""
        return self._change(*self._state(), self._shaped(rows, collection, model))

    def remove(self, keys: DataFrame) -> list[int]:
        """Remove rows by collection, model, kind and id."""
        return self._change(*self._state(), gone=keys.select(*KEY).distinct())

    def reset(self, collection: str, model: str) -> list[int]:
        """Remove all rows of a model in a collection, and its cells."""
        version, state = self._state()
        state = state | {"cells": {k: v for k, v in state["cells"].items() if k != f"{collection}/{model}"}}
        return self._change(version, state, gone=self._read(state).where((F.col("collection") == collection) & (F.col("model") == model)).select(*KEY))

    def index_messages(self, messages: DataFrame, embedder: vectors.Embedder, collection: str = "chat", **which) -> list[int]:
        """Embed and add the messages that are not here with their present text."""
        version, state = self._state()
        todo = vectors.pending(vectors.message_documents(messages, **which), self._read(state), collection, embedder.model)
        return self._change(version, state, self._shaped(vectors.embed_distinct(todo, embedder), collection, embedder.model))

    def index_windows(self, messages: DataFrame, embedder: vectors.Embedder, collection: str = "chat", mode: str = "model", size: int = 6, stride: int = 3, chat_id: str | None = None) -> list[int]:
        """Add windows, embedded by the model or as means of their messages; those of these chats that no longer exist go."""
        if mode not in ("model", "mean"):
            raise ValueError(f"mode must be 'model' or 'mean', not {mode!r}")
        version, state = self._state()
        index, name = self._read(state), self.store.new_folder("staged")
        try:
            # Windows are made once: what is gone, what is new and its members all ask for them.
            write(vectors.window_documents(messages, size, stride, chat_id), self.store.folder(name))
            found = self.spark.read.parquet(self.store.folder(name))
            gone = index.join(vectors.vanished(index, found, collection), ["collection", "kind", "id"], "left_semi").select(*KEY)
            todo = vectors.pending(found, index, collection, embedder.model)
            return self._change(version, state, self._shaped(vectors.window_vectors(todo, index, embedder, collection, mode), collection, embedder.model), gone)
        finally:
            self.store.delete(name)

    def _shaped(self, rows: DataFrame, collection: str, model: str) -> DataFrame:
        given = {"collection": F.lit(collection), "model": F.lit(model)}
        value = lambda name: given.get(name, F.col(name) if name in rows.columns else F.lit(None))
        return rows.select(*(value(f.name).cast(f.dataType).alias(f.name) for f in VECTORS))

    def tidy(self) -> int:
        """Delete the folders that the last version does not need; nobody may read or write meanwhile."""
        state = self._state()[1]
        return self.store.vacuum(("rows", "staged", "cells"), {*state["at"].values(), *(v["rows"] for v in state["cells"].values())})

    def build_cells(self, collection: str, model: str, cells: int | None = None, seed: int = 0) -> int:
        """Cells of a collection and model for `search`; by default the square root of its rows. Returns how many there are.

        Centroids are fitted to a sample of about 256 rows each; every row is put in a cell. A poor fit costs reading, not rows.
        """
        version, state = self._state()
        size = F.size("embedding")
        rows = self._read(state).where((F.col("collection") == collection) & (F.col("model") == model))
        common = rows.where("size(embedding) > 0").groupBy(size.alias("n")).count().orderBy(F.desc("count"), "n").first()
        dim, n = (common.n, common["count"]) if common else (0, 0)
        # A NaN component makes the sum NaN and an infinite one makes it infinite.
        e = F.col("embedding").cast("array<double>")
        square = F.aggregate(e, F.lit(0.0), lambda a, x: a + x * x)
        fit = (size == dim) & square.isNotNull() & (square > 0) & (square < float("inf"))
        wanted = min(CELLS, cells or math.isqrt(n))
        centres = []
        if wanted:
            name = self.store.new_folder("staged")
            write(rows.where(fit).select(array_to_vector(e).alias("features")).sample(min(1.0, SAMPLE * wanted / n), seed), self.store.folder(name))
            sample = self.spark.read.parquet(self.store.folder(name))
            if sample.limit(2).count() == 2:
                centres = KMeans(k=max(2, wanted), distanceMeasure="cosine", initMode="random", maxIter=8, seed=seed).fit(sample).clusterCenters()
            self.store.delete(name)
        units = [(c / np.linalg.norm(c)).tolist() for c in centres if np.linalg.norm(c) > 0]
        state["cells"] = state["cells"] | {f"{collection}/{model}": self._write_cells(rows, state, units)}
        self.store.commit(version, state)
        return len(units)

    def _write_cells(self, rows: DataFrame, state: dict, centres: list[list[float]]) -> dict:
        """Every row under its nearest centre. The centres are 1,024 at most, so a task holds them all and multiplies by a batch of rows at a time."""
        at = np.array(centres).T

        def nearest(batches):
            for part in batches:
                cell, angle = np.full(len(part), APART, np.int32), np.full(len(part), np.nan)
                have = np.flatnonzero([x is not None and len(x) == len(at) for x in part["embedding"]])
                if len(have) and len(centres):
                    e = np.stack([np.asarray(x, float) for x in part["embedding"].iloc[have]])
                    with np.errstate(all="ignore"):
                        length = np.linalg.norm(e, axis=1)
                    fit = np.isfinite(length) & (length > 0)
                    have, cos = have[fit], e[fit] / length[fit, None] @ at
                    cell[have] = cos.argmax(1)
                    angle[have] = np.arccos(np.clip(cos.max(1), -1.0, 1.0))
                yield part.assign(angle=angle, cell=cell)

        placed = rows.withColumn("bucket", self._bucket(state)).mapInPandas(nearest, CELL_ROWS)
        folder = self.store.new_folder("cells")
        # Ranges of (cell, angle, id): a large cell fills many tasks, and a file of it holds a range of angles.
        write(placed.repartitionByRange("cell", "angle", "id").sortWithinPartitions("cell", "angle"), self.store.folder(folder), "cell")
        held = self._cells(folder).groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("r")).collect()  # a row per cell
        facts = [{"cell": r.cell, "n": r.n, "r": None if r.cell == APART else r.r, "centre": None if r.cell == APART else centres[r.cell]} for r in held]
        self.spark.createDataFrame(facts, "cell int, n long, r double, centre array<double>").coalesce(1).write.parquet(self.store.folder(f"{folder}/facts"))
        return {"rows": folder, "at": state["at"]}

    def _cells(self, folder: str) -> DataFrame:
        paths = [self.store.folder(f"{folder}/{n}") for n in self.store._names(folder) if n.startswith("cell=")]
        return self.spark.read.option("basePath", self.store.folder(folder)).schema(CELL_ROWS).parquet(*paths) if paths else self.spark.createDataFrame([], CELL_ROWS)

    def search(self, vector: list[float], collection: str, model: str, top: int = 10, **where) -> DataFrame:
        """The rows of `vectors.nearest` over this collection and model, by its cells."""
        return self._search(vector, collection, model, top, **where)[0]

    def cells_read(self, vector: list[float], collection: str, model: str, top: int = 10, **where) -> tuple[int, int]:
        """How many cells a search reads, and of how many."""
        return self._search(vector, collection, model, top, **where)[1]

    def _search(self, vector, collection, model, top, **where) -> tuple[DataFrame, tuple[int, int]]:
        state = self._state()[1]
        cells = state["cells"].get(f"{collection}/{model}")
        of = lambda rows: filters.vectors(rows.where((F.col("collection") == collection) & (F.col("model") == model)), **where)
        query = np.asarray(vector, float)
        length = np.linalg.norm(query)
        if not cells or not length > 0 or not np.isfinite(length):
            return vectors.nearest(of(self._read(state)).where(_comparable(len(query))), vector, top), (0, 0)
        changed = {b for b in {*state["at"], *cells["at"]} if state["at"].get(b) != cells["at"].get(b)}
        facts = self.spark.read.parquet(self.store.folder(f"{cells['rows']}/facts")).collect()  # a row per cell
        if any(f.centre is not None and len(f.centre) != len(query) for f in facts):
            return vectors.nearest(of(self._read(state)).where(_comparable(len(query))), vector, top), (0, 0)
        angle = {f.cell: 0.0 if f.centre is None else math.acos(max(-1.0, min(1.0, float(query @ np.array(f.centre)) / length))) for f in facts}
        least = {f.cell: 0.0 if f.centre is None else max(0.0, angle[f.cell] - f.r - ANGLE_SLACK) for f in facts}
        order = sorted(facts, key=lambda f: (least[f.cell], angle[f.cell], f.cell))
        fresh = of(self._read(state, changed)).where(_comparable(len(query))).select(*VECTORS.fieldNames())

        def held(of_cells: list[int], reach: float = math.pi) -> DataFrame:
            if not of_cells:
                return fresh
            rows = of(self._cells(cells["rows"]).where(F.col("cell").isin(of_cells)))
            if changed:
                rows = rows.where(~F.col("bucket").isin([int(b) for b in changed]))
            if reach < math.pi:
                to = F.create_map(*(F.lit(x) for c in of_cells for x in (c, angle[c])))
                rows = rows.where((F.col("cell") == APART) | (F.abs(F.col("angle") - F.element_at(to, F.col("cell"))) <= reach))
            return rows.where(_comparable(len(query))).select(*VECTORS.fieldNames()).unionByName(fresh)

        many, reach = 1, math.pi
        while many < len(order):
            # The nearest cells for a first k-th score; twice as many where filters leave too few rows.
            while many < len(order) and sum(f.n for f in order[:many]) < 2 * top:
                many += 1
            found = vectors.nearest(held([f.cell for f in order[:many]]), vector, top).agg(F.count("*").alias("n"), F.min("score").alias("s")).first()
            if found.n >= top:
                reach = math.acos(max(-1.0, min(1.0, found.s - SCORE_SLACK))) + ANGLE_SLACK
                break
            many *= 2
        near = [f.cell for f in order if least[f.cell] <= reach]
        return vectors.nearest(held(near, reach), vector, top), (len(near), len(order))


def _comparable(dim: int):
    """Vectors that have a cosine with one of this length; others have none in `nearest`."""
    return (F.size("embedding") == dim) & F.coalesce(F.exists("embedding", lambda x: x != 0), F.lit(False)) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
