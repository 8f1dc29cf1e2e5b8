"""Stored tables with versions: readers see one committed state, whatever is being written beside it.

A store is a folder. Its data lie in folders that are written once and never
changed; a manifest, a small JSON file per version, names those that count. A
writer adds folders first and commits by creating the next manifest, which fails
if another writer has done so. What was never committed is not read; `vacuum`
deletes it and what older versions alone need.
"""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another writer has committed in between: read again and repeat."""


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which all executors share; a temporary one only where that is unset and Spark is one local process."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="threadloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return f"{path.rstrip('/')}/store-{uuid.uuid4().hex}"


#: Lets Spark delete the shuffle files of a query as soon as that query has ended.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write(df: DataFrame, path: str, *by: str) -> None:
    """Write as Parquet, partitioned by these columns; the shuffle files of the write go with it, as nothing after it reads them."""
    conf = df.sparkSession.conf
    before = conf.get(SHUFFLE_CLEANUP, None)
    conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.select("*").write.parquet(path, partitionBy=[*by])
    finally:
        if before is None:
            conf.unset(SHUFFLE_CLEANUP)
        else:
            conf.set(SHUFFLE_CLEANUP, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read back: cuts lineage and survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}-{name}"
    write(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), p

    def _names(self, folder: str) -> list[str]:
        fs, p = self._at(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def read(self) -> tuple[int, dict]:
        """The last version and its content; (0, {}) for a new store. A manifest that its writer left unfinished does not count."""
        for name in reversed(self._names("manifest")):
            fs, p = self._at(f"{self.path}/manifest/{name}")
            stream = fs.open(p)
            try:
                content = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            except ValueError:
                continue
            finally:
                stream.close()
            return int(name.split(".")[0]), content
        return 0, {}

    def commit(self, version: int, content: dict) -> int:
        """Make content the version after `version`."""
        fs, p = self._at(f"{self.path}/manifest/{version + 1:012d}.json")
        try:
            out = fs.create(p, False)
        except Exception as error:
            if fs.exists(p):
                raise Conflict(f"version {version + 1} exists") from error
            raise
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        return version + 1

    def new_folder(self, kind: str) -> str:
        """A name for data to be committed later."""
        return f"{kind}/part={uuid.uuid4().hex}"

    def folder(self, name: str) -> str:
        return f"{self.path}/{name}"

    def delete(self, name: str) -> None:
        fs, p = self._at(self.folder(name))
        fs.delete(p, True)

    def vacuum(self, kinds: tuple[str, ...], used: set[str]) -> int:
        """Delete folders that `used` does not name, and all manifests but the last; returns how many folders went."""
        gone = [f"{kind}/{name}" for kind in kinds for name in self._names(kind) if f"{kind}/{name}" not in used]
        for name in [*gone, *(f"manifest/{m}" for m in self._names("manifest")[:-1])]:
            self.delete(name)
        return len(gone)
