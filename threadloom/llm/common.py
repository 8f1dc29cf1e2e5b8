"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

#: Rows, and bytes of several rows, that a Python worker turns into Python objects at a time.
SLICE_ROWS, SLICE_BYTES = 256, 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir); a temporary one only where it is unset and Spark is one local process."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="threadloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: Lets Spark delete the shuffle files of a query as soon as that query has ended.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage and survives the loss of executors.

    The shuffle files of the write go when it has ended: nothing after it reads them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.select("*").write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def together(tables: list[DataFrame]) -> DataFrame:
    """The rows of stored tables of one schema, by one scan: a union would plan and compile one for each."""
    return tables[0].sparkSession.read.schema(tables[0].schema).parquet(*(t.stored_at for t in tables))


def trimmed() -> None:
    """Give memory that Python has freed on the driver back to the system: after training its pages stay with the process."""
    gc.collect()
    with contextlib.suppress(OSError, AttributeError, TypeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def counted(df: DataFrame, name: str, **figures: Column) -> tuple[DataFrame, dict]:
    """`materialise`, and aggregates of the rows that are taken while they are written, so that no query of its own reads them for that."""
    seen = Observation()
    return materialise(df.observe(seen, *(c.alias(k) for k, c in figures.items())), name), seen.get


def discard(*tables: DataFrame) -> None:
    """Delete tables that `materialise` wrote and that nothing reads any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.stored_at)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def id_crc32(col: str = "doc_id") -> Column:
    """Unsigned CRC-32 of an id's decimal text."""
    return F.crc32(F.col(col).cast("string").cast("binary"))


def slices(batch: pa.RecordBatch, rows: int = SLICE_ROWS):
    """The batch in parts of at most `rows` rows and, but for single rows, SLICE_BYTES bytes."""
    for at in range(0, batch.num_rows, rows):
        part = batch.slice(at, rows)
        if part.num_rows > 1 and part.nbytes > SLICE_BYTES:
            yield from slices(part, (part.num_rows + 1) // 2)
        else:
            yield part
