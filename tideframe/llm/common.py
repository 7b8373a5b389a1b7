"""What the corpus operators share: table access, durable intermediate tables, ASCII word rules."""

from __future__ import annotations

import atexit
import os
import shutil
import uuid

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideframe.functions.workers import with_workers  # noqa: F401

#: A word is a run of characters other than these six; Python's bytes.split() splits on exactly them.
WORD = r"[^\x20\x09-\x0D]+"
_OWN: list[str] = []


class Seen:
    """Tells words that came before from new ones, for caches that hold only what recurs: one byte for each hash, and all
    forgotten when half of them are taken. A false answer costs a place in a cache, no more."""

    SLOTS = 1 << 22

    def __init__(self):
        self.slots, self.taken = bytearray(self.SLOTS), 0

    def before(self, word) -> bool:
        at = hash(word) & self.SLOTS - 1
        if self.slots[at]:
            return True
        self.slots[at] = 1
        self.taken += 1
        if self.taken > self.SLOTS // 2:
            self.slots, self.taken = bytearray(self.SLOTS), 0
        return False


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; where that is unset, one of this process, on local masters only."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _OWN:
        _OWN.append(f"/tmp/checkpoints/{os.getpid()}-{uuid.uuid4().hex[:8]}")
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return f"file://{_OWN[0]}"


def _hadoop(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def temporary(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    fs, at = _hadoop(spark, path)
    fs.deleteOnExit(at)
    return path


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _hadoop(spark, path)
    return fs.exists(at)


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: cuts lineage, survives lost executors. The table
    goes when the driver ends, or by drop()."""
    path = temporary(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def held(df: DataFrame) -> DataFrame:
    """df kept on the executors' disks for a few uses, until unpersist(): a helper of what is settled next. What a lost
    executor held is made again from the settled tables before it."""
    return df.persist(StorageLevel.DISK_ONLY)


def drop(settled: DataFrame) -> None:
    """Remove a settled table that no later plan reads."""
    fs, at = _hadoop(settled.sparkSession, settled.settled_at)
    fs.delete(at, True)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def checkpointed(df: DataFrame) -> DataFrame:
    """df as a reliable checkpoint in the shared folder: unlike a table, it keeps partitions and the order in them."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


#: Rows, and bytes, of keys or findings that may be sent to every worker.
SMALL_ROWS, SMALL_BYTES = 500_000, 32 << 20


def _bytes(field: T.StructField) -> Column:
    """About the bytes of a value, whatever its length."""
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(field.name), F.lit(0)) + 16
    if isinstance(field.dataType, T.ArrayType):
        return F.octet_length(F.to_json(F.struct(field.name)))
    return F.lit(8)


def small_or_not(kept: DataFrame, rows: int = SMALL_ROWS, size: int = SMALL_BYTES) -> DataFrame:
    """kept (settled or held), marked for a broadcast join only if it is found to have few rows and bytes; else joins shuffle it."""
    n, total = kept.agg(F.count(F.lit(1)), F.sum(sum((_bytes(f) for f in kept.schema), F.lit(0)))).first()
    return F.broadcast(kept) if n <= rows and (total or 0) <= size else kept
