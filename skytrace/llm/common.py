"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: what counts as a word in every contract of this subpackage.
WORD = r"[^\x20\x09-\x0D]+"

_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir; in local mode, where there is one machine, a
    folder in the warehouse does."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    return sc.getCheckpointDir()


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet; it goes when the driver's process ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(forget_written)
    _written.append((spark, path))
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, survives lost executors, computes each row once.

    The tables go when the driver's process ends; results may still read them before.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget_written() -> None:
    """Delete what written() has left in the shared folder; call it when no result that reads it is needed any more."""
    while _written:
        spark, path = _written.pop()
        try:
            jvm = spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session has ended, and with it the way to reach the folder
            return


#: Rows of texts that go to Python at once, where the session allows more.
TEXT_ROWS = 1_000


def few_at_once(docs: DataFrame) -> DataFrame:
    """docs, with its session sending few rows to Python at a time: texts may be long, and each batch is held several times."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(docs.sparkSession.conf.get(key)) <= TEXT_ROWS:
        docs.sparkSession.conf.set(key, str(TEXT_ROWS))
    return docs


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def dealt_evenly(work: DataFrame, n: int) -> DataFrame:
    """work, written, with a column task from 0 to n - 1 for repartitionById(): each task gets as many rows as the next, whereas a
    hash of few rows may give some task several and others none."""
    numbered = written(work.withColumn("task", F.monotonically_increasing_id()), "work")
    within, part = F.col("task").bitwiseAND((1 << 33) - 1), F.shiftright("task", 33)
    return numbered.withColumn("task", F.pmod(within + part * 7919, F.lit(n)).cast("int"))


def crc32_of_id(doc_id: str | Column) -> Column:
    """crc32 of the id written as text, which splits rows into learning and held-out ones."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
