"""Results that are computed once and read again."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

_kept: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir; in local mode, where nothing names one, a folder in
    the warehouse."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    return sc.getCheckpointDir()


def place(spark: SparkSession, kind: str) -> str:
    """A new folder in the shared folder, which goes when the driver's process ends, or with forget_settled()."""
    path = f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"
    if not _kept:
        atexit.register(forget_settled)
    _kept.append((spark, path))
    return path


def settled(df: DataFrame) -> DataFrame:
    """df, computed once and kept as a table in the shared folder: its lineage ends there, and lost executors cost nothing. A table, as a
    checkpoint computes twice and hands on all that is known of its columns, which a loop piles up until planning takes longer than the work.
    The tables go when the driver's process ends, or with forget_settled()."""
    spark = df.sparkSession
    path = place(spark, "settled")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drained(stream: DataFrame) -> DataFrame:
    """The rows of a stream over what its source holds now, kept as settled() does; its checkpoint lies beside them, so a batch that is cut
    off is done again without leaving rows behind."""
    spark = stream.sparkSession
    path, at = place(spark, "drained"), place(spark, "stream")
    stream.writeStream.format("parquet").option("checkpointLocation", at).trigger(availableNow=True).start(path).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def replayed(df: DataFrame, files_at_once: int) -> DataFrame:
    """df, settled, as a stream of its files."""
    spark, path = df.sparkSession, place(df.sparkSession, "replayed")
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def forget_settled() -> None:
    """Delete what settled() has left in the shared folder; call it when no result that reads it is needed any more."""
    while _kept:
        spark, path = _kept.pop()
        try:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session has ended, and with it the way to reach the folder
            return
