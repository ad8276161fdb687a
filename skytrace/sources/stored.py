"""Tables by bucket of a key: an upsert rewrites the buckets it touches, a look-up reads those of the keys it is asked for.

A bucket is a folder, bucket=<pmod(xxhash64(keys), buckets)>. Buckets are the only thing that the driver lists, so what it holds is bound by
their number. Writers of one table come one after another; a bucket is replaced when the job that rewrites it commits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skytrace.operators.snapshots import upsert
from skytrace.storage import settled

BUCKETS = 256


def bucket_of(keys: list[str], buckets: int = BUCKETS) -> Column:
    """The bucket of a row's key; a null key has one too."""
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _put(rows: DataFrame, path: str, keys: list[str], buckets: int) -> None:
    """Replace the buckets that rows have; the others stay as they are. One shuffle by bucket, which AQE may split where a
    bucket is large."""
    own = rows.withColumn("bucket", bucket_of(keys, buckets)).hint("rebalance", "bucket")
    own.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def write(rows: DataFrame, path: str, keys: list[str], buckets: int = BUCKETS) -> None:
    """A new table. Rows that share a key all stay; a column called bucket is refused."""
    if "bucket" in rows.columns:
        raise ValueError("a table by bucket has no column of its own called bucket")
    _put(rows, path, keys, buckets)


def read(spark: SparkSession, path: str, keys: list[str], wanted: DataFrame | None = None, buckets: int = BUCKETS) -> DataFrame:
    """The rows of the table; with `wanted`, those whose key it has (repeats count once), read from the buckets of these keys alone."""
    stored = spark.read.parquet(path)
    if wanted is None:
        return stored.drop("bucket")
    keyed = wanted.select(keys).dropDuplicates().withColumn("bucket", bucket_of(keys, buckets))
    return stored.where(F.col("bucket").isin(touched(keyed))).join(keyed, ["bucket", *keys], "left_semi").drop("bucket")


def touched(keyed: DataFrame) -> list[int]:
    """The buckets that rows with a bucket have, at most as many as the table has."""
    return sorted(r.bucket for r in keyed.select("bucket").distinct().collect())


def upsert_into(spark: SparkSession, path: str, new: DataFrame, keys: list[str], set_columns: list[str] | None = None, buckets: int = BUCKETS) -> DataFrame:
    """(keys, outcome) of the rows of new, after they have replaced set_columns (all but the keys) of the rows with their key, or have been
    added. Keys of new are unique and not null. Only the buckets of new are read and rewritten; no row in new, no bucket."""
    keyed = settled(new.withColumn("bucket", bucket_of(keys, buckets)))
    own = touched(keyed)
    if not own:
        return keyed.select(*keys, F.lit("kept").alias("outcome")).limit(0)
    old = spark.read.parquet(path).where(F.col("bucket").isin(own))
    after = settled(upsert(old, keyed.select(old.columns), ["bucket", *keys], set_columns))
    _put(after.drop("bucket", "outcome"), path, keys, buckets)
    return after.where("outcome <> 'kept'").select(*keys, "outcome")


def truncate(spark: SparkSession, path: str) -> None:
    """The table at path without rows; its schema stays. For tables that aren't by bucket."""
    schema = spark.read.parquet(path).schema
    spark.createDataFrame([], schema).coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)
