"""Pages, lookups and top rows over flights and what hangs on them."""

from __future__ import annotations

import base64
import struct

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skytrace.storage import settled


def after(keys: list[tuple[str, bool]], values: list) -> Column:
    """Rows that come after a row with these values in an order of (column, descending) keys: a OR (a = AND b ...)."""
    out, equal = F.lit(False), F.lit(True)
    for (name, descending), value in zip(keys, values):
        beyond = F.col(name) < value if descending else F.col(name) > value
        out, equal = out | (equal & beyond), equal & (F.col(name) == value)
    return out


def page(rows: DataFrame, keys: list[tuple[str, bool]], limit: int, cursor: list | None = None, most: int = 100) -> DataFrame:
    """`limit` rows after the cursor and one more, which tells that there are more; a top-k, so no full sort.

    Nulls come first in descending order and last in ascending order. The last key should be unique.
    """
    if not 1 <= limit <= most:
        raise ValueError(f"limit must be from 1 to {most}")
    if cursor is not None:
        rows = rows.where(after(keys, cursor))
    return rows.orderBy(*[F.col(k).desc_nulls_first() if d else F.col(k).asc_nulls_last() for k, d in keys]).limit(limit + 1)


def page_limit(asked: Column, otherwise: int, most: int = 100) -> Column:
    """struct(limit, error): the limit asked for, `otherwise` where none is, and what is wrong with one that isn't from 1 to most."""
    bad = ~asked.between(1, most)
    return F.struct(F.when(bad, None).otherwise(F.coalesce(asked, F.lit(otherwise))).cast("int").alias("limit"), F.when(bad, f"limit must be from 1 to {most}").alias("error"))


def with_more(rows: DataFrame, keys: list[tuple[str, bool]], limit: int) -> DataFrame:
    """A page without its extra row; has_more tells on each row whether there was one. At most limit + 1 rows come in."""
    w = W.orderBy(*[F.col(k).desc_nulls_first() if d else F.col(k).asc_nulls_last() for k, d in keys])
    return rows.withColumn("has_more", F.count("*").over(W.partitionBy()) > limit).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).drop("_n")


def encode_cursor(at: int, key: str) -> str:
    """base64url of a 32-bit time, the key's length and the key."""
    raw = key.encode()
    return base64.urlsafe_b64encode(struct.pack(">IB", at, len(raw)) + raw).decode().rstrip("=")


def decode_cursor(text: str) -> tuple[int, str]:
    """The time and key of a cursor; ValueError for anything that encode_cursor() doesn't make."""
    try:
        raw = base64.b64decode(text + "=" * (-len(text) % 4), altchars=b"-_", validate=True)
        at, size = struct.unpack_from(">IB", raw)
        key = raw[5:].decode()
    except (ValueError, struct.error) as e:
        raise ValueError("malformed cursor") from e
    if len(raw) != 5 + size:
        raise ValueError("malformed cursor")
    return at, key


def ranked_enum(value: Column, names: list[str]) -> Column:
    """The place of a value in the order in which an enum declares its names, from 1; 0 for others."""
    return F.array_position(F.array(*map(F.lit, names)), value)


def earlier_count(rows: DataFrame, order: list[str], range_rows: int = 1 << 20) -> DataFrame:
    """rows with ahead: how many come before each in a total order.

    Rows are dealt to ranges of the whole order, ties of its first keys included, of about range_rows each, and kept there; ranks
    within a range are a window, and the ranges' counts, a row each, are summed before it.
    """
    ranges = max(1, -(-rows.count() // range_rows), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = settled(rows.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()))
    before = ranged.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = F.row_number().over(W.partitionBy("_range").orderBy(*order)) - 1
    return ranged.withColumn("_within", within).join(before, "_range").withColumn("ahead", F.col("_within") + F.col("_before")).drop("_range", "_within", "_before")


def visible_to(rows: DataFrame, user: Column | int, owner: str = "user_id") -> DataFrame:
    """Rows that belong to all, which have no owner, and those of the user."""
    return rows.where(F.col(owner).isNull() | (F.col(owner) == user))


def any_row(rows: DataFrame, name: str = "found") -> DataFrame:
    """One row: whether there is any; no more than one is read."""
    return rows.limit(1).agg((F.count("*") > 0).alias(name))
