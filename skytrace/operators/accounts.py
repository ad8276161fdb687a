"""Users: names that are taken, and rows that are added unless their address is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def name_taken(asked: DataFrame, users: DataFrame) -> DataFrame:
    """asked (user_id, name ...) with taken: whether another user (user_id, name) has the name, whatever its case; a null user_id asks for a
    user who isn't there yet. A null name is never taken. Users meet in one aggregate per name, so a common name is one row."""
    least, most = F.col("_least"), F.col("_most")
    who = users.where("name is not null").groupBy(F.lower("name").alias("_low")).agg(F.min("user_id").alias("_least"), F.max("user_id").alias("_most"))
    both = asked.withColumn("_low", F.lower("name")).join(who, "_low", "left")
    alone = least.eqNullSafe(F.col("user_id")) & most.eqNullSafe(F.col("user_id"))
    return both.withColumn("taken", least.isNotNull() & ~alone).drop("_low", "_least", "_most")


def _stripped(value: Column) -> Column:
    return F.regexp_replace(value, r"^\s+|\s+$", "")


def users_added(users: DataFrame, new: DataFrame) -> DataFrame:
    """new (n, name, email ...) as it is stored, names and addresses stripped and addresses in lower case, with outcome: inserted, conflict
    where a user (email) or an inserted row of lower n has the address, or invalid where the name is blank or null. Blank addresses are
    null, and null ones never conflict. Who asks for a conflict to be an error looks for such rows; who doesn't takes the inserted ones. n is unique."""
    name, email = _stripped(F.col("name")), F.nullif(F.lower(_stripped(F.col("email"))), F.lit(""))
    told = new.withColumn("name", name).withColumn("email", email)
    valid = F.coalesce(F.col("name") != "", F.lit(False))
    first = told.where(valid).select("email", F.col("n").alias("_first"), F.lit(False).alias("_old")).unionByName(users.select(email.alias("email"), F.lit(True).alias("_old")), allowMissingColumns=True)
    first = first.where("email is not null").groupBy("email").agg(F.min("_first").alias("_first"), F.bool_or("_old").alias("_old"))
    late = F.coalesce(F.col("_old") | (F.col("_first") != F.col("n")), F.lit(False))
    outcome = F.when(~valid, "invalid").when(late, "conflict").otherwise("inserted")
    return told.join(first, "email", "left").withColumn("outcome", outcome).select(*new.columns, "outcome")
