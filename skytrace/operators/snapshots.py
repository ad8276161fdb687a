"""Inserts, upserts, updates and deletes as new snapshots of a table.

Each takes the table as it is and returns the table as it will be; the caller writes that to a new place and points readers there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skytrace.storage import settled


def insert_missing(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new whose key the table lacks are added; the first of rows that share a key is any of them."""
    return table.unionByName(new.dropDuplicates(keys).join(table.select(keys), keys, "left_anti").select(table.columns))


def upsert(table: DataFrame, new: DataFrame, keys: list[str], set_columns: list[str] | None = None) -> DataFrame:
    """Rows of new replace set_columns (all but the keys) of the rows with their key, or are added. outcome: kept, updated or
    inserted. Keys of new are unique."""
    set_columns = set_columns if set_columns is not None else [c for c in table.columns if c not in keys]
    old, fresh = table.select(F.struct(table.columns).alias("_old"), *keys), new.select(F.struct(new.columns).alias("_new"), *keys)
    both = old.join(fresh, keys, "full_outer")
    value = lambda c: F.when(F.col("_old").isNull(), F.col(f"_new.{c}")).when(F.col("_new").isNull(), F.col(f"_old.{c}")).otherwise(F.col(f"_new.{c}") if c in set_columns else F.col(f"_old.{c}"))
    outcome = F.when(F.col("_old").isNull(), "inserted").when(F.col("_new").isNull(), "kept").otherwise("updated")
    return both.select(*[c if c in keys else value(c).alias(c) for c in table.columns], outcome.alias("outcome"))


def update_given(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """A change has a struct (given, value) per column; what isn't given stays, and a given null overwrites."""
    columns = [c for c in changes.columns if c not in keys]
    both = table.join(changes.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns]), keys, "left")
    value = lambda c: F.when(F.coalesce(F.col(f"_{c}.given"), F.lit(False)), F.col(f"_{c}.value")).otherwise(F.col(c))
    return both.select(*[value(c).alias(c) if c in columns else F.col(c) for c in table.columns])


def delete_with_children(keys: DataFrame, key: str, *tables: tuple[DataFrame, str]) -> list[DataFrame]:
    """Each table without the rows that refer to a deleted key by its own column."""
    gone = keys.select(F.col(key).alias("_gone")).distinct()
    return [t.join(gone, F.col(c) == F.col("_gone"), "left_anti") for t, c in tables]


def reap_orphans(parents: DataFrame, children: DataFrame, keys: list[str], only: Column) -> DataFrame:
    """Parents that `only` selects go when no child refers to them; others stay."""
    used = children.select(keys).distinct()
    return parents.where(~only).unionByName(parents.where(only).join(used, keys, "left_semi").select(parents.columns))


def transferred(rows: DataFrame, moves: DataFrame, user: str, slug: str) -> DataFrame:
    """Rows of a user that moves to another get the new user and the slug 'user:rest'; others stay. moves: (old, new)."""
    both = rows.join(moves, F.col(user) == F.col("old"), "left")
    rest = F.element_at(F.split(slug, ":", 2), -1)
    return both.select(*[F.coalesce("new", user).alias(c) if c == user else F.when(F.col("new").isNotNull() & F.col(slug).contains(":"), F.concat(F.col("new").cast("string"), F.lit(":"), rest)).otherwise(F.col(slug)).alias(c) if c == slug else F.col(c) for c in rows.columns])


def next_id(rows: DataFrame, column: str) -> DataFrame:
    """One row: where an identity goes on, 1 at least."""
    return rows.agg(F.greatest(F.coalesce(F.max(column), F.lit(0)), F.lit(1)).alias("next_id"))


def _reslugged(name: Column, user: Column) -> Column:
    """A private 'user:rest' under another user."""
    return F.concat(user.cast("string"), F.lit(":"), F.element_at(F.split(name, ":", 2), -1))


def flights_transferred(flights: DataFrame, models: DataFrame, brands: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """flights, models and brands after flights have moved to other users.

    A flight's model goes along as the new user's if it is its old user's own, and with it the brand if that is; what the new user
    has already stays. Of the old models and brands those go that nothing refers to any more. flights: (id, user_id, brand_id, kind,
    model_id); models: (brand_id, kind, model_id, name, user_id); brands: (brand_id, name, user_id), user_id null for shared ones;
    moves: (id, new_user), an id once.
    """
    own_model = models.select("brand_id", "kind", "model_id", F.col("user_id").alias("_model_user"), F.col("name").alias("_model_name"))
    own_brand = brands.select("brand_id", F.col("user_id").alias("_brand_user"), F.col("name").alias("_brand_name"))
    both = flights.join(moves, "id", "left").join(own_model, ["brand_id", "kind", "model_id"], "left").join(own_brand, "brand_id", "left")
    goes = F.col("new_user").isNotNull() & (F.col("_model_user") == F.col("user_id"))
    brand_goes = goes & (F.col("_brand_user") == F.col("user_id"))
    both = both.withColumn("_goes", F.coalesce(goes, F.lit(False))).withColumn("_brand_goes", F.coalesce(brand_goes, F.lit(False)))
    both = both.withColumn("_brand", F.when(F.col("_brand_goes"), _reslugged(F.col("brand_id"), F.col("new_user"))).otherwise(F.col("brand_id")))
    both = settled(both.withColumn("_model", F.when(F.col("_goes"), _reslugged(F.col("model_id"), F.col("new_user"))).otherwise(F.col("model_id"))))
    after = both.select("id", F.coalesce("new_user", "user_id").alias("user_id"), F.col("_brand").alias("brand_id"), "kind", F.col("_model").alias("model_id"))
    key = ["brand_id", "kind", "model_id"]
    came = both.where("_goes").select(F.col("_brand").alias("brand_id"), "kind", F.col("_model").alias("model_id"), F.col("_model_name").alias("name"), F.col("new_user").alias("user_id"))
    kept_models = settled(_kept(key, models, came, both.where("_goes").select(key), after.select(key)))
    came_brands = both.where("_brand_goes").select(F.col("_brand").alias("brand_id"), F.col("_brand_name").alias("name"), F.col("new_user").alias("user_id"))
    return after, kept_models, _kept(["brand_id"], brands, came_brands, both.where("_brand_goes").select("brand_id"), kept_models.select("brand_id"))


def _kept(key: list[str], rows: DataFrame, came: DataFrame, left: DataFrame, used: DataFrame) -> DataFrame:
    """rows and those that came (the old one where both have a key), without those that were left and that nothing uses. One shuffle: what
    is known of a key meets in one aggregate."""
    rest = [c for c in rows.columns if c not in key]
    said = lambda df, place, was_left, is_used: df.select(*key, (F.struct(F.lit(place).alias("_place"), *rest) if place is not None else F.lit(None)).alias("_row"), F.lit(was_left).alias("_left"), F.lit(is_used).alias("_used"))
    known = said(rows, 0, False, False).unionByName(said(came, 1, False, False)).unionByName(said(left, None, True, False)).unionByName(said(used, None, False, True))
    told = known.groupBy(*key).agg(F.min("_row").alias("_row"), F.bool_or("_left").alias("_left"), F.bool_or("_used").alias("_used"))
    return told.where(F.col("_row").isNotNull() & (~F.col("_left") | F.col("_used"))).select(*[c if c in key else F.col(f"_row.{c}").alias(c) for c in rows.columns])
