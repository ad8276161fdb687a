"""Glider catalogues: JSON of brand, class and models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skytrace.functions.gliders import glider_class
from skytrace.functions.text import model_name, slug
from skytrace.operators.snapshots import upsert


def models(catalogs: DataFrame) -> DataFrame:
    """(kind, brand, brand_slug, class, name, slug, is_tandem) of catalogues (kind, json); a class that the kind doesn't have is null."""
    brands = catalogs.select("kind", F.explode(F.from_json("json", "map<string,map<string,array<string>>>")).alias("brand", "classes"))
    listed = brands.select("kind", "brand", F.explode("classes").alias("key", "names")).select("kind", "brand", "key", F.explode("names").alias("raw"))
    named = listed.withColumn("_m", model_name(F.col("raw")))
    return named.select("kind", "brand", slug(F.col("brand")).alias("brand_slug"), glider_class(F.col("kind"), F.col("key")).alias("class"), F.col("_m.name").alias("name"), slug(F.col("_m.name")).alias("slug"), F.col("_m.is_tandem").alias("is_tandem"))


def errors(models: DataFrame) -> DataFrame:
    """(kind, brand_slug, slug, error) of models with an unknown class, of names listed twice and of names that share a slug."""
    keyed = models.groupBy("kind", "brand_slug", "slug").agg(F.count("*").alias("n"), F.countDistinct("name").alias("names"), F.bool_or(F.col("class").isNull()).alias("unknown"))
    found = F.array_compact(F.array(F.when(F.col("unknown"), "class"), F.when(F.col("n") > F.col("names"), "listed twice"), F.when(F.col("names") > 1, "slugs collide")))
    return keyed.select("kind", "brand_slug", "slug", F.explode(found).alias("error"))


def imported(table: DataFrame, models: DataFrame) -> DataFrame:
    """The catalogue's table after an import, with each row's outcome. table: (kind, brand_slug, slug, name, class, is_tandem)."""
    return upsert(table, models.select(table.columns), ["kind", "brand_slug", "slug"])


def import_summary(imported: DataFrame) -> DataFrame:
    return imported.groupBy("kind").agg(F.count_if(F.col("outcome") == "inserted").alias("added"), F.count_if(F.col("outcome") == "updated").alias("updated"), F.count_if((F.col("outcome") != "kept") & F.col("is_tandem")).alias("tandems"))
