"""Gliders of a legacy log, by brand and model of the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skytrace.functions.gliders import legacy_kind
from skytrace.functions.text import slug


def resolved(gliders: DataFrame, brand_names: DataFrame, brands: DataFrame, models: DataFrame, rules: DataFrame) -> DataFrame:
    """(id, brand_id, kind, model_id, outcome) of every glider: 'model' where the slug of its text is a model's, 'alias' where it is the
    first rule of the brand that its text matches, 'custom' for a model of the user's own, 'user:slug'; else why it was skipped.

    gliders: (id, user_id, category, brand_no, text); brand_names: (brand_no, brand); brands: (brand_id); models: (brand_id, kind,
    model_id); rules: (n, kind, brand_id, pattern, model_id), in order of n. Each distinct text meets the rules of its brand once.
    """
    own = gliders.select("id", "user_id", legacy_kind(F.col("category")).alias("kind"), "brand_no", F.trim("text").alias("text"))
    named = own.join(brand_names.select("brand_no", slug(F.col("brand")).alias("brand_id")), "brand_no", "left").withColumn("slug", slug(F.col("text")))
    named = named.join(brands.select("brand_id", F.lit(True).alias("_known")).distinct(), "brand_id", "left")
    skipped = F.when(F.col("kind") == "other", "no airframe").when(F.col("brand_no") == 0, "no brand picked").when(F.col("brand_id").isNull(), "unknown brand").when(F.col("_known").isNull(), "brand not in the catalogue")
    named = named.withColumn("_skipped", skipped)
    direct = models.select("brand_id", "kind", F.col("model_id").alias("slug"), F.lit(True).alias("_direct")).distinct()
    texts = named.where("_skipped is null").select("brand_id", "kind", "text").distinct().join(rules, ["brand_id", "kind"]).where(F.expr("text rlike pattern"))
    first = texts.groupBy("brand_id", "kind", "text").agg(F.min_by("model_id", "n").alias("_alias"))
    found = named.join(direct, ["brand_id", "kind", "slug"], "left").join(first, ["brand_id", "kind", "text"], "left")
    custom = F.concat(F.col("user_id").cast("string"), F.lit(":"), "slug")
    model = F.when(F.col("_skipped").isNull(), F.when(F.col("_direct"), F.col("slug")).otherwise(F.coalesce("_alias", custom)))
    outcome = F.coalesce("_skipped", F.when(F.col("_direct"), "model").when(F.col("_alias").isNotNull(), "alias").otherwise("custom"))
    return found.select("id", F.when(F.col("_skipped").isNull(), F.col("brand_id")).alias("brand_id"), "kind", model.alias("model_id"), outcome.alias("outcome"))
