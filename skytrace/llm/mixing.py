"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import NullType

from skytrace.llm.common import WORD, partitions, written

#: Weights of the sources in code-point order, repeating; the share of all words to take; the most copies of a document.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
_OWN = "__mix_"


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, n_rows, target) from rows (source, size): words to take from each source.

    Sources by code point, null last, get the weights in turn and share `share` of all words; a target stops at `most` times its
    source's size, and the excess is shared again by weight until none is above. Sources stop in order of size to weight, so the
    level that is left is the first, in this order, that the next source doesn't stop at. An empty table gives no rows.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    # One row per source, ranked by a range sort: rank within a partition, and the partitions' counts summed before it.
    ranged = written(per.repartitionByRange(partitions(sizes.sparkSession), F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "sources")
    base = ranged.groupBy("part").count().withColumn("before", F.coalesce(F.sum("count").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(W.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1 + F.col("before")
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    weighed = written(ranged.join(base, "part").select("source", "source_size", "n_rows", weight.alias("weight")), "weights")
    # Sums over the sources that stop earlier: within a range of this order, and over the ranges before it.
    ranged = weighed.withColumn("stop", F.col("source_size") * float(most) / F.col("weight"))
    ranged = written(ranged.repartitionByRange(partitions(sizes.sparkSession), "stop", F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "stops")
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = ranged.groupBy("part").agg(F.sum("source_size").alias("s"), F.sum("weight").alias("w"))
    parts = parts.select("part", before("s", W.orderBy("part")).alias("s"), before("w", W.orderBy("part")).alias("w"))
    within = W.partitionBy("part").orderBy("stop", F.col("source").asc_nulls_last())
    stops = ranged.join(parts, "part").select("stop", (F.col("s") + before("source_size", within)).alias("size"), (F.col("w") + before("weight", within)).alias("weight"))
    total, weights_ = weighed.agg(F.sum("source_size"), F.sum("weight")).first()
    own = (F.lit(share * (total or 0)) - most * F.col("size")) / (F.lit(weights_) - F.col("weight"))
    (level,) = stops.withColumn("level", own).where(F.col("level") < F.col("stop")).agg(F.min_by("level", "stop")).first()
    level = level if level is not None else float("inf") if share > most else 0.0
    cap = F.col("source_size").cast("double") * most
    return weighed.select("source", "source_size", "n_rows", F.least(cap, F.lit(level) * F.col("weight")).alias("target"))


def offset(source: Column, seed: str = "mix") -> Column:
    """The random offset of a source in [0, 1): from a digest of its name, so that reruns agree."""
    digest = F.md5(F.concat(F.lit(seed), F.when(source.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), source))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(1 << 32)


def _mark(docs: DataFrame) -> list[Column]:
    """128 bits that name a row by all its columns, so unlike rows are different documents even where id, source and text agree."""
    plain = lambda f: F.col(f"`{f.name}`").cast("string") if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`")
    columns = [plain(f) for f in docs.schema.fields if not isinstance(f.dataType, NullType)]
    none = F.concat(*[c.isNull().cast("int").cast("string") for c in columns])
    return [F.xxhash64(F.lit(seed), none, *columns) for seed in (0, 1)]


def copies(docs: DataFrame, **targets) -> DataFrame:
    """A row per document: (doc_id, mark, check, size, source, source_size, target, n_copies).

    Documents of a source lie in order of (size, doc_id, mark of the whole row), each as long as its expected copies, which is the
    source's target over its size; a random offset is added, and a document is taken once for each integer it crosses. As
    neighbours have nearly the same size, the words taken come within about one document of the target. Equal rows are
    interchangeable. A null text has size 0. mark and check tell apart rows that share an id. A null source is a source; rows with
    null ids come first among those of their size. Texts may have any length, other columns any name; an empty table gives no rows.
    """
    mark, check = _mark(docs)
    slim = written(docs.select("doc_id", mark.alias("mark"), check.alias("check"), n_words().alias("size"), "source"), "sizes")
    order = [F.col("source").asc_nulls_last(), "size", "doc_id", "mark"]
    slim = written(slim.repartitionByRange(partitions(docs.sparkSession), *order).withColumn("part", F.spark_partition_id()), "ordered")
    sources = written(source_targets(slim, **targets), "targets")
    runs = slim.groupBy("source", "part").count()
    before = F.coalesce(F.sum("count").over(W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    runs = runs.withColumn("before", before).select(F.col("source").alias("s"), F.col("part").alias("p"), "before")
    # A run is what one source has in one partition, so no window is larger than a partition.
    ranked = slim.withColumn("place", F.row_number().over(W.partitionBy("part", "source").orderBy("size", "doc_id", "mark")))
    ranked = ranked.join(runs, (F.col("part") == F.col("p")) & F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "mark", "check", "size", "source", (F.col("place") + F.col("before")).alias("place"))
    told = sources.select(F.col("source").alias("s"), "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("each"), offset(F.col("source")).alias("offset"))
    taken = F.floor(F.col("place") * F.col("each") + F.col("offset")) - F.floor((F.col("place") - 1) * F.col("each") + F.col("offset"))
    # Sources are one row each; the documents' side is split by AQE where a source is hot.
    return ranked.join(told, F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "mark", "check", "size", "source", "source_size", "target", taken.alias("n_copies"))


def mix(docs: DataFrame, **targets) -> DataFrame:
    """docs with each row as often as the mix takes it; columns as they come, whatever their names.

    Rows that agree in all columns are one document, which comes as often as the mix takes them together; unlike rows are documents
    of their own, whatever id and text they share. Only rows that repeat each other are brought together, on the map side first. Whole
    texts of any length are kept; an empty table gives none.
    """
    keys = [_OWN + "mark", _OWN + "check"]
    drawn = copies(docs, **targets).groupBy(F.col("mark").alias(keys[0]), F.col("check").alias(keys[1])).agg(F.sum("n_copies").cast("int").alias(_OWN + "n"), F.count("*").alias(_OWN + "rows")).where(F.col(_OWN + "n") > 0)
    named = docs.select(*[c.alias(k) for c, k in zip(_mark(docs), keys)], F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(_OWN + "row"))
    # One shuffle of the rows serves both branches.
    taken = named.join(drawn, keys)
    once = taken.where(F.col(_OWN + "rows") == 1).select(_OWN + "row", _OWN + "n")
    more = taken.where(F.col(_OWN + "rows") > 1).groupBy(*keys).agg(F.first(_OWN + "row").alias(_OWN + "row"), F.first(_OWN + "n").alias(_OWN + "n")).select(_OWN + "row", _OWN + "n")
    return once.unionByName(more).select(_OWN + "row", F.explode(F.array_repeat(F.lit(1), F.col(_OWN + "n")))).select(_OWN + "row.*")
