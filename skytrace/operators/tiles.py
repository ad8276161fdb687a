"""Raster tile pyramids over long-form pixels: (z, x, y, row, col, value).

Resampling is a join of pixels with the destination cells they overlap, weighted by area; a parent tile is the same over its four
children. Tiles of a zoom are independent, so each step is one shuffle on the tile's key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skytrace.functions.geo import mercator_lat, mercator_lon, mercator_x, mercator_y, tile_index
from skytrace.storage import settled

# Pixels of a tile's side; metres of a quantum of elevation; the largest elevation; pixels of a side that is read as it is.
SIDE, QUANTUM_M, MOST_M, MOST_EXACT = 256, 8, 32_767, 512


def elevation(value: Column) -> Column:
    """Metres of a sample: what is negative, not finite or missing is 0, and nothing exceeds MOST_M."""
    return F.least(F.greatest(F.coalesce(F.nanvl(value, F.lit(0.0)), F.lit(0.0)), F.lit(0.0)), F.lit(float(MOST_M)))


def quantised(metres: Column) -> Column:
    return F.greatest(F.round(metres / QUANTUM_M), F.lit(0)).cast("int")


def terrarium(red: Column, green: Column, blue: Column, alpha: Column) -> Column:
    """Metres of an RGB elevation pixel; -32768 where it is transparent."""
    return F.when(alpha == 0, F.lit(-32_768.0)).otherwise(red * 256 + green + blue / 256 - 32_768)


def pixels(tiles: DataFrame, array: str, width: str) -> DataFrame:
    """A row per pixel of row-major arrays."""
    at = tiles.select("z", "x", "y", F.col(width).alias("_w"), F.posexplode(array).alias("_i", "value"))
    return at.select("z", "x", "y", F.floor(F.col("_i") / F.col("_w")).cast("int").alias("row"), (F.col("_i") % F.col("_w")).cast("int").alias("col"), F.col("value").cast("double").alias("value"))


def _overlaps(at: Column, scale: Column, cells: int) -> Column:
    """Destination cells that a pixel overlaps along an axis, with the overlap's share of a cell; scale: cells per pixel."""
    lo, hi = at * scale, (at + 1) * scale
    first, last = F.floor(lo).cast("int"), F.least(F.ceil(hi).cast("int") - 1, F.lit(cells - 1))
    return F.transform(F.sequence(first, F.greatest(first, last)), lambda c: F.struct(c.alias("cell"), (F.least(hi, c + 1.0) - F.greatest(lo, c + 0.0)).alias("share")))


def resample(pixels: DataFrame, height: int, width: int, rows: int, cols: int) -> DataFrame:
    """Area-weighted means of tiles of height x width pixels on rows x cols cells. Partial sums are made where the pixels are."""
    by_row = pixels.withColumn("_r", F.explode(_overlaps(F.col("row"), F.lit(rows / height), rows)))
    both = by_row.withColumn("_c", F.explode(_overlaps(F.col("col"), F.lit(cols / width), cols))).withColumn("_w", F.col("_r.share") * F.col("_c.share"))
    summed = both.where("_w > 1e-12").groupBy("z", "x", "y", F.col("_r.cell").alias("row"), F.col("_c.cell").alias("col"))
    return summed.agg((F.sum(F.col("value") * F.col("_w")) / F.sum("_w")).alias("value"))


def parents(pixels: DataFrame, side: int) -> DataFrame:
    """Tiles one zoom up: four children side by side, of which missing ones are 0, halved by area. A child's first pixel brings a zero
    for every cell of its parent too, so one pass and one shuffle give whole tiles."""
    at = lambda v, odd: F.floor((F.col(v) + (F.col(odd) % 2) * side) / 2).cast("int")
    own = F.array(F.struct(at("row", "y").alias("row"), at("col", "x").alias("col"), F.col("value").alias("value")))
    blank = F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), lambda i: F.struct(F.floor(i / side).cast("int").alias("row"), (i % side).cast("int").alias("col"), F.lit(0.0).alias("value")))
    cells = F.when((F.col("row") == 0) & (F.col("col") == 0), F.concat(own, blank)).otherwise(own)
    moved = pixels.select((F.col("z") - 1).alias("z"), F.shiftright("x", 1).alias("x"), F.shiftright("y", 1).alias("y"), F.explode(cells).alias("_c"))
    return moved.groupBy("z", "x", "y", F.col("_c.row").alias("row"), F.col("_c.col").alias("col")).agg((F.sum("_c.value") / 4).alias("value"))


def pyramid(pixels: DataFrame, side: int, min_zoom: int, max_zoom: int) -> DataFrame:
    """All zooms from max_zoom, which pixels holds, up to min_zoom. Each zoom is computed once, from the one below as it was kept."""
    level = out = pixels.where(F.col("z") == max_zoom)
    for zoom in range(max_zoom - 1, min_zoom - 1, -1):
        level = settled(parents(level, side)) if zoom > min_zoom else parents(level, side)
        out = out.unionByName(level)
    return out


def deltas(pixels: DataFrame, value: str = "value") -> DataFrame:
    """delta: the difference from the left neighbour; in the first column from the one above; the first pixel as it is."""
    left = F.lag(value).over(W.partitionBy("z", "x", "y", "row").orderBy("col"))
    above = F.lag(value).over(W.partitionBy("z", "x", "y", "col").orderBy("row"))
    return pixels.withColumn("_above", above).withColumn("delta", F.col(value) - F.coalesce(left, F.col("_above"), F.lit(0))).drop("_above")


def undeltas(pixels: DataFrame) -> DataFrame:
    """value of what deltas() made: running sums down the first column, then along the rows."""
    edge = F.sum(F.when(F.col("col") == 0, F.col("delta")).otherwise(0)).over(W.partitionBy("z", "x", "y").orderBy("row").rangeBetween(W.unboundedPreceding, 0))
    along = F.sum(F.when(F.col("col") == 0, 0).otherwise(F.col("delta"))).over(W.partitionBy("z", "x", "y", "row").orderBy("col").rowsBetween(W.unboundedPreceding, 0))
    return pixels.withColumn("_edge", edge).withColumn("value", F.col("_edge") + along).drop("_edge")


def leaf_zoom(pixel_deg: Column) -> Column:
    """The zoom whose pixels are about as large as the source's; 0 where a tile holds the whole source."""
    tiles = F.floor(360.0 / pixel_deg / SIDE)
    return F.when(tiles >= 1, F.floor(F.log2(tiles))).otherwise(0).cast("int")


def tile_bounds(z: Column, x: Column, y: Column) -> Column:
    """struct(west, south, east, north) of a tile in degrees."""
    n = F.pow(F.lit(2.0), z)
    return F.struct(mercator_lon(x / n).alias("west"), mercator_lat((y + 1) / n).alias("south"), mercator_lon((x + 1) / n).alias("east"), mercator_lat(y / n).alias("north"))


def tiles_over(bounds: DataFrame, zoom: int) -> DataFrame:
    """A row (z, x, y) per tile that the bounds (west, south, east, north) reach into, next to the bounds' own columns."""
    z = F.lit(zoom)
    x = F.sequence(tile_index(mercator_x(F.col("west")), z), tile_index(mercator_x(F.col("east")), z, upper=True))
    y = F.sequence(tile_index(mercator_y(F.col("north")), z), tile_index(mercator_y(F.col("south")), z, upper=True))
    return bounds.withColumn("z", z).withColumn("x", F.explode(x)).withColumn("y", F.explode(y))


def pixel_region(low: Column, high: Column, origin: Column, pixel: Column, size: Column) -> Column:
    """struct(first, count) of the pixels along an axis that [low, high] touches: outward, but a bound within a millionth of a pixel's
    edge lies on it. Null where it leaves the source: nothing is clamped."""
    snap = lambda v: F.when(F.abs(v - F.round(v)) < 1e-6, F.round(v)).otherwise(v)
    first, last = F.floor(snap((low - origin) / pixel)), F.ceil(snap((high - origin) / pixel))
    return F.when((first >= 0) & (last <= size) & (last > first), F.struct(first.alias("first"), (last - first).alias("count")))


def region(chunks: DataFrame, regions: DataFrame, height: int, width: int) -> DataFrame:
    """(region_id, row, col, value): regions of a source that is kept in chunks of height x width pixels. A region meets in an equi-join
    the chunks that it touches, and takes of each the part within; samples become elevations. chunks: (chunk_x, chunk_y, px);
    regions: (region_id, x0, y0, w, h) in pixels."""
    x = F.sequence(F.floor(F.col("x0") / width).cast("int"), F.floor((F.col("x0") + F.col("w") - 1) / width).cast("int"))
    y = F.sequence(F.floor(F.col("y0") / height).cast("int"), F.floor((F.col("y0") + F.col("h") - 1) / height).cast("int"))
    touched = regions.where("w > 0 and h > 0").withColumn("chunk_x", F.explode(x)).withColumn("chunk_y", F.explode(y)).join(chunks, ["chunk_x", "chunk_y"])
    # Only the rows and columns within the region are ever made into rows.
    lines = F.sequence(F.greatest(F.col("y0"), F.col("chunk_y") * height), F.least(F.col("y0") + F.col("h"), (F.col("chunk_y") + 1) * height) - 1)
    places = F.sequence(F.greatest(F.col("x0"), F.col("chunk_x") * width), F.least(F.col("x0") + F.col("w"), (F.col("chunk_x") + 1) * width) - 1)
    cells = touched.withColumn("_y", F.explode(lines)).withColumn("_x", F.explode(places))
    sample = F.get("px", ((F.col("_y") - F.col("chunk_y") * height) * width + F.col("_x") - F.col("chunk_x") * width).cast("int"))
    finite = F.when(F.abs(sample) == float("inf"), 0.0).otherwise(F.round(sample))
    return cells.select("region_id", (F.col("_y") - F.col("y0")).alias("row"), (F.col("_x") - F.col("x0")).alias("col"), elevation(finite).alias("value"))


def write_tiles(tiles: DataFrame, path: str) -> None:
    """Tiles as Parquet, a folder per zoom and files by block, so a reader of one block prunes all else."""
    placed = tiles.withColumn("block_x", F.shiftright("x", 6)).withColumn("block_y", F.shiftright("y", 6))
    placed.repartition("z", "block_x", "block_y").sortWithinPartitions("block_x", "block_y", "y", "x").write.partitionBy("z").mode("overwrite").parquet(path)
