"""IGC flight logs: reading and writing with DataFrame functions only.

A file is one row until its lines are exploded, so files are read in parallel and a file's lines keep their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Fixed values of the format: fields of a B record as (first character from 1, length); the shortest record; from when a day may
# end and until when it may begin, in seconds.
B_TIME, B_LAT, B_LON, B_VALID, B_PRESSURE, B_GPS, B_LENGTH = (2, 6), (8, 8), (16, 9), (25, 1), (26, 5), (31, 5), 35
EVENING_S, MORNING_S = 18 * 3600, 6 * 3600
B_VALID_FIX = r"^B\d{6}\d{7}[NS]\d{8}[EW]A(-?\d{4}|\d{5})(-\d{4}|\d{5}).*$"
B_ANY = r"^B([01]\d|2[0-3])[0-5]\d[0-5]\d.{17}[AV].{10}"


def _field(at: tuple[int, int]) -> Column:
    return F.substring("line", *at)


def e5(text: Column, degree_digits: int) -> Column:
    """DDMMmmm or DDDMMmmm with its hemisphere to E5: a thousandth of a minute is 5/3, halves up."""
    degrees = F.substring(text, 1, degree_digits).cast("int")
    thousandths = F.substring(text, degree_digits + 1, 5).cast("int")
    size = degrees * 100_000 + F.floor((thousandths * 5 + 1) / 3).cast("int")
    return F.when(F.substring(text, degree_digits + 6, 1).isin("S", "W"), -size).otherwise(size)


def _in_file() -> WindowSpec:
    return W.partitionBy("path").orderBy("n")


def parse(lines: DataFrame) -> DataFrame:
    """(path, idx, t, lat_e5, lon_e5, geo_dm, pressure_dm, tas_kmh, error) of every valid fix; of a file that breaks the format one
    row, with an error and no fix.

    A date holds from its HFDTE record on; a repeated date goes on counting days, a new one starts again. A day passes where a time
    in the evening is followed by one in the morning; V records count for that, but are no fixes. Without a date, t is the seconds
    since midnight. A pressure that is 0 throughout is null; TAS is null unless the I record declares it and every fix has it.
    """
    up_to = _in_file().rowsBetween(W.unboundedPreceding, 0)
    digits = F.when(F.col("line").startswith("HFDTE"), F.nullif(F.regexp_extract("line", r"(\d{6})", 1), F.lit("")))
    year = F.substring(digits, 5, 2).cast("int")
    day = F.unix_date(F.try_make_timestamp(year + F.when(year < 70, 2000).otherwise(1900), F.substring(digits, 3, 2).cast("int"), F.substring(digits, 1, 2).cast("int"), F.lit(0), F.lit(0), F.lit(0)).cast("date"))
    dated = lines.withColumn("_day", day).withColumn("_bad_date", digits.isNotNull() & day.isNull())
    before = F.last("_day", ignorenulls=True).over(_in_file().rowsBetween(W.unboundedPreceding, -1))
    dated = dated.withColumn("_new", F.when(F.col("_day").isNotNull() & before.isNotNull() & (before != F.col("_day")), 1).otherwise(0))
    dated = dated.withColumn("_group", F.sum("_new").over(up_to)).withColumn("_date", F.last("_day", ignorenulls=True).over(up_to))
    entry = F.filter(F.transform(F.sequence(F.lit(0), F.greatest(F.substring("line", 2, 2).try_cast("int") - 1, F.lit(0))), lambda i: F.expr("line").substr(i * 7 + 4, F.lit(7))), lambda x: x.rlike(r"^\d{4}TAS$"))
    declared = F.when(F.col("line").rlike(r"^I\d\d(\d{4}...)+"), F.coalesce(F.get(entry, F.lit(0)), F.lit("")))
    dated = dated.withColumn("_tas", F.first(declared, ignorenulls=True).over(up_to))
    b = dated.where(F.col("line").startswith("B") | F.col("_bad_date"))
    known = F.col("line").rlike(B_ANY) & (F.length("line") >= B_LENGTH)
    valid = known & (_field(B_VALID) == "A")
    bad = F.col("_bad_date") | ~known | (valid & ~F.col("line").rlike(B_VALID_FIX))
    part = lambda k: F.substring("line", k, 2).try_cast("int")
    b = b.withColumn("_bad", F.max(bad).over(W.partitionBy("path"))).withColumn("_s", F.when(known, part(2) * 3600 + part(4) * 60 + part(6)))
    in_group = W.partitionBy("path", "_group").orderBy("n")
    over = F.when((F.lag("_s").over(in_group) >= EVENING_S) & (F.col("_s") <= MORNING_S), 1).otherwise(0)
    b = b.withColumn("_over", over).withColumn("_days", F.sum("_over").over(in_group.rowsBetween(W.unboundedPreceding, 0)))
    fixes = b.where(valid & ~F.col("_bad"))
    first, last = F.substring("_tas", 1, 2).try_cast("int"), F.substring("_tas", 3, 2).try_cast("int")
    tas = F.when((F.col("_tas") != "") & (F.length("line") >= last), F.trim(F.expr("line").substr(first, last - first + 1)).try_cast("int"))
    file = W.partitionBy("path")
    fixes = fixes.withColumn("_pressure", _field(B_PRESSURE).cast("int") * 10).withColumn("_own_tas", F.when(tas >= 0, tas))
    fixes = fixes.select(
        "path", (F.row_number().over(_in_file()) - 1).cast("long").alias("idx"),
        (F.coalesce(F.col("_date").cast("long"), F.lit(0)) * 86_400 + F.col("_days") * 86_400 + F.col("_s")).alias("t"),
        e5(_field(B_LAT), 2).alias("lat_e5"), e5(_field(B_LON), 3).alias("lon_e5"), (_field(B_GPS).cast("int") * 10).alias("geo_dm"),
        F.when(F.max(F.abs("_pressure")).over(file) > 0, F.col("_pressure")).alias("pressure_dm"),
        F.when(F.min(F.col("_own_tas").isNotNull()).over(file), F.col("_own_tas")).alias("tas_kmh"), F.lit(None).cast("string").alias("error"),
    )
    broken = b.where("_bad").groupBy("path").agg(F.min(F.when(bad, F.col("n") + 1)).alias("n"))
    void = {c: F.lit(None).cast(t) for c, t in fixes.dtypes if c not in ("path", "error")}
    return fixes.unionByName(broken.select("path", F.concat(F.lit("line "), "n").alias("error")).withColumns(void))


def _degrees_text(value: Column, digits: int, signs: str) -> Column:
    """E5 as degrees and thousandths of a minute with the hemisphere."""
    size = F.abs(value)
    thousandths = F.round(size % 100_000 * 0.6).cast("int")
    whole = F.floor(size / 100_000).cast("int") + F.floor(thousandths / 60_000).cast("int")
    return F.concat(F.lpad(whole.cast("string"), digits, "0"), F.lpad((thousandths % 60_000).cast("string"), 5, "0"), F.when(value < 0, signs[1]).otherwise(signs[0]))


def _altitude_text(dm: Column) -> Column:
    metres = (F.coalesce(dm, F.lit(0)) / 10).cast("int")
    return F.when(metres < 0, F.concat(F.lit("-"), F.lpad(F.abs(metres).cast("string"), 4, "0"))).otherwise(F.lpad(metres.cast("string"), 5, "0"))


def compose(fixes: DataFrame, logger: str = "AXSKYTRACE") -> DataFrame:
    """(flight_id, igc): each flight's fixes as the text of a log. TAS is written where every fix has it."""
    flight = W.partitionBy("flight_id")
    has_tas, width = F.min(F.col("tas_kmh").isNotNull()).over(flight), F.greatest(F.max(F.length(F.col("tas_kmh").cast("string"))).over(flight), F.lit(3))
    at = F.timestamp_seconds("t")
    record = F.concat(F.lit("B"), F.date_format(at, "HHmmss"), _degrees_text(F.col("lat_e5"), 2, "NS"), _degrees_text(F.col("lon_e5"), 3, "EW"), F.lit("A"), _altitude_text(F.col("pressure_dm")), _altitude_text(F.col("geo_dm")))
    rows = fixes.withColumn("_has", has_tas).withColumn("_width", width)
    rows = rows.withColumn("_line", F.when(F.col("_has"), F.concat(record, F.lpad(F.col("tas_kmh").cast("string"), F.col("_width").cast("int"), F.lit("0")))).otherwise(record))
    made = rows.groupBy("flight_id").agg(F.array_sort(F.collect_list(F.struct("idx", "_line"))).alias("rows"), F.min("t").alias("t"), F.first("_has").alias("has"), F.first("_width").alias("width"))
    head = F.concat(F.lit(logger + "\nHFDTE"), F.date_format(F.timestamp_seconds("t"), "ddMMyy"), F.lit("\n"), F.when(F.col("has"), F.concat(F.lit("I0136"), F.lpad((F.col("width") + 35).cast("string"), 2, "0"), F.lit("TAS\n"))).otherwise(""))
    return made.select("flight_id", F.concat(head, F.array_join("rows._line", "\n"), F.lit("\n")).alias("igc"))
