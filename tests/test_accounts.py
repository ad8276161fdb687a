"""Names that are taken, users that are added, preferences and limits: odd rows."""

from pyspark.sql import functions as F

from skytrace.functions import text
from skytrace.operators import accounts, cleaning, listing
from skytrace.sources import stored


def test_names_taken_by_others(spark):
    users = spark.createDataFrame([(1, "Ann"), (2, "ANN"), (3, "Bo"), (3, "bo"), (4, None)], "user_id long, name string")
    asked = spark.createDataFrame([(1, "ann"), (3, "BO"), (None, "bo"), (None, "new"), (4, None), (9, "")], "user_id long, name string")
    assert [r.taken for r in accounts.name_taken(asked, users).orderBy(F.col("user_id").asc_nulls_last(), "name").collect()] == [True, False, False, False, True, False]
    assert not any(r.taken for r in accounts.name_taken(asked, users.limit(0)).collect())


def test_users_added_once(spark):
    there = spark.createDataFrame([("A@x.org",), (None,), (" ",)], "email string")
    new = spark.createDataFrame([(1, " A ", "a@X.org "), (2, "B", "b@x.org"), (3, "C", "B@x.org"), (4, "\t", "d@x.org"), (5, "D", "d@x.org"), (6, None, None), (7, "E", None), (8, "F", " "), (9, "G", None)], "n long, name string, email string")
    got = {r.n: (r.name, r.email, r.outcome) for r in accounts.users_added(there, new).collect()}
    assert got[1] == ("A", "a@x.org", "conflict") and got[2] == ("B", "b@x.org", "inserted") and got[3][2] == "conflict"
    assert got[4][2] == got[6][2] == "invalid" and got[5] == ("D", "d@x.org", "inserted")  # an invalid row takes no address
    assert {got[n][1:] for n in (7, 8, 9)} == {(None, "inserted")}
    assert accounts.users_added(there, new.limit(0)).count() == 0


def test_preferences_follow_units(spark):
    df = spark.createDataFrame([(None, None, None, "US"), ("system", "mps", "system", "GB"), ("metric", "system", None, "US"), ("imperial", None, "kmh", None), (None, None, None, None)], "u string, v string, s string, r string")
    got = [tuple(x.p) for x in df.select(text.preferences(F.col("u"), F.col("v"), F.col("s"), F.col("r")).alias("p")).collect()]
    assert got == [("imperial", "fpm", "mph"), ("imperial", "mps", "mph"), ("metric", "mps", "kmh"), ("imperial", "fpm", "kmh"), ("metric", "mps", "kmh")]


def test_limits(spark):
    got = spark.createDataFrame([(None,), (1,), (100,), (0,), (101,)], "n long").select(listing.page_limit(F.col("n"), 25).alias("p")).collect()
    assert [r.p.limit for r in got] == [25, 1, 100, None, None] and [r.p.error is None for r in got] == [True, True, True, False, False]


def test_slices_without_fixes(spark):
    fixes = spark.createDataFrame([(1, i, 10 * i) for i in range(5)], "flight_id long, idx long, t long")
    windows = spark.createDataFrame([(1, 10, 30), (2, 0, 99), (3, None, 5)], "flight_id long, takeoff_t long, landing_t long")
    got = {r.flight_id: (r.first_idx, r.last_idx, r.n, r.error is None) for r in cleaning.slice_bounds(fixes, windows).collect()}
    assert got == {1: (1, 3, 3, True), 2: (None, None, 0, False), 3: (None, None, 0, False)}


def test_truncated_table_keeps_its_schema(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(5).write.parquet(path)
    stored.truncate(spark, path)
    assert spark.read.parquet(path).count() == 0 and spark.read.parquet(path).columns == ["id"]
