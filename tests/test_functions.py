import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skytrace.functions import geo, text
from skytrace.operators import listing


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_distances(spark):
    at = [F.lit(x) for x in (0, 0, 0, 100_000)]
    assert one(spark, geo.haversine_m(*at)) == pytest.approx(111_194.93, abs=0.01)
    assert one(spark, geo.flat_distance_m(*at)) == pytest.approx(111_194.93, abs=0.01)
    assert one(spark, geo.fcc_distance_km(*at)) == pytest.approx(111.3207, abs=1e-3)
    assert one(spark, geo.leg_m(*at)) == 111_195
    assert one(spark, geo.segment_distance_m(*[F.lit(float(x)) for x in (3, 4, 0, 0, 0, 0)])) == 5
    assert one(spark, geo.segment_distance_m(*[F.lit(float(x)) for x in (5, 2, 0, 0, 10, 0)])) == 2


def test_tiles(spark):
    assert one(spark, geo.tile_index(F.lit(0.5), F.lit(3))) == 4
    assert one(spark, geo.tile_index(F.lit(0.5), F.lit(3), upper=True)) == 3
    assert one(spark, geo.tile_index(F.lit(1.0), F.lit(3))) == 7
    assert one(spark, geo.mercator_lat(geo.mercator_y(F.lit(46.5)))) == pytest.approx(46.5)
    assert one(spark, geo.mercator_y(F.lit(89.9))) == pytest.approx(0, abs=1e-9)
    assert one(spark, geo.to_e5(F.lit(-0.000005))) == -1


def test_text(spark):
    for raw, want in (("  Ünïcode — Glider!", "unicode-glider"), ("---", ""), ("Ångström 5 S", "angstrom-5-s"), ("éa", "ea")):
        assert one(spark, text.slug(F.lit(raw))) == want
    assert one(spark, text.flag(F.lit("SI"))) == "🇸🇮"
    assert one(spark, text.country(F.lit(" si "))) == "SI" and one(spark, text.country(F.lit("sio"))) is None
    assert one(spark, text.sex(F.lit("Diverse"))) == "d" and one(spark, text.sex(F.lit("?"))) is None
    assert one(spark, text.distance_text(F.lit(950.4))) == "950 m" and one(spark, text.distance_text(F.lit(1234.0))) == "1.2 km"
    assert one(spark, text.duration_text(F.lit(12_790))) == "03:33"
    assert one(spark, text.signed(F.lit(-5.24), 1)) == "−5.2"
    assert one(spark, text.model_name(F.lit("Bi ¶tandem"))) == ("Bi", True)
    assert one(spark, text.preference(F.lit("system"), F.lit(None).cast("string"), "metric")) == "metric"
    assert one(spark, text.converted(F.lit(10.0), "ft", "m")) == pytest.approx(3.048)


@given(st.integers(0, 2**32 - 1), st.text(max_size=40))
def test_cursor_round_trip(at, key):
    assert listing.decode_cursor(listing.encode_cursor(at, key)) == (at, key)


@pytest.mark.parametrize("bad", ["", "!", "AAAA", "AAAAAAU", "AAAAAAEAAAA"])
def test_malformed_cursor(bad):
    with pytest.raises(ValueError):
        listing.decode_cursor(bad)


def test_pages_over_ties(spark):
    rows = spark.createDataFrame([(i // 7, i) for i in range(40)], "at long, id long")
    keys, seen, cursor = [("at", True), ("id", True)], [], None
    while True:
        page = listing.with_more(listing.page(rows, keys, 6, cursor), keys, 6).orderBy(F.desc("at"), F.desc("id")).collect()
        seen += [r.id for r in page]
        if not page[-1].has_more:
            break
        cursor = [page[-1]["at"], page[-1].id]
    assert seen == list(range(39, -1, -1))
    with pytest.raises(ValueError):
        listing.page(rows, keys, 0)


def test_sign_of_what_rounds_to_nothing(spark):
    """The sign is that of the number, also where its digits are all 0, or of another."""
    assert one(spark, text.signed(F.lit(0.04), 1)) == "+0.0" and one(spark, text.signed(F.lit(-0.04), 1)) == "−0.0" and one(spark, text.signed(F.lit(0.0), 1)) == "0.0"
    assert one(spark, text.signed(F.lit(0.0), 1, F.lit(-1))) == "−0.0"


def test_thousands_are_not_parted(spark):
    """Also where rounding makes the thousand."""
    assert one(spark, text.signed(F.lit(999.95), 1)) == "+1000.0" and one(spark, text.signed(F.lit(-1234567.89), 1)) == "−1234567.9"
    assert one(spark, text.distance_text(F.lit(1_234_500.0))) == "1234.5 km"
