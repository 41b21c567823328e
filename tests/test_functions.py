import pytest
from pyspark.sql import functions as F

from lakejobs import constants as K
from lakejobs.functions import fields, units


def one(spark, expression):
    return spark.range(1).select(expression.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "packed, speed",
    [
        ("200,1,N,0046,1", 4.6),
        ("200,5,N,0041,5", 4.1),
        ("170,5,N,0031,5", 3.1),
        ("190,5,N,0051,5", 5.1),
        ("190,5,N,0036,5", 3.6),
        ("190,5", None),
        ("190,5,N,fast,5", None),
        (None, None),
    ],
)
def test_packed_speed(spark, packed, speed):
    field = fields.packed_field(F.lit(packed).cast("string"), K.WIND_SPEED_INDEX)
    assert one(spark, fields.scaled(field, K.WIND_SPEED_DIVISOR)) == speed


def test_text_to_int_is_null_when_it_does_not_fit(spark):
    assert one(spark, fields.to_int(F.lit("3000000000"))) is None
    assert one(spark, fields.to_int(F.lit("x"))) is None
    assert one(spark, fields.to_int(F.lit("12"))) == 12


def test_dates(spark):
    assert one(spark, fields.iso_day(F.lit("2021-01-01T00:17:00"))) == "2021-01-01"
    assert one(spark, fields.human_date(F.lit("2020-01-13"))) == "January 13, 2020"
    assert str(one(spark, fields.day_number_to_date(F.lit(16678)))) == "2015-08-31"
    year, month = fields.day_parts(F.lit("2020-01-13"))
    assert (one(spark, year), one(spark, month)) == ("2020", "01")


def test_keywords_fold_case(spark):
    texts = spark.createDataFrame([("My BABY",), ("for an Infant",), ("toy",), (None,)], "t string")
    found = [r[0] for r in texts.select(fields.contains_any("t", K.KEYWORDS)).collect()]
    assert found == [True, True, False, None]


def test_text_id_is_never_negative(spark):
    ids = spark.range(2000).select(fields.text_id(F.col("id").cast("string")).alias("i"))
    low, high = ids.agg(F.min("i"), F.max("i")).first()
    assert 0 <= low and high <= 2**31


def test_units(spark):
    assert one(spark, units.kelvin_to_fahrenheit(F.lit(273.15))) == 32.0
    assert one(spark, units.pa_to_hpa(F.lit(101325.0))) == pytest.approx(1013.25)
    assert one(spark, units.longitude_180(F.lit(230.0))) == -130.0


@pytest.mark.parametrize(
    "value, number",
    [(-30.0, 0), (-25.1, 0), (-25.0, 1), (94.9, 24), (95.0, 24), (95.1, None), (-30.1, None)],
)
def test_temperature_bands(spark, value, number):
    assert one(spark, units.band(F.lit(value), *K.TEMPERATURE_LEVELS)) == number


def test_title_prefix_and_rounding(spark):
    assert one(spark, fields.title_prefix(F.lit("x" * 60), K.TITLE_PREFIX)) == "x" * 45
    assert one(spark, F.round(F.lit(4.0625), K.RATING_DIGITS)) == 4.063
