"""Daily top wind speed in a box."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakejobs import constants as K
from lakejobs.functions.fields import day_number_to_date, day_parts, human_date
from lakejobs.operators.readings import daily_max, wind_readings
from lakejobs.plans import stored, views
from lakejobs.sinks.files import write_csv_n
from lakejobs.sources.files import read_delimited

# The contiguous states, where the test stations are; the job's own default is a city.
BBOX = (-124.86, 24.62, -66.96, 49.16)


def top_days(stations: DataFrame, bbox: tuple[float, float, float, float] = K.DEFAULT_BBOX) -> DataFrame:
    """(ymd, max_wind_speed), windiest day first."""
    daily = daily_max(wind_readings(stations, bbox), "ymd", "wind_speed", "max_wind_speed")
    return daily.orderBy(F.desc("max_wind_speed"), "ymd")


def daily_max_wind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_days(views.weather(spark, sf_dir), BBOX)


def daily_max_wind_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    readings = wind_readings(views.weather(spark, sf_dir), BBOX, text_sentinel=False)
    return daily_max(readings, "ymd", "wind_speed", "max_wind_speed").orderBy("ymd")


def daily_max_wind_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same job from a directory of CSV files, read with a declared text schema."""
    path = stored.once(
        spark,
        sf_dir,
        "weather_csv",
        lambda out: write_csv_n(views.weather(spark, sf_dir), out, header=True),
    )
    return top_days(read_delimited(spark, path, views.WEATHER_SCHEMA, sep=","), BBOX)


def human_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders per month with the day text in words, and its year and month parts."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    days = views.table(spark, sf_dir, "orders").groupBy(day.alias("ymd")).agg(F.count("*").alias("n"))
    year, month = day_parts("ymd")
    return days.select("ymd", human_date("ymd").alias("human"), year.alias("year"), month.alias("month"), "n")


def day_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days kept as numbers since 1970, turned into dates."""
    number = F.unix_date(F.to_date("l_shipdate")).cast("bigint")
    days = views.table(spark, sf_dir, "lineitem").groupBy(number.alias("day_number")).agg(F.count("*").alias("n"))
    return days.select("day_number", day_number_to_date("day_number").alias("day"), "n")


QUERIES = {
    "daily_max_wind": daily_max_wind,
    "daily_max_wind_by_day": daily_max_wind_by_day,
    "daily_max_wind_csv": daily_max_wind_csv,
    "human_dates": human_dates,
    "day_numbers": day_numbers,
}

_TOP_DAYS_SQL = f"""
WITH {views.WEATHER_SQL}
SELECT split_part("DATE", 'T', 1) AS ymd, max(CAST(packed AS DOUBLE) / 10) AS max_wind_speed
FROM weather
WHERE packed <> '9999' AND lat BETWEEN 24.62 AND 49.16 AND lon BETWEEN -124.86 AND -66.96
GROUP BY 1 ORDER BY 2 DESC, 1
"""

SQL = {
    "daily_max_wind": _TOP_DAYS_SQL,
    "daily_max_wind_by_day": _TOP_DAYS_SQL,
    "daily_max_wind_csv": _TOP_DAYS_SQL,
    "human_dates": """
        SELECT strftime(o_orderdate, '%Y-%m-%d') AS ymd, strftime(o_orderdate, '%B %d, %Y') AS human,
               strftime(o_orderdate, '%Y') AS year, strftime(o_orderdate, '%m') AS month, count(*) AS n
        FROM orders GROUP BY 1, 2, 3, 4
    """,
    "day_numbers": """
        SELECT date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS day_number,
               CAST(l_shipdate AS DATE) AS day, count(*) AS n
        FROM lineitem GROUP BY 1, 2
    """,
}
