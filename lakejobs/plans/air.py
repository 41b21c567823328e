"""Latest air-quality reading per station, located in a region and averaged per region."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakejobs import constants as K
from lakejobs.operators.readings import attach_attributes, avg_per_region, latest_by_place, latest_per, with_latest
from lakejobs.operators.spatial import locate_in_cells
from lakejobs.plans import stored, views
from lakejobs.sources.files import read_json_day
from lakejobs.sources.polygons import read_polygons

JSON_DAY = "2024-01-15"


def wanted(readings: DataFrame, *more: str) -> DataFrame:
    """Readings of the country and measure of interest."""
    chosen = (F.col("parameter") == K.AIR_PARAMETER) & (F.col("country") == K.AIR_COUNTRY)
    return readings.where(chosen).select("location", "value", "date", "coordinates", *more)


def utc() -> Column:
    """The UTC text of a reading as a timestamp; text that is none sorts first, as NULL."""
    return F.col("date.utc").try_cast("timestamp")


def latest_values(readings: DataFrame, tie: str | None = None) -> DataFrame:
    """Distinct (lon, lat, last_value) of the wanted stations."""
    flat = wanted(readings, *([tie] if tie else [])).withColumns(
        {"lon": F.col("coordinates.longitude"), "lat": F.col("coordinates.latitude")}
    )
    return latest_by_place(flat, "location", ["lon", "lat"], "value", utc(), tie)


def region_averages(readings: DataFrame, cells: DataFrame, cell_size: float, tie: str | None = None) -> DataFrame:
    """(geoid, avg_value) with a NULL group for stations in no region."""
    located = locate_in_cells(latest_values(readings, tie), cells, "lon", "lat", "geoid", cell_size)
    return avg_per_region(located, "geoid", "last_value")


def latest_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_per(wanted(views.readings(spark, sf_dir), "event_id"), ["location"], "value", utc(), "event_id")


def reading_with_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every wanted reading beside the latest value of its station."""
    readings = wanted(views.readings(spark, sf_dir), "event_id")
    return with_latest(readings, "location", "value", utc(), "event_id").select(
        "event_id", "location", "value", "last_value"
    )


def latest_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_values(views.readings(spark, sf_dir), "event_id")


def latest_json_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest reading per station from the JSON lines of one dated folder."""

    def write(path: str) -> None:
        # One folder per day, named by the day alone as feeds do it.
        days = views.readings(spark, sf_dir).hint("rebalance", "day")
        days.write.partitionBy("day").json(path, compression="gzip")

    root = stored.once(spark, sf_dir, "readings_json", write)
    day = read_json_day(spark, root, f"day={JSON_DAY}", views.READINGS_SCHEMA)
    return latest_per(wanted(day, "event_id"), ["location"], "value", utc(), "event_id")


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(stored.region_cells(spark, sf_dir))


def points_in_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = views.order_places(spark, sf_dir)
    return locate_in_cells(places, _cells(spark, sf_dir), "lon", "lat", "geoid", stored.CELL)


def points_in_regions_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same lookup in the form for regions too large to be broadcast."""
    places = views.order_places(spark, sf_dir)
    return locate_in_cells(places, _cells(spark, sf_dir), "lon", "lat", "geoid", stored.CELL, broadcast_weight=0)


def region_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    averages = region_averages(views.readings(spark, sf_dir), _cells(spark, sf_dir), stored.CELL, "event_id")
    return averages.withColumn("avg_value", F.round("avg_value", 6))


def region_avg_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    attributes = read_polygons(spark, stored.regions(spark, sf_dir), ["geoid", "name", "stusps"]).drop("ord", "rings")
    return attach_attributes(region_avg(spark, sf_dir), attributes, "geoid", "stusps", K.EXCLUDED_STATES)


QUERIES = {
    "latest_reading": latest_reading,
    "reading_with_latest": reading_with_latest,
    "latest_distinct": latest_distinct,
    "latest_json_day": latest_json_day,
    "points_in_regions": points_in_regions,
    "points_in_regions_shuffled": points_in_regions_shuffled,
    "region_avg": region_avg,
    "region_avg_attributes": region_avg_attributes,
}

_LATEST_SQL = """
wanted AS (SELECT * FROM readings WHERE country = 'US' AND parameter = 'pm25'),
latest AS (
    SELECT location, value AS last_value
    FROM (SELECT *, row_number() OVER (PARTITION BY location ORDER BY ts DESC, event_id DESC) AS place FROM wanted)
    WHERE place = 1
),
latest_places AS (
    SELECT DISTINCT lon, lat, last_value FROM wanted JOIN latest USING (location)
)"""

_REGION_AVG_SQL = f"""
WITH {views.READINGS_SQL}, {_LATEST_SQL}, {views.REGIONS_SQL},
place AS (SELECT DISTINCT lon, lat FROM latest_places),
{views.LOCATED_SQL},
averages AS (
    SELECT geoid, round(avg(last_value), 6) AS avg_value
    FROM latest_places LEFT JOIN located USING (lon, lat) GROUP BY 1
)
"""

_IN_REGIONS_SQL = f"""
WITH {views.ORDER_PLACES_SQL}, {views.REGIONS_SQL},
place AS (SELECT DISTINCT lon, lat FROM order_places),
{views.LOCATED_SQL}
SELECT o_orderkey, lon, lat, geoid FROM order_places LEFT JOIN located USING (lon, lat)
"""

_AREAS = ", ".join(f"'{a}'" for a in views.AREAS)
_EXCLUDED = ", ".join(f"'{a}'" for a in K.EXCLUDED_STATES)

SQL = {
    "latest_reading": f"WITH {views.READINGS_SQL}, {_LATEST_SQL} SELECT * FROM latest",
    "reading_with_latest": f"""
        WITH {views.READINGS_SQL}, {_LATEST_SQL}
        SELECT event_id, location, value, last_value FROM wanted JOIN latest USING (location)
    """,
    "latest_distinct": f"WITH {views.READINGS_SQL}, {_LATEST_SQL} SELECT * FROM latest_places",
    "latest_json_day": f"""
        WITH all_{views.READINGS_SQL.strip()},
        readings AS (SELECT * FROM all_readings WHERE CAST(ts AS DATE) = DATE '{JSON_DAY}'),
        {_LATEST_SQL} SELECT * FROM latest
    """,
    "points_in_regions": _IN_REGIONS_SQL,
    "points_in_regions_shuffled": _IN_REGIONS_SQL,
    "region_avg": f"{_REGION_AVG_SQL} SELECT * FROM averages",
    "region_avg_attributes": f"""
        {_REGION_AVG_SQL}
        SELECT geoid, avg_value, n_name AS name, (ARRAY[{_AREAS}])[n_regionkey + 1] AS stusps
        FROM averages JOIN nation ON geoid = CAST(n_nationkey AS VARCHAR)
        WHERE (ARRAY[{_AREAS}])[n_regionkey + 1] NOT IN ({_EXCLUDED})
    """,
}
