"""Gridded weather: cells, one day, one hour in map units, aligned measures, mesh and bands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakejobs import constants as K
from lakejobs.functions.units import band, kelvin_to_fahrenheit, pa_to_hpa
from lakejobs.operators.filters import in_box
from lakejobs.operators.grid import align, align_chunks, band_counts, explode_chunks, explode_grid, mesh, nth_step
from lakejobs.operators.skew import broadcast_if_small
from lakejobs.plans import stored, views
from lakejobs.sources.grids import read_grid_day

PRESSURE, TEMPERATURE, PRECIPITATION = K.GRID_MEASURES
NAMES = {PRESSURE: "pressure", TEMPERATURE: "temperature", PRECIPITATION: "precipitation"}


def weather_map(steps: DataFrame, nlon: int, step: int = K.GRID_STEP_OF_DAY) -> DataFrame:
    """(time, lat_i, lon_i, pressure_hpa, temperature_f, precipitation) at one step of a day."""
    hour = align(nth_step(steps, step), NAMES, "values", nlon)
    return hour.select(
        "time",
        "lat_i",
        "lon_i",
        pa_to_hpa("pressure").alias("pressure_hpa"),
        kelvin_to_fahrenheit("temperature").alias("temperature_f"),
        "precipitation",
    )


def grid_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explode_grid(views.grid(spark, sf_dir), "values", views.GRID_NLON)


def grid_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All cells of the default day, from the stored grid's folder of that month."""
    day = read_grid_day(spark, stored.grid_store(spark, sf_dir), K.DEFAULT_WEATHER_DAY, K.GRID_MEASURES)
    return explode_grid(day.select("measure", "time", "values"), "values", views.GRID_NLON)


def grid_noon_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = read_grid_day(spark, stored.grid_store(spark, sf_dir), K.DEFAULT_WEATHER_DAY, K.GRID_MEASURES)
    hour = weather_map(day, views.GRID_NLON)
    return hour.withColumns({c: F.round(c, 6) for c in ("pressure_hpa", "temperature_f", "precipitation")})


def grid_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(views.grid(spark, sf_dir), NAMES, "values", views.GRID_NLON)


def grid_chunk_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All cells out of the grid that is stored in chunks."""
    return explode_chunks(spark.read.parquet(stored.grid_chunks(spark, sf_dir)), "values")


def grid_chunks_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_chunks(spark.read.parquet(stored.grid_chunks(spark, sf_dir)), NAMES, "values")


def grid_mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average of each measure at the mesh points inside the map box, longitudes counted 0..360."""
    grid = views.grid(spark, sf_dir)
    axes = grid.select("measure").distinct().select(
        "measure",
        F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: 60.0 - i * 6).alias("lats"),
        F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: 220.0 + i * 12).alias("lons"),
    )
    box = in_box(mesh(axes), "lon", "lat", K.MAP_BBOX_360, lon_360=True)
    cells = explode_grid(grid, "values", views.GRID_NLON).drop("time")
    means = cells.groupBy("measure", "lat_i", "lon_i").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    joined = means.join(broadcast_if_small(box), ["measure", "lat_i", "lon_i"], "inner")
    return joined.select("measure", "lat", "lon", "n", F.round("mean", 6).alias("mean"))


def grid_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells per temperature band (°F) and per pressure band (hPa), over all steps."""
    cells = explode_grid(views.grid(spark, sf_dir), "values", views.GRID_NLON)
    measure = F.col("measure")
    bands = F.when(
        measure == TEMPERATURE, band(kelvin_to_fahrenheit("value"), *K.TEMPERATURE_LEVELS)
    ).when(measure == PRESSURE, band(pa_to_hpa("value"), *K.PRESSURE_LEVELS))
    return band_counts(cells.where(measure.isin(TEMPERATURE, PRESSURE)), bands, ["measure"])


QUERIES = {
    "grid_cells": grid_cells,
    "grid_day": grid_day,
    "grid_noon_units": grid_noon_units,
    "grid_aligned": grid_aligned,
    "grid_chunk_cells": grid_chunk_cells,
    "grid_chunks_aligned": grid_chunks_aligned,
    "grid_mesh": grid_mesh,
    "grid_bands": grid_bands,
}

_DAY = K.DEFAULT_WEATHER_DAY
_IN_DAY = f"time BETWEEN TIMESTAMP '{_DAY} 00:00:00' AND TIMESTAMP '{_DAY} 23:59:00'"
_ALIGNED_SQL = f"""
aligned AS (
    SELECT p.time, p.lat_i, p.lon_i, p.value AS pressure, t.value AS temperature, r.value AS precipitation
    FROM (SELECT * FROM grid WHERE measure = '{PRESSURE}') p
    JOIN (SELECT * FROM grid WHERE measure = '{TEMPERATURE}') t USING (time, lat_i, lon_i)
    JOIN (SELECT * FROM grid WHERE measure = '{PRECIPITATION}') r USING (time, lat_i, lon_i)
)"""


def _band_sql(measure: str, value: str, levels: tuple) -> str:
    first, step, bands = levels
    return f"""
    SELECT measure, CAST(least(floor((v - {first}::DOUBLE) / {step}::DOUBLE), {bands - 1}) AS INTEGER) AS band,
           count(*) AS cells
    FROM (SELECT measure, {value} AS v FROM grid WHERE measure = '{measure}')
    WHERE v BETWEEN {first} AND {first + step * bands} GROUP BY 1, 2
    """


SQL = {
    "grid_cells": f"WITH {views.GRID_SQL} SELECT measure, time, lat_i, lon_i, value FROM grid",
    "grid_day": f"WITH {views.GRID_SQL} SELECT measure, time, lat_i, lon_i, value FROM grid WHERE {_IN_DAY}",
    "grid_noon_units": f"""
        WITH {views.GRID_SQL}, {_ALIGNED_SQL},
        steps AS (SELECT DISTINCT time FROM grid WHERE {_IN_DAY} ORDER BY time LIMIT 1 OFFSET {K.GRID_STEP_OF_DAY})
        SELECT time, lat_i, lon_i, round(pressure * 0.01::DOUBLE, 6) AS pressure_hpa,
               round((temperature - 273.15::DOUBLE) * 9 / 5 + 32, 6) AS temperature_f,
               round(precipitation, 6) AS precipitation
        FROM aligned JOIN steps USING (time)
    """,
    "grid_aligned": f"WITH {views.GRID_SQL}, {_ALIGNED_SQL} SELECT * FROM aligned",
    "grid_chunk_cells": f"WITH {views.GRID_SQL} SELECT measure, time, lat_i, lon_i, value FROM grid",
    "grid_chunks_aligned": f"WITH {views.GRID_SQL}, {_ALIGNED_SQL} SELECT * FROM aligned",
    "grid_mesh": f"""
        WITH {views.GRID_SQL},
        placed AS (SELECT measure, 60.0::DOUBLE - lat_i * 6 AS lat, 220.0::DOUBLE + lon_i * 12 AS lon, value FROM grid)
        SELECT measure, lat, lon, count(*) AS n, round(avg(value), 6) AS mean FROM placed
        WHERE lat BETWEEN 20 AND 55 AND lon BETWEEN 230 AND 300 GROUP BY 1, 2, 3
    """,
    "grid_bands": f"WITH {views.GRID_SQL} "
    + _band_sql(TEMPERATURE, "(value - 273.15::DOUBLE) * 9 / 5 + 32", K.TEMPERATURE_LEVELS)
    + " UNION ALL "
    + _band_sql(PRESSURE, "value * 0.01::DOUBLE", K.PRESSURE_LEVELS),
}
