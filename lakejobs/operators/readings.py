"""Station readings: daily maxima, latest reading per station, averages per region."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakejobs import constants as K
from lakejobs.functions.fields import as_col, iso_day, packed_field, scaled, to_double
from lakejobs.operators.filters import drop_sentinel, in_box, not_in
from lakejobs.operators.skew import BROADCAST_WEIGHT, join_one_per_key, store


def wind_readings(df: DataFrame, bbox: tuple[float, float, float, float], text_sentinel: bool = True) -> DataFrame:
    """(ymd, NAME, wind_speed) of the stations in the box that report a wind speed.

    The missing mark is dropped as packed text or, with ``text_sentinel=False``, as the
    number it becomes; for four-digit speeds both keep the same rows.
    """
    speed = packed_field("WND", K.WIND_SPEED_INDEX)
    boxed = in_box(df, to_double("LONGITUDE"), to_double("LATITUDE"), bbox)
    if text_sentinel:
        boxed = drop_sentinel(boxed, speed, K.WIND_MISSING_TEXT)
    readings = boxed.select(
        iso_day("DATE").alias("ymd"), "NAME", scaled(speed, K.WIND_SPEED_DIVISOR).alias("wind_speed")
    )
    return readings if text_sentinel else drop_sentinel(readings, "wind_speed", K.WIND_MISSING_NUMBER)


def daily_max(df: DataFrame, day: str, value: str, name: str) -> DataFrame:
    return df.groupBy(day).agg(F.max(value).alias(name))


def latest_per(
    df: DataFrame,
    keys: list[str],
    value: str,
    time: Column | str,
    tie: Column | str | None = None,
    name: str = "last_value",
) -> DataFrame:
    """One row per key: the value at the latest time, NULL when that reading is NULL.

    Partial aggregates run before the shuffle, so a station with a third of all rows sends
    one row per task. Among equal times the largest ``tie`` wins. Give ``time`` as a timestamp
    rather than text: it compares faster. A reading whose time is NULL comes before all others,
    but counts where there is no other.
    """
    order = F.struct(as_col(time).alias("time"), *([] if tie is None else [as_col(tie).alias("tie")]))
    return df.groupBy(*keys).agg(F.max_by(value, order).alias(name))


def with_latest(
    df: DataFrame,
    key: str,
    value: str,
    time: Column | str,
    tie: Column | str | None = None,
    name: str = "last_value",
    limit: int = BROADCAST_WEIGHT,
) -> DataFrame:
    """Every row with the latest value of its key beside it.

    Equal to ``last(value)`` over a window of all rows of the key, but no task holds them all:
    the latest values, one row per key, are aggregated and joined back.
    """
    latest = latest_per(df, [key], value, time, tie, name).withColumnRenamed(key, "_key")
    return join_one_per_key(df, latest, key, "_key", limit=limit)


def latest_by_place(
    df: DataFrame,
    station: str,
    place: list[str],
    value: str,
    time: Column | str,
    tie: Column | str | None = None,
    limit: int = BROADCAST_WEIGHT,
) -> DataFrame:
    """Distinct (place, latest value of the station) rows.

    A station may report from several places, and each of them gets the station's latest
    value. The rows are read once and aggregated to one row per station and place, which is
    stored; the latest per station comes from there. Among equal times the largest ``tie``
    wins, then the largest value.
    """
    order = [as_col(time).alias("time")] + ([] if tie is None else [as_col(tie).alias("tie")])
    reading = F.struct(*order, F.col(value).alias("value"))
    per_place = store(df.groupBy(station, *place).agg(F.max(reading).alias("_here")))
    per_station = per_place.groupBy(F.col(station).alias("_station")).agg(F.max("_here").alias("_latest"))
    joined = join_one_per_key(per_place.drop("_here"), per_station, station, "_station", limit=limit)
    return joined.select(*place, F.col("_latest.value").alias("last_value")).distinct()


def avg_per_region(df: DataFrame, region: str, value: str, name: str = "avg_value") -> DataFrame:
    """Average per region; rows in no region form the NULL group."""
    return df.groupBy(region).agg(F.avg(value).alias(name))


def attach_attributes(df: DataFrame, attributes: DataFrame, key: str, area: str, excluded: list | tuple) -> DataFrame:
    """Adds region attributes, leaving out regions of the ``excluded`` areas and the NULL group."""
    return attributes.where(not_in(area, excluded)).join(df, key, "inner")
