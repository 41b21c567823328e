"""Row filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakejobs.functions.fields import ColumnOrName, as_col
from lakejobs.functions.units import longitude_180


def drop_sentinel(df: DataFrame, value: ColumnOrName, missing: object) -> DataFrame:
    """Drops rows whose value is the mark for missing, and rows where it is NULL."""
    return df.where(as_col(value) != F.lit(missing))


def in_box(
    df: DataFrame,
    lon: ColumnOrName,
    lat: ColumnOrName,
    bbox: tuple[float, float, float, float],
    lon_360: bool = False,
) -> DataFrame:
    """Rows inside ``(left, bottom, right, top)``, bounds included.

    With ``lon_360`` the longitudes of both the data and the box count 0..360; both are
    turned to -180..180 first, and a box that then crosses the date line is honoured. A box
    360 wide or wider holds every longitude. A coordinate that is NULL or NaN is in no box.
    """
    left, bottom, right, top = bbox
    x, y = as_col(lon), as_col(lat)
    # NaN compares as the largest value, so it would be right of any left bound.
    df = df.where(~F.isnan(x.cast("double")) & ~F.isnan(y.cast("double")))
    if right - left >= 360:
        return df.where(y.between(bottom, top) & x.isNotNull())
    if lon_360:
        x = longitude_180(x)
        left, right = (v - 360 if v > 180 else v for v in (left, right))
    inside = x.between(left, right) if left <= right else (x >= left) | (x <= right)
    return df.where(y.between(bottom, top) & inside)


def not_in(col: ColumnOrName, values: list | tuple) -> Column:
    return ~as_col(col).isin(*values)
