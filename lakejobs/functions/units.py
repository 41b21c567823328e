"""Unit conversions, longitudes and value bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lakejobs.functions.fields import ColumnOrName, as_col


def kelvin_to_fahrenheit(col: ColumnOrName) -> Column:
    return (as_col(col) - 273.15) * 9 / 5 + 32.0


def pa_to_hpa(col: ColumnOrName) -> Column:
    return as_col(col) * 0.01


def longitude_180(col: ColumnOrName) -> Column:
    """A longitude counted 0..360 as one in -180..180."""
    lon = as_col(col)
    return F.when(lon > 180, lon - 360).otherwise(lon)


def band(col: ColumnOrName, first: float, step: float, bands: int) -> Column:
    """The band number 0..bands-1 of a value, NULL outside of all bands.

    A band holds its lower level but not its upper one; the top level is in the last band.
    """
    value = as_col(col)
    top = first + step * bands
    number = F.least(F.floor((value - first) / step), F.lit(bands - 1)).cast("int")
    return F.when((value >= first) & (value <= top), number)
