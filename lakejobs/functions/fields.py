"""Text, number and date expressions for raw lake fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def as_col(value: ColumnOrName) -> Column:
    return F.col(value) if isinstance(value, str) else value


def packed_field(col: ColumnOrName, index: int, sep: str = ",") -> Column:
    """The ``index``-th (from 0) part of a packed text field, NULL when the text is too short."""
    return F.get(F.split(as_col(col), rf"\Q{sep}\E"), index)


def to_double(col: ColumnOrName) -> Column:
    """Text to double; NULL, not an error, when the text is no number."""
    return as_col(col).try_cast("double")


def to_int(col: ColumnOrName) -> Column:
    """Text to int; NULL when it is no number or does not fit."""
    return as_col(col).try_cast("int")


def scaled(col: ColumnOrName, divisor: float) -> Column:
    """A packed number in units of 1/``divisor``."""
    return to_double(col) / divisor


def iso_day(col: ColumnOrName) -> Column:
    """The day part of ISO date-time text, as text."""
    return F.substring_index(as_col(col), "T", 1)


def day_parts(col: ColumnOrName) -> tuple[Column, Column]:
    """The year and month texts of ``Y-m-d`` text."""
    parts = F.split(as_col(col), "-")
    return F.get(parts, 0), F.get(parts, 1)


def human_date(col: ColumnOrName) -> Column:
    """``2020-01-13`` as ``January 13, 2020``; NULL when the text is no date."""
    return F.date_format(as_col(col).try_cast("date"), "MMMM dd, yyyy")


def day_number_to_date(col: ColumnOrName) -> Column:
    """Days since 1970-01-01 as a date; NULL when the number does not fit."""
    return F.date_from_unix_date(as_col(col).try_cast("int"))


def title_prefix(col: ColumnOrName, length: int) -> Column:
    """The first ``length`` characters."""
    return as_col(col).substr(1, length)


def contains_any(col: ColumnOrName, words: list[str] | tuple[str, ...]) -> Column:
    """True when the lower-cased text contains one of ``words``."""
    lowered = F.lower(as_col(col))
    found = F.lit(False)
    for word in words:
        found = found | lowered.contains(word.lower())
    return found


def text_id(col: ColumnOrName) -> Column:
    """A non-negative bigint made from Spark's 32-bit hash of the text.

    Two texts can share an id; ``recommend.dense_ids`` gives ids that never collide.
    """
    return F.abs(F.hash(as_col(col)).cast("bigint"))
