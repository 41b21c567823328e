"""Counts and top-k reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakejobs.functions.fields import title_prefix, to_int


def row_count(df: DataFrame, where: Column | str | None = None, name: str = "n") -> DataFrame:
    rows = df if where is None else df.where(where)
    return rows.agg(F.count("*").alias(name))


def top_counts(df: DataFrame, key: str, k: int, name: str = "n") -> DataFrame:
    """The ``k`` keys with the most rows; equal counts in key order."""
    return df.groupBy(key).agg(F.count("*").alias(name)).orderBy(F.desc(name), key).limit(k)


def top_rated(
    df: DataFrame,
    keys: list[str],
    rating: str,
    k: int,
    count_rows: bool = True,
    avg_name: str = "mean_rating",
    count_name: str = "reviews",
    weight: str | None = None,
) -> DataFrame:
    """The ``k`` groups with the most reviews and their average rating.

    Counts rows, or with ``count_rows=False`` ratings that are not NULL. A row may stand for
    several equal reviews, whose number is in the ``weight`` column.
    """
    stars = F.col(rating)
    number = F.lit(1) if weight is None else F.col(weight)
    rated = F.sum(F.when(stars.isNotNull(), number))
    average = F.avg(stars) if weight is None else F.sum(stars * number) / rated
    counted = F.sum(number) if count_rows else F.coalesce(rated, F.lit(0))
    grouped = df.groupBy(*keys).agg(average.alias(avg_name), counted.alias(count_name))
    return grouped.orderBy(F.desc(count_name), *keys).limit(k)


def readable(df: DataFrame, title: str, rating: str, length: int, digits: int) -> DataFrame:
    """Shortens the title and rounds the rating, for a report that is already small."""
    return df.withColumns({title: title_prefix(title, length), rating: F.round(rating, digits)})


def nested_max(df: DataFrame, keys: dict[str, str], measures: dict[str, str]) -> DataFrame:
    """Largest value of each text measure, read as int, per group of (nested) keys.

    Both arguments map output names to field paths. Sorted by the first measure, largest first.
    """
    grouped = df.groupBy(*[F.col(path).alias(name) for name, path in keys.items()])
    result = grouped.agg(*[F.max(to_int(path)).alias(name) for name, path in measures.items()])
    return result.orderBy(F.desc(next(iter(measures))), *keys)
