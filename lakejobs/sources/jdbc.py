"""Tables of a relational database."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def jdbc_options(
    url: str,
    table: str,
    driver: str,
    user: str | None = None,
    password: str | None = None,
    column: str | None = None,
    bounds: tuple[object, object] | None = None,
    partitions: int | None = None,
    fetch_size: int = 10_000,
) -> dict[str, str]:
    """Reader options. With ``column``, ``bounds`` and ``partitions`` the table is read by that
    many tasks, each asking for one range of the column; the bounds only place the ranges,
    rows outside them are read by the first and last task. Without them one task reads all.
    """
    options = {"url": url, "dbtable": table, "driver": driver, "fetchsize": str(fetch_size)}
    if user is not None:
        options["user"] = user
    if password is not None:
        options["password"] = password
    split = (column, bounds, partitions)
    if any(part is not None for part in split):
        if any(part is None for part in split):
            raise ValueError("give column, bounds and partitions together")
        options |= {
            "partitionColumn": column,
            "lowerBound": str(bounds[0]),
            "upperBound": str(bounds[1]),
            "numPartitions": str(partitions),
        }
    return options


def read_jdbc(spark: SparkSession, url: str, table: str, driver: str, **kwargs: object) -> DataFrame:
    """A database table or parenthesised query; see ``jdbc_options`` for a parallel read."""
    return spark.read.format("jdbc").options(**jdbc_options(url, table, driver, **kwargs)).load()
