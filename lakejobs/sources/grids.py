"""Grid tables: one row per time step, its cells in an array.

Folders: ``measure=M/year=Y/month=MM``. Columns: a time column, whose name may differ between
measures, and ``values array<...>`` in row order (latitude first, then longitude).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from lakejobs.operators.grid import day_slice
from lakejobs.sources.catalog import time_column
from lakejobs.sources.files import read_partitioned


def read_grid_day(
    spark: SparkSession,
    path: str,
    day: str,
    measures: list[str] | tuple[str, ...],
    time_name: str = "time",
) -> DataFrame:
    """The steps of one day (``Y-m-d``) for the given measures.

    Only the folder of that month is listed and read for each measure. The time column is
    found by its metadata, whatever its name, and returned as ``time_name``.
    """
    year, month, _ = day.split("-")

    def steps(measure: str) -> DataFrame:
        grid = read_partitioned(spark, path, f"measure={measure}/year={year}/month={month}", keep_partition=True)
        found = time_column(grid.schema)
        return day_slice(grid, found, day).withColumnRenamed(found, time_name)

    return reduce(DataFrame.unionByName, [steps(m) for m in measures])
