"""What the files of a table hold, and which of them a key can be in."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakejobs.sources.files import with_path


def file_counts(df: DataFrame, key: str | None = None, name: str = "n") -> DataFrame:
    """Rows per file, or per file and key. ``df`` must be a file scan, columns added or not."""
    keys = ["path"] if key is None else ["path", key]
    return with_path(df).groupBy(*keys).agg(F.count("*").alias(name))


def _typed_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per file with rows, smallest and largest value and NULLs of each column, in their types."""
    aggregates = [F.count("*").alias("_rows")]
    for c in columns:
        aggregates += [F.min(c).alias(f"_min_{c}"), F.max(c).alias(f"_max_{c}"), F.count_if(F.col(c).isNull()).alias(f"_nulls_{c}")]
    return with_path(df).groupBy("path").agg(*aggregates)


def _as_rows(stats: DataFrame, columns: list[str], *keys: str) -> DataFrame:
    """One row per column, its values as text."""
    entries = [
        F.struct(
            F.lit(c).alias("column"),
            F.col("_rows").alias("rows"),
            F.col(f"_min_{c}").cast("string").alias("min"),
            F.col(f"_max_{c}").cast("string").alias("max"),
            F.col(f"_nulls_{c}").alias("nulls"),
        )
        for c in columns
    ]
    return stats.select(*keys, F.inline(F.array(*entries)))


def file_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """(path, column, rows, min, max, nulls) for each file and column; values as text."""
    return _as_rows(_typed_stats(df, columns), columns, "path")


def column_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, rows, min, max, nulls) over all files: compared in the column's type, text last."""
    merged = [F.sum("_rows").alias("_rows")]
    for c in columns:
        merged += [F.min(f"_min_{c}").alias(f"_min_{c}"), F.max(f"_max_{c}").alias(f"_max_{c}"), F.sum(f"_nulls_{c}").alias(f"_nulls_{c}")]
    return _as_rows(_typed_stats(df, columns).agg(*merged), columns)


def key_ranges(df: DataFrame, key: str) -> DataFrame:
    """(path, rows, bytes, low, high): size and range of ``key`` of each file."""
    sized = with_path(df).withColumn("size", F.col("_metadata.file_size"))
    return sized.groupBy("path").agg(
        F.count("*").alias("rows"), F.max("size").alias("bytes"), F.min(key).alias("low"), F.max(key).alias("high")
    )


def keep_ranges(spark: SparkSession, path: str, key: str) -> None:
    """Writes the ``key_ranges`` of a table just written beside it, so that later lookups read no data."""
    key_ranges(spark.read.parquet(path), key).write.mode("overwrite").parquet(_kept(path))


def kept_ranges(spark: SparkSession, path: str) -> DataFrame:
    """The ranges that ``keep_ranges`` wrote beside a table."""
    return spark.read.parquet(_kept(path))


def _kept(path: str) -> str:
    return f"{path.rstrip('/')}_ranges"


def files_touched(df: DataFrame, key: str, values: list) -> DataFrame:
    """For each value the number and bytes of the files it can be in, and those of all files."""
    return touched_in(key_ranges(df, key), key, values)


def touched_in(ranges: DataFrame, key: str, values: list) -> DataFrame:
    """``files_touched`` from ``key_ranges``, such as kept ones."""
    aggregates = [F.count("*").alias("files"), F.sum("bytes").alias("bytes")]
    entries = []
    for i, value in enumerate(values):
        inside = F.lit(value).between(F.col("low"), F.col("high"))
        aggregates += [F.count_if(inside).alias(f"_n{i}"), F.sum(F.when(inside, F.col("bytes"))).alias(f"_b{i}")]
        entries.append(
            F.struct(
                F.lit(value).alias(key),
                F.col(f"_n{i}").alias("files_touched"),
                F.coalesce(f"_b{i}", F.lit(0)).alias("bytes_touched"),
            )
        )
    touched = ranges.agg(*aggregates).select("files", "bytes", F.inline(F.array(*entries)))
    return touched.select(key, "files_touched", "bytes_touched", "files", "bytes")


def compare_layouts(ranges: dict[str, DataFrame], key: str, values: list) -> DataFrame:
    """``touched_in`` for the ranges of several layouts of the same rows."""
    named = [touched_in(df, key, values).withColumn("layout", F.lit(name)) for name, df in ranges.items()]
    return reduce(DataFrame.unionByName, named)


def files_per_key(df: DataFrame, key: str) -> DataFrame:
    """(key, rows, files): how many rows a key has, and in how many files they are."""
    pairs = file_counts(df, key, "rows")
    return pairs.groupBy(key).agg(F.sum("rows").alias("rows"), F.count("*").alias("files"))
