"""Delimited text, JSON lines and Parquet directories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType


def read_delimited(
    spark: SparkSession,
    path: str | list[str],
    schema: str | StructType | None = None,
    sep: str = "\t",
    header: bool = True,
) -> DataFrame:
    """Delimited text with optional quotes: files or directories of them, gz included.

    Without a ``schema`` the header names the columns and all of them are strings; only the
    header line is read ahead. With one, fields are typed without a pass over the data, and a
    value that does not fit, or is missing from a short line, is NULL.
    """
    reader = spark.read.option("sep", sep).option("header", header).option("mode", "PERMISSIVE")
    if schema is not None:
        reader = reader.schema(schema)
    return reader.csv(path)


def read_escaped(
    spark: SparkSession,
    path: str | list[str],
    schema: str | StructType,
    sep: str = "\t",
    skip_header: bool = True,
    null_text: str = "\\N",
) -> DataFrame:
    """Text tables without quotes, in which a backslash escapes a separator.

    Every line is a row. Fields are cast to ``schema``; one that does not fit, or is missing
    from a short line, is NULL. ``skip_header`` drops the first line of a file if it holds the column
    names, in letters of either case; the same line further down is a row.
    """
    fields = as_struct(spark, schema).fields
    lines = spark.read.option("lineSep", "\n").text(path)
    if skip_header:
        lines = without_header(lines, sep.join(f.name for f in fields))
    # A mark and a letter stand for the mark itself, an escaped backslash and an escaped separator.
    mark = "\u0001" if sep != "\u0001" else "\u0002"
    stands_for = ((mark, mark + "a"), ("\\\\", mark + "b"), ("\\" + sep, mark + "c"))
    marked = F.col("value")
    for raw, stand in stands_for:
        marked = F.replace(marked, F.lit(raw), F.lit(stand))
    parts = F.split(marked, rf"\Q{sep}\E")

    def field(i: int, type_: DataType) -> Column:
        part = F.get(parts, i)
        text = F.replace(F.replace(part, F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r"))
        for value, stand in ((sep, mark + "c"), ("\\", mark + "b"), (mark, mark + "a")):
            text = F.replace(text, F.lit(stand), F.lit(value))
        return F.when(part != null_text, text).try_cast(type_)

    return lines.select(*[field(i, f.dataType).alias(f.name) for i, f in enumerate(fields)])


def without_header(lines: DataFrame, header: str) -> DataFrame:
    """The lines of a text scan without the first one of each file where that is the ``header``, in either case.

    Only lines that look like the header need a place. They are counted by file and text, beside
    the place of the first line in the file's first block, and come back as often as they were
    found, the first line of the file left out. All other lines pass by as they are read.
    """
    alike = F.when(F.lower("value") == header.lower(), F.col("value"))
    # Inside a block the numbers of rows rise, whatever the task; only blocks at the start of a file matter.
    place = F.when(F.col("_metadata.file_block_start") == 0, F.monotonically_increasing_id())
    told = lines.select(alike.alias("value"), F.col("_metadata.file_path").alias("file"), place.alias("place"))
    counted = told.groupBy("file", "value").agg(F.count("*").alias("n"), F.min("place").alias("place"))
    first = F.min("place").over(Window.partitionBy("file"))
    headers = counted.withColumn("first", F.coalesce(F.col("place") == first, F.lit(False))).where(F.col("value").isNotNull())
    rows = headers.select("value", (F.col("n") - F.col("first").cast("int")).alias("n")).where("n > 0")
    repeated = rows.select("value", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).select("value")
    return lines.where(F.lower("value") != header.lower()).unionByName(repeated)


def as_struct(spark: SparkSession, schema: str | StructType) -> StructType:
    return schema if isinstance(schema, StructType) else StructType.fromDDL(schema)


def read_leading(spark: SparkSession, path: str, fields: dict[str, str], sep: str = ",", header: bool = False) -> DataFrame:
    """The first ``len(fields)`` columns of delimited text, named and typed by ``fields``.

    The schema holds the leading columns only, so the parser skips the rest of each line.
    """
    schema = ", ".join(f"`{name}` {type_}" for name, type_ in fields.items())
    return spark.read.option("sep", sep).option("header", header).schema(schema).csv(path)


def read_partitioned(
    spark: SparkSession,
    root: str,
    partition: str | None = None,
    keep_partition: bool = False,
    schema: str | StructType | None = None,
) -> DataFrame:
    """A Parquet directory with ``column=value`` folders, or one of its folders.

    A folder read by itself lacks the partition column; ``keep_partition`` keeps it.
    """
    reader = spark.read if schema is None else spark.read.schema(schema)
    root = root.rstrip("/")
    if partition is None:
        return reader.parquet(root)
    if keep_partition:
        reader = reader.option("basePath", root)
    return reader.parquet(f"{root}/{partition}")


def read_json_day(spark: SparkSession, root: str, day: str, schema: str | StructType | None = None) -> DataFrame:
    """JSON lines (gz or plain) under ``root/day/``; give a schema to save the inference pass."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(f"{root.rstrip('/')}/{day}/")


def with_path(df: DataFrame, name: str = "path") -> DataFrame:
    """Adds the path of the file each row comes from. ``df`` must be a file scan."""
    return df.withColumn(name, F.col("_metadata.file_path"))


def read_path_like(df: DataFrame, pattern: str) -> DataFrame:
    """Rows from files whose path matches a LIKE pattern; other files are not opened."""
    return df.where(F.col("_metadata.file_path").like(pattern))
