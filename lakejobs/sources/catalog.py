"""Catalog listings, schemas as rows, and SQL text over named views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StructType, TimestampNTZType, TimestampType


def databases(spark: SparkSession) -> DataFrame:
    return spark.sql("SHOW DATABASES")


def tables(spark: SparkSession, database: str) -> DataFrame:
    return spark.sql(f"SHOW TABLES FROM `{database}`")


def stored_tables(spark: SparkSession, folder: str) -> dict[str, str]:
    """Name and path of each Parquet table, a file or a folder, that a folder holds now; any file system Spark reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).listStatus(path)
    paths = [str(status.getPath().toString()) for status in found]
    names = {p.rstrip("/").rsplit("/", 1)[-1]: p for p in paths}
    return {n.removesuffix(".parquet"): p for n, p in sorted(names.items()) if n.endswith(".parquet")}


def table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def run_sql(spark: SparkSession, text: str, **views: DataFrame) -> DataFrame:
    """SQL text in which ``{name}`` stands for the DataFrame passed under that name."""
    return spark.sql(text, **views)


def describe(df: DataFrame) -> DataFrame:
    """The schema as rows of (position, name, type, nullable)."""
    rows = [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position int, name string, type string, nullable boolean")


def time_column(schema: StructType, standard_name: str = "time") -> str:
    """The name of the time column: the one whose metadata says so, else the first timestamp or date."""
    for field in schema.fields:
        if (field.metadata or {}).get("standard_name") == standard_name:
            return field.name
    for field in schema.fields:
        if isinstance(field.dataType, (TimestampType, TimestampNTZType, DateType)):
            return field.name
    raise ValueError("no time column in the schema")


def mark_time_column(df: DataFrame, name: str, standard_name: str = "time") -> DataFrame:
    """Says in the column's metadata that it is the time dimension; Parquet keeps this."""
    return df.withMetadata(name, {"standard_name": standard_name})


def literal_rows(spark: SparkSession, rows: list[tuple], schema: str | StructType) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def newest_rows(df: DataFrame, column: str, extra=None) -> DataFrame:
    """Rows whose ``column`` equals its largest value in the whole table.

    The largest value is a scalar subquery, so on a partition column only the newest
    folder is scanned for rows. ``extra`` is a further condition on the rows.
    """
    newest = df.agg(F.max(column).alias("newest")).scalar()
    kept = df.where(F.col(column) == newest)
    return kept if extra is None else kept.where(extra)
