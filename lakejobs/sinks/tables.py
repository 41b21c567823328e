"""Catalog tables: create, insert, bucket, preview."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F


def ensure_database(spark: SparkSession, database: str, location: str | None = None) -> None:
    place = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`{place}")


def ensure_table(spark: SparkSession, database: str, table: str, schema: str, location: str | None = None) -> str:
    """Creates the Parquet table if it is missing and returns its qualified name."""
    ensure_database(spark, database)
    name = f"`{database}`.`{table}`"
    place = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet{place}")
    return name


def external_table(spark: SparkSession, name: str, location: str, schema: str | None = None) -> None:
    """Declares a table over an existing Parquet directory."""
    columns = f" ({schema})" if schema else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name}{columns} USING parquet LOCATION '{location}'")


def insert_rows(df: DataFrame, table: str) -> None:
    """Appends the rows to a table, columns by position."""
    df.write.insertInto(table)


def write_bucketed(df: DataFrame, table: str, key: str, n: int, location: str | None = None) -> None:
    """Creates ``table`` in ``n`` hash buckets of ``key``; later joins on it need no shuffle.

    Rows are first rebalanced by bucket, so a bucket takes few files, and one that holds a
    hot key is written by several tasks.
    """
    bucket = F.pmod(F.hash(key), F.lit(n))
    rebalanced = df.withColumn("_bucket", bucket).hint("rebalance", "_bucket").drop("_bucket")
    writer = rebalanced.write.mode("overwrite").format("parquet").bucketBy(n, key)
    if location:
        writer = writer.option("path", location)
    writer.saveAsTable(table)


def write_partitioned_table(df: DataFrame, table: str, columns: list[str], location: str | None = None) -> None:
    """Creates ``table`` with one partition per value of ``columns``, rebalanced by them."""
    writer = df.hint("rebalance", *columns).write.mode("overwrite").format("parquet").partitionBy(*columns)
    if location:
        writer = writer.option("path", location)
    writer.saveAsTable(table)


def preview(df: DataFrame, n: int = 20) -> list[Row]:
    """At most ``n`` rows, handed to the client."""
    return df.limit(n).collect()
