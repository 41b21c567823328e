"""Catalog listings and schemas of the given tables, with their row counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakejobs.operators.reports import row_count
from lakejobs.plans import stored, views
from lakejobs.sinks.tables import ensure_database, external_table
from lakejobs.sources.catalog import databases, describe, run_sql, stored_tables, tables

# The tables of the contract, for SQL, which can't count a table by a name that it finds.
GIVEN = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def _database(spark: SparkSession, sf_dir: str) -> str:
    """A database of external tables over the files that the folder holds."""

    def write(path: str) -> None:
        name = stored.table_name(path)
        ensure_database(spark, name, path)
        for t, place in stored_tables(spark, sf_dir).items():
            external_table(spark, f"{name}.`{t}`", place)

    return stored.table_name(stored.once(spark, sf_dir, "lake", write))


def catalog_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables listed in the database and the rows each one holds."""
    database = _database(spark, sf_dir)
    found = databases(spark).where(F.col("namespace") == database).select("namespace")
    listed = tables(spark, database).join(found, "namespace", "left_semi").select(F.col("tableName").alias("table_name"))
    # Names of tables, not rows of them.
    names = [row["table_name"] for row in listed.collect()]
    counts = [run_sql(spark, f"SELECT '{t}' AS table_name, count(*) AS n FROM {database}.`{t}`") for t in names]
    return listed.join(reduce(DataFrame.unionAll, counts), "table_name")


def catalog_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables that the database lists, which are those that the folder holds."""
    return tables(spark, _database(spark, sf_dir)).select(F.col("tableName").alias("table_name"))


def schema_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The schema of the line items and the number of rows."""
    lines = views.table(spark, sf_dir, "lineitem")
    return describe(lines).select("position", "name", "type", row_count(lines).scalar().alias("n"))


QUERIES = {"catalog_listing": catalog_listing, "catalog_tables": catalog_tables, "schema_rows": schema_rows}

SQL = {
    "catalog_listing": " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in GIVEN),
    "catalog_tables": "SELECT table_name FROM information_schema.tables WHERE table_schema = 'main'",
    "schema_rows": """
        SELECT position, name, type, (SELECT count(*) FROM lineitem) AS n
        FROM (VALUES (0, 'l_orderkey', 'bigint'), (1, 'l_partkey', 'bigint'), (2, 'l_suppkey', 'bigint'),
                     (3, 'l_linenumber', 'int'), (4, 'l_quantity', 'double'), (5, 'l_extendedprice', 'double'),
                     (6, 'l_discount', 'double'), (7, 'l_tax', 'double'), (8, 'l_returnflag', 'string'),
                     (9, 'l_linestatus', 'string'), (10, 'l_shipdate', 'timestamp_ntz')) AS t(position, name, type)
    """,
}
