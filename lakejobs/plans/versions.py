"""Orders with a version column, read as they are and as they were; inserts of literal rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from lakejobs.plans import stored, views
from lakejobs.session import new_path
from lakejobs.sinks.files import write_partitioned
from lakejobs.sinks.tables import ensure_table, insert_rows
from lakejobs.sources.catalog import literal_rows
from lakejobs.sources.files import read_partitioned


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in folders of ``_version``, one version per status, the missing status first, then in order."""
    orders = views.table(spark, sf_dir, "orders")

    def write(path: str) -> None:
        statuses = orders.select(F.col("o_orderstatus").alias("status")).distinct()
        numbered = statuses.select("status", F.row_number().over(Window.orderBy("status")).alias("_version"))
        same = F.col("o_orderstatus").eqNullSafe(F.col("status"))
        write_partitioned(orders.join(F.broadcast(numbered), same).drop("status"), path, ["_version"])

    schema = StructType([*orders.schema.fields, StructField("_version", IntegerType())])
    return read_partitioned(spark, stored.once(spark, sf_dir, "orders_versions", write), schema=schema)


def _by_status(rows: DataFrame) -> DataFrame:
    return rows.groupBy("o_orderstatus").agg(
        F.count("*").alias("n"), F.min("o_orderkey").alias("low"), F.max("o_orderkey").alias("high")
    )


def version_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_status(_orders(spark, sf_dir))


def version_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_status(_orders(spark, sf_dir).where(F.col("_version") <= 2))


def inserted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table made if missing, with two literal rows and then all customers inserted."""
    path = new_path(spark, "people")
    table = ensure_table(spark, "default", stored.table_name(path), "id int, name string, value int", path)
    insert_rows(literal_rows(spark, [(-1, "ann", 33), (-2, "bob", 34)], "id int, name string, value int"), table)
    customers = views.table(spark, sf_dir, "customer")
    insert_rows(customers.select(F.col("c_custkey").cast("int"), "c_name", "c_nationkey"), table)
    return spark.table(table)


QUERIES = {"version_current": version_current, "version_asof": version_asof, "inserted_rows": inserted_rows}

_STATUS_SQL = """
SELECT o_orderstatus, count(*) AS n, min(o_orderkey) AS low, max(o_orderkey) AS high
FROM (SELECT *, dense_rank() OVER (ORDER BY o_orderstatus NULLS FIRST) AS version FROM orders) AS o
WHERE {which} GROUP BY 1
"""

SQL = {
    "version_current": _STATUS_SQL.format(which="true"),
    "version_asof": _STATUS_SQL.format(which="version <= 2"),
    "inserted_rows": """
        SELECT * FROM (VALUES (-1, 'ann', 33), (-2, 'bob', 34)) AS t(id, name, value)
        UNION ALL SELECT CAST(c_custkey AS INTEGER), c_name, c_nationkey FROM customer
    """,
}
