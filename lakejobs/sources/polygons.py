"""Polygon tables: ``ord`` (file order), id and attributes, ``rings``."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakejobs.operators.skew import broadcast_if_small

RINGS_TYPE = "array<array<struct<x:double,y:double>>>"

_FEATURE = """
    type string,
    ord bigint,
    properties map<string,string>,
    geometry struct<type:string,coordinates:string>
"""


# Decimal digits for the place of a row in its task (33 bits), and for that of a block in its file.
_ROW_DIGITS, _BLOCK_DIGITS = 10, 15


def _file_order(raw: DataFrame) -> DataFrame:
    """``raw`` with ``place``, a number that rises with the path of the file, the block in it and the row.

    Files are numbered by path, which is one row for each; the numbers meet the rows in a join by path.
    """
    row = F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1)).cast("decimal(38,0)")
    block = F.col("_metadata.file_block_start").cast("decimal(15,0)")
    placed = raw.select("*", (block * F.lit(Decimal(10**_ROW_DIGITS)) + row).cast("decimal(26,0)").alias("place"), F.col("_metadata.file_path").alias("file"))
    paths = raw.select(F.col("_metadata.file_path").alias("file")).distinct()
    numbered = paths.select("file", (F.row_number().over(Window.orderBy("file")) - 1).cast("decimal(10,0)").alias("number"))
    scale = F.lit(Decimal(10 ** (_ROW_DIGITS + _BLOCK_DIGITS)))
    met = placed.join(broadcast_if_small(numbered), "file")
    return met.withColumn("place", (F.col("number") * scale + F.col("place")).cast("decimal(38,0)")).drop("file", "number")


def read_polygons(spark: SparkSession, path: str | list[str], properties: list[str]) -> DataFrame:
    """Line-delimited GeoJSON features as rows of (ord, properties..., rings).

    ``ord`` is a top-level member of that name where the features give one, else the place of a feature:
    by the path of its file, then in the file. The first polygon that holds a point wins. A collection
    of features in one document is an error. Rings of a multipolygon are put in one list; holes need
    no mark because insideness is decided by even-odd over all rings.
    """
    raw = spark.read.schema(_FEATURE).json(path)
    coordinates = F.col("geometry.coordinates")
    polygon = F.from_json(coordinates, "array<array<array<double>>>")
    multi = F.flatten(F.from_json(coordinates, "array<array<array<array<double>>>>"))
    rings = F.when(F.col("geometry.type") == "MultiPolygon", multi).otherwise(polygon)
    points = F.transform(
        rings,
        lambda ring: F.transform(ring, lambda p: F.struct(F.get(p, 0).alias("x"), F.get(p, 1).alias("y"))),
    )
    whole = F.raise_error(F.lit("a FeatureCollection: give one feature a line"))
    ord_ = F.coalesce(F.col("ord").cast("decimal(38,0)"), F.col("place"))
    order = F.when(F.col("type") == "FeatureCollection", whole).otherwise(ord_).cast("decimal(38,0)")
    return _file_order(raw).select(order.alias("ord"), *[F.col("properties")[p].alias(p) for p in properties], points.alias("rings"))
