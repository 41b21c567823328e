"""Tables written once per session into the shared folder, for queries that study files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakejobs import constants as K
from lakejobs.operators.grid import cut_chunks
from lakejobs.operators.layout import keep_ranges
from lakejobs.operators.skew import parts_by_bytes
from lakejobs.operators.spatial import polygon_cells
from lakejobs.plans import views
from lakejobs.session import new_path
from lakejobs.sinks.files import write_partitioned, write_ranged, write_sorted
from lakejobs.sinks.tables import write_bucketed, write_partitioned_table
from lakejobs.sources.catalog import mark_time_column
from lakejobs.sources.polygons import read_polygons

CELL = 1.0  # cell width in degrees for lookups in regions
BUCKETS = 30  # at least; large tables get more
RANGES = 30  # at least; large tables get more
_TYPES = dict(field.split() for field in K.REVIEW_SCHEMA.split(","))
RANGED_SCHEMA = ", ".join(f"{c} {_TYPES[c]}" for c in K.RANGED_COLUMNS)

_written: dict[tuple[str, str, str], str] = {}


def once(spark: SparkSession, sf_dir: str, name: str, write: Callable[[str], None]) -> str:
    """The path of a stored table, written by ``write(path)`` on first use in the session."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _written:
        path = new_path(spark, name)
        write(path)
        _written[key] = path
    return _written[key]


def table_name(path: str) -> str:
    """A catalog name for a stored path, unique like the path."""
    return path.rsplit("/", 1)[-1].replace("-", "_")


def by_category(spark: SparkSession, sf_dir: str) -> str:
    """All reviews, one folder per product category."""
    folder = "product_category"

    def write(path: str) -> None:
        lines = views.review_lines(spark, sf_dir, views.STORED_COLUMNS)
        lines = lines.withColumns(dict(zip([folder], views.review_columns((folder,)))))
        texts = [F.col(folder) if c == folder else made for c, made in zip(views.STORED_COLUMNS, views.review_columns(views.STORED_COLUMNS))]
        write_partitioned(lines, path, [folder], made=texts)

    return once(spark, sf_dir, "reviews_by_category", write)


def stored_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(by_category(spark, sf_dir))


def by_market_year(spark: SparkSession, sf_dir: str) -> str:
    """Reviews in folders of marketplace and review year."""
    return once(
        spark,
        sf_dir,
        "reviews_by_market_year",
        lambda path: write_partitioned(stored_reviews(spark, sf_dir), path, ["marketplace", "review_year"]),
    )


def _layout(spark: SparkSession, sf_dir: str, name: str, columns: tuple[str, ...], write: Callable[[DataFrame, str], None]) -> str:
    """A layout of the reviews, with the ranges of product ids of its files beside it."""

    def lay_out(path: str) -> None:
        write(stored_reviews(spark, sf_dir).select(*columns), path)
        keep_ranges(spark, path, "product_id")

    return once(spark, sf_dir, name, lay_out)


def by_sort(spark: SparkSession, sf_dir: str) -> str:
    return _layout(spark, sf_dir, "reviews_sorted", K.LAYOUT_COLUMNS, lambda rows, path: write_sorted(rows, path, "product_id"))


def by_bucket(spark: SparkSession, sf_dir: str) -> str:
    """The path of the bucketed table; its catalog name is ``table_name`` of it."""

    def write(rows: DataFrame, path: str) -> None:
        write_bucketed(rows, table_name(path), "review_id", parts_by_bytes(rows, BUCKETS), path)

    return _layout(spark, sf_dir, "reviews_bucketed", K.LAYOUT_COLUMNS, write)


def by_range(spark: SparkSession, sf_dir: str) -> str:
    def write(rows: DataFrame, path: str) -> None:
        write_ranged(rows, path, "product_id", parts_by_bytes(rows, RANGES))

    return _layout(spark, sf_dir, "reviews_ranged", K.RANGED_COLUMNS, write)


def names_by_day(spark: SparkSession, sf_dir: str) -> str:
    """The path of the catalog table of name records, partitioned by day."""
    return once(
        spark,
        sf_dir,
        "name_records",
        lambda path: write_partitioned_table(views.name_records(spark, sf_dir), table_name(path), ["date"], path),
    )


def regions(spark: SparkSession, sf_dir: str) -> str:
    """The path of the region polygons as lines of GeoJSON features."""

    def write(path: str) -> None:
        points = F.transform("rings", lambda ring: F.transform(ring, lambda p: F.array(p["x"], p["y"])))
        # The second ring is a hole in some polygons and a part of its own in the others.
        parts = F.col("ord") % 5 == 2
        coordinates = F.when(parts, F.to_json(F.transform(points, lambda ring: F.array(ring)))).otherwise(F.to_json(points))
        kind = F.when(parts, "MultiPolygon").otherwise("Polygon")
        line = F.concat(
            F.lit('{"type":"Feature","ord":'),
            F.col("ord"),
            F.lit(',"properties":'),
            F.to_json(F.struct("geoid", "name", "stusps")),
            F.lit(',"geometry":{"type":"'),
            kind,
            F.lit('","coordinates":'),
            coordinates,
            F.lit("}}"),
        )
        views.regions(spark, sf_dir).select(line.alias("value")).write.text(path)

    return once(spark, sf_dir, "regions", write)


def region_cells(spark: SparkSession, sf_dir: str) -> str:
    """The path of the regions' cells, ready for lookups."""

    def write(path: str) -> None:
        polygons = read_polygons(spark, regions(spark, sf_dir), ["geoid"])
        polygon_cells(polygons, CELL, "geoid").write.parquet(path)

    return once(spark, sf_dir, "region_cells", write)


def grid_store(spark: SparkSession, sf_dir: str) -> str:
    """The grid in folders of measure, year and month; each measure has its own time column."""

    def write(path: str) -> None:
        for measure in K.GRID_MEASURES:
            name = "time1" if measure.startswith("precipitation") else "time0"
            steps = views.grid(spark, sf_dir).where(F.col("measure") == measure)
            dated = steps.select(
                F.col("time").alias(name),
                "values",
                F.date_format("time", "yyyy").alias("year"),
                F.date_format("time", "MM").alias("month"),
            )
            write_partitioned(mark_time_column(dated, name), f"{path}/measure={measure}", ["year", "month"])

    return once(spark, sf_dir, "grid", write)


def grid_chunks(spark: SparkSession, sf_dir: str) -> str:
    """The grid in chunks; one measure is cut in another way in every other step."""

    def write(path: str) -> None:
        other = F.col("measure").startswith("precipitation") & (F.hour("time") % 2 == 1)
        height, width = (F.when(other, a).otherwise(b) for a, b in ((4, 3), (3, 5)))
        cut_chunks(views.grid(spark, sf_dir), "values", views.GRID_NLON, height, width).write.parquet(path)

    return once(spark, sf_dir, "grid_chunks", write)
