"""The jobs as commands: ``spark-submit lakejobs/jobs.py JOB ...`` or ``python -m lakejobs.jobs JOB ...``."""

from __future__ import annotations

import argparse
import datetime
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

if __package__ in (None, ""):
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from lakejobs import constants as K
from lakejobs.operators.layout import file_stats
from lakejobs.operators.readings import attach_attributes
from lakejobs.operators.recommend import fit_als, hash_split, rmse, with_dense_id
from lakejobs.operators.reports import row_count, top_rated
from lakejobs.operators.skew import parts_by_bytes, parts_for
from lakejobs.operators.spatial import polygon_cells
from lakejobs.plans.air import region_averages
from lakejobs.plans.grids import weather_map
from lakejobs.plans.weather import top_days
from lakejobs.session import CATALOGS, build_session, new_path
from lakejobs.sinks.files import (
    write_csv_n,
    write_escaped,
    write_parquet_n,
    write_partitioned,
    write_ranged,
    write_sorted,
)
from lakejobs.sinks.tables import write_bucketed
from lakejobs.sources.catalog import run_sql
from lakejobs.sources.files import read_delimited, read_escaped, read_json_day
from lakejobs.sources.grids import read_grid_day
from lakejobs.sources.jdbc import read_jdbc
from lakejobs.sources.polygons import read_polygons


def bbox(text: str) -> tuple[float, ...]:
    """``left,bottom,right,top``."""
    values = tuple(float(v) for v in text.split(","))
    if len(values) != 4:
        raise argparse.ArgumentTypeError("a box is left,bottom,right,top")
    return values


def daily_wind(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Top wind speed per day in a box, from a directory of station CSV files."""
    days = top_days(read_delimited(spark, args.input, sep=","), args.bbox)
    days.show(50, truncate=False)
    return days


def convert(spark: SparkSession, args: argparse.Namespace) -> None:
    """Tab-separated text with a header to Parquet, or to CSV with --csv, in a number of files, by default ten or as many as the rows need."""
    write = write_csv_n if args.csv else write_parquet_n
    rows = read_delimited(spark, args.input)
    write(rows, args.output, args.files or parts_for(rows, K.CONVERTED_FILES))


def top_products(spark: SparkSession, args: argparse.Namespace) -> None:
    """Products of a category with the most reviews, as tab-separated text."""
    reviews = read_escaped(spark, args.input, K.REVIEW_SCHEMA)
    chosen = reviews.where(F.col("product_category") == args.category)
    report = top_rated(chosen, ["product_id", "product_title"], "star_rating", args.top)
    write_escaped(report.select("product_id", "product_title", "reviews", "mean_rating"), args.output)


def air_averages(spark: SparkSession, args: argparse.Namespace) -> None:
    """Average of the latest readings of a day per region, with the region's attributes."""
    schema = """
        country string, parameter string, unit string, location string, value double,
        coordinates struct<latitude:double,longitude:double>, date struct<utc:string,local:string>
    """
    readings = read_json_day(spark, args.readings, args.date, schema)
    polygons = read_polygons(spark, args.regions, ["GEOID", "STUSPS", "NAME"]).withColumnRenamed("GEOID", "geoid")
    path = new_path(spark, "region_cells")
    polygon_cells(polygons, args.cell, "geoid").write.parquet(path)
    averages = region_averages(readings, spark.read.parquet(path), args.cell)
    attributes = polygons.select("geoid", "STUSPS", "NAME")
    attach_attributes(averages, attributes, "geoid", "STUSPS", K.EXCLUDED_STATES).write.mode("overwrite").parquet(args.output)


def recommender(spark: SparkSession, args: argparse.Namespace) -> float:
    """Trains the recommender on 80 % of the ratings, saves it and prints its error on the rest."""
    reviews = spark.read.parquet(args.input).select("customer_id", "product_id", "star_rating", "review_id")
    ratings = with_dense_id(with_dense_id(reviews, "customer_id", "user"), "product_id", "item")
    path = new_path(spark, "ratings")
    ratings.write.parquet(path)
    train, test = hash_split(spark.read.parquet(path), ["user", "item", "review_id"])
    model = fit_als(train, "user", "item", "star_rating", blocks=args.blocks)
    model.write().overwrite().save(args.output)
    error = rmse(model, test, "star_rating")
    print(error)
    return error


def map_data(spark: SparkSession, args: argparse.Namespace) -> None:
    """Pressure, temperature and precipitation of one hour of a day, per grid cell."""
    steps = read_grid_day(spark, args.input, args.date, K.GRID_MEASURES)
    weather_map(steps.select("measure", "time", "values"), args.columns, args.step).write.mode("overwrite").parquet(args.output)


def stats(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Rows, smallest and largest value and NULLs of each file and column of a Parquet table."""
    result = file_stats(spark.read.parquet(args.input), args.columns)
    result.show(50, truncate=False)
    return result


def layout(spark: SparkSession, args: argparse.Namespace) -> None:
    """Writes a Parquet table sorted or range-split by a key, or in folders or buckets of it."""
    rows = spark.read.parquet(args.input)
    if args.kind == "folders":
        write_partitioned(rows, args.output, args.key.split(","))
    elif args.kind == "buckets":
        write_bucketed(rows, args.table, args.key, args.parts or parts_by_bytes(rows, 30), args.output)
    elif args.kind == "sorted":
        write_sorted(rows, args.output, args.key, args.parts)
    else:
        write_ranged(rows, args.output, args.key, args.parts or parts_by_bytes(rows, 30))


def sql(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Runs SQL text against the catalog and shows the first rows of the result."""
    result = run_sql(spark, args.text)
    result.show(args.rows, truncate=False)
    return result


def database(spark: SparkSession, args: argparse.Namespace) -> None:
    """Shows a database table and its number of rows."""
    bounds = tuple(args.bounds.split(",")) if args.bounds else None
    table = read_jdbc(
        spark,
        args.url,
        args.table,
        args.driver,
        user=args.user,
        password=args.password,
        column=args.column,
        bounds=bounds,
        partitions=args.partitions,
    )
    table.show()
    row_count(table).show()


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lakejobs", description=__doc__)
    top.add_argument("--catalog", choices=CATALOGS, default=CATALOGS[0], help="where tables are kept; hive outlives the session")
    jobs = top.add_subparsers(required=True, metavar="JOB")

    def job(name: str, work, *positional: str) -> argparse.ArgumentParser:
        sub = jobs.add_parser(name, help=work.__doc__.replace("%", "%%"))
        sub.set_defaults(work=work)
        for p in positional:
            sub.add_argument(p)
        return sub

    wind = job("daily-wind", daily_wind, "input")
    wind.add_argument("--bbox", type=bbox, default=K.DEFAULT_BBOX, help="--bbox=left,bottom,right,top")

    converter = job("convert", convert, "input", "output")
    converter.add_argument("--files", type=int)
    converter.add_argument("--csv", action="store_true")

    report = job("top-products", top_products, "input", "output")
    report.add_argument("--category", default="Toys")
    report.add_argument("--top", type=int, default=100)

    air = job("air-averages", air_averages, "readings", "regions", "output")
    air.add_argument("--date", default=str(datetime.datetime.now(datetime.timezone.utc).date()))
    air.add_argument("--cell", type=float, default=0.25)

    model = job("recommender", recommender, "input", "output")
    model.add_argument("--blocks", type=int)

    weather = job("weather-map", map_data, "input", "output")
    weather.add_argument("--date", default=K.DEFAULT_WEATHER_DAY)
    weather.add_argument("--step", type=int, default=K.GRID_STEP_OF_DAY)
    weather.add_argument("--columns", type=int, default=1440, help="cells per latitude row")

    files = job("file-stats", stats, "input")
    files.add_argument("columns", nargs="+")

    layouts = job("layout", layout, "input", "output", "key")
    layouts.add_argument("--kind", choices=("sorted", "ranges", "folders", "buckets"), default="sorted")
    layouts.add_argument("--parts", type=int)
    layouts.add_argument("--table", help="catalog name of the bucketed table")

    text = job("sql", sql, "text")
    text.add_argument("--rows", type=int, default=20)

    db = job("database", database, "url", "table", "driver")
    for option in ("--user", "--password", "--column", "--bounds"):
        db.add_argument(option)
    db.add_argument("--partitions", type=int)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> object:
    args = parser().parse_args(argv)
    return args.work(spark or build_session(catalog=args.catalog), args)


if __name__ == "__main__":
    main()
