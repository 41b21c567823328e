"""The same rows laid out in different ways, and what that does to the files a query touches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakejobs.operators.layout import column_stats, compare_layouts, file_counts, files_per_key, kept_ranges
from lakejobs import constants as K
from lakejobs.operators.reports import row_count
from lakejobs.operators.skew import BYTES_PER_PART, FIXED_BYTES, parts_by_bytes, row_bytes
from lakejobs.plans import stored, views
from lakejobs.sinks.files import SORTED_PARTS

KEY = "42"
STAT_COLUMNS = ["star_rating", "helpful_votes", "total_votes", "review_date", "review_year"]


def _layout_report(df: DataFrame, key: str, least: int) -> DataFrame:
    """Rows, keys, ordinary keys, and how many of those are whole in one file.

    Ordinary keys hold no more bytes than their share of one file; the others may be spread.
    """
    total = df.agg(F.sum(row_bytes(df))).scalar()
    bytes_of = df.groupBy(key).agg(F.sum(row_bytes(df)).alias("bytes"))
    ordinary = F.col("bytes") * parts_by_bytes(df, least) <= total
    return files_per_key(df, key).join(bytes_of, key).agg(
        F.sum("rows").alias("n"),
        F.count("*").alias("keys"),
        F.count_if(ordinary).alias("ordinary_keys"),
        F.count_if(ordinary & (F.col("files") == 1)).alias("whole_in_one_file"),
    )


def sorted_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _layout_report(spark.read.parquet(stored.by_sort(spark, sf_dir)), "product_id", SORTED_PARTS)


def ranged_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _layout_report(spark.read.parquet(stored.by_range(spark, sf_dir)), "product_id", stored.RANGES)


def bucketed_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, those in a file of the bucket their key must have, and the buckets in use."""
    reviews = spark.table(stored.table_name(stored.by_bucket(spark, sf_dir)))
    bucket = F.pmod(F.hash("review_id"), F.lit(parts_by_bytes(reviews, stored.BUCKETS)))
    per_file = file_counts(reviews.withColumn("bucket", bucket), "bucket")
    in_file = F.regexp_extract("path", r"_(\d{5})\.c", 1).cast("int")
    return per_file.agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("bucket") == in_file, F.col("n"))).alias("in_right_file"),
        F.count_distinct("bucket").alias("buckets"),
    )


def file_counts_by_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per file, summed over the Parquet files of each category folder."""
    per_file = file_counts(stored.stored_reviews(spark, sf_dir)).where(F.col("path").like("%.parquet"))
    folder = F.regexp_extract("path", "product_category=([^/]*)/", 1)
    return per_file.groupBy(folder.alias("folder")).agg(F.sum("n").alias("n"))


def file_stats_by_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of every file and column, put together per column."""
    stats = column_stats(stored.stored_reviews(spark, sf_dir), STAT_COLUMNS)
    return stats.select("column", F.col("rows").alias("n"), F.col("min").alias("low"), F.col("max").alias("high"), "nulls")


def files_touched_by_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For one product: the rows found, and whether its key range points to a single file.

    The ranges are those kept when the layouts were written; only the count reads the products.
    """
    layouts = {"sorted": stored.by_sort(spark, sf_dir), "ranged": stored.by_range(spark, sf_dir), "bucketed": stored.by_bucket(spark, sf_dir)}
    touched = compare_layouts({name: kept_ranges(spark, path) for name, path in layouts.items()}, "product_id", [KEY])
    found = F.lit(None)
    for name, path in layouts.items():
        rows = row_count(spark.read.parquet(path), F.col("product_id") == KEY).scalar()
        found = F.when(F.col("layout") == name, rows).otherwise(found)
    return touched.select(
        "layout", "product_id", (F.col("files_touched") == 1).alias("one_file"), found.alias("n")
    )


QUERIES = {
    "sorted_layout": sorted_layout,
    "bucketed_layout": bucketed_layout,
    "ranged_layout": ranged_layout,
    "file_counts": file_counts_by_folder,
    "file_stats": file_stats_by_column,
    "files_touched_by_layout": files_touched_by_layout,
}

def _bytes_sql(columns: tuple[str, ...]) -> str:
    """``row_bytes`` of a review with these columns, in SQL."""
    texts = [c for c in columns if stored._TYPES[c] == "string"]
    return f"{FIXED_BYTES * (len(columns) + 1)} + " + " + ".join(f"strlen({c})" for c in texts)


def _sized_sql(columns: tuple[str, ...], least: int) -> str:
    """CTEs: reviews with their bytes, and into how many parts these make them."""
    return f"""{views.REVIEWS_SQL},
    sized AS (SELECT product_id, {_bytes_sql(columns)} AS size FROM reviews),
    whole AS (SELECT CAST(sum(size) AS BIGINT) AS total, CAST(greatest({least}, ceil(sum(size) / {BYTES_PER_PART})) AS BIGINT) AS parts FROM sized)"""


def _layout_sql(columns: tuple[str, ...], least: int) -> str:
    return f"""
    WITH {_sized_sql(columns, least)},
    per_key AS (SELECT product_id, count(*) AS k, sum(size) AS bytes FROM sized GROUP BY 1)
    SELECT CAST(sum(k) AS BIGINT) AS n, count(*) AS keys,
           count(*) FILTER (bytes * parts <= total) AS ordinary_keys, count(*) FILTER (bytes * parts <= total) AS whole_in_one_file
    FROM per_key, whole
    """


def _touched_sql(layout: str, columns: tuple[str, ...], least: int | None) -> str:
    one = "false" if least is None else f"bytes * greatest({least}, ceil(total / {BYTES_PER_PART})) <= total"
    return f"""SELECT '{layout}' AS layout, '{KEY}' AS product_id, n, {one} AS one_file FROM (
        SELECT count(*) FILTER (product_id = '{KEY}') AS n, sum({_bytes_sql(columns)}) FILTER (product_id = '{KEY}') AS bytes,
               sum({_bytes_sql(columns)}) AS total FROM reviews)"""


def _stat_sql(column: str) -> str:
    return f"""SELECT '{column}' AS "column", count(*) AS n, CAST(min({column}) AS VARCHAR) AS low,
               CAST(max({column}) AS VARCHAR) AS high, count(*) - count({column}) AS nulls FROM reviews"""


_STATS_SQL = f"WITH {views.REVIEWS_SQL} " + " UNION ALL ".join(_stat_sql(c) for c in STAT_COLUMNS)

SQL = {
    "sorted_layout": _layout_sql(K.LAYOUT_COLUMNS, SORTED_PARTS),
    "ranged_layout": _layout_sql(K.RANGED_COLUMNS, stored.RANGES),
    "bucketed_layout": f"""
        WITH {_sized_sql(K.LAYOUT_COLUMNS, stored.BUCKETS)}
        SELECT count(*) AS n, count(*) AS in_right_file, max(parts) AS buckets FROM sized, whole
    """,
    "file_counts": f"""
        WITH {views.REVIEWS_SQL}
        SELECT product_category AS folder, count(*) AS n FROM reviews GROUP BY 1
    """,
    "file_stats": _STATS_SQL,
    "files_touched_by_layout": f"WITH {views.REVIEWS_SQL} "
    + " UNION ALL ".join(
        (
            _touched_sql("sorted", K.LAYOUT_COLUMNS, SORTED_PARTS),
            _touched_sql("ranged", K.RANGED_COLUMNS, stored.RANGES),
            _touched_sql("bucketed", K.LAYOUT_COLUMNS, None),
        )
    ),
}
