"""Reading and writing text, CSV and Parquet directories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakejobs import constants as K
from lakejobs.operators.layout import file_counts
from lakejobs.operators.reports import top_counts, top_rated
from lakejobs.operators.skew import ROWS_PER_PART, parts_for
from lakejobs.plans import stored, views
from lakejobs.session import new_path
from lakejobs.sinks.files import write_csv_n, write_escaped, write_parquet_n
from lakejobs.sinks.tables import external_table, preview
from lakejobs.sources.catalog import literal_rows
from lakejobs.sources.files import (
    read_delimited,
    read_escaped,
    read_leading,
    read_partitioned,
    read_path_like,
)

N_FILES = K.CONVERTED_FILES


def tsv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All review rows out to tab-separated text with headers, and back by declared types."""
    path = stored.once(
        spark,
        sf_dir,
        "reviews_tsv",
        lambda out: write_escaped(views.reviews(spark, sf_dir, *views.REVIEW_COLUMNS), out, header=True),
    )
    return read_escaped(spark, path, K.REVIEW_SCHEMA)


def tsv_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tab-separated gz text with a header, all strings, converted to ten or more Parquet files."""
    source, target = new_path(spark, "lines_gz"), new_path(spark, "lines_parquet")
    lines = views.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_quantity")
    write_csv_n(lines, source, sep="\t", header=True, compression="gzip")
    write_parquet_n(read_path_like(read_delimited(spark, source), "%.csv.gz"), target, parts_for(lines, N_FILES))
    per_file = file_counts(spark.read.parquet(target), "l_returnflag")
    return per_file.groupBy("l_returnflag").agg(F.sum("n").alias("n"), F.count_distinct("path").alias("files"))


def tsv_convert_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line item, all columns, out of the converted files, whose texts are cast back to their types."""
    lines = views.table(spark, sf_dir, "lineitem")

    def write(path: str) -> None:
        source = new_path(spark, "lines_gz")
        write_csv_n(lines, source, sep="\t", header=True, compression="gzip")
        write_parquet_n(read_delimited(spark, source), path, parts_for(lines, N_FILES))

    texts = spark.read.parquet(stored.once(spark, sf_dir, "lines_converted", write))
    typed = texts.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in lines.schema.fields])
    return typed.withColumn("l_shipdate", F.col("l_shipdate").cast("date"))


def path_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines per flag from a folder of packed and plain text, of which only the packed files are wanted."""

    def write(path: str) -> None:
        lines = views.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus")
        wanted = F.col("l_returnflag") == "R"
        write_csv_n(lines.where(wanted), path, sep="\t", header=True, compression="gzip")
        lines.where(~wanted).write.mode("append").csv(path, sep="\t", header=True)

    folder = read_delimited(spark, stored.once(spark, sf_dir, "lines_mixed", write))
    return read_path_like(folder, "%.csv.gz").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


def csv_leading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leading columns of CSV lines without a header, named and typed."""
    path = stored.once(
        spark, sf_dir, "customer_csv", lambda out: write_csv_n(views.table(spark, sf_dir, "customer"), out)
    )
    return read_leading(spark, path, {"key": "bigint", "name": "string", "nation": "int"})


def n_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and files after a split into ten CSV files, or more when ten would be too large."""
    path = new_path(spark, "orders_csv")
    orders = views.table(spark, sf_dir, "orders")
    write_csv_n(orders, path, parts_for(orders, N_FILES))
    counts = file_counts(read_leading(spark, path, {"o_orderkey": "bigint"}))
    return counts.agg(F.sum("n").alias("total_rows"), F.count("*").alias("files"))


def pruned_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top products of one marketplace and year, from the folder of those two."""
    reviews = read_partitioned(spark, stored.by_market_year(spark, sf_dir))
    return top_counts(reviews.where("marketplace = 'AMERICA' AND review_year = 1997"), "product_id", 10)


def one_partition_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings of one category, read from its folder alone, with the category kept."""
    folder = read_partitioned(
        spark, stored.by_category(spark, sf_dir), "product_category=ECONOMY", keep_partition=True
    )
    return folder.groupBy("product_category", "star_rating").agg(F.count("*").alias("n"))


def tsv_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The top-100 report written as tab-separated text and read again."""
    path = new_path(spark, "top_products")
    reviews = views.reviews(spark, sf_dir, "product_id", "product_title", "product_category", "star_rating")
    chosen = reviews.where(F.col("product_category") == "STANDARD")
    report = top_rated(chosen, ["product_id", "product_title"], "star_rating", 100)
    write_escaped(report.select("product_id", "product_title", "reviews", "mean_rating"), path)
    schema = "product_id string, product_title string, reviews bigint, mean_rating double"
    return read_escaped(spark, path, schema, skip_header=False)


def external_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings per marketplace through a table declared over the range-split files."""
    path = stored.by_range(spark, sf_dir)
    name = f"default.{stored.table_name(path)}"
    external_table(spark, name, path, stored.RANGED_SCHEMA)
    return spark.table(name).groupBy("marketplace", "star_rating").agg(F.count("*").alias("n"))


def preview_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten customers of a segment."""
    customers = views.table(spark, sf_dir, "customer")
    chosen = customers.where(F.col("c_mktsegment") == "BUILDING").orderBy("c_custkey")
    return literal_rows(spark, preview(chosen, 10), customers.schema)


QUERIES = {
    "tsv_roundtrip": tsv_roundtrip,
    "tsv_convert": tsv_convert,
    "tsv_convert_values": tsv_convert_values,
    "path_filtered": path_filtered,
    "csv_leading": csv_leading,
    "n_files": n_files,
    "pruned_top10": pruned_top10,
    "one_partition_read": one_partition_read,
    "tsv_report": tsv_report,
    "external_derived": external_derived,
    "preview_rows": preview_rows,
}

_FILES_SQL = f"CAST(greatest({N_FILES}, ceil(count(*) / {ROWS_PER_PART})) AS BIGINT)"

SQL = {
    "tsv_roundtrip": f"WITH {views.REVIEWS_SQL} SELECT {', '.join(views.REVIEW_COLUMNS)} FROM reviews",
    "tsv_convert": f"""
        SELECT l_returnflag, count(*) AS n, (SELECT {_FILES_SQL} FROM lineitem) AS files FROM lineitem GROUP BY 1
    """,
    "tsv_convert_values": "SELECT * REPLACE (CAST(l_shipdate AS DATE) AS l_shipdate) FROM lineitem",
    "path_filtered": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2",
    "csv_leading": "SELECT c_custkey AS key, c_name AS name, c_nationkey AS nation FROM customer",
    "n_files": f"SELECT count(*) AS total_rows, {_FILES_SQL} AS files FROM orders",
    "pruned_top10": f"""
        WITH {views.REVIEWS_SQL}
        SELECT product_id, count(*) AS n FROM reviews WHERE marketplace = 'AMERICA' AND review_year = 1997
        GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10
    """,
    "one_partition_read": f"""
        WITH {views.REVIEWS_SQL}
        SELECT product_category, star_rating, count(*) AS n FROM reviews
        WHERE product_category = 'ECONOMY' GROUP BY 1, 2
    """,
    "tsv_report": f"""
        WITH {views.REVIEWS_SQL}
        SELECT product_id, product_title, count(*) AS reviews, avg(star_rating) AS mean_rating
        FROM reviews WHERE product_category = 'STANDARD'
        GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 100
    """,
    "external_derived": f"""
        WITH {views.REVIEWS_SQL}
        SELECT marketplace, star_rating, count(*) AS n FROM reviews GROUP BY 1, 2
    """,
    "preview_rows": "SELECT * FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_custkey LIMIT 10",
}
