"""Review counts and top-k reports, nested maxima, newest partition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakejobs import constants as K
from lakejobs.functions.fields import contains_any, text_id
from lakejobs.operators.reports import nested_max, readable, row_count, top_counts, top_rated
from lakejobs.plans import stored, views
from lakejobs.plans.hashes import MURMUR_SQL
from lakejobs.sources.catalog import newest_rows, run_sql, table

CATEGORY = "ECONOMY"
SINCE_YEAR = 1998


def total_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return row_count(views.table(spark, sf_dir, "lineitem"), name="total_rows")


def top_products_count_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratings = views.rating_counts(spark, sf_dir, "product_id", "product_title", "product_category")
    chosen = ratings.where(F.col("product_category") == CATEGORY)
    return top_rated(chosen, ["product_id", "product_title"], "star_rating", 100, weight="n")


def top_products_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most reviewed products of a category with the spread of their ratings, as SQL text over single reviews.

    Grouped and sorted by the positions of the selected columns.
    """
    reviews = views.reviews(spark, sf_dir, "product_id", "product_title", "product_category", "star_rating")
    return run_sql(
        spark,
        f"""
        SELECT product_title, product_id, min(star_rating) AS lowest, avg(star_rating) AS mean_rating,
               max(star_rating) AS highest, count(*) AS reviews
        FROM {{reviews}} WHERE product_category = '{CATEGORY}'
        GROUP BY 1, 2 ORDER BY 6 DESC, 4 DESC, 2, 1 LIMIT 100
        """,
        reviews=reviews,
    )


def _top_by_id(ratings: DataFrame) -> DataFrame:
    top = top_rated(
        ratings.withColumn("product_id_int", text_id("product_id")),
        ["product_id_int", "product_title"],
        "star_rating",
        25,
        count_rows=False,
        weight="n",
    )
    return readable(top, "product_title", "mean_rating", K.TITLE_PREFIX, K.RATING_DIGITS)


def top_products_rounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top_by_id(views.rating_counts(spark, sf_dir, "product_id", "product_title"))


def keyword_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratings = views.rating_counts(spark, sf_dir, "product_id", "product_title", "review_body")
    return _top_by_id(ratings.where(contains_any("review_body", K.KEYWORDS)))


def count_since_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    reviews = views.reviews(spark, sf_dir, "product_category", "review_year")
    return row_count(reviews, (F.col("product_category") == CATEGORY) & (F.col("review_year") >= SINCE_YEAR))


def count_per_key_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_counts(views.reviews(spark, sf_dir, "product_id"), "product_id", 10)


def nested_max_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested_max(
        views.videos(spark, sf_dir),
        {"id": "id", "title": "snippet.title"},
        {"max_views": "statistics.viewcount", "max_likes": "statistics.likecount"},
    )


def newest_partition_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All columns of the newest day's rows whose name has the suffix, from a catalog table."""
    names = table(spark, f"default.{stored.table_name(stored.names_by_day(spark, sf_dir))}")
    return newest_rows(names, "date", F.col("name").like("%.click.com")).select("*")


def text_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each product's hashed id and its number of reviews."""
    reviews = views.reviews(spark, sf_dir, "product_id")
    counts = reviews.groupBy("product_id").agg(F.count("*").alias("n"))
    return counts.withColumn("product_id_int", text_id("product_id"))


QUERIES = {
    "total_rows": total_rows,
    "top_products_count_avg": top_products_count_avg,
    "top_products_sql": top_products_sql,
    "top_products_rounded": top_products_rounded,
    "keyword_top_products": keyword_top_products,
    "count_since_year": count_since_year,
    "count_per_key_top10": count_per_key_top10,
    "nested_max_report": nested_max_report,
    "newest_partition_rows": newest_partition_rows,
    "text_ids": text_ids,
}

_TOP_SQL = f"""
WITH {views.REVIEWS_SQL}
SELECT product_id, product_title, count(*) AS reviews, avg(star_rating) AS mean_rating
FROM reviews WHERE product_category = '{CATEGORY}'
GROUP BY ALL ORDER BY reviews DESC, product_id, product_title LIMIT 100
"""

_SPREAD_SQL = f"""
WITH {views.REVIEWS_SQL},
spread AS (
    SELECT product_id, product_title, min(star_rating) AS lowest, avg(star_rating) AS mean_rating,
           max(star_rating) AS highest, count(*) AS reviews
    FROM reviews WHERE product_category = '{CATEGORY}' GROUP BY ALL
)
SELECT * FROM spread ORDER BY reviews DESC, mean_rating DESC, product_id, product_title LIMIT 100
"""

_RATED_SQL = """
SELECT product_id_int, substr(whole_title, 1, 45) AS product_title, round(mean_rating, 3) AS mean_rating, reviews
FROM (
    SELECT product_id_int, product_title AS whole_title, avg(star_rating) AS mean_rating, count(star_rating) AS reviews
    FROM {source} JOIN hashed ON product_id = txt {where} GROUP BY ALL
)
ORDER BY reviews DESC, product_id_int, whole_title LIMIT 25
"""

_PRODUCT_IDS = MURMUR_SQL.format(keys="SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS txt FROM lineitem", id="product_id_int")

SQL = {
    "total_rows": "SELECT count(*) AS total_rows FROM lineitem",
    "top_products_count_avg": _TOP_SQL,
    "top_products_sql": _SPREAD_SQL,
    "top_products_rounded": f"WITH RECURSIVE {views.REVIEWS_SQL}, {_PRODUCT_IDS} "
    + _RATED_SQL.format(source="reviews", where=""),
    "keyword_top_products": f"WITH RECURSIVE {views.REVIEWS_SQL}, {_PRODUCT_IDS} "
    + _RATED_SQL.format(
        source="reviews", where="WHERE lower(review_body) LIKE '%baby%' OR lower(review_body) LIKE '%infant%'"
    ),
    "count_since_year": f"""
        WITH {views.REVIEWS_SQL}
        SELECT count(*) AS n FROM reviews WHERE product_category = '{CATEGORY}' AND review_year >= {SINCE_YEAR}
    """,
    "count_per_key_top10": f"""
        WITH {views.REVIEWS_SQL}
        SELECT product_id, count(*) AS n FROM reviews GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10
    """,
    "nested_max_report": f"""
        WITH {views.VIDEOS_SQL}
        SELECT id, title, max(try_cast(viewcount AS INTEGER)) AS max_views,
               max(try_cast(likecount AS INTEGER)) AS max_likes
        FROM videos GROUP BY 1, 2
    """,
    "newest_partition_rows": f"""
        WITH {views.NAMES_SQL}
        SELECT * FROM name_records
        WHERE name LIKE '%.click.com' AND date = (SELECT max(date) FROM name_records)
    """,
    "text_ids": f"""
        WITH RECURSIVE {_PRODUCT_IDS}
        SELECT txt AS product_id, count(*) AS n, any_value(product_id_int) AS product_id_int
        FROM lineitem JOIN hashed ON txt = CAST(l_partkey AS VARCHAR) GROUP BY 1
    """,
}
