"""Views that give the test tables the shapes the jobs expect, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakejobs import constants as K


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- places ------------------------------------------------------------------------------


def _longitude(key: Column) -> Column:
    return (key * 457 % 1200) / 10 - 180


def _latitude(key: Column) -> Column:
    return (key * 137 % 480) / 10 + 10


def _quarter(value: Column) -> Column:
    return F.floor(value * 4) / 4


# --- weather stations --------------------------------------------------------------------


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly station lines with the wind packed into one text field; all columns are text."""
    events = table(spark, sf_dir, "events")
    speed = F.lpad(F.floor(F.col("value") * 10).cast("string"), 4, "0")
    wind = F.concat_ws(
        ",",
        F.lpad((F.col("event_id") % 360).cast("string"), 3, "0"),
        F.lit("1"),
        F.lit("N"),
        F.when(F.col("event_type") == "error", F.lit(K.WIND_MISSING_TEXT)).otherwise(speed),
        F.lit("1"),
    )
    return events.select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("DATE"),
        _latitude(F.col("user_id")).cast("string").alias("LATITUDE"),
        _longitude(F.col("user_id")).cast("string").alias("LONGITUDE"),
        F.concat(F.lit("STATION_"), F.col("user_id").cast("string")).alias("NAME"),
        wind.alias("WND"),
    )


WEATHER_SCHEMA = "DATE string, LATITUDE string, LONGITUDE string, NAME string, WND string"

WEATHER_SQL = """
weather AS (
    SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S') AS "DATE",
           (user_id * 137 % 480) / 10 + 10 AS lat,
           (user_id * 457 % 1200) / 10 - 180 AS lon,
           CASE WHEN event_type = 'error' THEN '9999'
                ELSE lpad(CAST(CAST(floor(value * 10) AS BIGINT) AS VARCHAR), 4, '0') END AS packed
    FROM events
)"""

# --- reviews -----------------------------------------------------------------------------

_FROM_LINE = {
    "review_id": "concat_ws('-', l_orderkey, l_linenumber)",
    "product_id": "string(l_partkey)",
    "star_rating": "int(l_quantity) % 5 + 1",
    "helpful_votes": "l_linenumber",
    "total_votes": "l_linenumber + int(l_quantity)",
    "vine": "if(l_linestatus = 'O', 'Y', 'N')",
    "verified_purchase": "if(l_returnflag = 'R', 'N', 'Y')",
    "review_date": "to_date(l_shipdate)",
    "review_year": "year(l_shipdate)",
}
_FROM_PART = {
    "product_parent": "p_brand",
    "product_title": "p_name",
    "product_category": "p_type",
    "review_headline": "initcap(p_name)",
    "review_body": """concat_ws(' ', p_name, 'for',
        CASE p_size % 7 WHEN 0 THEN 'my Baby' WHEN 1 THEN 'INFANT use' ELSE 'anyone' END)""",
}
_FROM_ORDER = {"customer_id": "string(o_custkey)"}
_FROM_REGION = {"marketplace": "r_name"}

REVIEW_COLUMNS = tuple(field.split()[0] for field in K.REVIEW_SCHEMA.split(","))
STORED_COLUMNS = (*REVIEW_COLUMNS, "review_year")


def review_lines(spark: SparkSession, sf_dir: str, columns: tuple[str, ...]) -> DataFrame:
    """What the named columns of reviews are made from, one row a review: only the tables they come from are joined.

    Orders meet their markets before the lines, which are several times as many.
    """
    rows = table(spark, sf_dir, "lineitem")
    if any(c in _FROM_ORDER or c in _FROM_REGION for c in columns):
        orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
        if any(c in _FROM_REGION for c in columns):
            market = (
                table(spark, sf_dir, "customer")
                .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
                .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
                .select("c_custkey", "r_name")
            )
            orders = orders.join(market, F.col("o_custkey") == F.col("c_custkey"))
        rows = rows.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    if any(c in _FROM_PART for c in columns):
        rows = rows.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows


def review_columns(columns: tuple[str, ...]) -> list[Column]:
    sources = _FROM_LINE | _FROM_PART | _FROM_ORDER | _FROM_REGION
    return [F.expr(sources[c]).alias(c) for c in columns]


def reviews(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Reviews with the named columns. Only the tables those columns come from are joined."""
    columns = columns or STORED_COLUMNS
    return review_lines(spark, sf_dir, columns).select(*review_columns(columns))


def rating_counts(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Reviews of equal product and rating as one row with their number ``n``.

    The lines are counted before they meet the products, so the join moves at most one row
    per product, rating and task instead of every line. The columns are those of a product.
    """
    lines = table(spark, sf_dir, "lineitem")
    counted = lines.groupBy("l_partkey", F.expr(_FROM_LINE["star_rating"]).alias("star_rating")).agg(
        F.count("*").alias("n")
    )
    sold = counted.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    sources = _FROM_PART | {"product_id": _FROM_LINE["product_id"]}
    return sold.select(*[F.expr(sources[c]).alias(c) for c in columns], "star_rating", "n")


REVIEWS_SQL = """
reviews AS (
    SELECT r_name AS marketplace,
           CAST(o_custkey AS VARCHAR) AS customer_id,
           CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS review_id,
           CAST(l_partkey AS VARCHAR) AS product_id,
           p_brand AS product_parent,
           p_name AS product_title,
           p_type AS product_category,
           CAST(l_quantity AS INTEGER) % 5 + 1 AS star_rating,
           l_linenumber AS helpful_votes,
           l_linenumber + CAST(l_quantity AS INTEGER) AS total_votes,
           CASE WHEN l_linestatus = 'O' THEN 'Y' ELSE 'N' END AS vine,
           CASE WHEN l_returnflag = 'R' THEN 'N' ELSE 'Y' END AS verified_purchase,
           array_to_string(list_transform(string_split(p_name, ' '),
               lambda w: upper(w[1]) || lower(w[2:])), ' ') AS review_headline,
           p_name || ' for ' || CASE p_size % 7 WHEN 0 THEN 'my Baby' WHEN 1 THEN 'INFANT use'
                                ELSE 'anyone' END AS review_body,
           CAST(l_shipdate AS DATE) AS review_date,
           CAST(year(l_shipdate) AS INTEGER) AS review_year
    FROM lineitem
    JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey
    JOIN part ON l_partkey = p_partkey
)"""

# --- air quality -------------------------------------------------------------------------

READINGS_SCHEMA = """
    country string, parameter string, unit string, location string, value double,
    coordinates struct<latitude:double,longitude:double>,
    date struct<utc:string,local:string>, event_id bigint, day string
"""


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Air-quality readings with nested coordinates and dates; every tenth station moves about."""
    events = table(spark, sf_dir, "events")
    user = F.col("user_id")
    moved = F.when(user % 10 == 0, (F.col("event_id") % 3) * 0.25).otherwise(0.0)
    utc = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return events.select(
        F.when(user % 3 == 0, "MX").otherwise(K.AIR_COUNTRY).alias("country"),
        F.when(F.col("event_type") == "click", K.AIR_PARAMETER).otherwise(F.col("event_type")).alias("parameter"),
        F.lit("ug/m3").alias("unit"),
        F.concat(F.lit("S"), user.cast("string")).alias("location"),
        "value",
        F.struct(
            _quarter(_latitude(user)).alias("latitude"),
            (_quarter(_longitude(user)) + moved).alias("longitude"),
        ).alias("coordinates"),
        F.struct(utc.alias("utc"), utc.alias("local")).alias("date"),
        "event_id",
        F.date_format("ts", "yyyy-MM-dd").alias("day"),
    )


READINGS_SQL = """
readings AS (
    SELECT CASE WHEN user_id % 3 = 0 THEN 'MX' ELSE 'US' END AS country,
           CASE WHEN event_type = 'click' THEN 'pm25' ELSE event_type END AS parameter,
           'S' || CAST(user_id AS VARCHAR) AS location,
           value,
           floor(((user_id * 137 % 480) / 10 + 10) * 4) / 4 AS lat,
           floor(((user_id * 457 % 1200) / 10 - 180) * 4) / 4
               + CASE WHEN user_id % 10 = 0 THEN event_id % 3 * 0.25 ELSE 0 END AS lon,
           ts, event_id
    FROM events
)"""

# --- regions -----------------------------------------------------------------------------

# Polygons by key modulo 5, as rings of offsets from a corner: a rectangle that overlaps its
# neighbour, one with a hole, one in two parts, a diamond, and one with slanted sides.
SHAPES = (
    (((0, 0), (30, 0), (30, 9), (0, 9)),),
    (((0, 0), (22, 0), (22, 9), (0, 9)), ((6, 2), (14, 2), (14, 6), (6, 6))),
    (((0, 0), (8, 0), (8, 9), (0, 9)), ((12, 1), (20, 1), (20, 5), (12, 5))),
    (((11, 0), (22, 4.5), (11, 9), (0, 4.5)),),
    (((0, 0), (20, 2), (16, 9), (2, 7)),),
)
# Area code of each region key.
AREAS = ("AK", "CA", "HI", "NY", "TX")


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polygons (ord, geoid, name, stusps, rings), one per nation."""
    nation = table(spark, sf_dir, "nation")
    key = F.col("n_nationkey")
    left, bottom = (key % 5) * 24.0 - 180, F.floor(key / 5) * 9.5 + 10

    def rings(shape: tuple) -> Column:
        return F.array(
            *[F.array(*[F.struct((left + dx).alias("x"), (bottom + dy).alias("y")) for dx, dy in r]) for r in shape]
        )

    shaped = F.when(key % 5 == 0, rings(SHAPES[0]))
    for i in range(1, 5):
        shaped = shaped.when(key % 5 == i, rings(SHAPES[i]))
    return nation.select(
        key.cast("bigint").alias("ord"),
        key.cast("string").alias("geoid"),
        F.col("n_name").alias("name"),
        F.get(F.array(*[F.lit(a) for a in AREAS]), F.col("n_regionkey")).alias("stusps"),
        shaped.alias("rings"),
    )


_OFFSETS = ", ".join(
    f"({kind}, {r}, {i}, {float(dx)}::DOUBLE, {float(dy)}::DOUBLE)"
    for kind, shape in enumerate(SHAPES)
    for r, ring in enumerate(shape)
    for i, (dx, dy) in enumerate(ring)
)

# Sides of all polygons; then, for a CTE `place(lon, lat)`, the first polygon of each place.
REGIONS_SQL = f"""
offsets(kind, ring, seq, dx, dy) AS (VALUES {_OFFSETS}),
corner AS (
    SELECT n_nationkey AS ord, ring, seq,
           (n_nationkey % 5) * 24 - 180 + dx AS x, (n_nationkey // 5) * 9.5::DOUBLE + 10 + dy AS y
    FROM nation JOIN offsets ON kind = n_nationkey % 5
),
side AS (
    SELECT ord, x AS x1, y AS y1,
           coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2,
           coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2
    FROM corner WINDOW w AS (PARTITION BY ord, ring ORDER BY seq)
)"""

LOCATED_SQL = """
tested AS (
    SELECT lon, lat, ord,
           sum(CASE WHEN (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1
                    THEN 1 ELSE 0 END) AS crossings,
           bool_or((x2 - x1) * (lat - y1) = (lon - x1) * (y2 - y1)
                   AND lon BETWEEN least(x1, x2) AND greatest(x1, x2)
                   AND lat BETWEEN least(y1, y2) AND greatest(y1, y2)) AS on_side
    FROM place CROSS JOIN side
    GROUP BY lon, lat, ord
),
located AS (
    SELECT lon, lat, CAST(min(ord) AS VARCHAR) AS geoid
    FROM tested WHERE crossings % 2 = 1 OR on_side
    GROUP BY lon, lat
)"""


def order_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as points on quarter degrees."""
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", _quarter(_longitude(key)).alias("lon"), _quarter(_latitude(F.col("o_custkey"))).alias("lat")
    )


ORDER_PLACES_SQL = """
order_places AS (
    SELECT o_orderkey,
           floor(((o_orderkey * 457 % 1200) / 10 - 180) * 4) / 4 AS lon,
           floor(((o_custkey * 137 % 480) / 10 + 10) * 4) / 4 AS lat
    FROM orders
)"""

# --- videos ------------------------------------------------------------------------------


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Video statistics: counts as text inside structs, some too big for an int."""
    events = table(spark, sf_dir, "events")
    views = F.when(F.col("event_id") % 97 == 0, "3000000000").otherwise(
        F.floor(F.col("value") * 100).cast("string")
    )
    return events.select(
        F.col("user_id").cast("string").alias("id"),
        F.struct(F.concat(F.lit("V"), F.col("user_id").cast("string")).alias("title")).alias("snippet"),
        F.struct(
            views.alias("viewcount"), F.floor(F.col("value")).cast("string").alias("likecount")
        ).alias("statistics"),
    )


VIDEOS_SQL = """
videos AS (
    SELECT CAST(user_id AS VARCHAR) AS id, 'V' || CAST(user_id AS VARCHAR) AS title,
           CASE WHEN event_id % 97 = 0 THEN '3000000000'
                ELSE CAST(CAST(floor(value * 100) AS BIGINT) AS VARCHAR) END AS viewcount,
           CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS likecount
    FROM events
)"""

# --- name records ------------------------------------------------------------------------


def name_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host names by day."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("."), F.col("event_type"), F.lit(".com")).alias(
            "name"
        ),
        "value",
        F.to_date("ts").alias("date"),
    )


NAMES_SQL = """
name_records AS (
    SELECT event_id, 'u' || CAST(user_id AS VARCHAR) || '.' || event_type || '.com' AS name,
           value, CAST(ts AS DATE) AS date
    FROM events
)"""

# --- gridded weather ---------------------------------------------------------------------

GRID_START = "2020-01-12 00:00:00"
GRID_NLON = 8


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly 8 x 8 grids, three measures in turn: pressure (Pa), temperature (K), precipitation."""
    vectors = table(spark, sf_dir, "embeddings")
    kind = (F.col("vec_id") % 3).cast("int")
    cells = F.transform("embedding", lambda v: v.cast("double"))
    values = (
        F.when(kind == 0, F.transform(cells, lambda v: v * 10000 + 100000))
        .when(kind == 1, F.transform(cells, lambda v: v * 100 + 273.15))
        .otherwise(cells)
    )
    hours = F.floor(F.col("vec_id") / 3).cast("int")
    return vectors.select(
        F.get(F.array(*[F.lit(m) for m in K.GRID_MEASURES]), kind).alias("measure"),
        (F.lit(GRID_START).cast("timestamp_ntz") + F.make_dt_interval(hours=hours)).alias("time"),
        values.alias("values"),
    )


GRID_SQL = f"""
grid AS (
    SELECT CASE vec_id % 3 WHEN 0 THEN '{K.GRID_MEASURES[0]}' WHEN 1 THEN '{K.GRID_MEASURES[1]}'
                           ELSE '{K.GRID_MEASURES[2]}' END AS measure,
           TIMESTAMP '{GRID_START}' + to_hours(CAST(vec_id // 3 AS INTEGER)) AS time,
           CASE vec_id % 3 WHEN 0 THEN CAST(v AS DOUBLE) * 10000 + 100000
                           WHEN 1 THEN CAST(v AS DOUBLE) * 100 + 273.15::DOUBLE
                           ELSE CAST(v AS DOUBLE) END AS value,
           CAST(pos // {GRID_NLON} AS INTEGER) AS lat_i, CAST(pos % {GRID_NLON} AS INTEGER) AS lon_i
    FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)
)"""
