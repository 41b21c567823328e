import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from lakejobs import constants as K
from lakejobs.operators import filters, grid, readings, recommend, reports
from lakejobs.operators.skew import BROADCAST_WEIGHT
from lakejobs.plans import weather
from lakejobs.sources.grids import read_grid_day

STATIONS = [
    ("2021-01-01T00:00:00", "47.45", "-122.3", "A", "200,1,N,0046,1"),
    ("2021-01-01T05:00:00", "47.45", "-122.3", "A", "200,1,N,9999,1"),
    ("2021-01-01T06:00:00", "47.60", "-122.3", "B", "200,1,N,0093,1"),
    ("2021-01-02T00:00:00", "47.60", "-122.3", "B", "200,1,N,0103,1"),
    ("2021-01-02T01:00:00", "10.00", "-122.3", "C", "200,1,N,0999,1"),
    ("2021-01-02T02:00:00", "47.60", "-122.3", "B", "200"),
    ("2021-01-02T03:00:00", "north", "-122.3", "D", "200,1,N,0888,1"),
    ("2021-01-02T04:00:00", "47.60", "-122.3", "B", None),
]


def stations(spark):
    return spark.createDataFrame(STATIONS, "DATE string, LATITUDE string, LONGITUDE string, NAME string, WND string")


def test_daily_top_wind(spark):
    top = weather.top_days(stations(spark), (-122.48, 47.41, -122.16, 47.73))
    assert [tuple(r) for r in top.collect()] == [("2021-01-02", 10.3), ("2021-01-01", 9.3)]


def test_number_sentinel_keeps_the_same_rows(spark):
    box = (-123.0, 47.0, -122.0, 48.0)
    by_text = readings.wind_readings(stations(spark), box).collect()
    by_number = readings.wind_readings(stations(spark), box, text_sentinel=False).collect()
    assert sorted(by_text) == sorted(by_number) and len(by_text) == 3


def test_box_bounds_are_inclusive_and_360_is_turned(spark):
    points = spark.createDataFrame([(-130.0, 20.0), (-60.0, 55.0), (-59.0, 30.0), (170.0, 30.0)], "lon double, lat double")
    assert filters.in_box(points, "lon", "lat", (-130.0, 20.0, -60.0, 55.0)).count() == 2
    assert filters.in_box(points, "lon", "lat", K.MAP_BBOX_360, lon_360=True).count() == 2
    turned = points.withColumn("lon", F.pmod(F.col("lon"), F.lit(360.0)))
    assert filters.in_box(turned, "lon", "lat", K.MAP_BBOX_360, lon_360=True).count() == 2
    across = filters.in_box(turned, "lon", "lat", (160.0, 20.0, 240.0, 55.0), lon_360=True)
    assert sorted(r["lon"] for r in across.collect()) == [170.0, 230.0]


_READING = st.tuples(
    st.sampled_from(["S1", "S2", None]),
    st.integers(0, 2),
    st.sampled_from(["2024-01-01T00:00:00Z", "2024-01-02T00:00:00Z", "2024-01-03T00:00:00Z", None]),
    st.none() | st.integers(0, 5).map(float),
)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(_READING, min_size=1, max_size=25))
def test_latest_equals_the_window(spark, rows):
    numbered = [(*row, i) for i, row in enumerate(rows)]
    df = spark.createDataFrame(numbered, "location string, place int, utc string, value double, tie int")
    station = Window.partitionBy("location").orderBy("utc", "tie")
    whole = station.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    windowed = df.withColumn("last_value", F.last("value").over(whole))
    time = F.col("utc").try_cast("timestamp")
    want = sorted(map(str, windowed.collect()))
    for limit in (BROADCAST_WEIGHT, 0):
        got = readings.with_latest(df, "location", "value", time, "tie", limit=limit)
        assert sorted(map(str, got.select(*windowed.columns).collect())) == want

    per_station = readings.latest_per(df, ["location"], "value", time, "tie")
    want = {tuple(r) for r in windowed.select("location", "last_value").collect()}
    assert {tuple(r) for r in per_station.collect()} == want

    want = {tuple(r) for r in windowed.select("place", "last_value").collect()}
    for limit in (BROADCAST_WEIGHT, 0):
        per_place = readings.latest_by_place(df, "location", ["place"], "value", time, "tie", limit).collect()
        assert len(per_place) == len(want) and {tuple(r) for r in per_place} == want


def test_no_readings_give_no_rows(spark):
    df = spark.createDataFrame([], "location string, place int, utc timestamp, value double")
    assert readings.latest_by_place(df, "location", ["place"], "value", "utc").count() == 0
    assert readings.with_latest(df, "location", "value", "utc").count() == 0


def test_averages_keep_the_null_group_and_attributes_drop_it(spark):
    df = spark.createDataFrame([("1", 1.0), ("1", 3.0), (None, 9.0), ("2", 5.0), ("3", None)], "geoid string, v double")
    averages = readings.avg_per_region(df, "geoid", "v")
    assert {tuple(r) for r in averages.collect()} == {("1", 2.0), (None, 9.0), ("2", 5.0), ("3", None)}
    regions = spark.createDataFrame([("1", "NY"), ("2", "AK"), ("3", "TX")], "geoid string, stusps string")
    kept = readings.attach_attributes(averages, regions, "geoid", "stusps", K.EXCLUDED_STATES)
    assert {r["geoid"] for r in kept.collect()} == {"1", "3"}


def test_top_rated_counts_rows_or_ratings(spark):
    rows = [("a", "x", 5), ("a", "x", 4), ("b", "y", 1), ("b", "y", None), ("c", "z", 3)]
    df = spark.createDataFrame(rows, "product_id string, product_title string, star_rating int")
    keys = ["product_id", "product_title"]
    by_rows = reports.top_rated(df, keys, "star_rating", 2).collect()
    assert [tuple(r) for r in by_rows] == [("a", "x", 4.5, 2), ("b", "y", 1.0, 2)]
    by_ratings = reports.top_rated(df, keys, "star_rating", 3, count_rows=False).collect()
    assert [r["reviews"] for r in by_ratings] == [2, 1, 1]
    counted = df.groupBy(*keys, "star_rating").agg(F.count("*").alias("n"))
    for count_rows in (True, False):
        plain = reports.top_rated(df, keys, "star_rating", 9, count_rows).collect()
        assert reports.top_rated(counted, keys, "star_rating", 9, count_rows, weight="n").collect() == plain


def test_nested_max_ignores_numbers_too_big(spark):
    df = spark.sql(
        """SELECT id, named_struct('title', t) AS snippet, named_struct('viewcount', v, 'likecount', l) AS statistics
           FROM VALUES ('1', 'A', '10', '1'), ('1', 'A', '9', '2'), ('2', 'B', '3000000000', 'x') AS r(id, t, v, l)"""
    )
    result = reports.nested_max(
        df,
        {"id": "id", "title": "snippet.title"},
        {"max_views": "statistics.viewcount", "max_likes": "statistics.likecount"},
    )
    assert [tuple(r) for r in result.collect()] == [("1", "A", 10, 2), ("2", "B", None, None)]


# --- grids -------------------------------------------------------------------------------


def steps(spark, hours=30):
    rows = spark.range(hours).select(
        F.explode(F.array(F.lit("p"), F.lit("t"))).alias("measure"),
        (F.lit("2020-01-13").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("id").cast("int"))).alias("time"),
        F.col("id"),
    )
    base = F.when(F.col("measure") == "p", 100.0).otherwise(0.0) + F.col("id")
    return rows.select("measure", "time", F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: base + i / 10).alias("values"))


def test_day_slice_is_closed_and_nth_step_is_zero_based(spark):
    day = grid.day_slice(steps(spark), "time", "2020-01-13")
    assert day.select("time").distinct().count() == 24
    noon = grid.nth_step(day, 12)
    assert {(r["measure"], r["time"].hour) for r in noon.collect()} == {("p", 12), ("t", 12)}
    assert grid.nth_step(day, 24).count() == 0


def test_cells_and_aligned_measures(spark):
    cells = grid.explode_grid(grid.nth_step(steps(spark), 0), "values", 3)
    got = {(r["measure"], r["lat_i"], r["lon_i"]): r["value"] for r in cells.collect()}
    assert len(got) == 12 and got[("p", 1, 2)] == 100.5 and got[("t", 0, 1)] == pytest.approx(0.1)
    some = steps(spark).where((F.col("measure") == "p") | (F.hour("time") != 3))
    lined = grid.align(some, {"p": "pressure", "t": "temperature"}, "values", 3)
    by_join = grid.explode_grid(some.where("measure = 'p'").drop("measure"), "values", 3, "pressure").join(
        grid.explode_grid(some.where("measure = 't'").drop("measure"), "values", 3, "temperature"),
        ["time", "lat_i", "lon_i"],
    )
    assert sorted(lined.collect()) == sorted(by_join.select(*lined.columns).collect())


def test_mesh(spark):
    axes = spark.sql("SELECT array(10.0D, 20.0D) AS lats, array(1.0D, 2.0D, 3.0D) AS lons")
    got = {(r["lat_i"], r["lon_i"]): (r["lat"], r["lon"]) for r in grid.mesh(axes).collect()}
    assert len(got) == 6 and got[(1, 2)] == (20.0, 3.0)


def test_grid_store_is_pruned_by_folder(spark, out):
    from lakejobs.sinks.files import write_partitioned
    from lakejobs.sources.catalog import mark_time_column

    for measure, name in (("p", "time0"), ("t", "time1")):
        dated = steps(spark, 24 * 40).where(F.col("measure") == measure).select(
            F.lit(None).cast("date").alias("made"),
            F.col("time").alias(name),
            "values",
            F.date_format("time", "yyyy").alias("year"),
            F.date_format("time", "MM").alias("month"),
        )
        write_partitioned(mark_time_column(dated, name), f"{out}/measure={measure}", ["year", "month"])
    day = read_grid_day(spark, out, "2020-02-01", ["p", "t"])
    assert day.groupBy("measure").count().orderBy("measure").collect() == [("p", 24), ("t", 24)]
    assert day.agg(F.min("time").cast("string")).first()[0] == "2020-02-01 00:00:00"
    assert {f.split("/")[-2] for f in day.inputFiles()} == {"month=02"}


# --- recommender -------------------------------------------------------------------------


def test_dense_ids_have_no_gaps_and_never_change(spark):
    df = spark.range(5000).select((F.col("id") % 700).cast("string").alias("c"))
    first = recommend.dense_ids(df, "c", "i", 16).collect()
    assert sorted(r["i"] for r in first) == list(range(700))
    again = recommend.dense_ids(df.repartition(7), "c", "i", 16).collect()
    assert sorted(first) == sorted(again)
    with_null = df.unionByName(spark.sql("SELECT CAST(NULL AS STRING) AS c"))
    numbered = recommend.with_dense_id(with_null, "c", "i")
    assert numbered.count() == 5001 and numbered.where("i IS NULL").count() == 1


def test_splits(spark):
    df = spark.range(10_000).withColumn("v", F.col("id") % 7)
    train, test = recommend.hash_split(df, ["id"])
    assert train.count() + test.count() == 10_000 and train.join(test, "id").count() == 0
    assert 0.77 < train.count() / 10_000 < 0.83
    moved, _ = recommend.hash_split(df.repartition(5, "v"), ["id"])
    assert sorted(moved.collect()) == sorted(train.collect())
    parts = recommend.random_split(df, seed=3)
    assert sum(p.count() for p in parts) == 10_000 and 0.75 < parts[0].count() / 10_000 < 0.85


def test_recommender_learns_and_drops_unseen(spark):
    rnd = random.Random(1)
    rows = [(u, i, 5.0 if (u + i) % 2 else 1.0) for u in range(30) for i in range(20) if rnd.random() < 0.8]
    df = spark.createDataFrame(rows, "user int, item int, stars double")
    train, test = recommend.hash_split(df, ["user", "item"])
    model = recommend.fit_als(train, "user", "item", "stars", blocks=2)
    assert model.rank == 10
    assert recommend.rmse(model, test, "stars") < 1.0
    unseen = spark.createDataFrame([(999, 1, 5.0)], df.schema)
    assert model.transform(unseen).count() == 0


