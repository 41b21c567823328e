"""Cases that green rows did not show: odd input of filters, grids, readings, versions, polygons."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lakejobs.functions import fields
from lakejobs import session
from lakejobs.operators import filters, grid, readings, recommend
from lakejobs.operators.spatial import locate_first
from lakejobs.plans import QUERIES, stored
from lakejobs.sources.polygons import read_polygons


def test_a_full_circle_holds_every_longitude(spark):
    points = spark.createDataFrame([(0.0, 1.0), (90.0, 1.0), (180.0, 1.0), (359.0, 1.0), (10.0, 95.0), (None, 1.0)], "lon double, lat double")
    assert filters.in_box(points, "lon", "lat", (0, -90, 360, 90), lon_360=True).count() == 4
    assert filters.in_box(points, "lon", "lat", (-180, -90, 180, 90)).count() == 3 + 1


def test_unfit_dates_are_null(spark):
    row = spark.range(1).select(
        fields.human_date(F.lit("x")).alias("a"), fields.day_number_to_date(F.lit(5_000_000_000)).alias("b"), fields.packed_field(F.lit("1|2"), 1, "|").alias("c")
    ).first()
    assert tuple(row) == (None, None, "2")


def test_a_station_without_a_time_keeps_its_value(spark):
    rows = [("a", "x", 1.0), ("b", "2024-01-01", 2.0), ("b", "bad", 3.0)]
    df = spark.createDataFrame(rows, "s string, t string, v double")
    got = readings.latest_per(df, ["s"], "v", F.col("t").try_cast("timestamp")).collect()
    assert {r["s"]: r["last_value"] for r in got} == {"a": 1.0, "b": 2.0}


def test_two_arrays_for_one_time_are_an_error(spark):
    df = spark.createDataFrame([(1, "p", [1.0]), (1, "p", [2.0]), (1, "t", [3.0])], "time int, measure string, values array<double>")
    with pytest.raises(Exception, match="two arrays"):
        grid.align(df, {"p": "a", "t": "b"}, "values", 1).collect()
    step = grid.nth_step(df.withColumn("time", F.col("values")[0].cast("int")), 1)
    assert [(r["measure"], r["time"]) for r in step.collect()] == [("p", 2)]


def test_version_queries_read_plain_folders_of_a_version_column(spark, tmp_path):
    rows = [(1, "P"), (2, None), (3, "F"), (4, "O"), (5, "F")]
    spark.createDataFrame(rows, "o_orderkey long, o_orderstatus string").write.parquet(str(tmp_path / "orders.parquet"))
    now, then = (QUERIES[name](spark, str(tmp_path)).collect() for name in ("version_current", "version_asof"))
    assert sorted(map(tuple, now), key=str) == [("F", 2, 3, 5), ("O", 1, 4, 4), ("P", 1, 1, 1), (None, 1, 2, 2)]
    assert sorted(map(tuple, then), key=str) == [("F", 2, 3, 5), (None, 1, 2, 2)]
    path = next(p for (_, sf, name), p in stored._written.items() if (sf, name) == (str(tmp_path), "orders_versions"))
    folder = Path(path.removeprefix("file:"))
    assert sorted(p.name for p in folder.iterdir() if p.is_dir()) == [f"_version={k}" for k in range(1, 5)]


def test_unusable_ratings_are_left_out(spark):
    rows = [(u, i, float((u + i) % 5)) for u in range(12) for i in range(12)] + [(None, 1, 1.0), (1, None, 1.0), (1, 1, None)]
    df = spark.createDataFrame(rows, "user int, item int, rating float")
    model = recommend.fit_als(df, "user", "item", "rating", max_iter=2, blocks=2)
    assert recommend.predicted(model, df, "rating").count() == 144 and recommend.rmse(model, df, "rating") < 5


def square(name, x, size, **more):
    ring = [[x, 0], [x + size, 0], [x + size, size], [x, size], [x, 0]]
    return json.dumps({"type": "Feature", "properties": {"id": name}, "geometry": {"type": "Polygon", "coordinates": [ring]}, **more})


@pytest.mark.parametrize(
    ("features", "want"),
    [
        ([square("z", 0, 4), square("a", 2, 4)], ["z", "z", "a", None, None, None]),
        ([square("z", 0, 4, ord=2), square("a", 2, 4, ord=1)], ["z", "a", "a", None, None, None]),
        ([square("z", 0, 4, ord=1), square("a", 2, 4, ord=1)], ["z", "a", "a", None, None, None]),
    ],
)
def test_both_forms_give_the_first_polygon(spark, tmp_path, features, want):
    (tmp_path / "p.json").write_text("\n".join(features))
    polygons = read_polygons(spark, str(tmp_path / "p.json"), ["id"])
    places = [(1.0, 1.0), (3.0, 1.0), (5.0, 1.0), (9.0, 1.0), (float("nan"), 1.0), (None, 1.0)]
    points = spark.createDataFrame([(k, x, y) for k, (x, y) in enumerate(places)], "k int, x double, y double")
    for weight in (0, 10**6):
        got = locate_first(points, polygons, "x", "y", "id", 1.0, weight).orderBy("k").collect()
        assert [r["id"] for r in got] == want


def test_a_collection_is_an_error(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"type": "FeatureCollection", "features": [json.loads(square("a", 0, 1))]}))
    with pytest.raises(Exception, match="FeatureCollection"):
        read_polygons(spark, str(tmp_path / "c.json"), ["id"]).collect()


def test_the_catalog_is_chosen_by_name(monkeypatch):
    asked = []
    builder = type(session.SparkSession.builder)
    monkeypatch.setattr(builder, "enableHiveSupport", lambda self: asked.append("hive") or self)
    monkeypatch.setattr(builder, "getOrCreate", lambda self: "session")
    assert session.build_session(catalog="hive") == "session" and asked == ["hive"]
    assert session.build_session() == "session" and asked == ["hive"]
    with pytest.raises(ValueError):
        session.build_session(catalog="other")
