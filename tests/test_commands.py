import json

import pytest

from lakejobs import jobs
from lakejobs.plans import stored, views
from lakejobs.sinks.files import write_csv_n, write_escaped
from lakejobs.sources.files import read_escaped

SF = "/root/testdata/sf0.001"


def test_daily_wind_with_a_box(spark, out):
    write_csv_n(views.weather(spark, SF), out, 3, header=True)
    days = jobs.main(["daily-wind", out, "--bbox=-125,24,-66,50"], spark)
    assert days.columns == ["ymd", "max_wind_speed"] and days.count() > 0
    assert jobs.main(["daily-wind", out], spark).count() == 0
    with pytest.raises(SystemExit):
        jobs.parser().parse_args(["daily-wind", out, "--bbox=1,2,3"])


def test_convert(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    write_csv_n(views.reviews(spark, SF, *views.REVIEW_COLUMNS), source, 1, sep="\t", header=True, compression="gzip")
    jobs.main(["convert", source, target, "--files", "5"], spark)
    back = spark.read.parquet(target)
    assert set(t for _, t in back.dtypes) == {"string"} and back.count() == 6000
    assert len(back.inputFiles()) == 5
    jobs.main(["convert", source, target, "--files", "3", "--csv"], spark)
    assert len(spark.read.csv(target).inputFiles()) == 3


def test_top_products(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    write_escaped(views.reviews(spark, SF, *views.REVIEW_COLUMNS), source, header=True)
    jobs.main(["top-products", source, target, "--category", "ECONOMY", "--top", "7"], spark)
    schema = "product_id string, product_title string, reviews bigint, mean_rating double"
    rows = read_escaped(spark, target, schema, skip_header=False).collect()
    assert len(rows) == 7 and all(1 <= r["mean_rating"] <= 5 for r in rows)


def test_air_averages(spark, tmp_path):
    day = tmp_path / "2024-01-02"
    day.mkdir()
    reading = {"country": "US", "parameter": "pm25", "unit": "u", "coordinates": {"longitude": 0.5, "latitude": 0.5}}
    lines = [
        reading | {"location": "A", "value": 1.0, "date": {"utc": "2024-01-02T01:00:00.000Z"}},
        reading | {"location": "A", "value": 7.0, "date": {"utc": "2024-01-02T02:00:00.000Z"}},
        reading | {"location": "B", "value": 9.0, "date": {"utc": "2024-01-02T01:30:00.000Z"}},
        reading | {"location": "C", "value": 99.0, "country": "MX", "date": {"utc": "2024-01-02T01:30:00.000Z"}},
    ]
    (day / "a.json").write_text("\n".join(map(json.dumps, lines)))
    square = [[[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]]]
    features = [
        {"ord": 0, "properties": {"GEOID": "1", "STUSPS": "NY", "NAME": "one"}},
        {"ord": 1, "properties": {"GEOID": "2", "STUSPS": "AK", "NAME": "two"}},
    ]
    regions = [json.dumps(f | {"geometry": {"type": "Polygon", "coordinates": square}}) for f in features]
    (tmp_path / "regions.json").write_text("\n".join(regions))
    out = str(tmp_path / "out")
    jobs.main(["air-averages", str(tmp_path), str(tmp_path / "regions.json"), out, "--date", "2024-01-02"], spark)
    assert [r.asDict() for r in spark.read.parquet(out).collect()] == [
        {"geoid": "1", "STUSPS": "NY", "NAME": "one", "avg_value": 8.0}
    ]


def test_weather_map(spark, out):
    grid = stored.grid_store(spark, SF)
    jobs.main(["weather-map", grid, out, "--columns", "8"], spark)
    rows = spark.read.parquet(out)
    assert rows.count() == 64 and {"pressure_hpa", "temperature_f", "precipitation"} <= set(rows.columns)


def test_recommender_and_file_stats(spark, out):
    source = stored.by_category(spark, SF)
    assert 0 < jobs.main(["recommender", source, out, "--blocks", "2"], spark) < 10
    result = jobs.main(["file-stats", source, "star_rating"], spark)
    assert {(r["column"], r["min"], r["max"], r["nulls"]) for r in result.collect()} == {("star_rating", "1", "5", 0)}


@pytest.mark.parametrize("kind, files", [("sorted", 4), ("ranges", 4), ("folders", 5), ("buckets", 4)])
def test_layout_and_sql(spark, tmp_path, kind, files):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    views.reviews(spark, SF, "review_id", "product_id", "star_rating").write.parquet(source)
    key = {"folders": "star_rating", "buckets": "review_id"}.get(kind, "product_id")
    jobs.main(["layout", source, out, key, "--kind", kind, "--parts", "4", "--table", "command_buckets"], spark)
    back = spark.read.parquet(out)
    assert back.count() == 6000 and len(back.inputFiles()) == files
    shown = jobs.main(["sql", f"SELECT count(*) AS n FROM parquet.`{out}`"], spark)
    assert shown.first()["n"] == 6000


def test_database_arguments():
    assert "daily-wind" in jobs.parser().format_help()
    args = jobs.parser().parse_args(["database", "jdbc:x", "users", "d", "--column", "id", "--bounds", "0,9", "--partitions", "3"])
    assert (args.url, args.bounds, args.partitions) == ("jdbc:x", "0,9", 3)
