"""Places of lines and files, boxes, and layouts by bytes."""

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lakejobs.operators import filters, grid, recommend
from lakejobs.operators.layout import files_per_key, keep_ranges, kept_ranges, key_ranges, touched_in
from lakejobs.operators.skew import parts_by_bytes, row_bytes
from lakejobs.operators.spatial import locate_first
from lakejobs.sinks import files as sink
from lakejobs.sources import catalog
from lakejobs.sources import files as source
from lakejobs.sources.polygons import read_polygons


@pytest.fixture
def small_splits(spark):
    """Files are read in blocks of some hundred bytes."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_only_the_first_line_is_a_header(spark, tmp_path, small_splits):
    rng = random.Random(1)
    want = Counter()
    for k in range(6):
        rows = [rng.choice([("id", "t"), ("ID", "T"), ("Id", "t"), (str(k), "x" * rng.randrange(9)), ("", "")]) for _ in range(300)]
        lines = ["\t".join(r) for r in rows]
        # Two files have no header: what they begin with is a row, unless it looks like one.
        header = [["id\tt"], ["ID\tT"], ["id\tt"], ["iD\tt"], [], []][k]
        if not header:
            lines.insert(0, "first\trow")
            rows.insert(0, ("first", "row"))
        (tmp_path / f"{k}.tsv").write_text("\n".join(header + lines) + "\n")
        want.update(rows)
    assert spark.read.text(str(tmp_path)).select("_metadata.file_block_start").distinct().count() > 2
    got = source.read_escaped(spark, str(tmp_path), "id string, t string").collect()
    assert Counter(tuple(r) for r in got) == want
    every = source.read_escaped(spark, str(tmp_path), "id string, t string", skip_header=False).count()
    assert every == sum(want.values()) + 4


def test_rows_equal_to_the_header_come_back(spark, out, small_splits):
    rows = [("id", "t"), ("ID", "T"), ("1", "x")] * 40
    df = spark.createDataFrame(rows, "id string, t string").repartition(3)
    sink.write_escaped(df, out, header=True)
    assert sorted(tuple(r) for r in source.read_escaped(spark, out, "id string, t string").collect()) == sorted(rows)


def test_no_number_is_in_no_box(spark):
    nan = float("nan")
    rows = [(0, 1.0, 1.0), (1, nan, 1.0), (2, 1.0, nan), (3, None, 1.0), (4, 185.0, 1.0), (5, 1.0, None)]
    df = spark.createDataFrame(rows, "id int, lon double, lat double")
    for box, wide in (((0, -90, 359.9, 90), True), ((180, -90, 300, 90), True), ((-180, -90, 180, 90), False), ((0, -90, 360, 90), True)):
        assert {r["id"] for r in filters.in_box(df, "lon", "lat", box, wide).collect()} <= {0, 4}
    texts = spark.createDataFrame([("1.0", "2.0"), ("NaN", "2.0")], "lon string, lat string")
    assert filters.in_box(texts.selectExpr("double(lon) AS lon", "double(lat) AS lat"), "lon", "lat", (-180, -90, 180, 90)).count() == 1


def feature(name, side, **more):
    square = [[[0, 0], [side, 0], [side, side], [0, side]]]
    return json.dumps({"type": "Feature", "properties": {"id": name}, "geometry": {"type": "Polygon", "coordinates": square}} | more)


def test_polygons_of_several_files_are_in_order(spark, tmp_path, small_splits):
    names = []
    for k in range(4):
        own = [f"{k}-{i:02d}" for i in range(25)]
        (tmp_path / f"part{k}.json").write_text("\n".join(feature(n, 1 + len(names) + i) for i, n in enumerate(own)) + "\n")
        names += own
    polygons = read_polygons(spark, str(tmp_path), ["id"])
    assert [r["id"] for r in polygons.orderBy("ord").collect()] == names
    # Every polygon holds those before it: a point is found in the first that reaches it.
    points = spark.range(1, 101).select("id", (F.col("id") - 0.5).alias("v"))
    found = locate_first(points.withColumnRenamed("id", "n"), polygons, "v", "v", "id", 7.0)
    assert {r["n"]: r["id"] for r in found.collect()} == {n: names[n - 1] for n in range(1, 101)}


def test_a_given_order_wins(spark, tmp_path):
    (tmp_path / "a.json").write_text(feature("late", 2, ord=9) + "\n")
    (tmp_path / "b.json").write_text(feature("early", 2, ord=-1) + "\n")
    assert [r["id"] for r in read_polygons(spark, str(tmp_path), ["id"]).orderBy("ord").collect()] == ["early", "late"]


@pytest.mark.parametrize("stored", [True, False])
def test_files_have_equal_bytes(spark, out, tmp_path, stored):
    """Rows of low keys are wide and those of high keys narrow; one key holds a third of the bytes."""
    wide = F.repeat(F.lit("x"), F.when(F.col("id") % 100 < 10, 2000).otherwise(5).cast("int"))
    key = F.when(F.col("id") % 100 == 50, F.lit(None)).when(F.col("id") % 5 == 4, 77).otherwise(F.col("id") % 100)
    text = F.when(F.col("id") % 5 == 4, F.repeat(F.lit("y"), 500)).otherwise(wide)
    df = spark.range(20_000).select(key.cast("int").alias("k"), F.concat(F.col("id").cast("string"), text).alias("t"))
    if stored:
        df.write.parquet(str(tmp_path / "in"))
        df = spark.read.parquet(str(tmp_path / "in"))
    sink.write_ranged(df, out, "k", 12)
    back = spark.read.parquet(out)
    assert back.count() == 20_000 and back.exceptAll(df).isEmpty()
    sizes = back.groupBy(F.col("_metadata.file_path")).agg(F.sum(row_bytes(back)).alias("b"), F.min("k").alias("low"), F.max("k").alias("high"), F.count("*").alias("n"))
    rows = sizes.collect()
    share = sum(r["b"] for r in rows) / 12
    largest = max(r["b"] for r in back.where("k <> 77").groupBy("k").agg(F.sum(row_bytes(back)).alias("b")).collect())
    assert len(rows) == 12 and max(r["b"] for r in rows) < 1.15 * share + largest
    assert max(r["n"] for r in rows) > 4 * min(r["n"] for r in rows)
    spread = files_per_key(back, "k").where("files > 1").collect()
    assert [r["k"] for r in spread] == [77] and spread[0]["files"] >= 4


@pytest.mark.parametrize("kind", ["double", "string", "date", "struct"])
def test_ranges_of_any_type(spark, out, kind):
    value = {"double": "if(id % 7 = 0, double('NaN'), cast(id % 50 AS double))", "string": "if(id % 7 = 0, NULL, concat('é', id % 50))", "date": "date_add(date'2020-01-01', int(id % 50))", "struct": "struct(id % 5 AS a, if(id % 3 = 0, NULL, id % 50) AS b)"}[kind]
    df = spark.range(2000).selectExpr(f"{value} AS k", "id")
    sink.write_sorted(df, out, "k", 6)
    back = spark.read.parquet(out)
    assert sorted(r["id"] for r in back.collect()) == list(range(2000))
    assert back.select("_metadata.file_path").distinct().count() == 6
    assert files_per_key(back, "k").where("files > 1").count() <= 1
    sink.write_sorted(df.where("false"), out, "k")
    assert spark.read.parquet(out).count() == 0


def test_kept_ranges_are_those_of_the_files(spark, out):
    df = spark.range(1000).select((F.col("id") % 100).alias("k"), "id")
    sink.write_ranged(df, out, "k", 5)
    keep_ranges(spark, out, "k")
    assert sorted(kept_ranges(spark, out).collect()) == sorted(key_ranges(spark.read.parquet(out), "k").collect())
    assert touched_in(kept_ranges(spark, out), "k", [42]).first()["files_touched"] == 1
    assert parts_by_bytes(df, 2) == 2 and parts_by_bytes(df, 2, 4800) == 10


def test_a_grid_in_chunks_equals_the_whole(spark):
    nlat, nlon = 5, 7
    rows = [(t, m, [float(1000 * t + 100 * k + i) if i != 9 else None for i in range(nlat * nlon)]) for t in range(3) for k, m in enumerate("pqr") if (t, m) != (2, "r")]
    whole = spark.createDataFrame(rows, "time int, measure string, values array<double>")
    names = {"p": "a", "q": "b", "r": "c"}
    cells, want = (sorted(map(str, d.collect())) for d in (grid.explode_grid(whole, "values", nlon), grid.align(whole, names, "values", nlon)))
    assert len(want) == 2 * (nlat * nlon - 1)
    odd = (F.col("measure") == "q") & (F.col("time") == 1)
    for height, width in ((1, 1), (2, 3), (5, 7), (9, 9), (F.when(odd, 4).otherwise(2), F.when(odd, 2).otherwise(3))):
        chunks = grid.cut_chunks(whole, "values", nlon, height, width)
        assert sorted(map(str, grid.explode_chunks(chunks, "values").collect())) == cells
        assert sorted(map(str, grid.align_chunks(chunks, names, "values").collect())) == want
    twice = grid.cut_chunks(whole, "values", nlon, 2, 3)
    with pytest.raises(Exception, match="two arrays"):
        grid.align_chunks(twice.union(twice), names, "values").collect()


def test_tables_that_a_folder_holds(spark, tmp_path):
    for name in ("b", "a b"):
        spark.range(3).write.parquet(str(tmp_path / f"{name}.parquet"))
    (tmp_path / "note.txt").write_text("x")
    found = catalog.stored_tables(spark, str(tmp_path))
    assert list(found) == ["a b", "b"] and spark.read.parquet(found["b"]).count() == 3
    (tmp_path / "region.parquet").mkdir()
    spark.range(5).write.mode("overwrite").parquet(str(tmp_path / "region.parquet"))
    assert list(catalog.stored_tables(spark, f"file://{tmp_path}")) == ["a b", "b", "region"]


def test_error_of_stored_predictions(spark):
    df = spark.createDataFrame([(1.0, 2.0), (5.0, 2.0), (3.0, None), (None, 1.0)], "r double, prediction double")
    assert recommend.rmse_of(df, "r") == pytest.approx(5**0.5)
