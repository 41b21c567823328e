import gzip
from datetime import date
from pathlib import Path

import pyarrow
import pyarrow.parquet
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakejobs import constants as K
from lakejobs.operators.layout import column_stats, file_counts, file_stats, files_per_key, files_touched, key_ranges
from lakejobs.operators.skew import broadcast_if_small, hot_keys, join_one_per_key, parts_for, salted, stored_rows
from lakejobs.sinks import files as sink
from lakejobs.sinks import tables
from lakejobs.sources import catalog
from lakejobs.sources import files as source
from lakejobs.sources.jdbc import jdbc_options
from lakejobs.sources.polygons import read_polygons


def test_header_names_columns_and_all_are_strings(spark, tmp_path):
    path = tmp_path / "a.tsv.gz"
    path.write_bytes(gzip.compress(b"id\tname\n1\tx\n2\ty\n"))
    df = source.read_delimited(spark, str(path))
    assert df.dtypes == [("id", "string"), ("name", "string")]
    assert df.count() == 2
    assert source.read_path_like(df, "%tsv.gz").count() == 2
    assert source.read_path_like(df, "%csv").count() == 0


def test_declared_types_over_a_directory(spark, tmp_path):
    (tmp_path / "a.csv").write_text("DATE,N\n2021-01-01T00:00:00,1\n")
    (tmp_path / "b.csv").write_text("DATE,N\n2021-01-02T00:00:00,bad\n")
    rows = source.read_delimited(spark, str(tmp_path), "DATE string, N int", sep=",").orderBy("DATE").collect()
    assert [tuple(r) for r in rows] == [("2021-01-01T00:00:00", 1), ("2021-01-02T00:00:00", None)]


def test_escaped_text(spark, tmp_path):
    lines = [
        "id\ttitle\tstars\tday",
        "a\tone\\\ttwo\t4\t2015-08-31",
        "b\tback\\\\\t5\t2015-08-30",
        "c\tx\tmany\tsoon",
        "d\t\\N",
    ]
    (tmp_path / "a.tsv").write_text("\n".join(lines) + "\n")
    schema = "id string, title string, stars int, day date"
    got = {r["id"]: tuple(r)[1:] for r in source.read_escaped(spark, str(tmp_path), schema).collect()}
    assert got == {
        "a": ("one\ttwo", 4, date(2015, 8, 31)),
        "b": ("back\\", 5, date(2015, 8, 30)),
        "c": ("x", None, None),
        "d": (None, None, None),
    }
    with_header = source.read_escaped(spark, str(tmp_path), schema, skip_header=False)
    assert with_header.count() == 5


_TEXT = st.text(alphabet="ab\t\n\r\\N ,\"'é#", max_size=8)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(st.tuples(st.none() | _TEXT, st.none() | st.integers(-9, 9)), min_size=1, max_size=30), header=st.booleans())
def test_escaped_text_round_trip(spark, tmp_path_factory, rows, header):
    out = str(tmp_path_factory.mktemp("text") / "out")
    sink.write_escaped(spark.createDataFrame(rows, "t string, n int"), out, header=header)
    back = [tuple(r) for r in source.read_escaped(spark, out, "t string, n int", skip_header=header).collect()]
    assert sorted(back, key=str) == sorted(rows, key=str)


def test_each_file_begins_with_the_header(spark, out):
    sink.write_escaped(spark.range(20).repartition(3).withColumn("t", F.lit("x")), out, header=True)
    files = sorted(Path(out).glob("part-*"))
    assert len(files) == 3
    assert all(f.read_text().startswith("id\tt\n") and f.read_text().count("id") == 1 for f in files)


def test_leading_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("ann,33,90210,extra\nbob,x,1,extra\n")
    df = source.read_leading(spark, str(tmp_path), {"name": "string", "age": "int"})
    assert sorted(tuple(r) for r in df.collect()) == [("ann", 33), ("bob", None)]


def test_partition_folder_alone_and_with_its_column(spark, out):
    df = spark.createDataFrame([(1, "Toys"), (2, "Books")], "n int, product_category string")
    sink.write_partitioned(df, out, ["product_category"])
    assert set(source.read_partitioned(spark, out).columns) == {"n", "product_category"}
    alone = source.read_partitioned(spark, out, "product_category=Toys")
    assert alone.columns == ["n"] and alone.count() == 1
    kept = source.read_partitioned(spark, out, "product_category=Toys", keep_partition=True)
    assert [tuple(r) for r in kept.select("n", "product_category").collect()] == [(1, "Toys")]


def test_json_day(spark, tmp_path):
    day = tmp_path / "2024-01-02"
    day.mkdir()
    (day / "a.json.gz").write_bytes(
        gzip.compress(b'{"value": 1.5, "date": {"utc": "t1"}}\n{"value": null, "date": {"utc": "t2"}}\n')
    )
    df = source.read_json_day(spark, str(tmp_path), "2024-01-02", "value double, date struct<utc:string>")
    assert sorted((r["date"]["utc"], r["value"]) for r in df.collect()) == [("t1", 1.5), ("t2", None)]
    assert source.read_json_day(spark, str(tmp_path), "2024-01-02").count() == 2


def test_number_of_files(spark, out, tmp_path):
    rows = spark.range(1000)
    sink.write_parquet_n(rows, out, 10)
    counts = [r["n"] for r in file_counts(spark.read.parquet(out)).collect()]
    assert len(counts) == 10 and max(counts) - min(counts) <= 10
    sink.write_csv_n(rows, str(tmp_path / "csv"), 4)
    assert len(list((tmp_path / "csv").glob("*.csv"))) == 4
    assert parts_for(rows, 1, 300) == 4 and parts_for(rows, 10) == 10


def skewed(spark):
    """3000 rows in 300 keys; a third of the rows has one key."""
    key = F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 300)
    return spark.range(3000).select(key.cast("int").alias("k"), F.col("id").alias("review_id"))


def test_hot_keys_are_few_and_salted(spark):
    df = skewed(spark)
    assert [r[0] for r in hot_keys(df, "k", 10).collect()] == [7]
    nulls = df.withColumn("k", F.when(F.col("k") != 7, F.col("k")))
    assert [r[0] for r in hot_keys(nulls, "k", 10).collect()] == [None]
    for rows in (stored_rows(df), stored_rows(nulls)):
        marked = salted(rows, "k", 10, "s")
        assert marked.count() == 3000
        hot = F.col("k").isNull() | (F.col("k") == 7)
        assert marked.where(~hot).agg(F.max("s")).first()[0] == 0
        assert marked.where(hot).select("s").distinct().count() == 10


def test_exact_copies_are_spread_too(spark, out):
    key = F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 300)
    copies = spark.range(3000).select(key.cast("int").alias("k"), F.lit("same").alias("v"))
    rows = stored_rows(copies.repartition(3))
    assert stored_rows(rows) is rows
    marked = salted(rows, "k", 10, "s").where("k = 7").groupBy("s").count()
    assert marked.count() == 10 and marked.agg(F.max("count")).first()[0] < 200
    sink.write_ranged(rows, out, "k", 10)
    back = spark.read.parquet(out)
    assert sorted(back.collect()) == sorted(copies.collect())
    assert file_counts(back).agg(F.max("n")).first()[0] < 900


@pytest.mark.parametrize("writer", [sink.write_sorted, sink.write_ranged])
def test_sorted_and_ranged_files(spark, out, writer):
    df = skewed(spark)
    writer(df, out, "k", 10)
    back = spark.read.parquet(out)
    assert sorted(back.collect()) == sorted(df.collect())
    ranges = sorted((r["low"], r["high"], r["rows"]) for r in key_ranges(back, "k").collect())
    # Neighbours may share the hot key and nothing else.
    assert all(a[1] < b[0] or a[1] == b[0] == 7 for a, b in zip(ranges, ranges[1:]))
    assert max(r[2] for r in ranges) < 900
    spread = files_per_key(back, "k").where(F.col("files") > 1).collect()
    assert [r["k"] for r in spread] == [7]


def test_statistics_compare_values_not_texts(spark, out):
    rows = [(9, -2.5, "9"), (10, 30.0, "10"), (57, None, None), (2, -10.25, "57")]
    spark.createDataFrame(rows, "k int, v double, t string").repartition(4).write.parquet(out)
    scan = spark.read.parquet(out)
    got = {r["column"]: tuple(r)[1:] for r in column_stats(scan, ["k", "v", "t"]).collect()}
    assert got == {"k": (4, "2", "57", 0), "v": (4, "-10.25", "30.0", 1), "t": (4, "10", "9", 1)}
    assert sum(r["rows"] for r in file_stats(scan, ["k"]).collect()) == 4


def test_escaped_text_holds_marks_and_other_separators(spark, tmp_path):
    rows = [("a\x01b\x02c", "p|q"), ("\x01a\x01b\x01c", "\\x\\"), ("\x02", "\n\r\t"), (None, "")]
    for k, sep in enumerate(("\t", "|", "\x01", ".")):
        path = str(tmp_path / str(k))
        df = spark.createDataFrame(rows, "one string, two string")
        sink.write_escaped(df, path, sep=sep)
        back = source.read_escaped(spark, path, "one string, two string", sep=sep)
        assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    (tmp_path / "h").mkdir()
    (tmp_path / "h" / "x.tsv").write_text("One\tTWO\n1\t2\n")
    assert [tuple(r) for r in source.read_escaped(spark, str(tmp_path / "h"), "one string, two string").collect()] == [("1", "2")]


def test_files_touched_by_layout(spark, out, tmp_path):
    df = skewed(spark).withColumn("k", F.format_string("%04d", "k"))
    sink.write_ranged(df, out, "k", 10)
    tables.write_bucketed(df, "touched_bucketed", "review_id", 10, str(tmp_path / "b"))
    ranged = {r["k"]: r for r in files_touched(spark.read.parquet(out), "k", ["0100", "9999"]).collect()}
    bucketed = files_touched(spark.read.parquet(str(tmp_path / "b")), "k", ["0100"]).first()
    assert ranged["0100"]["files_touched"] == 1 and ranged["9999"]["files_touched"] == 0
    assert ranged["9999"]["bytes_touched"] == 0
    assert bucketed["files_touched"] == bucketed["files"] >= 10
    assert bucketed["bytes_touched"] > ranged["0100"]["bytes_touched"]


def test_buckets_serve_a_join_without_shuffle(spark, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("left_b", "right_b"):
            tables.write_bucketed(skewed(spark), name, "review_id", 4, str(tmp_path / name))
        joined = spark.table("left_b").join(spark.table("right_b"), "review_id")
        assert joined.count() == 3000
        assert "Exchange hashpartitioning" not in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_hot_bucket_is_written_by_several_tasks(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        one_key = spark.range(60_000).select(F.lit(1).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
        tables.write_bucketed(one_key.repartition(8), "hot_bucket", "k", 4, str(tmp_path / "hot"))
        assert file_counts(spark.read.parquet(str(tmp_path / "hot"))).count() > 1
        sink.write_partitioned(one_key.repartition(8), str(tmp_path / "part"), ["k"])
        assert file_counts(spark.read.parquet(str(tmp_path / "part"))).count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")


def test_tables_insert_preview_and_catalog(spark, tmp_path):
    name = tables.ensure_table(spark, "shop", "demo", "id int, name string, value int", str(tmp_path / "demo"))
    assert tables.ensure_table(spark, "shop", "demo", "id int, name string, value int") == name
    rows = [(1, "ann", 33), (2, "bob", 34)]
    tables.insert_rows(catalog.literal_rows(spark, rows, "id int, name string, value int"), name)
    assert sorted(tuple(r) for r in tables.preview(catalog.table(spark, "shop.demo"), 50)) == rows
    assert len(tables.preview(spark.table(name), 1)) == 1
    assert ("shop",) in [tuple(r) for r in catalog.databases(spark).collect()]
    assert "demo" in [r["tableName"] for r in catalog.tables(spark, "shop").collect()]
    described = [tuple(r)[1:3] for r in catalog.describe(spark.table(name)).collect()]
    assert described == [("id", "int"), ("name", "string"), ("value", "int")]
    counted = catalog.run_sql(spark, "SELECT name, count(*) AS n FROM {t} GROUP BY 1 ORDER BY 1", t=spark.table(name))
    assert [tuple(r) for r in counted.collect()] == [("ann", 1), ("bob", 1)]


def test_newest_partition_is_a_partition_filter(spark, tmp_path):
    df = spark.createDataFrame([("a.x.com", 1), ("b.x.com", 2), ("c.y.com", 2)], "name string, date int")
    tables.write_partitioned_table(df, "names", ["date"], str(tmp_path / "names"))
    newest = catalog.newest_rows(spark.table("names"), "date", F.col("name").like("%.x.com"))
    assert [tuple(r) for r in newest.collect()] == [("b.x.com", 2)]
    plan = newest._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan and "ubquery" in plan.split("PartitionFilters")[1]


def test_time_column_by_metadata_then_by_type(spark, out):
    df = spark.sql("SELECT timestamp_ntz'2020-01-01' AS made, timestamp_ntz'2020-01-02' AS time1, 1 AS v")
    assert catalog.time_column(df.schema) == "made"
    catalog.mark_time_column(df, "time1").write.parquet(out)
    assert catalog.time_column(spark.read.parquet(out).schema) == "time1"
    with pytest.raises(ValueError):
        catalog.time_column(df.select("v").schema)


def test_jdbc_options():
    plain = jdbc_options("jdbc:x", "users", "d.Driver", "u", "p")
    assert plain == {
        "url": "jdbc:x", "dbtable": "users", "driver": "d.Driver", "user": "u", "password": "p", "fetchsize": "10000"
    }
    split = jdbc_options("jdbc:x", "users", "d.Driver", column="id", bounds=(0, 99), partitions=4)
    assert (split["partitionColumn"], split["lowerBound"], split["upperBound"], split["numPartitions"]) == (
        "id", "0", "99", "4"
    )
    with pytest.raises(ValueError):
        jdbc_options("jdbc:x", "users", "d.Driver", column="id")


def test_polygons_from_geojson_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text(
        '{"type":"Feature","ord":1,"properties":{"id":"p"},"geometry":{"type":"Polygon",'
        '"coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}}\n'
        '{"type":"Feature","ord":2,"properties":{"id":"m"},"geometry":{"type":"MultiPolygon",'
        '"coordinates":[[[[0,0],[1,0],[1,1],[0,0]]],[[[5,5],[6,5],[6,6],[5,5]]]]}}\n'
    )
    rows = read_polygons(spark, str(tmp_path), ["id"]).orderBy("ord").collect()
    assert [(r["ord"], r["id"], len(r["rings"])) for r in rows] == [(1, "p", 1), (2, "m", 2)]
    assert rows[1]["rings"][1][0].asDict() == {"x": 5.0, "y": 5.0}


def test_broadcast_only_when_counted_small(spark):
    def hinted(df):
        return "broadcast" in df._jdf.queryExecution().analyzed().toString().lower()

    assert hinted(broadcast_if_small(spark.range(10), limit=10))
    assert not hinted(broadcast_if_small(spark.range(11), limit=10))
    wide = spark.range(3).select("id", F.repeat(F.lit("é"), 500).alias("t"), F.array(F.lit(None).cast("string"), F.lit("x")).alias("a"))
    assert hinted(broadcast_if_small(wide, most=4000)) and not hinted(broadcast_if_small(wide, most=3000))
    assert hinted(broadcast_if_small(wide.where("false"), most=0))


@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_keys_are_joined_apart(spark, how):
    rows = skewed(spark).withColumn("k", F.when(F.col("k") != 7, F.col("k")))
    one = spark.range(1, 250).select(F.col("id").cast("int").alias("j"), (F.col("id") * 2).alias("v"))
    one = one.unionByName(spark.sql("SELECT CAST(NULL AS INT) AS j, -1L AS v"))
    plain = rows.join(one, rows["k"].eqNullSafe(one["j"]), how).drop("j")
    small = join_one_per_key(rows, one, "k", "j", how)
    large = join_one_per_key(rows, one, "k", "j", how, limit=0, share=10)
    want = sorted(map(str, plain.collect()))
    assert sorted(map(str, small.collect())) == want == sorted(map(str, large.collect()))
    assert "Union" in plan_text(large) and "Union" not in plan_text(small)


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_review_schema_has_all_columns(spark):
    assert len(source.as_struct(spark, K.REVIEW_SCHEMA).fields) == 15
