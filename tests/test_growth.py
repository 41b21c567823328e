"""What is shuffled and stored grows no faster than the rows."""

from pyspark.sql import functions as F

from lakejobs.plans import views
from lakejobs.sinks.files import write_partitioned


def test_texts_are_made_after_the_rebalancing(spark, out):
    rows = [(k % 3, None if k % 7 == 0 else f"n{k}") for k in range(60)] + [(None, "x"), (1, "n1")]
    df = spark.createDataFrame(rows, "folder int, name string")
    made = [F.concat_ws(" ", "name", F.lit("for all")).alias("body"), F.col("folder")]
    write_partitioned(df, out, ["folder"], made=made)
    got = sorted(((r.folder, r.body) for r in spark.read.parquet(out).collect()), key=str)
    assert got == sorted(((f, " ".join(filter(None, [n, "for all"]))) for f, n in rows), key=str)


def test_orders_meet_their_markets_before_the_lines(spark, tmp_path):
    def table(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))

    table("lineitem", [(1, 1, 5), (1, 2, 5), (2, 1, 6), (2, 1, 6), (None, 1, 5), (3, 1, 5), (9, 1, 5)], "l_orderkey long, l_linenumber int, l_partkey long")
    table("orders", [(1, 10), (2, 11), (2, 10), (3, None), (None, 10)], "o_orderkey long, o_custkey long")
    table("customer", [(10, 0), (11, 1), (11, 1), (None, 0)], "c_custkey long, c_nationkey int")
    table("nation", [(0, 0), (1, 1)], "n_nationkey int, n_regionkey int")
    table("region", [(0, "ASIA"), (1, "EUROPE")], "r_regionkey int, r_name string")
    made = views.reviews(spark, str(tmp_path), "review_id", "marketplace", "customer_id")
    got = sorted((r.review_id, r.marketplace, r.customer_id) for r in made.collect())
    line = [("2-1", "ASIA", "10"), ("2-1", "EUROPE", "11"), ("2-1", "EUROPE", "11")]
    assert got == sorted([("1-1", "ASIA", "10"), ("1-2", "ASIA", "10"), *line, *line])
    # The side of the lines has one join above it, not one for each table.
    plan = made._jdf.queryExecution().optimizedPlan().toString().split("\n")
    above = [row.index("Join") for row in plan if "Join" in row]
    assert above[0] == min(above) and above.count(above[0]) == 1
    lines = next(row for row in plan if "l_linenumber" in row and "Relation" in row)
    orders = next(row for row in plan if "o_custkey" in row and "Relation" in row)
    assert lines.index("Relation") < orders.index("Relation")
