"""Every registered query against its SQL, and the plans that must hold at scale."""

import re

import pytest
from check import differences, duck

import __spark_entry__ as entry
from lakejobs import plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) & set(plans.SQL)))
def test_query_equals_sql(spark, con, name):
    assert differences(plans.QUERIES[name](spark, SF), con, plans.SQL[name]) == ""


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["ymd", "max_wind_speed"] and df.count() > 0


def test_only_the_model_has_no_sql():
    assert set(plans.QUERIES) - set(plans.SQL) == {"als_rmse"}
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_recommender_scores_the_held_out_ratings(spark):
    row = plans.QUERIES["als_rmse"](spark, SF).first()
    assert row["held_out"] > 0 and 0 < row["rmse"] < 10


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_no_pairs_of_all_rows_and_no_python(spark, name):
    plan = plan_of(plans.QUERIES[name](spark, SF))
    assert not re.search("CartesianProduct|NestedLoopJoin|EvalPython|MapInPandas|MapInArrow", plan)


def test_reports_read_only_the_tables_and_columns_they_need(spark):
    plan = plan_of(plans.QUERIES["top_products_count_avg"](spark, SF))
    schemas = sorted(re.findall(r"ReadSchema: struct<([^>]*)>", plan))
    assert schemas == ["l_partkey:bigint,l_quantity:double", "p_partkey:bigint,p_name:string,p_type:string"]
    assert "EqualTo(p_type,ECONOMY)" in plan and "TakeOrderedAndProject" in plan


def test_partitioned_reads_are_pruned(spark):
    plan = plan_of(plans.QUERIES["pruned_top10"](spark, SF))
    found = plan.split("PartitionFilters:")[1].split("PushedFilters")[0]
    assert "marketplace" in found and "review_year" in found


def test_latest_reading_scans_once_and_aggregates_before_the_shuffle(spark):
    df = plans.QUERIES["latest_distinct"](spark, SF)
    # The readings were read and aggregated to one row per station and place before this plan.
    plan = plan_of(df)
    assert "events.parquet" not in plan and "Window" not in plan and "SortMergeJoin" not in plan
