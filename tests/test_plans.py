"""Plan checks: no Python in the row path, no single-task global window, pushdown."""

import pytest

import __spark_entry__ as E

from .conftest import SF_SMALL

PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["dataset_stats", "factors_long", "split_exact", "validate_api",
                                  "clean_applications", "risk_level", "class_report"])
def test_no_python_udf(spark, name):
    plan = _plan(E.queries()[name](spark, SF_SMALL))
    assert not any(p in plan for p in PYTHON_NODES)


def test_split_has_no_global_window(spark):
    plan = _plan(E.queries()["split_exact"](spark, SF_SMALL))
    assert "Window" not in plan and "SinglePartition" not in plan and "SortMergeJoin" not in plan


@pytest.mark.parametrize("name", ["rf_score", "rf_score_factors"])
def test_scoring_is_one_pass_without_python(spark, name):
    plan = _plan(E.queries()[name](spark, SF_SMALL))
    assert not any(p in plan for p in (*PYTHON_NODES, "MapInArrow"))
    for table in ("o_orderkey", "c_custkey", "column_name"):  # orders and customer once, the code table for each category
        assert plan.count(f"FileScan parquet [{table}") == (3 if table == "column_name" else 1)
    assert plan.count("FileScan") == 5 and "Exchange hashpartitioning" not in plan


def test_dataset_stats_has_one_expand(spark):
    df = E.queries()["dataset_stats"](spark, SF_SMALL)
    df.collect()
    final = _plan(df).split("Initial Plan")[0]
    assert final.count("Expand") == 1


def test_scan_prunes_columns(spark):
    plan = _plan(E.queries()["rate_by_intent"](spark, SF_SMALL))
    assert "FileScan parquet" in plan
    assert "c_name" not in plan and "o_orderdate" not in plan


@pytest.mark.parametrize("name", ["rate_by_intent", "value_counts_all", "age_bins", "confusion_matrix"])
def test_aggregations_combine_map_side(spark, name):
    # A key holding a third of all rows is collapsed inside each map task
    # (partial aggregation) before the exchange.
    assert "partial_" in _plan(E.queries()[name](spark, SF_SMALL))


def test_hot_key_group_rate(spark):
    from pyspark.sql import functions as F
    from lendscope.operators import profile
    # One key holds a third of the rows.
    df = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, F.lit("HOT")).otherwise((F.col("id") % 101).cast("string")).alias("k"),
        (F.col("id") % 2).cast("int").alias("status")).repartition(8)
    got = {r.k: (r.approval_rate, r.applications) for r in profile.rate_by_group(df, "k", "status").collect()}
    assert got["HOT"] == (50.0, 10000)
    assert sum(n for _, n in got.values()) == 30000
