import uuid

from pyspark.sql import functions as F

import __spark_entry__ as E
from lendscope.operators import joins
from lendscope.sources import tables

from .conftest import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_stored_table_is_joined_by_its_bytes(spark):
    big = spark.range(1000).select((F.col("id") % 7).alias("k"), F.col("id"))
    small = joins.stored(big.groupBy("k").agg(F.count(F.lit(1)).alias("n")))
    a = big.join(small, "k", "left")
    assert "BroadcastHashJoin" in _plan(a)
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        b = big.join(small, "k", "left")
        assert "BroadcastHashJoin" not in _plan(b)
        rows_b = sorted(map(tuple, b.collect()))
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert sorted(map(tuple, a.collect())) == rows_b


def test_risk_level_broadcasts_checked_rates(spark):
    plan = _plan(E.queries()["risk_level"](spark, SF_SMALL))
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") >= 2


def test_materialized_view_equals_view(spark, tmp_path):
    m = tables.materialize_applications(spark, SF_SMALL, str(tmp_path / "apps"), buckets=4)
    v = tables.applications(spark, SF_SMALL)
    assert m.count() == v.count() == 1500
    assert m.exceptAll(v).count() == 0 and v.exceptAll(m).count() == 0


def test_copartitioned_view_moves_no_row(spark, tmp_path):
    """Both tables lie in buckets of the customer key: no exchange under the join, also where nothing is broadcast."""
    name = f"apps_{uuid.uuid4().hex[:8]}"
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        view = tables.copartitioned_applications(spark, SF_SMALL, name, str(tmp_path), buckets=4)
        tables.use_copartitioned(SF_SMALL, name)
        for k, v in conf.items():
            spark.conf.set(k, v)
        plan = _plan(tables.applications(spark, SF_SMALL))
        assert "SortMergeJoin" in plan and "Exchange" not in plan and "Bucketed: true" in plan
        tables.use_copartitioned(SF_SMALL, None)
        plain = tables.applications(spark, SF_SMALL)
        assert "Exchange" in _plan(plain)
        assert view.exceptAll(plain).isEmpty() and view.count() == plain.count() == 1500
    finally:
        tables.use_copartitioned(SF_SMALL, None)
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
        for t in ("orders", "customer"):
            spark.sql(f"DROP TABLE IF EXISTS {name}_{t}")


def test_rates_of_missing_groups(spark):
    """A null group has its own rate."""
    from unittest import mock

    from lendscope.plans import catalog

    apps = tables.applications(spark, SF_SMALL).withColumn("home", F.when(F.col("home") != "RENT", F.col("home")))
    with mock.patch.object(catalog, "_apps", lambda *_: apps):
        assert E.queries()["risk_level"](spark, SF_SMALL).where("confidence is null").isEmpty()
