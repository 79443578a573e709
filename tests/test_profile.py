
from lendscope.operators import profile
from lendscope.schema import AGE_BIN_EDGES, AGE_BIN_LABELS


def test_binned_counts_edges_and_empty_bin(spark):
    ages = [0, 1, 18, 25, 26, 30, 31, 40, 41, 50, 51, 200, 201, None]
    df = spark.createDataFrame([(a,) for a in ages], "age int")
    rows = profile.binned_counts(df, "age", AGE_BIN_EDGES, AGE_BIN_LABELS).collect()
    assert [r["bin"] for r in rows] == AGE_BIN_LABELS
    # (0,25]: 1,18,25 ; (25,30]: 26,30 ; (30,35]: 31 ; (35,40]: 40 ; (40,50]: 41,50 ; (50,200]: 51,200
    assert [r["count"] for r in rows] == [3, 2, 1, 1, 2, 2]
    only_old = spark.createDataFrame([(60,)], "age int")
    counts = [r["count"] for r in profile.binned_counts(only_old, "age", AGE_BIN_EDGES, AGE_BIN_LABELS).collect()]
    assert counts == [0, 0, 0, 0, 0, 1]


def test_bin_expr_labels(spark):
    df = spark.createDataFrame([(25,), (26,), (None,), (0,)], "age int")
    lab, ordn = profile.bin_expr("age", AGE_BIN_EDGES, AGE_BIN_LABELS)
    got = [(r[0], r[1]) for r in df.select(lab, ordn).collect()]
    assert got == [("18-25", 0), ("26-30", 1), (None, None), (None, None)]


def test_value_counts_multi_keeps_columns_apart(spark):
    df = spark.createDataFrame([("A", "x"), ("A", None), (None, "x"), ("B", "y")], "a string, b string")
    got = {(r.column_name, r.value): r["count"] for r in profile.value_counts_multi(df, ["a", "b"]).collect()}
    assert got == {("a", "A"): 2, ("a", "B"): 1, ("b", "x"): 2, ("b", "y"): 1}


def test_null_counts_and_overview(spark):
    df = spark.createDataFrame([(1, None), (0, 2.0), (1, 3.0)], "status int, x double")
    nulls = {r.column_name: r.null_count for r in profile.null_counts(df).collect()}
    assert nulls == {"status": 0, "x": 1}
    ov = profile.overview(df, "status").first()
    assert (ov.total_records, ov.approved_count, ov.rejected_count, ov.approval_rate) == (3, 2, 1, 66.7)


def test_rate_by_group_null_key(spark):
    df = spark.createDataFrame([("A", 1), ("A", 0), (None, 1)], "k string, status int")
    got = {r.k: r.approval_rate for r in profile.rate_by_group(df, "k", "status").collect()}
    assert got == {"A": 50.0}
    got = {r.k: r.approval_rate for r in profile.rate_by_group(df, "k", "status", keep_null_group=True).collect()}
    assert got == {"A": 50.0, None: 100.0}


def test_summary_stats_half_even(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (None,)], "x double")
    r = profile.summary_stats(df, "x").first()
    assert (r["mean"], r["median"], r["min"], r["max"]) == (2.33, 2.0, 1.0, 4.0)
    assert abs(r["std"] - 1.53) < 1e-9


def test_summary_stats_skip_nan(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (float("nan"),), (None,)], "x double")
    r = profile.summary_stats(df, "x").first()
    assert (r["mean"], r["median"], r["min"], r["max"], r["std"]) == (1.5, 1.5, 1.0, 2.0, 0.71)
    assert tuple(profile.summary_stats(df.where("x = 5"), "x").first()) == (None,) * 5
    assert profile.summary_stats(df.where("x = 1"), "x").first()["std"] is None


def test_ten_thousand_bins(spark):
    import bisect
    from pyspark.sql import functions as F
    edges = [i * 0.7 - 50 for i in range(10_001)]
    labels = [f"b{i}" for i in range(10_000)]
    values = [edges[0], edges[1], edges[-1], edges[-1] + 1, -1e9, float("nan"), None, *(i * 0.337 - 60 for i in range(3000)), *edges[::97]]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    label, ordinal = profile.bin_expr("x", edges, labels)
    for x, name, at in df.select("x", label, ordinal).collect():
        want = bisect.bisect_left(edges, x) - 1 if x is not None and x == x else -1
        want = want if 0 <= want < 10_000 else None
        assert at == want and name == (None if want is None else labels[want])
    rows = profile.binned_counts(df, "x", edges, labels)
    assert rows.count() == 10_000 and rows.agg(F.sum("count")).first()[0] == df.where(ordinal.isNotNull()).count()


def test_distribution_sums_equal_rows(apps_mid):
    n = apps_mid.count()
    for c in ("intent", "home", "default_flag"):
        assert sum(r["count"] for r in profile.value_counts(apps_mid, c).collect()) == n


def test_fixture_facts_sf001(apps_mid):
    """FIXTURES F5 facts at sf0.01."""
    status = {r.status: r["count"] for r in profile.value_counts(apps_mid, "status").collect()}
    assert status == {0: 9679, 1: 5321}
    home = {r.home: r["count"] for r in profile.value_counts(apps_mid, "home").collect()}
    assert home == {"MORTGAGE": 6068, "RENT": 5918, "OWN": 2958, "OTHER": 56}
    nulls = {r.column_name: r.null_count for r in profile.null_counts(apps_mid, ["emp_length", "rate"]).collect()}
    assert nulls == {"emp_length": 406, "rate": 1364}
