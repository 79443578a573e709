import random
import statistics

import pytest
from pyspark.sql import functions as F

from lendscope.operators import quantiles

DIST = dict(buckets=8, collect_limit=5)


@pytest.mark.parametrize("kw", [{}, DIST])
def test_odd_even_allnull_nonull(spark, kw):
    df = spark.createDataFrame(
        [(1.0, 1.0, None, 5), (3.0, 2.0, None, 1), (2.0, 10.0, None, 3), (None, 4.0, None, 2)],
        "odd double, even double, none double, ints int")
    got = quantiles.exact_medians(df, ["odd", "even", "none", "ints"], **kw)
    assert got == {"odd": 2.0, "even": 3.0, "none": None, "ints": 2.5}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_distributed_matches_statistics_median(spark, seed):
    rnd = random.Random(seed)
    vals = [rnd.choice([rnd.random() * 1e6, float(rnd.randint(0, 20)), -rnd.random()]) for _ in range(3001 + seed)]
    df = spark.createDataFrame([(v,) for v in vals], "x double").repartition(4)
    got = quantiles.exact_medians(df, ["x"], **DIST)["x"]
    assert got == pytest.approx(statistics.median(vals), rel=0, abs=1e-9)


def test_heavy_duplicates(spark):
    # One value holds most rows: ranks resolve when a bucket has a single value.
    vals = [7.0] * 5000 + [1.0, 2.0, 100.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    assert quantiles.exact_medians(df, ["x"], **DIST)["x"] == 7.0


def test_filtered_median(spark):
    df = spark.createDataFrame([(a,) for a in [100, 101, 144, None, 20, 30]], "age int")
    for kw in ({}, DIST):
        assert quantiles.exact_median(df, "age", where=F.col("age") <= 100, **kw) == 30.0


def test_fixture_medians(apps_mid):
    got = quantiles.exact_medians(apps_mid, ["emp_length", "rate", "age"], **dict(DIST, buckets=64, collect_limit=50))
    assert got == {"emp_length": 20.0, "rate": 14.31, "age": 44.0}


@pytest.mark.parametrize("kw", [{}, DIST])
def test_special_values_have_one_rule(spark, kw):
    inf, nan = float("inf"), float("nan")
    cases = {
        "nan": [51.0, nan, 76.0, nan, 40.0], "one_inf": [1.0, 2.0, 3.0, 4.0, inf], "most_inf": [1.0, inf, inf, inf], "both": [-inf, 1.0, 2.0, inf],
        "half": [-inf, -inf, 3.0, 4.0], "tiny": [5e-324, 1e-323, 1.5e-323, 0.0], "wide": [-1.7e308, 1.7e308, 1.0, 2.0, 1.6e308]}
    for name, values in cases.items():
        got = quantiles.exact_medians(spark.createDataFrame([(v,) for v in values * 7], "x double"), ["x"], **kw)["x"]
        kept = sorted(v for v in values * 7 if v == v)
        low, high = kept[(len(kept) - 1) // 2], kept[len(kept) // 2]
        want = low if low == high else 0.5 * low + 0.5 * high
        assert got == want or (got != got and want != want), name


def passes(spark, df, run):
    """How often ``run`` reads ``df`` as a whole."""
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        read.add(1)
        yield from batches

    run(df.mapInArrow(count, df.schema))
    return read.value / df.rdd.getNumPartitions()


def test_two_passes_at_any_size(spark):
    from lendscope.operators import clean, profile

    df = spark.range(40_000).select((F.col("id") * 7919 % 40_009).cast("double").alias("x"), F.when(F.col("id") % 9 > 0, F.col("id") % 1000).cast("int").alias("y")).repartition(4).cache()
    assert passes(spark, df, lambda d: quantiles.exact_medians(d, ["x", "y"])) == 2
    assert passes(spark, df, lambda d: quantiles.exact_medians(d, ["x", "y"], **DIST)) == 2  # the rest is read from the stored counts
    assert passes(spark, df, lambda d: profile.summary_stats(d, "x").collect()) == 2
    assert passes(spark, df, lambda d: clean.fit_median_imputer(d, ["x", "y"])) == 2


@pytest.mark.parametrize("kw", [{}, DIST])
def test_a_bracket_that_misses_is_found_out(spark, kw):
    values = [float(i * 37 % 1001) for i in range(1001)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for lo, hi in ((0.0, 10.0), (900.0, 1000.0), (600.0, 600.5), (500.0, 500.0)):
        assert quantiles.exact_medians(df, ["x"], first={"x": quantiles.Bracket(1001, lo, hi)}, **kw) == {"x": 500.0}


def test_groups_are_merged(spark):
    """More input partitions than groups: counts, sums and deviations are those of all rows."""
    rnd = random.Random(4)
    vals = [rnd.gauss(1e6, 3.0) for _ in range(2000)]
    df = spark.createDataFrame([(v,) for v in vals], "x double").repartition(37)
    before, quantiles.GROUPS = quantiles.GROUPS, 5
    try:
        x = quantiles.value("x")
        row = quantiles.two_level(df, {"n": quantiles.counted(x), "s": quantiles.summed(x), "d": quantiles.spread(x), "lo": quantiles.smallest(x), "hi": quantiles.largest(x)})
        assert (row.n, row.lo, row.hi) == (2000, min(vals), max(vals)) and row.s == pytest.approx(sum(vals))
        assert quantiles.deviation(row.d) == pytest.approx(statistics.stdev(vals), rel=1e-9)
        assert quantiles.exact_medians(df, ["x"])["x"] == pytest.approx(statistics.median(vals), abs=1e-9)
    finally:
        quantiles.GROUPS = before
