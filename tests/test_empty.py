"""Every operator on an empty table: defined results, nothing fails."""

import pytest
from pyspark.sql import functions as F

from lendscope.operators import clean, encode, evaluate, profile, split
from lendscope.plans import reports
from lendscope.sources.tables import applications

from .conftest import SF_SMALL


@pytest.fixture(scope="module")
def none(spark):
    return applications(spark, SF_SMALL).limit(0).cache()


def test_codes_counts_and_bins(none):
    assert encode.label_codes(none, ["home", "intent"]).isEmpty()
    assert profile.ranked_counts(profile.value_counts(none, "home"), "home").isEmpty()
    assert [tuple(r) for r in profile.binned_counts(none, "age", [0, 10, 20], ["a", "b"]).collect()] == [(0, "a", 0), (1, "b", 0)]
    assert profile.rate_by_group(none, "intent", "status").isEmpty()


def test_statistics(none):
    assert tuple(profile.summary_stats(none, "income").first()) == (None,) * 5
    found = clean.fit_median_imputer(none, ["income", "rate"])
    assert found.null_counts == {"income": 0, "rate": 0} and found.fill_values == {}
    stats = {(r.section, r.key): r.value for r in reports.dataset_stats(none).collect()}
    assert stats["total_records", None] == 0 and stats["approval_rate", None] is None and stats["income_stats", "median"] is None


def test_evaluation_and_split(none):
    rows = none.withColumn("p", F.col("status"))
    assert [r["count"] for r in evaluate.confusion_matrix(rows, "status", "p").collect()] == [0, 0, 0, 0]
    report = {r.row_name: r for r in evaluate.classification_report(rows, "status", "p").collect()}
    assert report["0"].precision == 0.0 and report["weighted avg"].recall is None and report["macro avg"].support == 0
    assert tuple(evaluate.accuracy(rows, "status", "p").first()) == (None, None, 0)
    assert split.stratified_split(none, "app_id", "status").isEmpty()
