from pyspark.sql import functions as F

from lendscope.operators import evaluate, split


def _allocate(spark, counts, fraction=0.2):
    sizes = spark.createDataFrame(list(counts.items()), "c int, n long")
    return {r.c: r.want for r in split.allocate(sizes, fraction).collect()}


def test_allocate_matches_published_split(spark):
    # 32,581 rows with classes 25,473 / 7,108 give a 5,095 / 1,422 test side.
    assert _allocate(spark, {0: 25473, 1: 7108}) == {0: 5095, 1: 1422}
    many = {i: 3 + i % 4 for i in range(3000)}  # classes are not bounded
    want = _allocate(spark, many)
    assert sum(want.values()) == -(-sum(many.values()) // 5) and all(0 <= want[c] <= many[c] for c in many)


def test_hash_threshold():
    assert split.hash_threshold(0.2) == "33333333"


def test_stratified_split_exact_and_stable(spark, apps_mid):
    a = split.stratified_split(apps_mid, "app_id", "status", 0.2, 42)
    sizes = {(r.is_test, r.status): r.rows for r in split.split_sizes(a, "status").collect()}
    want = _allocate(spark, {0: 9679, 1: 5321})
    assert sizes[(True, 0)] == want[0] and sizes[(True, 1)] == want[1]
    assert sum(sizes.values()) == 15000
    # Same membership with one digit at a time (several radix levels) and after repartitioning.
    b = split.stratified_split(apps_mid.repartition(3), "app_id", "status", 0.2, 42, digits=1)
    ta = {r.app_id for r in a.where("is_test").select("app_id").collect()}
    tb = {r.app_id for r in b.where("is_test").select("app_id").collect()}
    assert ta == tb
    # Equals a plain per-class ranking by (hash, id).
    from pyspark.sql import Window
    h = apps_mid.withColumn("h", split.split_hash(apps_mid, "app_id", 42))
    w = Window.partitionBy("status").orderBy("h", "app_id")
    ranked = h.withColumn("rn", F.row_number().over(w))
    plain = {r.app_id for r in ranked.where(
        ((F.col("status") == 0) & (F.col("rn") <= want[0])) | ((F.col("status") == 1) & (F.col("rn") <= want[1]))
    ).collect()}
    assert ta == plain


def _cm_frame(spark, cells):
    parts = []
    for (a, p), n in cells.items():
        parts.append(spark.range(n).select(F.lit(a).alias("label"), F.lit(p).alias("pred")))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def test_golden_report(spark):
    df = _cm_frame(spark, {(0, 0): 5043, (0, 1): 52, (1, 0): 517, (1, 1): 905})
    s = evaluate.report_summary(df, "label", "pred").first()
    assert (s.accuracy, s.accuracy_percent) == (0.9127, 91.3)
    assert (s.precision_rejected, s.recall_rejected) == (0.907, 0.9898)
    assert (s.precision_approved, s.recall_approved) == (0.9457, 0.6364)
    assert [list(r) for r in s.confusion_matrix] == [[5043, 52], [517, 905]]
    rep = {r.row_name: r for r in evaluate.classification_report(df, "label", "pred").collect()}
    assert rep["0"].support == 5095 and rep["1"].support == 1422
    assert rep["weighted avg"].support == 6517


def test_zero_cells_and_no_predictions(spark):
    df = _cm_frame(spark, {(0, 0): 3})
    cm = {(r.actual, r.predicted): r["count"] for r in evaluate.confusion_matrix(df, "label", "pred").collect()}
    assert cm == {(0, 0): 3, (0, 1): 0, (1, 0): 0, (1, 1): 0}
    rep = {r.row_name: r for r in evaluate.classification_report(df, "label", "pred").collect()}
    assert rep["1"].precision == 0.0 and rep["1"].recall == 0.0


def test_golden_approval_rate(spark):
    from lendscope.operators import profile
    df = spark.range(32581).select((F.col("id") < 7108).cast("int").alias("status"))
    r = profile.overview(df, "status").first()
    assert (r.total_records, r.approved_count, r.rejected_count, r.approval_rate) == (32581, 7108, 25473, 21.8)


def test_split_with_hot_class(spark):
    # One class holds 90% of the rows; tiny buckets force several radix levels.
    df = spark.range(5000).select(F.col("id").alias("app_id"), (F.col("id") % 10 == 0).cast("int").alias("status"))
    out = split.stratified_split(df, "app_id", "status", 0.2, 7, digits=1)
    sizes = {(r.is_test, r.status): r.rows for r in split.split_sizes(out, "status").collect()}
    want = _allocate(spark, {0: 4500, 1: 500})
    assert sizes[(True, 0)] == want[0] and sizes[(True, 1)] == want[1] and sum(sizes.values()) == 5000


def test_split_keeps_rows_without_or_with_shared_ids(spark):
    df = spark.range(1000).select(F.when(F.col("id") % 10 == 0, None).otherwise(F.col("id")).alias("app_id"), (F.col("id") % 3 == 0).cast("int").alias("status"), F.col("id").alias("v"))
    for frame in (df, df.withColumn("app_id", F.lit(5).cast("long")), df.withColumn("app_id", F.lit(None).cast("long"))):
        out = split.stratified_split(frame, "app_id", "status", 0.2, 42)
        sizes = {(r.is_test, r.status): r.rows for r in split.split_sizes(out, "status").collect()}
        want = _allocate(spark, {0: 666, 1: 334})
        assert sum(sizes.values()) == 1000 and sizes[(True, 0)] == want[0] and sizes[(True, 1)] == want[1]
        assert out.where("is_test is null").count() == 0
        again = split.stratified_split(frame.repartition(3), "app_id", "status", 0.2, 42)
        assert sorted(r.v for r in out.where("is_test").collect()) == sorted(r.v for r in again.where("is_test").collect())
        assert split.hash_split(frame, "app_id").where("is_test is null").count() == 0


def test_split_of_equal_rows_and_null_classes(spark):
    same = spark.range(100).select(F.lit(1).cast("long").alias("app_id"), F.lit(0).alias("status"))
    assert {r.is_test for r in split.stratified_split(same, "app_id", "status").collect()} == {False}  # told apart by nothing
    none = spark.range(50).select(F.col("id").alias("app_id"), F.when(F.col("id") < 40, 1).alias("status"))
    out = split.stratified_split(none, "app_id", "status")
    assert out.count() == 50 and out.where("is_test").count() == 8 and out.where("is_test and status is null").count() == 0
    assert split.stratified_split(none.limit(0), "app_id", "status").count() == 0


def test_rows_outside_the_classes_count(spark):
    df = spark.createDataFrame([(0, 0), (1, 1), (2, 1), (None, 0), (1, None)], "label int, pred int")
    cm = {(r.actual, r.predicted): r["count"] for r in evaluate.confusion_matrix(df, "label", "pred").collect()}
    assert cm == {(0, 0): 1, (0, 1): 0, (1, 0): 0, (1, 1): 1, (None, None): 3}
    row = evaluate.accuracy(df, "label", "pred").first()
    assert (row.accuracy, row.test_rows) == (0.4, 5)


def test_many_classes(spark):
    """A thousand classes: the report is as long as the classes; the full matrix is made on request."""
    import pytest

    df = spark.range(6000).select((F.col("id") % 1000).cast("int").alias("label"), F.when(F.col("id") < 5000, F.col("id") % 1000).otherwise(F.col("id") % 7).cast("int").alias("pred"))
    assert evaluate.confusion_cells(df, "label", "pred").count() < 2100
    cm = evaluate.confusion_matrix(df, "label", "pred", classes=range(1000))
    assert tuple(cm.agg(F.count("*"), F.sum("count")).first()) == (1_000_000, 6000)
    rep = {r.row_name: r for r in evaluate.classification_report(df, "label", "pred", classes=range(1000)).collect()}
    assert len(rep) == 1002 and rep["500"].recall == round(5 / 6, 4) and rep["500"].precision == 1.0 and rep["500"].support == 6
    assert rep["weighted avg"].support == 6000 and rep["macro avg"].recall == pytest.approx(5 / 6, abs=2e-3)
    names = evaluate.classification_report(df.select(F.col("label").cast("string").alias("label"), F.col("pred").cast("string").alias("pred")), "label", "pred", classes=["1", "2"], names={"1": "one"})
    assert {r.row_name for r in names.collect()} == {"one", "2", "macro avg", "weighted avg"}


def test_bands_that_miss_are_found_out(spark, apps_mid):
    """Bands of no width hold no boundary, so every class takes the radix selection; the rows are the same."""
    a = split.stratified_split(apps_mid, "app_id", "status", 0.2, 42)
    b = split.stratified_split(apps_mid, "app_id", "status", 0.2, 42, band=-1.0, digits=2)
    assert {r.app_id for r in a.where("is_test").collect()} == {r.app_id for r in b.where("is_test").collect()}


def test_split_reads_the_rows_twice(spark, apps_mid):
    from .test_quantiles import passes

    df = apps_mid.select("app_id", "status").repartition(4).cache()
    assert passes(spark, df, lambda d: split._thresholds(d, "app_id", "status", 0.2, 42, 3, split.BAND)) == 2


def test_split_of_many_small_classes(spark):
    df = spark.range(4000).select(F.col("id").alias("app_id"), (F.col("id") % 611).alias("status"))
    out = split.stratified_split(df, "app_id", "status", 0.3, 1)
    got = {r.status: r.rows for r in split.split_sizes(out, "status").where("is_test").collect()}
    sizes = df.groupBy(F.col("status").alias("c")).agg(F.count("*").alias("n"))
    want = {r.c: r.want for r in split.allocate(sizes, 0.3).collect() if r.want}
    assert got == want and sum(got.values()) == 1200


def test_few_classes_are_allotted_alike(spark):
    import random

    rng = random.Random(3)
    for _ in range(4):
        counts = {i: rng.randrange(1, 60) for i in range(rng.randrange(1, 30))}
        for fraction in (0.2, 0.33, 0.5):
            assert split.allocate_few(counts, fraction) == _allocate(spark, counts, fraction)
    assert split.allocate_few({0: 25473, 1: 7108}, 0.2) == {0: 5095, 1: 1422}
    assert split.allocate_few({}, 0.2) == {}


def test_split_with_sizes_as_tables(spark, apps_mid, monkeypatch):
    a = {r.app_id for r in split.stratified_split(apps_mid, "app_id", "status", 0.2, 42).where("is_test").collect()}
    monkeypatch.setattr(split, "FEW", 0)
    assert {r.app_id for r in split.stratified_split(apps_mid, "app_id", "status", 0.2, 42).where("is_test").collect()} == a
