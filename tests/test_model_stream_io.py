"""Model fit, persistence, batch and stream scoring, and file sources (small forest)."""

import dataclasses
import json
import threading

import pytest
from pyspark.sql import functions as F

from lendscope.operators import encode, model, quality, score
from lendscope.plans import model_queries, reports, training
from lendscope.schema import AGE_BIN_LABELS
from lendscope.sources import files
from lendscope.streaming import scoring as stream

SMALL = training.TrainConfig(forest=model.ForestParams(num_trees=20, max_depth=8))


@pytest.fixture(scope="module")
def trained(spark, apps_mid):
    return training.train(spark, apps_mid, SMALL)


def test_model_finds_signal(trained):
    # Majority share at sf0.01 is 9,679 / 15,000 = 0.645.
    assert trained.summary["accuracy"] > 0.7
    assert trained.sizes == {"train_rows": 12000, "test_rows": 3000}
    assert abs(sum(r.importance for r in trained.importance.collect()) - 1.0) < 2e-3
    home = {r.label: r.code for r in trained.codes.where("column_name = 'home'").collect()}
    assert home == {"MORTGAGE": 0, "OTHER": 1, "OWN": 2, "RENT": 3}
    stats = {(r.section, r.key): r.value for r in trained.stats.collect()}
    for section in ("intent_distribution", "age_distribution"):
        assert sum(v for (s, _), v in stats.items() if s == section) == stats["total_records", None] == 15000


def test_save_load_and_scoring_equal(spark, trained, tmp_path, apps_mid):
    path = str(tmp_path / "model")
    model.save_model(trained.pipeline, path)
    loaded = model.load_model(path)
    valid = apps_mid.where(F.col("rate").isNotNull() & F.col("emp_length").isNotNull() & (F.col("age") <= 100))
    a = score.score(valid, trained.pipeline, trained.codes, columns={}, keep=["app_id"])
    b = score.score(valid, loaded, trained.codes, columns={}, keep=["app_id"])
    ra = {r.app_id: (r.prediction_code, r.confidence) for r in a.collect()}
    rb = {r.app_id: (r.prediction_code, r.confidence) for r in b.collect()}
    assert ra == rb
    confs = [c for _, c in ra.values()]
    assert min(confs) >= 50.0 and max(confs) <= 100.0


def test_refused_rows_have_reasons_and_no_results(spark, trained, apps_mid):
    from lendscope.operators import quality

    checked = quality.validate(apps_mid, quality.API_RULES)
    out = score.score(checked, trained.pipeline, trained.codes, columns={}, keep=["app_id", "violations"], refused=F.size("violations") > 0)
    refused = out.where(F.size("violations") > 0)
    assert out.count() == 15000 and 0 < refused.count() < 15000
    assert refused.where("prediction is not null or confidence is not null or risk_level is not null or factors is not null").count() == 0
    assert out.where(F.size("violations") == 0).where("prediction is null or confidence is null or risk_level is null").count() == 0


def test_report_roundtrip(spark, trained, tmp_path):
    path = str(tmp_path / "report")
    reports.write_report(spark, trained.report, path)
    rep = reports.read_report(spark, path)
    row = rep.first()
    assert row.n_estimators == 20 and row.dataset_stats.total_records == 15000
    key = lambda r: (r.column_name, r.code)
    assert sorted(reports.encoding_codes(rep).collect(), key=key) == sorted(trained.codes.collect(), key=key)
    text = "".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    doc = json.loads(text)
    assert list(doc) == ["model_type", "accuracy", "accuracy_percent", "n_estimators", "feature_columns", "encoding_maps", "feature_importance",
                         "classification_report", "dataset_stats", "confusion_matrix"]
    assert list(doc["encoding_maps"]) == ["Home", "Intent", "Default"] and list(doc["encoding_maps"]["Home"].values()) == [0, 1, 2, 3]
    importance = list(doc["feature_importance"].values())
    assert importance == sorted(importance, reverse=True) and len(importance) == 10
    ds = doc["dataset_stats"]
    assert list(ds)[:5] == ["total_records", "approved_count", "rejected_count", "approval_rate", "intent_distribution"] and len(ds) == 13
    assert list(ds["age_distribution"]) == AGE_BIN_LABELS and list(ds["income_stats"]) == ["mean", "median", "min", "max", "std"]
    counts = list(ds["intent_distribution"].values())
    assert counts == sorted(counts, reverse=True) and all(isinstance(c, int) for c in counts)
    info = reports.model_info(rep).first()
    assert info.feature_columns[0] == "Age" and info.model_name == "Random Forest"
    summary = reports.model_summary(rep).collect()
    assert [r.position for r in summary] == list(range(1, 11))
    assert summary[3].label == "Emp Length"


def test_report_of_many_and_odd_labels(spark, trained, tmp_path):
    """Every label is an entry of the document, written in order by one task; odd ones are escaped."""
    odd = ['a "quote"', "back\\slash", "two\nlines", "é漢\U0001f600", "", "nan"]
    labels = spark.createDataFrame([(x,) for x in odd], "home string").unionByName(spark.range(20_000).select(F.concat(F.lit("x"), F.col("id")).alias("home")))
    codes = encode.label_codes(labels, ["home"])
    path = str(tmp_path / "report")
    reports.write_report(spark, dataclasses.replace(trained.report, codes=codes), path)
    doc = json.loads("".join(r.value for r in spark.read.text(path, wholetext=True).collect()))
    assert list(doc["encoding_maps"]["Home"].items()) == [(x, i) for i, x in enumerate(sorted([*odd, *(f"x{i}" for i in range(20_000))]))]
    assert doc["encoding_maps"]["Intent"] == {} and doc["encoding_maps"]["Default"] == {}
    rep = reports.read_report(spark, path)
    assert reports.encoding_codes(rep).exceptAll(codes).isEmpty() and reports.report_rows(rep).where("section = 'encoding_maps'").count() == 20_006
    empty = dataclasses.replace(trained.report, codes=codes.limit(0), stats=trained.stats.limit(0), importance=trained.importance.limit(0))
    reports.write_report(spark, empty, path + "2")
    assert json.loads("".join(r.value for r in spark.read.text(path + "2", wholetext=True).collect()))["dataset_stats"]["rate_stats"] == {}


def test_saved_model_has_its_codes(spark, trained, tmp_path):
    model_path, report_path = str(tmp_path / "model"), str(tmp_path / "report")
    training.save(spark, trained, model_path, report_path)
    training.save(spark, trained, model_path, report_path)  # overwrites both
    _, codes = training.load(spark, model_path)
    assert codes.exceptAll(trained.codes).isEmpty() and codes.count() == trained.codes.count()


def test_stream_equals_batch(spark, trained, tmp_path, apps_mid):
    src = tmp_path / "requests"
    req = apps_mid.limit(500).select(
        "app_id", "age", "income", "home", "emp_length", "intent", "amount", "rate", "percent_income",
        F.col("default_flag").alias("default"), "cred_length")
    req.repartition(3).write.json(str(src))
    out = str(tmp_path / "scored")
    q = stream.start_scoring_stream(spark, str(src), trained.pipeline, trained.codes, out,
                                    checkpoint=str(tmp_path / "ckpt"), keep=["app_id"])
    q.awaitTermination(120)
    streamed = {r.app_id: (r.prediction, r.confidence, list(r.violations)) for r in spark.read.parquet(out).collect()}
    batch_in = files.read_scoring_json(spark, str(src), ["app_id"])
    batch = {r.app_id: (r.prediction, r.confidence, list(r.violations))
             for r in stream.scored_records(batch_in, trained.pipeline, trained.codes, ["app_id"]).collect()}
    assert len(streamed) == 500 and streamed == batch


def test_csv_source_null_tokens(spark, tmp_path):
    p = tmp_path / "apps.csv"
    p.write_text(
        "Id,Age,Income,Home,Emp_length,Intent,Amount,Rate,Status,Percent_income,Default,Cred_length\n"
        "1,22,59000,RENT,123,PERSONAL,35000,16.02,1,0.59,Y,3\n"
        "2,21,9600,OWN,5,EDUCATION,1000,NA,0,0.1,N,2\n"
        "3,,9600,MORTGAGE,nan,MEDICAL,5500,12.87,1,0.57,N,3\n"
        "4,abc,NaN,RENT,1,MEDICAL,#N/A,15.23,1,0.53,N,2\n")
    df = files.read_applications_csv(spark, str(p))
    rows = df.orderBy("app_id").collect()
    assert df.columns[:3] == ["app_id", "age", "income"]
    assert rows[1].rate is None and rows[2].age is None and rows[2].emp_length is None
    assert rows[3].age is None and rows[3].income is None and rows[3].amount is None
    assert rows[0].default_flag == "Y" and rows[0].percent_income == 0.59


def test_csv_whole_numbers_quotes_and_rejects(spark, tmp_path):
    p = tmp_path / "apps.csv"
    p.write_text(
        "Id,Age,Income,Home,Emp_length,Intent,Amount,Rate,Status,Percent_income,Default,Cred_length\n"
        '1.0,22.0,59000,"RE ""x"" NT, y",1e1,PERSONAL,35000,16.02,1.0,0.59,Y,3.0\n'
        '2,21.5,9600,"two\nlines",5,EDUCATION,1000,NA,x,0.1,N,1e1\n')
    rows = files.read_applications_csv(spark, str(p), rejects=True).orderBy("app_id").collect()
    assert (rows[0].app_id, rows[0].age, rows[0].status, rows[0].cred_length, rows[0].emp_length) == (1, 22, 1, 3, 10.0)
    assert rows[0].home == 'RE "x" NT, y' and rows[1].home == "two\nlines"
    assert rows[1].age is None and rows[1].cred_length == 10 and rows[1].rejects == {"age": "21.5", "status": "x"} and rows[0].rejects == {}


def test_write_scored_and_column_types(spark, trained, tmp_path, apps_mid):
    from lendscope.operators import profile
    valid = apps_mid.where(F.col("rate").isNotNull() & F.col("emp_length").isNotNull()).limit(50)
    out = score.score(valid, trained.pipeline, trained.codes, columns={}, keep=["app_id"])
    files.write_scored(out, str(tmp_path / "scored"))
    back = spark.read.parquet(str(tmp_path / "scored"))
    assert back.count() == 50 and dict(back.dtypes)["factors"] == "map<string,string>"
    types = {r.column_name: r.data_type for r in profile.column_types(apps_mid).collect()}
    assert types["app_id"] == "bigint" and types["income"] == "double" and types["home"] == "string"


def test_stream_query_matches_batch_query(spark, apps_mid):
    import __spark_entry__ as E
    from tests.conftest import SF_SMALL
    from lendscope.plans import model_queries
    key = (spark.sparkContext.applicationId, SF_SMALL, repr(None))
    apps = __import__("lendscope.sources.tables", fromlist=["applications"]).applications(spark, SF_SMALL)
    had = model_queries._TRAINED.pop(key, None)
    model_queries._TRAINED[key] = training.train(spark, apps, SMALL)
    try:
        batch = {r.app_id: (r.prediction, r.confidence, r.violations) for r in E.queries()["rf_score"](spark, SF_SMALL).collect()}
        streamed = {r.app_id: (r.prediction, r.confidence, r.violations)
                    for r in E.queries()["rf_stream_score"](spark, SF_SMALL).collect()}
    finally:
        model_queries._TRAINED.pop(key)
        if had is not None:
            model_queries._TRAINED[key] = had
    assert streamed == batch


def test_train_only_cleaning_and_table_materialisation(spark):
    from lendscope.sources.tables import applications
    from tests.conftest import SF_SMALL
    cfg = training.TrainConfig(forest=model.ForestParams(num_trees=5, max_depth=4), fit_cleaning_on="train",
                               materialize="table")
    res = training.train(spark, applications(spark, SF_SMALL), cfg)
    assert res.sizes["train_rows"] + res.sizes["test_rows"] == 1500
    assert res.report.scalars["n_estimators"] == 5
    # Medians were fitted on training rows only: emp_length's fill differs from the whole-table median only
    # if the split moved it; either way it is one of the observed half-steps.
    assert res.impute.null_counts["emp_length"] > 0
    assert float(res.impute.fill_values["emp_length"]) * 2 == int(float(res.impute.fill_values["emp_length"]) * 2)


def test_chart_and_kpis_with_model(spark, trained, apps_mid):
    stats = reports.dataset_stats(apps_mid)
    chart = reports.chart_series(stats, trained.importance)
    imp = {r.label: r.value for r in chart.where(F.col("series") == "importance").collect()}
    assert len(imp) == 10 and "Emp Length" in imp and "Percent Income" in imp
    assert abs(sum(imp.values()) - 100.0) < 0.2
    kpis = {r.name: r.text for r in reports.kpi_rows(stats, trained.summary["accuracy_percent"]).collect()}
    assert kpis["total_applications"] == "15,000" and kpis["model_accuracy"].endswith("%")
    assert kpis["approval_rate"] == "35.5%" and kpis["rejection_rate"] == "64.5%"


def test_few_partitions_are_dealt_out_for_the_forest(spark):
    rows = spark.range(0, 60_000, 1, 1).select("id", (F.col("id") % 7).cast("double").alias("x"))
    n = 60_000 // training.LEAST_ROWS
    out = training.spread(rows, 60_000)
    parts = out.rdd.getNumPartitions()
    assert 2 <= parts == min(n, 3 * spark.sparkContext.defaultParallelism) and out.exceptAll(rows).isEmpty() and out.count() == 60_000
    assert training.spread(rows, 15_000) is rows


def test_forest_grown_a_few_trees_at_a_time(spark, tmp_path):
    """Over many rows no fit has all trees; the joined forest answers with all of them, also when saved and loaded."""
    assert model.trees_at_a_time(1000) == (None, 1)
    sizes = [model.trees_at_a_time(n)[0] for n in (720_000, 43_200_000)]
    assert sizes == sorted(sizes, reverse=True) and all(s < model.ForestParams().num_trees for s in sizes)
    rows = spark.range(2000).select("id", ((F.col("id") * 7919) % 101).cast("double").alias("x"), ((F.col("id") * 104729) % 97).cast("double").alias("y"))
    rows = encode.assemble(rows.withColumn("status", ((F.col("x") > 50) != (F.col("y") > 30)).cast("int")), ["x", "y"]).cache()
    params = model.ForestParams(num_trees=5, max_depth=4, features_per_split="1")
    whole = model.fit_forest(rows, params)
    forest = model.fit_forest(rows, params, at_a_time=2, side_by_side=2)
    assert forest.getNumTrees == len(forest.trees) == 5 and len({t.toDebugString.split("\n", 1)[1] for t in forest.trees}) == 5
    assert (forest.numFeatures, forest.numClasses) == (whole.numFeatures, whole.numClasses) == (2, 2)
    assert abs(sum(forest.featureImportances.toArray()) - 1) < 1e-9
    answers = lambda m: [(r.id, r.prediction_code, r.probability) for r in model.predict(m, rows).select("id", "prediction_code", "probability").orderBy("id").collect()]
    got = answers(forest)
    trees = [{r.id: r.probability for r in t.transform(rows).select("id", "probability").collect()} for t in forest.trees]
    assert all(abs(sum(t[i][1] for t in trees) / 5 - p[1]) < 1e-9 for i, _, p in got)
    model.save_model(model.scoring_pipeline(forest, ["x", "y"]), str(tmp_path / "joined"))
    loaded = model.load_model(str(tmp_path / "joined")).stages[1]
    assert loaded.getNumTrees == 5 and answers(loaded) == got
    rows.unpersist()


def _one_partition(spark, n):
    """``n`` applications in one partition, as a table of one row group has them."""
    x = F.col("id")
    return spark.range(0, n, 1, 1).select(
        x.alias("app_id"), (18 + x % 53).cast("int").alias("age"), (20_000 + x * 7919 % 90_000).cast("double").alias("income"),
        F.when(x % 3 == 0, "RENT").otherwise("OWN").alias("home"), (x % 41).cast("double").alias("emp_length"),
        F.when(x % 2 == 0, "MEDICAL").otherwise("VENTURE").alias("intent"), (500 + x % 9000).cast("double").alias("amount"),
        (5 + x % 17).cast("double").alias("rate"), F.when(x % 6 == 1, "Y").otherwise("N").alias("default_flag"),
        (2 + x % 29).cast("int").alias("cred_length"), (x % 100 / 100).alias("percent_income"), (x % 100 > 60).cast("int").alias("status"))


def test_rows_to_be_scored_are_dealt_over_the_cores(spark, trained, monkeypatch):
    """Asking the forest is the work of scoring: a table in one partition no longer keeps one core busy and the rest idle."""
    rows = _one_partition(spark, 60_000)
    monkeypatch.setattr(model_queries, "applications", lambda *_: rows)
    monkeypatch.setattr(model_queries, "trained", lambda *_: dataclasses.replace(trained, sizes={"train_rows": 48_000, "test_rows": 12_000}))
    parts = training.pieces(rows, 60_000)
    assert parts >= 2
    for name in ("rf_score", "rf_stream_score"):
        out = model_queries.Q[name](spark, "").select("app_id", F.spark_partition_id().alias("p")).collect()
        assert sorted(r.app_id for r in out) == list(range(60_000))
        if name == "rf_score":
            sizes = [sum(r.p == p for r in out) for p in {r.p for r in out}]
            assert len(sizes) == parts and max(sizes) <= 2 * 60_000 / parts
    small = rows.limit(100)
    assert training.deal(small, 100, model_queries.NEAR) is small


def test_training_keeps_its_rows_dealt_over_the_cores(spark, monkeypatch):
    seen, keep = [], training._materialize
    monkeypatch.setattr(training, "_materialize", lambda s, df, *a: seen.append(df.rdd.getNumPartitions()) or keep(s, df, *a))
    rows = _one_partition(spark, 30_000)
    res = training.train(spark, rows, training.TrainConfig(forest=model.ForestParams(num_trees=2, max_depth=3)))
    assert seen == [training.pieces(rows, 30_000)] and seen[0] >= 2
    assert res.sizes == {"train_rows": 24_000, "test_rows": 6_000}
    assert model.trees_at_a_time(720_000)[1] > model.trees_at_a_time(5_000_000)[1] > model.trees_at_a_time(43_200_000)[1]
    res.test_predictions.unpersist()


def test_rows_for_the_forest_stand_by_value(spark):
    """Rows that take the same way through the trees follow each other in a partition."""
    rows = _one_partition(spark, 30_000).select("app_id", F.when(F.col("home") == "OWN", 1).otherwise(0).alias("home_code"), "percent_income")
    for part in training.spread(rows, 30_000).rdd.glom().collect():
        keys = [(r.home_code, r.percent_income, r.app_id) for r in part]
        assert keys == sorted(keys) and len(keys) > 1000


def test_rows_alike_stand_together_when_the_forest_is_asked(spark, trained, monkeypatch):
    """The sort must stand after the joins with the code table: Spark drops one before them."""
    rows = _one_partition(spark, 60_000)
    monkeypatch.setattr(model_queries, "applications", lambda *_: rows)
    monkeypatch.setattr(model_queries, "trained", lambda *_: dataclasses.replace(trained, sizes={"train_rows": 48_000, "test_rows": 12_000}))
    near = training.NEAR[0]
    for name in ("rf_score", "rf_score_factors"):
        plan = model_queries.Q[name](spark, "")._jdf.queryExecution().optimizedPlan().toString()
        sort = next((line for line in plan.splitlines() if "Sort [" in line), "")
        assert f"Sort [{near}#" in sort and plan.index(sort) < plan.index("Join ")
        # The largest probability is taken once, not for each step of its rounding; the factors do without it.
        assert plan.count("array_max(") == (name == "rf_score")
    got = {r.app_id: r for r in model_queries.Q["rf_score"](spark, "").collect()}
    checked = quality.validate(rows, quality.API_RULES)
    plain = score.score(checked, trained.pipeline, trained.codes, columns={}, keep=["app_id"], refused=F.size("violations") > 0).collect()
    assert len(got) == len(plain) == 60_000
    results = ("prediction", "prediction_code", "confidence", "risk_level")
    assert all(got[r.app_id][c] == r[c] for r in plain for c in results)


def test_readers_of_the_test_predictions_do_not_load_the_forest(trained):
    """A kept frame's tasks carry the plan behind it, with the whole forest, also when they only read kept rows."""
    plan = trained.test_predictions._jdf.queryExecution().executedPlan().toString()
    assert "InMemoryRelation" not in plan and "UDF" not in plan and trained.test_predictions.inputFiles()
    assert trained.test_predictions.count() == trained.sizes["test_rows"]


def test_statistics_are_computed_while_the_trees_grow(spark, monkeypatch):
    begun, stats, fit = threading.Event(), reports.dataset_stats, model.fit_forest
    monkeypatch.setattr(reports, "dataset_stats", lambda *a, **k: begun.set() or stats(*a, **k))
    waited = []
    monkeypatch.setattr(model, "fit_forest", lambda *a, **k: waited.append(begun.wait(60)) or fit(*a, **k))
    res = training.train(spark, _one_partition(spark, 2_000), training.TrainConfig(forest=model.ForestParams(num_trees=2, max_depth=3)))
    assert waited == [True]
    assert {r.key: r.value for r in res.stats.where("section = 'total_records'").collect()} == {None: 2000.0}
