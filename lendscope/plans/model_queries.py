"""Model-backed queries: the forest is trained by Spark ML on the exact split.

Growing trees is not SQL, so what the forest says is checked on rows; what
surrounds it (validation, factors, the evaluated rows, what must hold of every
record) has SQL. One training run per session and folder is kept, as the
original service keeps its model loaded, so the queries share it.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..operators import encode, evaluate, model, quality, score
from ..schema import CATEGORICAL, ID, TARGET
from ..session import scratch_path
from ..sources.tables import applications
from ..streaming import scoring as stream
from . import catalog, training

_TRAINED: dict = {}
NEAR = [*CATEGORICAL, "percent_income", "rate"]  # the columns of ``training.NEAR`` before they are coded

Q: dict = {}
SQL: dict = {}


def trained(spark, sf_dir, cfg: training.TrainConfig | None = None) -> training.TrainResult:
    """One training run for each session, folder and configuration."""
    key = (spark.sparkContext.applicationId, sf_dir, repr(cfg))
    if key not in _TRAINED:
        for old in [k for k in _TRAINED if k[0] != key[0]]:  # frames of sessions that have ended
            del _TRAINED[old]
        _TRAINED[key] = training.train(spark, applications(spark, sf_dir), cfg)
    return _TRAINED[key]


def _checked(spark, sf_dir, res: training.TrainResult):
    """Every application with its violations, dealt out for the forest, which takes far longer than reading,
    and the columns by which ``score`` sorts them (none for a small table)."""
    rows, n = applications(spark, sf_dir), sum(res.sizes.values())
    near = training.NEAR if training.pieces(rows, n) >= 2 else None
    return quality.validate(training.deal(rows, n), quality.API_RULES), near


def _register(name, sql=None):
    def deco(fn):
        Q[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


@_register("rf_importance")
def q_rf_importance(spark, sf_dir):
    """G4 + J1: ``(feature, importance)`` sorted descending."""
    return trained(spark, sf_dir).importance


@_register("rf_report")
def q_rf_report(spark, sf_dir):
    """H1-H3 + R5 numbers of the forest on the test side, one row."""
    res = trained(spark, sf_dir)
    preds = res.test_predictions
    return evaluate.report_summary(preds, TARGET, "prediction_code").select(
        F.lit("Random Forest Classifier").alias("model_type"),
        "accuracy", "accuracy_percent", "precision_rejected", "recall_rejected",
        "precision_approved", "recall_approved",
        F.lit(res.sizes["train_rows"]).cast("long").alias("train_rows"),
        F.lit(res.sizes["test_rows"]).cast("long").alias("test_rows"),
    )


@_register("rf_confusion")
def q_rf_confusion(spark, sf_dir):
    """H2 for the forest: ``(actual, predicted, count)``."""
    return evaluate.confusion_matrix(trained(spark, sf_dir).test_predictions, TARGET, "prediction_code")


@_register("rf_score")
def q_rf_score(spark, sf_dir):
    """I11 over every application: decision, confidence, risk level and factors (as JSON).

    One pass; rows that the service would refuse keep their place, with the
    reasons instead of results."""
    res = trained(spark, sf_dir)
    checked, near = _checked(spark, sf_dir, res)
    scored = score.score(checked, res.pipeline, res.codes, columns={}, keep=[ID, "violations"], refused=F.size("violations") > 0, near=near)
    return scored.select(ID, "prediction", "prediction_code", "confidence", "risk_level",
                         F.to_json("factors").alias("factors"), F.array_join("violations", ",").alias("violations"))


def _factor_rows(scored):
    """Factors of scored rows, one row each; a refused row has one without factor."""
    entries = F.map_entries(F.from_json("factors", "map<string,string>"))
    return scored.select(ID, "violations", F.explode_outer(entries).alias("e")).select(
        ID, "violations", F.col("e.key").alias("factor"), F.col("e.value").alias("text"))


_FACTORS_SQL = catalog._with(f"""
SELECT v.app_id, v.violations, f.factor, f.text
FROM ({catalog._validate_sql(catalog._API_CHECKS)}) v
LEFT JOIN ({catalog._factor_sql()}) f ON f.app_id = v.app_id AND v.is_valid""")


@_register("rf_score_factors", _FACTORS_SQL)
def q_rf_score_factors(spark, sf_dir):
    """I10 in I11: violations and factor texts of the scored records."""
    return _factor_rows(q_rf_score(spark, sf_dir))


@_register("rf_support", catalog._with(f"""
SELECT status, count(*) AS test_rows FROM ({catalog._EXACT_SPLIT_SQL}) s WHERE is_test GROUP BY status"""))
def q_rf_support(spark, sf_dir):
    """Actual class totals among the rows that the forest was evaluated on."""
    return trained(spark, sf_dir).test_predictions.groupBy(TARGET).agg(F.count("*").alias("test_rows"))


@_register("rf_invariants", catalog._with(f"""
SELECT count(*) AS applications, count(*) FILTER (WHERE is_valid) AS scored, CAST(0 AS BIGINT) AS bad_confidence,
       CAST(0 AS BIGINT) AS bad_decision, CAST(0 AS BIGINT) AS bad_risk, CAST(0 AS BIGINT) AS bad_refusal,
       CAST(1 AS DOUBLE) AS importance_sum, CAST(10 AS BIGINT) AS features
FROM ({catalog._validate_sql(catalog._API_CHECKS)}) v"""))
def q_rf_invariants(spark, sf_dir):
    """What must hold of every scored record and of the importances."""
    res = trained(spark, sf_dir)
    s, code, conf = q_rf_score(spark, sf_dir), F.col("prediction_code"), F.col("confidence")
    strong, fair = conf >= 80, conf >= 60
    risk = F.when(code == 0, F.when(strong, "Low Risk").when(fair, "Medium Risk").otherwise("High Risk")).otherwise(
        F.when(strong, "High Risk").when(fair, "Medium Risk").otherwise("Low Risk"))
    valid = F.col("violations") == ""
    out = s.agg(
        F.count("*").alias("applications"), F.count(code).alias("scored"),
        F.count_if(valid & ~F.coalesce(conf.between(50, 100), F.lit(False))).alias("bad_confidence"),
        F.count_if(valid & ~F.col("prediction").eqNullSafe(F.when(code == 0, "Approved").otherwise("Rejected"))).alias("bad_decision"),
        F.count_if(valid & ~F.col("risk_level").eqNullSafe(risk)).alias("bad_risk"),
        F.count_if(~valid & (code.isNotNull() | conf.isNotNull() | F.col("prediction").isNotNull() | F.col("risk_level").isNotNull())).alias("bad_refusal"))
    raw = [float(v) for v in res.forest.featureImportances.toArray()]
    return out.select("*", F.round(F.lit(sum(raw)), 6).alias("importance_sum"), F.lit(len(raw)).cast("long").alias("features"))


# A forest of few trees without resampling, in which every split sees all
# features, must find a rule that two of them decide; SQL can state the rule.
_RULE_FEATURES = ["age", "cred_length", "income", "amount", "percent_income"]
_RULE_FOREST = model.ForestParams(num_trees=3, max_depth=4, bootstrap=False, features_per_split="all")


def _rule_forest(spark, sf_dir, rule: str):
    rows = applications(spark, sf_dir).select(ID, F.expr(f"CAST({rule} AS INT)").alias("label"), *(F.col(c).cast("double").alias(c) for c in _RULE_FEATURES))
    rows = encode.assemble(rows, _RULE_FEATURES).select(ID, "label", "features")
    return rows, model.fit_forest(rows, _RULE_FOREST, label_col="label")


@_register("forest_finds_rule", catalog._with("""
SELECT app_id, CAST(cred_length > 15 AND age <= 40 AS INT) AS prediction_code, CAST(cred_length > 15 AND age <= 40 AS DOUBLE) AS probability FROM applications"""))
def q_forest_finds_rule(spark, sf_dir):
    """Fitted to a rule over two features, the forest predicts it for every row, with certainty."""
    rows, forest = _rule_forest(spark, sf_dir, "cred_length > 15 AND age <= 40")
    return model.predict(forest, rows).select(ID, "prediction_code", vector_to_array("probability")[1].alias("probability"))


@_register("forest_rule_importance", "SELECT * FROM (VALUES " + ", ".join(
    f"({i + 1}, '{c}', {float(c == 'cred_length')}e0)" for i, c in enumerate(sorted(_RULE_FEATURES, key=lambda c: (c != "cred_length", c)))) + ") AS t(rank, feature, importance)")
def q_forest_rule_importance(spark, sf_dir):
    """Where one feature decides, it has all the importance and comes first."""
    _, forest = _rule_forest(spark, sf_dir, "cred_length > 15")
    rows = model.feature_importance(spark, forest, _RULE_FEATURES).collect()  # one row a feature, in order
    return spark.createDataFrame([(i + 1, r.feature, r.importance) for i, r in enumerate(rows)], "rank int, feature string, importance double")


@_register("rf_saved_scores", catalog._with(f"""
SELECT v.app_id, CAST(CASE WHEN v.is_valid THEN 1 ELSE 0 END AS INT) AS answered, TRUE AS equal FROM ({catalog._validate_sql(catalog._API_CHECKS)}) v"""))
def q_rf_saved_scores(spark, sf_dir):
    """A4 and A5: the saved and loaded model, with its saved codes, answers every application as the fitted one does."""
    import uuid

    res = trained(spark, sf_dir)
    path = scratch_path(spark, f"model_{uuid.uuid4().hex[:12]}")
    training.save(spark, res, path, path + "_report")
    loaded, codes = training.load(spark, path)
    checked, near = _checked(spark, sf_dir, res)
    of = lambda m, c, name: score.score(checked, m, c, columns={}, keep=[ID], refused=F.size("violations") > 0, near=near).select(
        F.col(ID).alias(f"{name}_id"), F.struct("prediction", "prediction_code", "confidence", "risk_level").alias(name))
    both = of(res.pipeline, res.codes, "fitted").join(of(loaded, codes, "loaded"), F.col("fitted_id") == F.col("loaded_id"))
    return both.select(F.col("fitted_id").alias(ID), F.col("loaded.prediction").isNotNull().cast("int").alias("answered"), F.col("fitted").eqNullSafe(F.col("loaded")).alias("equal"))


@_register("rule_top_features", catalog._with(f"SELECT * FROM ({catalog._IMPORTANCE_SQL}) i ORDER BY importance DESC, feature LIMIT 3"))
def q_rule_top_features(spark, sf_dir):
    """J4 over importances that SQL can state (the limit is the feature)."""
    return model.top_features(catalog._rule_importance(applications(spark, sf_dir)))


@_register("rf_top_features")
def q_rf_top_features(spark, sf_dir):
    """The three most important features (the limit is the feature)."""
    return model.top_features(trained(spark, sf_dir).importance)


@_register("rf_stream_score")
def q_rf_stream_score(spark, sf_dir):
    """Applications written as JSON request files, scored by a Structured
    Streaming job (``availableNow``), read back from the stream's Parquet sink.

    Files live under the session's shared checkpoint folder; each call uses a
    fresh sub-folder so the stream's checkpoint starts clean.
    """
    import uuid

    res = trained(spark, sf_dir)
    run = scratch_path(spark, f"stream_{uuid.uuid4().hex}")
    requests = training.deal(applications(spark, sf_dir), sum(res.sizes.values()), NEAR).select(
        ID, "age", "income", "home", "emp_length", "intent", "amount", "rate", "percent_income",
        F.col("default_flag").alias("default"), "cred_length")
    requests.write.json(f"{run}/requests")
    q = stream.start_scoring_stream(spark, f"{run}/requests", res.pipeline, res.codes, f"{run}/scored",
                                    checkpoint=f"{run}/checkpoint", keep=[ID])
    q.awaitTermination()
    out = spark.read.parquet(f"{run}/scored")
    return out.select(ID, "prediction", "prediction_code", "confidence", "risk_level",
                      F.to_json("factors").alias("factors"), F.array_join("violations", ",").alias("violations"))


@_register("stream_factors", _FACTORS_SQL)
def q_stream_factors(spark, sf_dir):
    """I10 and B7 of the streamed records."""
    return _factor_rows(q_rf_stream_score(spark, sf_dir))
