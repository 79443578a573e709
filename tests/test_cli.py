import json

from pyspark.sql import functions as F

from lendscope import cli
from lendscope.sources.tables import applications

from .conftest import SF_SMALL


def test_cli_train_score_stats(spark, tmp_path, capsys):
    model, report = str(tmp_path / "model"), str(tmp_path / "report")
    assert cli.main(["train", "--tables", SF_SMALL, "--model", model, "--report", report]) == 0
    trained = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert 0.5 < trained["accuracy"] <= 1.0
    req = str(tmp_path / "requests")
    applications(spark, SF_SMALL).limit(200).select(
        "age", "income", "home", "emp_length", "intent", "amount", "rate", "percent_income",
        F.col("default_flag").alias("default"), "cred_length").write.json(req)
    out = str(tmp_path / "scored")
    assert cli.main(["score", "--model", model, "--input", req, "--output", out]) == 0
    scored = spark.read.parquet(out)
    assert cli.main(["score", "--model", model, "--report", report, "--input", req, "--output", out + "2"]) == 0
    plain = ["prediction", "confidence", "risk_level"]
    assert scored.select(plain).exceptAll(spark.read.parquet(out + "2").select(plain)).isEmpty()
    assert scored.count() == 200
    assert scored.where(F.size("violations") == 0).where(F.col("prediction").isNull()).count() == 0
    assert cli.main(["stats", "--report", report]) == 0
    stats = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert stats["total_records"] == 1500
    assert cli.main(["model-info", "--report", report]) == 0
    info = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert info["n_estimators"] == 100 and info["model_name"] == "Random Forest"


def test_cli_trains_on_csv_and_writes_rejects(spark, tmp_path, capsys, monkeypatch):
    import pytest

    from lendscope.operators import model as model_ops
    from lendscope.plans import training
    from lendscope.schema import FROM_DISPLAY, RAW_APPLICATION_SCHEMA

    small = training.TrainConfig(forest=model_ops.ForestParams(num_trees=3, max_depth=3))
    whole = training.train
    monkeypatch.setattr(training, "train", lambda spark, raw: whole(spark, raw, small))
    names = {v: k for k, v in FROM_DISPLAY.items()}
    apps = applications(spark, SF_SMALL)
    rows = apps.select(*(F.col(c).alias(names[c]) for c in apps.columns)).select(RAW_APPLICATION_SCHEMA.names)
    rows.coalesce(1).write.option("header", True).csv(str(tmp_path / "csv"))
    text = next((tmp_path / "csv").glob("*.csv")).read_text()
    (tmp_path / "a.csv").write_text(text + "9000000,22\n9000001,22,59000,RENT,123,PERSONAL,35000,16.02,1,0.59,Y,3,4\n")
    args = ["train", "--csv", str(tmp_path / "a.csv"), "--model", str(tmp_path / "m"), "--report", str(tmp_path / "r")]
    with pytest.raises(ValueError, match="line 1502: 2 fields"):
        cli.main(args)
    assert cli.main([*args, "--rejects", str(tmp_path / "rejects")]) == 0
    assert sorted((r.line, r.reason) for r in spark.read.parquet(str(tmp_path / "rejects")).collect()) == [(1502, "2 fields"), (1503, "13 fields")]
    assert spark.read.json(str(tmp_path / "r"), multiLine=True).first().dataset_stats.total_records == 1500
