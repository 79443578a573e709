from pyspark.sql import functions as F

from lendscope.operators import explain

REQ = ("age int, income double, home string, emp_length double, intent string, amount double, "
       "rate double, percent_income double, default string, cred_length int")
CANON = (25, 60000.0, "RENT", 3.0, "PERSONAL", 10000.0, 11.5, 0.17, "N", 4)
COLS = {"default_flag": "default"}


def test_risk_levels(spark):
    rows = [(c, x) for c in (0, 1) for x in (59.9, 60.0, 79.9, 79.96, 80.0)]
    df = spark.createDataFrame(rows, "code int, raw double")
    conf = F.bround(F.col("raw"), 1)
    got = [r[0] for r in df.select(explain.risk_level("code", conf)).collect()]
    assert got == ["High Risk", "Medium Risk", "Medium Risk", "Low Risk", "Low Risk",
                   "Low Risk", "Medium Risk", "Medium Risk", "High Risk", "High Risk"]


def test_canonical_factors(spark):
    df = spark.createDataFrame([CANON], REQ)
    f = df.select(explain.factors_map(COLS).alias("f")).first().f
    assert f == {
        "debt_to_income": "✅ Low debt-to-income ratio (17%)",
        "interest_rate": "⚡ Moderate interest rate (11.5%)",
        "income": "⚡ Moderate income ($60,000)",
        "credit_history": "✅ Good credit history (4 years)",
        "previous_default": "✅ No previous defaults",
        "employment": "⚡ Moderate employment history (3 years)",
    }


def test_thresholds(spark):
    base = list(CANON)

    def with_(**kw):
        r = dict(zip(["age", "income", "home", "emp_length", "intent", "amount", "rate", "percent_income",
                      "default", "cred_length"], base))
        r.update(kw)
        return tuple(r.values())

    rows = [with_(percent_income=0.4), with_(percent_income=0.41), with_(percent_income=0.2),
            with_(rate=15.0), with_(rate=15.01), with_(rate=10.0), with_(income=100000.0),
            with_(income=49999.0), with_(cred_length=2), with_(cred_length=1), with_(default="y"),
            with_(emp_length=5.0), with_(emp_length=1.9)]
    df = spark.createDataFrame(rows, REQ)
    levels = [{k: v for k, v in r.f.items()} for r in df.select(
        F.map_from_entries(F.transform(explain.factors_long(COLS), lambda s: F.struct(s.factor, s.level)))
        .alias("f")).collect()]
    assert [levels[0]["debt_to_income"], levels[1]["debt_to_income"], levels[2]["debt_to_income"]] == \
        ["medium", "bad", "good"]
    assert [levels[3]["interest_rate"], levels[4]["interest_rate"], levels[5]["interest_rate"]] == \
        ["medium", "bad", "good"]
    assert [levels[6]["income"], levels[7]["income"]] == ["good", "bad"]
    assert [levels[8]["credit_history"], levels[9]["credit_history"]] == ["medium", "bad"]
    assert levels[10]["previous_default"] == "bad"
    assert [levels[11]["employment"], levels[12]["employment"]] == ["good", "bad"]


def test_format_parity_half_even(spark):
    from lendscope.functions.text import fixed
    df = spark.createDataFrame([(12.25,), (2500.5,), (0.285,)], "x double")
    got = [tuple(r) for r in df.select(fixed("x", 1), fixed("x", 0), fixed("x", 2)).collect()]
    assert got[0][0] == "12.2" and got[1][1] == "2500" and got[2][2] == "0.28"
