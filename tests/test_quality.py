from lendscope.operators import quality

ROW = dict(age=25, income=60000.0, home="RENT", emp_length=3.0, intent="PERSONAL", amount=10000.0,
           rate=11.5, percent_income=0.17, default_flag="N", cred_length=4)
SCHEMA = ("age int, income double, home string, emp_length double, intent string, amount double, "
          "rate double, percent_income double, default_flag string, cred_length int")


def _check(spark, changes, rules=quality.API_RULES):
    rows = []
    for ch in changes:
        r = dict(ROW)
        r.update(ch)
        rows.append(tuple(r[k] for k in ROW))
    df = spark.createDataFrame(rows, SCHEMA)
    return [list(r.violations) for r in quality.validate(df, rules).collect()]


def test_canonical_row_valid(spark):
    assert _check(spark, [{}]) == [[]]


def test_bounds(spark):
    got = _check(spark, [{"age": 18}, {"age": 17}, {"age": 100}, {"age": 101}, {"income": 0.0},
                         {"rate": 30.0}, {"rate": 30.01}, {"rate": 0.0}, {"percent_income": 1.0},
                         {"percent_income": -0.01}, {"emp_length": -1.0}, {"cred_length": -1},
                         {"amount": 0.0}])
    assert got == [[], ["age_range"], [], ["age_range"], ["income_positive"], [], ["rate_range"],
                   ["rate_range"], [], ["percent_income_range"], ["emp_length_nonnegative"],
                   ["cred_length_nonnegative"], ["amount_positive"]]


def test_null_nan_and_several_faults(spark):
    got = _check(spark, [{"rate": None}, {"rate": float("nan")}, {"age": 10, "income": -5.0, "home": None}])
    assert got == [["rate_required"], ["rate_required"], ["home_required", "age_range", "income_positive"]]


def test_form_rules_stricter(spark):
    got = _check(spark, [{"income": 0.5}, {"amount": 0.5}, {"rate": 0.005}], rules=quality.FORM_RULES)
    assert got == [["income_min"], ["amount_min"], ["rate_range"]]


def test_domain_and_defaults(spark):
    df = spark.createDataFrame([(None, "castle", None)], "home string, intent string, default_flag string")
    filled = quality.fill_form_defaults(df)
    r = filled.first()
    assert (r.home, r.intent, r.default_flag) == ("RENT", "castle", "N")
    v = quality.validate(filled, quality.DOMAIN_RULES, required=None).first().violations
    assert list(v) == ["intent_domain"]
    valid, rejected = quality.split_valid(quality.validate(filled, quality.DOMAIN_RULES, required=None))
    assert valid.count() == 0 and rejected.count() == 1
