import pytest
from pyspark.sql import functions as F

from lendscope.operators import clean, encode


def test_median_imputer_only_where_nulls(spark):
    df = spark.createDataFrame([(1.0, 5, 1.0), (None, 6, 2.0), (3.0, None, 3.0), (4.0, 7, 4.0)],
                               "a double, b int, c double")
    p = clean.fit_median_imputer(df, ["a", "b", "c"])
    assert p.null_counts == {"a": 1, "b": 1, "c": 0}
    assert p.fill_values == {"a": 3.0, "b": 6.0}
    out = clean.apply_median_imputer(df, p)
    assert dict(out.dtypes)["b"] == "int"
    assert [r.a for r in out.collect()] == [1.0, 3.0, 3.0, 4.0]


def test_imputer_even_median_on_int_becomes_double(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "b int")
    p = clean.fit_median_imputer(df, ["b"])
    assert p.fill_values == {"b": 1.5}
    out = clean.apply_median_imputer(df, p)
    assert [r.b for r in out.collect()] == [1.0, 2.0, 1.5]


def test_imputer_all_null(spark):
    df = spark.createDataFrame([(None,), (None,)], "x double")
    p = clean.fit_median_imputer(df, ["x"])
    assert p.fill_values == {} and p.null_counts == {"x": 2}


def test_outlier_cap(spark):
    df = spark.createDataFrame([(a,) for a in [100, 101, 144, None, 20]], "age int")
    p = clean.fit_outlier_cap(df, "age", 100)
    assert p.replacement == 60.0
    assert [r.age for r in clean.apply_outlier_cap(df, p).collect()] == [100, 60, 60, None, 20]


def codes_of(codes):
    out = {}
    for r in codes.collect():
        out.setdefault(r.column_name, {})[r.label] = r.code
    return out


def code_table(spark, maps):
    rows = [(c, label, code) for c, m in maps.items() for label, code in m.items()]
    return spark.createDataFrame(rows, encode.CODES_SCHEMA)


def test_label_codes_sorted_and_nan(spark, tmp_path):
    df = spark.createDataFrame([("RENT",), ("OWN",), (None,), ("MORTGAGE",)], "home string")
    codes = encode.label_codes(df, ["home"])
    assert codes_of(codes) == {"home": {"MORTGAGE": 0, "OWN": 1, "RENT": 2, "nan": 3}}
    coded = encode.apply_training_codes(df, codes, ["home"], suffix="_code")
    assert {r.home: r.home_code for r in coded.collect()} == {"RENT": 2, "OWN": 1, None: 3, "MORTGAGE": 0}
    encode.save_codes(codes, str(tmp_path / "codes"))
    assert codes_of(encode.load_codes(spark, str(tmp_path / "codes"))) == codes_of(codes)


def test_scoring_codes_upper_unknown_null(spark):
    codes = code_table(spark, {"home": {"MORTGAGE": 0, "OTHER": 1, "OWN": 2, "RENT": 3}})
    df = spark.createDataFrame([("RENT", "x"), ("rent", None), ("castle", "y"), (None, "z")],
                               "home string, intent string")
    out = encode.apply_scoring_codes(df.withColumn("default_flag", F.lit("Y")), codes, suffix="_code").collect()
    assert {r.home: r.home_code for r in out} == {"RENT": 3, "rent": 3, "castle": 0, None: 0}
    assert {(r.intent_code, r.default_flag_code) for r in out} == {(0, 0)}  # no labels at all


def test_scoring_joins_a_dictionary_of_any_size(spark, tmp_path):
    """Its labels stand neither in the plan nor on the driver; Spark joins the saved table by its bytes."""
    labels = spark.range(200_000).select(F.concat(F.lit("LABEL_"), F.col("id")).alias("home"))
    path = str(tmp_path / "codes")
    encode.save_codes(encode.label_codes(labels, ["home"]), path)
    requests = labels.where("home like '%77'").select(F.lower("home").alias("home"))
    out = encode.apply_scoring_codes(requests, encode.load_codes(spark, path), suffix="_code", cols=["home"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "LABEL_1" not in plan and "FileScan parquet" in plan
    want = {x.lower(): i for i, x in enumerate(sorted(f"LABEL_{i}" for i in range(200_000)))}
    rows = out.collect()
    assert len(rows) == 2000 and all(r.home_code == want[r.home] for r in rows)


def test_derive_ratio(spark):
    df = spark.createDataFrame([(10000.0, 60000.0, None), (5.0, 0.0, 0.3), (None, 10.0, 0.2)],
                               "amount double, income double, percent_income double")
    got = [r.percent_income for r in encode.derive_ratio(df).collect()]
    assert got == [0.17, 0.3, 0.2]


def test_label_codes_over_ranges(spark):
    rows = [(f"h{i % 37}", f"i{i % 101}", None if i % 5 == 0 else f"d{i % 3}") for i in range(400)]
    df = spark.createDataFrame(rows, "h string, i string, d string").repartition(5)
    codes = encode.label_codes(df, ["h", "i", "d"])
    got = {(r.column_name, r.label): r.code for r in codes.collect()}
    want = {}
    for k, c in enumerate("hid"):
        labels = sorted({r[k] if r[k] is not None else "nan" for r in rows})
        want |= {(c, label): n for n, label in enumerate(labels)}
    assert got == want
    coded = encode.apply_training_codes(df, codes, ["h", "i", "d"], suffix="_c")
    assert coded.count() == 400
    assert all(want["i", r.i] == r.i_c and want["d", r.d or "nan"] == r.d_c for r in coded.collect())


def test_nan_is_missing(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(nan,), (1.0,), (3.0,), (inf,), (None,)], "x double")
    p = clean.fit_median_imputer(df, ["x"])
    assert p.null_counts == {"x": 2} and p.fill_values == {"x": 3.0}
    assert sorted(r.x for r in clean.apply_median_imputer(df, p).collect()) == [1.0, 3.0, 3.0, 3.0, inf]
    from lendscope.operators import profile

    assert profile.null_counts(df).first().null_count == 2
