from pyspark.sql import functions as F

from lendscope.functions import numeric, text


def test_parse_prefixes(spark):
    vals = [" 12abc", "-3.9", "abc", "1e3", ".5", "+7", "", None, "4-NOT SPECIFIED"]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    got = [(r.i, r.f) for r in df.select(numeric.parse_int_prefix("s").alias("i"),
                                         numeric.parse_float_prefix("s").alias("f")).collect()]
    assert got == [(12, 12.0), (-3, -3.9), (None, None), (1, 1000.0), (None, 0.5), (7, 7.0),
                   (None, None), (None, None), (4, 4.0)]


def test_rounding_modes(spark):
    df = spark.createDataFrame([(12.25,), (0.285,), (2500.5,), (-1.25,)], "x double")
    even = [r[0] for r in df.select(numeric.round_even("x", 1)).collect()]
    up = [r[0] for r in df.select(numeric.round_half_up("x", 1)).collect()]
    assert even == [12.2, 0.3, 2500.5, -1.2]
    assert up == [12.3, 0.3, 2500.5, -1.2]


def test_percent_and_complement(spark):
    df = spark.createDataFrame([(1, 4), (1, 0)], "a int, b int")
    got = [tuple(r) for r in df.select(numeric.percent("a", "b"), numeric.complement(F.lit(21.8))).collect()]
    assert got[0] == (25.0, 78.2) and got[1][0] is None


def test_text_helpers(spark):
    df = spark.createDataFrame([("VENTURE", "Emp_length", 66074.856, 0.2721)], "v string, k string, m double, imp double")
    r = df.select(text.capitalize_first("v").alias("a"), text.key_to_label("k").alias("b"),
                  text.thousands("m", 2).alias("c"), text.fixed("m", 1).alias("d"),
                  text.text_bar("imp").alias("e"), text.remove_word(F.lit("Random Forest Classifier"), "Classifier").alias("f"),
                  text.percent_text(F.lit(0.17)).alias("g"), text.upper(F.lit("rent")).alias("h")).first()
    assert (r.a, r.b, r.c, r.d) == ("Venture", "Emp Length", "66,074.86", "66074.9")
    assert r.e == "#" * 13 and r.f == "Random Forest " and r.g == "17%" and r.h == "RENT"


def test_nan_to_null(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,), (None,)], "x double")
    assert [r[0] for r in df.select(numeric.nan_to_null("x")).collect()] == [None, 1.0, None]
