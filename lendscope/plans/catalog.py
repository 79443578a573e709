"""Registered queries over the driver's tables, with equivalent SQL for a DuckDB check.

Each query takes ``(spark, sf_dir)`` and returns a DataFrame over the whole
``applications`` view (one row per order). Rounded values use
``floor(x * 10^k + 0.5) / 10^k`` on both sides (``rounding='half_up'``),
because Spark and DuckDB round binary ties differently; the library's own
default (``'even'``) follows the original's Python rounding.
"""

from __future__ import annotations

import uuid

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import round_even, round_half_up
from ..operators import clean, encode, evaluate, explain, joins, profile, quality, quantiles, split
from ..schema import (AGE_BIN_EDGES, AGE_BIN_LABELS, AGE_CAP, CATEGORICAL, DISPLAY_NAME, FEATURE_DISPLAY_NAMES,
                      FEATURES, FORM_DEFAULTS, FROM_DISPLAY, NUMERIC, RAW_APPLICATION_SCHEMA, TARGET)
from ..operators.score import model_inputs
from ..session import scratch_path
from ..sources import files, tables
from ..sources.tables import APPLICATIONS_SQL, applications, load_table
from . import reports, training

R = "half_up"
APP_COLS = ["app_id", "age", "income", "home", "emp_length", "intent", "amount", "rate",
            "default_flag", "cred_length", "percent_income", "status"]


def _apps(spark, sf_dir):
    return applications(spark, sf_dir)


def _with(sql: str) -> str:
    body = sql.lstrip()
    if body[:5].upper() == "WITH ":
        return f"WITH applications AS ({APPLICATIONS_SQL}),\n{body[5:]}"
    return f"WITH applications AS ({APPLICATIONS_SQL})\n{body}"


def _r(expr: str, places: int) -> str:
    s = 10 ** places
    return f"floor(({expr}) * {s} + 0.5) / {s}"


Q: dict = {}
SQL: dict = {}


def register(name: str, sql: str | None = None, whole: bool = False):
    """``whole``: the SQL already has the view."""
    def deco(fn):
        Q[name] = fn
        if sql is not None:
            SQL[name] = sql if whole else _with(sql)
        return fn
    return deco


# --- E13 / E14: outcome rate per group ------------------------------------
@register("rate_by_intent", f"""
SELECT intent, {_r('avg(status) * 100', 1)} AS approval_rate, count(*) AS applications
FROM applications WHERE intent IS NOT NULL GROUP BY intent""")
def q_rate_by_intent(spark, sf_dir):
    return profile.rate_by_group(_apps(spark, sf_dir), "intent", TARGET, rounding=R)


@register("rate_by_home", f"""
SELECT home, {_r('avg(status) * 100', 1)} AS approval_rate, count(*) AS applications
FROM applications WHERE home IS NOT NULL GROUP BY home""")
def q_rate_by_home(spark, sf_dir):
    return profile.rate_by_group(_apps(spark, sf_dir), "home", TARGET, rounding=R)


# --- E4 / E5 / J2: value counts -------------------------------------------
@register("target_counts", """
SELECT status, count(*) AS count FROM applications WHERE status IS NOT NULL GROUP BY status""")
def q_target_counts(spark, sf_dir):
    return profile.order_counts(profile.value_counts(_apps(spark, sf_dir), TARGET), TARGET)


def _value_counts_query(col):
    def q(spark, sf_dir):
        return profile.ranked_counts(profile.value_counts(_apps(spark, sf_dir), col), col)
    return q


for _c in CATEGORICAL:
    register(f"value_counts_{_c}", f"""
SELECT {_c}, count(*) AS count, CAST(row_number() OVER (ORDER BY count(*) DESC, {_c}) AS INT) AS rank
FROM applications WHERE {_c} IS NOT NULL GROUP BY {_c}""")(
        _value_counts_query(_c))


@register("ranked_counts_many", """
SELECT o_custkey, count(*) AS count, CAST(row_number() OVER (ORDER BY count(*) DESC, o_custkey) AS INT) AS rank FROM orders GROUP BY o_custkey""")
def q_ranked_counts_many(spark, sf_dir):
    """J2 over a column with as many values as there are customers with orders."""
    return profile.ranked_counts(profile.value_counts(load_table(spark, sf_dir, "orders"), "o_custkey"), "o_custkey")


@register("value_counts_all", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, count(*) AS count "
    f"FROM applications WHERE {c} IS NOT NULL GROUP BY {c}" for c in CATEGORICAL))
def q_value_counts_all(spark, sf_dir):
    return profile.value_counts_multi(_apps(spark, sf_dir), CATEGORICAL)


# --- E1: size ---------------------------------------------------------------------
@register("row_count", f"SELECT count(*) AS rows, CAST({len(APP_COLS)} AS BIGINT) AS columns FROM applications")
def q_row_count(spark, sf_dir):
    return profile.row_count(_apps(spark, sf_dir))


# --- E12: distinct values ------------------------------------------------------
@register("distinct_intents", "SELECT DISTINCT intent FROM applications")
def q_distinct_intents(spark, sf_dir):
    return profile.distinct_values(_apps(spark, sf_dir), "intent")


# --- D5: the bin of every application -------------------------------------------
@register("age_bin_rows", f"""
SELECT app_id, CASE {' '.join(f"WHEN age > {AGE_BIN_EDGES[i]} AND age <= {AGE_BIN_EDGES[i + 1]} THEN '{lab}'" for i, lab in enumerate(AGE_BIN_LABELS))} END AS bin
FROM applications""")
def q_age_bin_rows(spark, sf_dir):
    label, _ = profile.bin_expr("age", AGE_BIN_EDGES, AGE_BIN_LABELS)
    return _apps(spark, sf_dir).select("app_id", label.alias("bin"))


# --- E3: null profile -------------------------------------------------------
@register("null_profile", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS null_count FROM applications"
    for c in APP_COLS))
def q_null_profile(spark, sf_dir):
    return profile.null_counts(_apps(spark, sf_dir), APP_COLS)


# --- E1 + E6 + E7 + B13 -----------------------------------------------------
@register("approval_overview", f"""
SELECT count(*) AS total_records, CAST(sum(status) AS BIGINT) AS approved_count,
       count(*) - CAST(sum(status) AS BIGINT) AS rejected_count,
       {_r('CAST(sum(status) AS DOUBLE) / count(*) * 100', 1)} AS approval_rate
FROM applications""")
def q_approval_overview(spark, sf_dir):
    return profile.overview(_apps(spark, sf_dir), TARGET, rounding=R)


@register("copartitioned_overview", SQL["approval_overview"], whole=True)
def q_copartitioned_overview(spark, sf_dir):
    """A1 and B2 over orders and customer written in buckets of the customer key: the join moves no row."""
    name = f"lendscope_{uuid.uuid4().hex[:12]}"
    apps = tables.copartitioned_applications(spark, sf_dir, name, scratch_path(spark, name), buckets=8)
    return profile.overview(apps, TARGET, rounding=R)


# --- D5 + E8 + J3: age bins -------------------------------------------------
_BINS_VALUES = ", ".join(
    f"({i}, '{lab}', {AGE_BIN_EDGES[i]}, {AGE_BIN_EDGES[i + 1]})" for i, lab in enumerate(AGE_BIN_LABELS))


@register("age_bins", f"""
SELECT b.ordinal, b.bin, count(a.age) AS count
FROM (VALUES {_BINS_VALUES}) AS b(ordinal, bin, lo, hi)
LEFT JOIN applications a ON a.age > b.lo AND a.age <= b.hi
GROUP BY b.ordinal, b.bin""")
def q_age_bins(spark, sf_dir):
    return profile.binned_counts(_apps(spark, sf_dir), "age", AGE_BIN_EDGES, AGE_BIN_LABELS)


_MANY = [4 * i for i in range(10_001)]


@register("amount_bins_many", """
WITH c AS (SELECT CAST(ceil(amount / 4) AS INT) - 1 AS at, count(*) AS n FROM applications WHERE amount > 0 AND amount <= 40000 GROUP BY 1)
SELECT CAST(i AS INT) AS ordinal, 'to ' || CAST(4 * i + 4 AS VARCHAR) AS bin, coalesce(n, 0) AS count
FROM range(10000) r(i) LEFT JOIN c ON c.at = i""")
def q_amount_bins_many(spark, sf_dir):
    """D5 and E8 with ten thousand bins."""
    return profile.binned_counts(_apps(spark, sf_dir), "amount", _MANY, [f"to {e}" for e in _MANY[1:]])


# --- E9-E11: summary statistics ---------------------------------------------
def _stats_sql(col, funcs):
    parts = {"mean": f"avg({col})", "median": f"median({col})", "min": f"min({col})",
             "max": f"max({col})", "std": f"stddev_samp({col})"}
    return "SELECT " + ", ".join(f"{_r(parts[f], 2)} AS {f}" for f in funcs) + " FROM applications"


def _stats_query(col, funcs):
    def q(spark, sf_dir):
        return profile.summary_stats(_apps(spark, sf_dir), col, funcs, rounding=R)
    return q


for _sec, (_col, _funcs) in reports.STATS_SPEC.items():
    register(_sec, _stats_sql(_col, _funcs))(_stats_query(_col, _funcs))


# --- C1 / C2 / E15: cleaning ------------------------------------------------
@register("impute_median", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS null_count, "
    f"CASE WHEN count(*) FILTER (WHERE {c} IS NULL) > 0 THEN median({c}) END AS fill_value "
    f"FROM applications" for c in NUMERIC))
def q_impute_median(spark, sf_dir):
    apps = _apps(spark, sf_dir)
    params = clean.fit_median_imputer(apps, NUMERIC)
    fill = F.lit(None).cast("double")
    for c, v in params.fill_values.items():
        fill = F.when(F.col("column_name") == c, F.lit(float(v))).otherwise(fill)
    return profile.null_counts(apps, NUMERIC).withColumn("fill_value", fill)


_SPECIAL = {"all_signs": ("CASE app_id % 10 WHEN 0 THEN CAST('NaN' AS DOUBLE) WHEN 1 THEN CAST('Infinity' AS DOUBLE) WHEN 2 THEN CAST('-Infinity' AS DOUBLE) ELSE rate END"),
            "mostly_infinite": "CASE WHEN app_id % 3 = 0 THEN rate ELSE CAST('Infinity' AS DOUBLE) END",
            "wide": "CASE app_id % 4 WHEN 0 THEN 1e300 * rate WHEN 1 THEN -1e300 * rate WHEN 2 THEN 1e-300 * rate ELSE rate END"}


@register("median_special", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, median(x) AS median, count(x) AS n FROM (SELECT {e} AS x FROM applications) a WHERE NOT isnan(x)"
    for c, e in _SPECIAL.items()))
def q_median_special(spark, sf_dir):
    """C1's medians with NaN (missing), infinities and a very wide range; narrowed in small steps."""
    x = _apps(spark, sf_dir).selectExpr(*(f"{e} AS {c}" for c, e in _SPECIAL.items()))
    first = quantiles.brackets(x, list(_SPECIAL))
    medians = quantiles.exact_medians(x, list(_SPECIAL), first=first, buckets=64, collect_limit=50)
    rows = [F.struct(F.lit(c).alias("column_name"), F.lit(medians[c]).cast("double").alias("median"), F.lit(first[c].n).cast("long").alias("n")) for c in _SPECIAL]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


@register("cap_age", f"""
SELECT {AGE_CAP} AS cap, median(age) FILTER (WHERE age <= {AGE_CAP}) AS replacement,
       count(*) FILTER (WHERE age > {AGE_CAP}) AS outliers
FROM applications""")
def q_cap_age(spark, sf_dir):
    apps = _apps(spark, sf_dir)
    p = clean.fit_outlier_cap(apps, "age", AGE_CAP)
    return apps.agg(F.count_if(F.col("age") > AGE_CAP).alias("outliers")).select(
        F.lit(AGE_CAP).alias("cap"), F.lit(p.replacement).cast("double").alias("replacement"), "outliers")


_CLEAN_SELECT = ", ".join(
    ["a.app_id",
     f"CAST(CASE WHEN coalesce(a.age, m.age) > {AGE_CAP} THEN c.cap ELSE coalesce(a.age, m.age) END AS DOUBLE) AS age"]
    + [f"CAST(coalesce(a.{c}, m.{c}) AS DOUBLE) AS {c}" for c in NUMERIC if c != "age"]
    + ["a.home", "a.intent", "a.default_flag", "a.status"])


@register("clean_applications", f"""
SELECT {_CLEAN_SELECT}
FROM applications a,
     (SELECT {', '.join(f'median({c}) AS {c}' for c in NUMERIC)} FROM applications) m,
     (SELECT median(coalesce(x.age, mm.age)) FILTER (WHERE coalesce(x.age, mm.age) <= {AGE_CAP}) AS cap
      FROM applications x, (SELECT median(age) AS age FROM applications) mm) c""")
def q_clean_applications(spark, sf_dir):
    apps = _apps(spark, sf_dir)
    filled = clean.apply_median_imputer(apps, clean.fit_median_imputer(apps, NUMERIC))
    capped = clean.apply_outlier_cap(filled, clean.fit_outlier_cap(filled, "age", AGE_CAP))
    return capped.select(
        "app_id", *[F.col(c).cast("double").alias(c) for c in NUMERIC],
        "home", "intent", "default_flag", "status")


# --- D1-D3: label codes -----------------------------------------------------
_LABELS_SQL = " UNION ALL ".join(
    f"SELECT DISTINCT '{c}' AS column_name, coalesce(CAST({c} AS VARCHAR), 'nan') AS label FROM applications"
    for c in CATEGORICAL)
_CODES_SQL = (f"SELECT column_name, label, CAST(dense_rank() OVER (PARTITION BY column_name ORDER BY label) - 1 AS INT)"
              f" AS code FROM ({_LABELS_SQL}) l")


@register("label_codes", _CODES_SQL)
def q_label_codes(spark, sf_dir):
    return encode.label_codes(_apps(spark, sf_dir), CATEGORICAL)


@register("encode_training", f"""
WITH codes AS ({_CODES_SQL})
SELECT a.app_id, {', '.join(f'k_{c}.code AS {c}_code' for c in CATEGORICAL)}
FROM applications a
{' '.join(f"LEFT JOIN codes k_{c} ON k_{c}.column_name = '{c}' AND k_{c}.label = coalesce(a.{c}, 'nan')"
          for c in CATEGORICAL)}""")
def q_encode_training(spark, sf_dir):
    apps = _apps(spark, sf_dir)
    coded = encode.apply_training_codes(apps, encode.label_codes(apps, CATEGORICAL), CATEGORICAL, suffix="_code")
    return coded.select("app_id", *[f"{c}_code" for c in CATEGORICAL])


_TRAIN_FLAG = "substring(md5('42:' || CAST(app_id AS VARCHAR)), 1, 8) >= '33333333'"


# Labels arrive in lower case or unknown, and the report has no map for default_flag.
_SCORING_INPUT = {"home": ("CASE WHEN app_id % 3 = 0 THEN lower(home) WHEN app_id % 13 = 0 THEN 'BOAT' ELSE home END"),
                  "intent": "CASE WHEN app_id % 7 = 0 THEN NULL ELSE intent END", "default_flag": "default_flag"}
_MAPPED = ["home", "intent"]


@register("encode_scoring", f"""
WITH codes AS (
  SELECT column_name, label, CAST(dense_rank() OVER (PARTITION BY column_name ORDER BY label) - 1 AS INT) AS code
  FROM ({' UNION ALL '.join(f"SELECT DISTINCT '{c}' AS column_name, coalesce(CAST({c} AS VARCHAR), 'nan') AS label FROM applications WHERE {_TRAIN_FLAG}" for c in _MAPPED)}) l),
a AS (SELECT app_id, {', '.join(f'{e} AS {c}' for c, e in _SCORING_INPUT.items())} FROM applications)
SELECT a.app_id, {', '.join(f'coalesce(k_{c}.code, 0) AS {c}_code' for c in _MAPPED)}, 0 AS default_flag_code
FROM a
{' '.join(f"LEFT JOIN codes k_{c} ON k_{c}.column_name = '{c}' AND k_{c}.label = upper(a.{c})" for c in _MAPPED)}""")
def q_encode_scoring(spark, sf_dir):
    flagged = split.hash_split(_apps(spark, sf_dir), "app_id", 0.2, 42)
    codes = encode.label_codes(flagged.where(~F.col("is_test")), _MAPPED)
    requests = _apps(spark, sf_dir).selectExpr("app_id", *(f"{e} AS {c}" for c, e in _SCORING_INPUT.items()))
    coded = encode.apply_scoring_codes(requests, codes, suffix="_code")
    return coded.select("app_id", *[f"{c}_code" for c in CATEGORICAL])


@register("codes_many", """
SELECT 'o_orderkey' AS column_name, CAST(o_orderkey AS VARCHAR) AS label,
       CAST(dense_rank() OVER (ORDER BY CAST(o_orderkey AS VARCHAR)) - 1 AS INT) AS code, count(*) AS orders
FROM orders GROUP BY o_orderkey""")
def q_codes_many(spark, sf_dir):
    """D1 and D2 over a column with as many labels as the table has keys."""
    orders = load_table(spark, sf_dir, "orders").select("o_orderkey")
    coded = encode.apply_training_codes(orders, encode.label_codes(orders, ["o_orderkey"]), ["o_orderkey"], suffix="_code")
    return coded.groupBy(F.lit("o_orderkey").alias("column_name"), F.col("o_orderkey").cast("string").alias("label"),
                         F.col("o_orderkey_code").alias("code")).agg(F.count("*").alias("orders"))


@register("codes_many_scoring", """
WITH codes AS (SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INT) AS code
               FROM (SELECT DISTINCT CAST(o_orderkey AS VARCHAR) AS label FROM orders WHERE o_orderkey % 10 <> 0) l)
SELECT o_orderkey, coalesce(code, 0) AS o_orderkey_code FROM orders LEFT JOIN codes ON label = CAST(o_orderkey AS VARCHAR)""")
def q_codes_many_scoring(spark, sf_dir):
    """D3 and A5 with a dictionary of as many labels: saved beside a model, loaded and joined; a tenth of the keys is unknown."""
    orders = load_table(spark, sf_dir, "orders").select("o_orderkey")
    path = scratch_path(spark, f"label_codes_{uuid.uuid4().hex[:12]}")
    encode.save_codes(encode.label_codes(orders.where("o_orderkey % 10 <> 0"), ["o_orderkey"]), path)
    return encode.apply_scoring_codes(orders, encode.load_codes(spark, path), suffix="_code", cols=["o_orderkey"])


# --- D4: the assembled feature vector ----------------------------------------------------
_FEATURE_SQL = {"age": f"CASE WHEN coalesce(a.age, m.age) > {AGE_CAP} THEN c.cap ELSE coalesce(a.age, m.age) END"} | {
    c: f"coalesce(a.{c}, m.{c})" for c in NUMERIC if c != "age"} | {c: f"k_{c}.code" for c in CATEGORICAL}


@register("assembled_features", f"""
WITH codes AS ({_CODES_SQL})
SELECT a.app_id, {', '.join(f'CAST({_FEATURE_SQL[c]} AS DOUBLE) AS {c}' for c in FEATURES)}
FROM applications a
{' '.join(f"LEFT JOIN codes k_{c} ON k_{c}.column_name = '{c}' AND k_{c}.label = coalesce(a.{c}, 'nan')" for c in CATEGORICAL)},
     (SELECT {', '.join(f'median({c}) AS {c}' for c in NUMERIC)} FROM applications) m,
     (SELECT median(coalesce(x.age, mm.age)) FILTER (WHERE coalesce(x.age, mm.age) <= {AGE_CAP}) AS cap
      FROM applications x, (SELECT median(age) AS age FROM applications) mm) c""")
def q_assembled_features(spark, sf_dir):
    """D4 over the prepared applications (C1, C2, D2): the entries of the vector, in feature order."""
    apps = _apps(spark, sf_dir)
    prepared = training.apply_preparation(apps, *training.fit_preparation(apps, training.TrainConfig()))
    vector = vector_to_array("features")
    return encode.assemble(prepared, model_inputs()).select("app_id", *(vector[i].alias(c) for i, c in enumerate(FEATURES)))


# --- D6: derived ratio --------------------------------------------------------
@register("derived_ratio", f"""
SELECT app_id, CASE WHEN amount IS NOT NULL AND income > 0 THEN {_r('amount / income', 2)}
                    ELSE percent_income END AS percent_income
FROM applications""")
def q_derived_ratio(spark, sf_dir):
    return encode.derive_ratio(_apps(spark, sf_dir), rounding=R).select("app_id", "percent_income")


# --- K1: the library's own rounding, as the original's language rounds -----------
def _even_sql(x, places):
    """Half to even on the exact binary value: the product's rounding error decides what looks like a tie."""
    s = f"{float(10 ** places)!r}e0"
    return f"""(SELECT (floor(p) + CASE WHEN p - floor(p) > 0.5e0 OR (p - floor(p) = 0.5e0 AND (e > 0 OR (e = 0 AND floor(p) % 2 = 1)))
  THEN 1e0 ELSE 0e0 END) / {s} FROM (SELECT p, (h * {s} - p) + (v - h) * {s} AS e
  FROM (SELECT v, v * {s} AS p, v * 134217729e0 - (v * 134217729e0 - v) AS h FROM (SELECT CAST({x} AS DOUBLE) AS v) a1) a2) a3)"""


@register("round_default", f"""
SELECT app_id, {_even_sql('rate / 8', 2)} AS by_eighths, {_even_sql('rate + 0.005e0', 2)} AS near_ties, {_even_sql('amount / 16', 1)} AS by_sixteenths
FROM applications""")
def q_round_default(spark, sf_dir):
    return _apps(spark, sf_dir).select("app_id", round_even(F.col("rate") / 8, 2).alias("by_eighths"),
                                       round_even(F.col("rate") + F.lit(0.005), 2).alias("near_ties"),
                                       round_even(F.col("amount") / 16, 1).alias("by_sixteenths"))


# --- B7 / B8 / B9: validation -------------------------------------------------
def _missing_sql(c):
    return f"({c} IS NULL OR isnan({c}))" if c in ("income", "emp_length", "amount", "rate", "percent_income") \
        else f"{c} IS NULL"


_API_CHECKS = [("age_range", "age", "age BETWEEN 18 AND 100"), ("income_positive", "income", "income > 0"),
               ("emp_length_nonnegative", "emp_length", "emp_length >= 0"),
               ("amount_positive", "amount", "amount > 0"), ("rate_range", "rate", "rate > 0 AND rate <= 30"),
               ("percent_income_range", "percent_income", "percent_income BETWEEN 0 AND 1"),
               ("cred_length_nonnegative", "cred_length", "cred_length >= 0")]
_FORM_CHECKS = [("age_range", "age", "age BETWEEN 18 AND 100"), ("income_min", "income", "income >= 1"),
                ("emp_length_nonnegative", "emp_length", "emp_length >= 0"),
                ("amount_min", "amount", "amount >= 1"), ("rate_range", "rate", "rate BETWEEN 0.01 AND 30"),
                ("percent_income_range", "percent_income", "percent_income BETWEEN 0 AND 1"),
                ("cred_length_nonnegative", "cred_length", "cred_length >= 0")]


def _validate_sql(checks):
    parts = [f"CASE WHEN {_missing_sql(c)} THEN '{c}_required' END" for c in quality.REQUIRED_FIELDS]
    parts += [f"CASE WHEN NOT {_missing_sql(c)} AND NOT coalesce({cond}, false) THEN '{n}' END"
              for n, c, cond in checks]
    v = f"concat_ws(',', {', '.join(parts)})"
    return f"SELECT app_id, {v} AS violations, {v} = '' AS is_valid FROM applications"


def _validate_query(rules):
    def q(spark, sf_dir):
        v = quality.validate(_apps(spark, sf_dir), rules)
        return v.select("app_id", F.array_join("violations", ",").alias("violations"),
                        (F.size("violations") == 0).alias("is_valid"))
    return q


register("validate_api", _validate_sql(_API_CHECKS))(_validate_query(quality.API_RULES))
register("validate_form", _validate_sql(_FORM_CHECKS))(_validate_query(quality.FORM_RULES))


_ODD_LABELS = {"home": "CASE WHEN app_id % 11 = 0 THEN 'rent' WHEN app_id % 17 = 0 THEN NULL ELSE home END",
               "intent": "CASE WHEN app_id % 19 = 0 THEN 'BOAT' ELSE intent END",
               "default_flag": "CASE WHEN app_id % 23 = 0 THEN '' ELSE default_flag END"}


@register("validate_domain", f"""
SELECT app_id, concat_ws(',', {', '.join(
    f"CASE WHEN NOT coalesce({c} IN ({', '.join(repr(x) for x in v)}), false) THEN '{c}_domain' END"
    for c, v in quality.DOMAINS.items())}) AS violations
FROM (SELECT app_id, {', '.join(f'{e} AS {c}' for c, e in _ODD_LABELS.items())} FROM applications) a""")
def q_validate_domain(spark, sf_dir):
    odd = _apps(spark, sf_dir).selectExpr("app_id", *(f"{e} AS {c}" for c, e in _ODD_LABELS.items()))
    v = quality.validate(odd, quality.DOMAIN_RULES, required=None)
    return v.select("app_id", F.array_join("violations", ",").alias("violations"))


@register("form_defaults", f"""
SELECT app_id, {', '.join(f"coalesce({c}, '{d}') AS {c}" for c, d in FORM_DEFAULTS.items())}
FROM (SELECT app_id, {', '.join(f"CASE WHEN app_id % {n} = 0 THEN NULL ELSE {c} END AS {c}" for n, c in zip((2, 3, 5), FORM_DEFAULTS))} FROM applications) a""")
def q_form_defaults(spark, sf_dir):
    unset = _apps(spark, sf_dir).select("app_id", *(F.when(F.col("app_id") % n != 0, F.col(c)).alias(c) for n, c in zip((2, 3, 5), FORM_DEFAULTS)))
    return quality.fill_form_defaults(unset)


# --- P1-P3: splits --------------------------------------------------------------
@register("split_hash", """
SELECT app_id, status, substring(md5('42:' || CAST(app_id AS VARCHAR)), 1, 8) < '33333333' AS is_test
FROM applications""")
def q_split_hash(spark, sf_dir):
    return split.hash_split(_apps(spark, sf_dir), "app_id", 0.2, 42).select("app_id", "status", "is_test")


_EXACT_SPLIT_SQL = """
WITH cc AS (SELECT status, count(*) AS n_c FROM applications GROUP BY status),
tot AS (SELECT sum(n_c) AS n, sum(n_c) - CAST(ceil(0.2 * sum(n_c)) AS BIGINT) AS n_train FROM cc),
alloc AS (SELECT cc.status, cc.n_c, (tot.n_train * cc.n_c) // tot.n AS fl, (tot.n_train * cc.n_c) % tot.n AS rem,
                 tot.n_train FROM cc, tot),
ranked AS (SELECT *, row_number() OVER (ORDER BY rem DESC, status) AS pos, sum(fl) OVER () AS fl_sum FROM alloc),
targets AS (SELECT status, n_c - fl - CASE WHEN pos <= n_train - fl_sum THEN 1 ELSE 0 END AS t FROM ranked),
h AS (SELECT app_id, status, row_number() OVER (PARTITION BY status
        ORDER BY md5('42:' || CAST(app_id AS VARCHAR)), app_id) AS rn FROM applications)
SELECT h.app_id, h.status, h.rn <= targets.t AS is_test FROM h JOIN targets USING (status)"""


@register("split_exact", _EXACT_SPLIT_SQL)
def q_split_exact(spark, sf_dir):
    return split.stratified_split(_apps(spark, sf_dir), "app_id", TARGET, 0.2, 42).select(
        "app_id", "status", "is_test")


@register("split_sizes", f"""
SELECT is_test, status, count(*) AS rows FROM ({_EXACT_SPLIT_SQL}) s GROUP BY is_test, status""")
def q_split_sizes(spark, sf_dir):
    return split.split_sizes(q_split_exact(spark, sf_dir), TARGET)


@register("split_null_ids", f"""
SELECT is_test, status, count(*) AS rows FROM ({_EXACT_SPLIT_SQL}) s GROUP BY is_test, status""")
def q_split_null_ids(spark, sf_dir):
    """P1 and P3 where ids are missing or shared: every row has a side, the sizes stay exact."""
    some = F.when(F.col("app_id") % 5 == 0, F.lit(None)).when(F.col("app_id") % 5 == 1, F.lit(7)).otherwise(F.col("app_id"))
    apps = _apps(spark, sf_dir).withColumn("order_key", F.col("app_id")).withColumn("app_id", some.cast("long"))
    return split.split_sizes(split.stratified_split(apps, "app_id", TARGET, 0.2, 42), TARGET)


# --- H1-H4: evaluation of the rule predictor ``percent_income > 0.5`` ------------
_RULE_PRED = "CAST(percent_income > 0.5 AS INT)"


def _rule_predicted(spark, sf_dir):
    return _apps(spark, sf_dir).withColumn("predicted", (F.col("percent_income") > 0.5).cast("int"))


@register("confusion_matrix", f"""
SELECT c.actual, c.predicted, count(p.status) AS count
FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS c(actual, predicted)
LEFT JOIN (SELECT status, {_RULE_PRED} AS predicted FROM applications) p
  ON p.status = c.actual AND p.predicted = c.predicted
GROUP BY c.actual, c.predicted""")
def q_confusion_matrix(spark, sf_dir):
    return evaluate.confusion_matrix(_rule_predicted(spark, sf_dir), TARGET, "predicted")


@register("confusion_zero_cells", """
SELECT a.i AS actual, p.i AS predicted, CASE WHEN a.i = 3 AND p.i = 3 THEN (SELECT count(*) FROM applications) ELSE 0 END AS count
FROM (VALUES (1), (2), (3), (4), (5)) a(i), (VALUES (1), (2), (3), (4), (5)) p(i)""")
def q_confusion_zero_cells(spark, sf_dir):
    """H5: one class is seen, of five; all other cells count 0."""
    three = F.lit(3).alias
    return evaluate.confusion_matrix(_apps(spark, sf_dir).select(three("actual"), three("predicted")), "actual", "predicted", classes=(1, 2, 3, 4, 5))


@register("confusion_three_class", """
WITH x AS (SELECT CASE app_id % 6 WHEN 3 THEN 7 WHEN 4 THEN NULL ELSE app_id % 6 % 3 END AS actual, age % 3 AS predicted FROM applications)
SELECT c.actual, c.predicted, count(x.predicted) AS count
FROM (VALUES (0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (1, 2), (2, 0), (2, 1), (2, 2)) AS c(actual, predicted)
LEFT JOIN x ON x.actual = c.actual AND x.predicted = c.predicted GROUP BY c.actual, c.predicted
UNION ALL SELECT NULL, NULL, count(*) FROM x WHERE actual IS NULL OR actual = 7 OR predicted IS NULL""")
def q_confusion_three_class(spark, sf_dir):
    """H2 over three classes, with labels outside them and missing ones."""
    k = F.col("app_id") % 6
    x = _apps(spark, sf_dir).select(F.when(k == 3, 7).when(k != 4, k % 3).cast("int").alias("actual"), (F.col("age") % 3).alias("predicted"))
    return evaluate.confusion_matrix(x, "actual", "predicted", classes=(0, 1, 2))


_CM_CTE = f"""cm AS (
  SELECT count(*) FILTER (WHERE status = 0 AND p = 0) AS c00, count(*) FILTER (WHERE status = 0 AND p = 1) AS c01,
         count(*) FILTER (WHERE status = 1 AND p = 0) AS c10, count(*) FILTER (WHERE status = 1 AND p = 1) AS c11
  FROM (SELECT status, {_RULE_PRED} AS p FROM applications) x),
m AS (
  SELECT coalesce(c00 / nullif(c00 + c10, 0), 0) AS p0, coalesce(c00 / nullif(c00 + c01, 0), 0) AS r0,
         coalesce(c11 / nullif(c01 + c11, 0), 0) AS p1, coalesce(c11 / nullif(c10 + c11, 0), 0) AS r1,
         c00 + c01 AS s0, c10 + c11 AS s1, c00 + c01 + c10 + c11 AS total, c00 + c11 AS trace FROM cm),
f AS (SELECT *, coalesce(2 * p0 * r0 / nullif(p0 + r0, 0), 0) AS f0,
                coalesce(2 * p1 * r1 / nullif(p1 + r1, 0), 0) AS f1 FROM m)"""


@register("class_report", f"""
WITH {_CM_CTE}
SELECT '0' AS row_name, {_r('p0', 4)} AS precision, {_r('r0', 4)} AS recall, {_r('f0', 4)} AS f1, s0 AS support FROM f
UNION ALL SELECT '1', {_r('p1', 4)}, {_r('r1', 4)}, {_r('f1', 4)}, s1 FROM f
UNION ALL SELECT 'macro avg', {_r('(p0 + p1) / 2.0', 4)}, {_r('(r0 + r1) / 2.0', 4)}, {_r('(f0 + f1) / 2.0', 4)}, total FROM f
UNION ALL SELECT 'weighted avg', {_r('(p0 * s0 + p1 * s1) / total', 4)}, {_r('(r0 * s0 + r1 * s1) / total', 4)},
                 {_r('(f0 * s0 + f1 * s1) / total', 4)}, total FROM f""")
def q_class_report(spark, sf_dir):
    return evaluate.classification_report(_rule_predicted(spark, sf_dir), TARGET, "predicted", rounding=R)


@register("accuracy", f"""
WITH {_CM_CTE}
SELECT {_r('CAST(trace AS DOUBLE) / total', 4)} AS accuracy, {_r('CAST(trace AS DOUBLE) / total * 100', 1)} AS accuracy_percent,
       total AS test_rows FROM f""")
def q_accuracy(spark, sf_dir):
    return evaluate.accuracy(_rule_predicted(spark, sf_dir), TARGET, "predicted", rounding=R)


_MANY_CLASSES = """x AS (SELECT CAST(app_id % 1000 AS INT) AS a, CAST(CASE WHEN app_id % 3 = 0 THEN app_id % 1000 ELSE app_id * 7 % 1003 END AS INT) AS p FROM applications)"""


def _many_predicted(spark, sf_dir):
    """A thousand classes; a third of the rows is right, some predictions are none of the classes."""
    k = F.col("app_id")
    return _apps(spark, sf_dir).select((k % 1000).cast("int").alias("a"), F.when(k % 3 == 0, k % 1000).otherwise(k * 7 % 1003).cast("int").alias("p"))


@register("confusion_cells_many", f"WITH {_MANY_CLASSES} SELECT a AS actual, p AS predicted, count(*) AS count FROM x GROUP BY a, p")
def q_confusion_cells_many(spark, sf_dir):
    """H2 over a thousand classes: the cells that occur."""
    return evaluate.confusion_cells(_many_predicted(spark, sf_dir), "a", "p")


@register("class_report_many", f"""
WITH {_MANY_CLASSES},
k AS (SELECT CAST(i AS INT) AS c FROM range(1000) r(i)),
m AS (SELECT c, (SELECT count(*) FROM x WHERE a = c AND p = c) AS tp, (SELECT count(*) FROM x WHERE a = c AND p < 1000) AS s,
             (SELECT count(*) FROM x WHERE p = c) AS q, (SELECT count(*) FROM x) AS total FROM k),
r AS (SELECT c, s, total, coalesce(tp / nullif(q, 0), 0) AS pr, coalesce(tp / nullif(s, 0), 0) AS re FROM m),
f AS (SELECT *, coalesce(2 * pr * re / nullif(pr + re, 0), 0) AS f1 FROM r)
SELECT CAST(c AS VARCHAR) AS row_name, {_r('pr', 4)} AS precision, {_r('re', 4)} AS recall, {_r('f1', 4)} AS f1, s AS support FROM f
UNION ALL SELECT 'macro avg', {_r('avg(pr)', 4)}, {_r('avg(re)', 4)}, {_r('avg(f1)', 4)}, max(total) FROM f
UNION ALL SELECT 'weighted avg', {_r('sum(pr * s) / max(total)', 4)}, {_r('sum(re * s) / max(total)', 4)}, {_r('sum(f1 * s) / max(total)', 4)}, max(total) FROM f""")
def q_class_report_many(spark, sf_dir):
    """H3 and H4 over a thousand classes."""
    return evaluate.classification_report(_many_predicted(spark, sf_dir), "a", "p", classes=range(1000), rounding=R)


# --- I1-I3: decision, confidence and risk from a group-rate scorer ---------------
# The probability of class 1 is the outcome rate of the applicant's
# (intent, home) group: a transparent, deterministic stand-in for a model.
@register("risk_level", f"""
WITH g AS (SELECT app_id, avg(status) OVER (PARTITION BY intent, home) AS p1 FROM applications),
s AS (SELECT app_id, CASE WHEN p1 > 0.5 THEN 1 ELSE 0 END AS code,
             {_r('greatest(p1, 1 - p1) * 100', 1)} AS confidence FROM g)
SELECT app_id, CASE WHEN code = 0 THEN 'Approved' ELSE 'Rejected' END AS prediction, code AS prediction_code,
       confidence,
       CASE WHEN code = 0 THEN (CASE WHEN confidence >= 80 THEN 'Low Risk' WHEN confidence >= 60 THEN 'Medium Risk'
                                     ELSE 'High Risk' END)
            ELSE (CASE WHEN confidence >= 80 THEN 'High Risk' WHEN confidence >= 60 THEN 'Medium Risk'
                       ELSE 'Low Risk' END) END AS risk_level
FROM s""")
def q_risk_level(spark, sf_dir):
    apps = _apps(spark, sf_dir)
    rates = apps.groupBy("intent", "home").agg(F.avg(F.col("status").cast("double")).alias("p1"))
    # One row per group, its bytes known: Spark broadcasts it, so the applications are not shuffled.
    rates = joins.stored(rates.select(F.col("intent").alias("i"), F.col("home").alias("h"), "p1"))
    scored = apps.select("app_id", "intent", "home").join(rates, F.col("intent").eqNullSafe(F.col("i")) & F.col("home").eqNullSafe(F.col("h")), "left")
    code = F.when(F.col("p1") > 0.5, 1).otherwise(0)
    conf = explain.confidence_from_array(F.array(F.col("p1"), F.lit(1.0) - F.col("p1")), rounding=round_half_up)
    return scored.select(
        "app_id", explain.decision(code).alias("prediction"), code.alias("prediction_code"),
        conf.alias("confidence"), explain.risk_level(code, conf).alias("risk_level"))


# --- I4-I10 / M4: factors in long form; fixed values: bounds and messages, stated apart from the operator ------------------------------------------------
def _factor_sql():
    marks = {"good": "✅", "medium": "⚡", "bad": "⚠️"}
    pct = "format('{:.0f}', percent_income * 100) || '%'"
    rate = "format('{:.1f}', rate)"
    inc = "format('{:,.0f}', income)"
    cred = "CAST(cred_length AS VARCHAR)"
    emp = "format('{:.0f}', emp_length)"

    def case(col, bands, default, val):
        lv = " ".join(f"WHEN {cond} THEN '{lvl}'" for cond, lvl, _ in bands)
        tx = " ".join(f"WHEN {cond} THEN {msg(lvl, m, val)}" for cond, lvl, m in bands)
        return (f"CASE WHEN {col} IS NULL THEN NULL {lv} ELSE '{default[0]}' END",
                f"CASE WHEN {col} IS NULL THEN NULL {tx} ELSE {msg(default[0], default[1], val)} END")

    def msg(lvl, m, val):
        if "{v}" not in m:
            return f"'{marks[lvl]} {m}'"
        head, tail = m.split("{v}")
        return f"'{marks[lvl]} {head}' || {val} || '{tail}'"

    specs = [
        ("debt_to_income", "percent_income", [("percent_income > 0.4", "bad", "High debt-to-income ratio ({v})"),
                                              ("percent_income > 0.2", "medium", "Moderate debt-to-income ratio ({v})")],
         ("good", "Low debt-to-income ratio ({v})"), pct),
        ("interest_rate", "rate", [("rate > 15", "bad", "High interest rate ({v}%)"),
                                   ("rate > 10", "medium", "Moderate interest rate ({v}%)")],
         ("good", "Low interest rate ({v}%)"), rate),
        ("income", "income", [("income >= 100000", "good", "Strong income (${v})"),
                              ("income >= 50000", "medium", "Moderate income (${v})")],
         ("bad", "Lower income (${v})"), inc),
        ("credit_history", "cred_length", [("cred_length >= 4", "good", "Good credit history ({v} years)"),
                                           ("cred_length >= 2", "medium", "Short credit history ({v} years)")],
         ("bad", "Very short credit history ({v} years)"), cred),
        ("previous_default", "default_flag", [("upper(default_flag) = 'Y'", "bad", "Has previous default on record")],
         ("good", "No previous defaults"), None),
        ("employment", "emp_length", [("emp_length >= 5", "good", "Stable employment ({v} years)"),
                                      ("emp_length >= 2", "medium", "Moderate employment history ({v} years)")],
         ("bad", "Short employment history ({v} years)"), emp),
    ]
    parts = []
    for name, col, bands, default, val in specs:
        lv, tx = case(col, bands, default, val)
        parts.append(f"SELECT app_id, '{name}' AS factor, {lv} AS level, {tx} AS text FROM applications")
    return " UNION ALL ".join(parts)


@register("factors_long", _factor_sql())
def q_factors_long(spark, sf_dir):
    apps = _apps(spark, sf_dir)
    return apps.select("app_id", F.explode(explain.factors_long()).alias("f")).select(
        "app_id", "f.factor", "f.level", "f.text")


# --- K5 / K6: display labels ---------------------------------------------------------
@register("labels_pretty", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, count(*) AS count, "
    f"'{' '.join(w[:1].upper() + w[1:].lower() for w in c.split('_'))}' AS column_label, "
    f"upper(substring({c}, 1, 1)) || lower(substring({c}, 2)) AS value_label "
    f"FROM applications WHERE {c} IS NOT NULL GROUP BY {c}" for c in CATEGORICAL))
def q_labels_pretty(spark, sf_dir):
    from ..functions.text import capitalize_first, key_to_label
    vc = profile.value_counts_multi(_apps(spark, sf_dir), CATEGORICAL)
    return vc.select("column_name", "value", "count",
                     key_to_label(F.col("column_name")).alias("column_label"),
                     capitalize_first(F.col("value")).alias("value_label"))


# --- R1 / R3 / R4: dataset statistics and dashboard data ------------------------------
def _stats_rows_sql():
    parts = [
        "SELECT 'total_records' AS section, CAST(NULL AS VARCHAR) AS key, CAST(count(*) AS DOUBLE) AS value FROM applications",
        "SELECT 'approved_count', NULL, CAST(sum(status) AS DOUBLE) FROM applications",
        "SELECT 'rejected_count', NULL, CAST(count(*) - sum(status) AS DOUBLE) FROM applications",
        f"SELECT 'approval_rate', NULL, {_r('CAST(sum(status) AS DOUBLE) / count(*) * 100', 1)} FROM applications",
    ]
    for i, lab in enumerate(AGE_BIN_LABELS):
        parts.append(f"SELECT 'age_distribution', '{lab}', CAST(count(*) FILTER (WHERE age > {AGE_BIN_EDGES[i]} "
                     f"AND age <= {AGE_BIN_EDGES[i + 1]}) AS DOUBLE) FROM applications")
    fn = {"mean": "avg", "median": "median", "min": "min", "max": "max", "std": "stddev_samp"}
    for sec, (col, funcs) in reports.STATS_SPEC.items():
        for f in funcs:
            parts.append(f"SELECT '{sec}', '{f}', {_r(f'{fn[f]}({col})', 2)} FROM applications")
    for sec, col in reports.DISTRIBUTIONS.items():
        parts.append(f"SELECT '{sec}', CAST({col} AS VARCHAR), CAST(count(*) AS DOUBLE) FROM applications "
                     f"WHERE {col} IS NOT NULL GROUP BY {col}")
    for sec, col in reports.RATES.items():
        parts.append(f"SELECT '{sec}', CAST({col} AS VARCHAR), {_r('avg(status) * 100', 1)} FROM applications "
                     f"WHERE {col} IS NOT NULL GROUP BY {col}")
    return " UNION ALL ".join(parts)


_STATS_ROWS_SQL = _stats_rows_sql()


@register("dataset_stats", _STATS_ROWS_SQL)
def q_dataset_stats(spark, sf_dir):
    return reports.dataset_stats(_apps(spark, sf_dir), TARGET, rounding=R)


# A stand-in for a model's importances that SQL can state: the distance of the class means over the largest value.
_IMPORTANCE_SQL = " UNION ALL ".join(
    f"SELECT '{DISPLAY_NAME[c]}' AS feature, {_r(f'abs(avg({c}) FILTER (WHERE status = 1) - avg({c}) FILTER (WHERE status = 0)) / max({c})', 4)} AS importance "
    f"FROM applications" for c in NUMERIC)


def _rule_importance(apps):
    mean = lambda c, k: F.avg(F.when(F.col(TARGET) == k, F.col(c)))
    wide = apps.agg(*(round_half_up(F.abs(mean(c, 1) - mean(c, 0)) / F.max(c), 4).alias(c) for c in NUMERIC))
    rows = [F.struct(F.lit(DISPLAY_NAME[c]).alias("feature"), F.col(c).alias("importance")) for c in NUMERIC]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


_LABEL_SQL = "upper(substring(key, 1, 1)) || lower(substring(key, 2))"


@register("chart_series", f"""
WITH st AS ({_STATS_ROWS_SQL})
SELECT 'approval' AS series, CASE WHEN section = 'approved_count' THEN 0 ELSE 1 END AS position,
       CASE WHEN section = 'approved_count' THEN 'Approved' ELSE 'Rejected' END AS label, value
FROM st WHERE section IN ('approved_count', 'rejected_count')
UNION ALL
SELECT CASE section WHEN 'intent_distribution' THEN 'intent' ELSE 'home' END,
       CAST(row_number() OVER (PARTITION BY section ORDER BY value DESC, key) - 1 AS INT), {_LABEL_SQL}, value
FROM st WHERE section IN ('intent_distribution', 'home_distribution')
UNION ALL
SELECT section, CAST(row_number() OVER (ORDER BY key) - 1 AS INT), {_LABEL_SQL}, value FROM st WHERE section = 'approval_by_intent'
UNION ALL
SELECT 'age', CASE key {' '.join(f"WHEN '{lab}' THEN {i}" for i, lab in enumerate(AGE_BIN_LABELS))} END, key, value
FROM st WHERE section = 'age_distribution'
UNION ALL
SELECT 'importance', CAST(row_number() OVER (ORDER BY importance DESC, feature) - 1 AS INT),
       CASE feature {' '.join(f"WHEN '{DISPLAY_NAME[c]}' THEN '{' '.join(w.capitalize() for w in DISPLAY_NAME[c].split('_'))}'" for c in NUMERIC)} END,
       importance * 100 FROM ({_IMPORTANCE_SQL}) i""")
def q_chart_series(spark, sf_dir):
    apps = _apps(spark, sf_dir)
    return reports.chart_series(reports.dataset_stats(apps, TARGET, rounding=R), joins.stored(_rule_importance(apps)))


@register("kpi_rows", f"""
WITH st AS ({_STATS_ROWS_SQL}), {_CM_CTE}
SELECT 'total_applications' AS name, value, format('{{:,.0f}}', value) AS text FROM st WHERE section = 'total_records'
UNION ALL SELECT 'approved', value, format('{{:,.0f}}', value) FROM st WHERE section = 'approved_count'
UNION ALL SELECT 'rejected', value, format('{{:,.0f}}', value) FROM st WHERE section = 'rejected_count'
UNION ALL SELECT 'approval_rate', value, format('{{:.1f}}', value) || '%' FROM st WHERE section = 'approval_rate'
UNION ALL SELECT 'rejection_rate', 100.0 - value, format('{{:.1f}}', 100.0 - value) || '%' FROM st WHERE section = 'approval_rate'
UNION ALL SELECT 'avg_income', value, format('{{:,.2f}}', value) FROM st WHERE section = 'income_stats' AND key = 'mean'
UNION ALL SELECT 'avg_amount', value, format('{{:,.2f}}', value) FROM st WHERE section = 'amount_stats' AND key = 'mean'
UNION ALL SELECT 'avg_rate', value, format('{{:.2f}}', value) || '%' FROM st WHERE section = 'rate_stats' AND key = 'mean'
UNION ALL SELECT 'max_amount', value, format('{{:,.2f}}', value) FROM st WHERE section = 'amount_stats' AND key = 'max'
UNION ALL SELECT 'model_accuracy', a, format('{{:.1f}}', a) || '%' FROM (SELECT {_r('CAST(trace AS DOUBLE) / total * 100', 1)} AS a FROM f) x""")
def q_kpi_rows(spark, sf_dir):
    accuracy = evaluate.accuracy(_rule_predicted(spark, sf_dir), TARGET, "predicted", rounding=R).first().accuracy_percent
    return reports.kpi_rows(reports.dataset_stats(_apps(spark, sf_dir), TARGET, rounding=R), accuracy)


# --- R5 / A6 / A7 / B12 / M7 / M8 / M9: a report written, read again and shown ---------
def _rule_report(spark, sf_dir):
    """The report document of the rule predictor, written by Spark and read back."""
    apps = _apps(spark, sf_dir)
    summary = evaluate.report_summary(_rule_predicted(spark, sf_dir), TARGET, "predicted", rounding=R).first().asDict(recursive=True)
    report = reports.Report(
        scalars={"model_type": "Rule Predictor Classifier", "accuracy": summary["accuracy"], "accuracy_percent": summary["accuracy_percent"], "n_estimators": 1},
        feature_columns=FEATURE_DISPLAY_NAMES, codes=encode.label_codes(apps, CATEGORICAL), importance=_rule_importance(apps),
        classification_report={k: summary[k] for k in ("precision_rejected", "recall_rejected", "precision_approved", "recall_approved")},
        stats=joins.stored(reports.dataset_stats(apps, TARGET, rounding=R)), confusion_matrix=summary["confusion_matrix"])
    path = scratch_path(spark, f"report_{uuid.uuid4().hex[:12]}")
    reports.write_report(spark, report, path)
    return reports.read_report(spark, path)


def _page_sql():
    pct = lambda e: f"format('{{:.1f}}', {_r(e, 4)} * 100) || '%'"
    rows = ["SELECT 'card' AS section, 0 AS position, 'Model' AS label, 'Rule Predictor' AS text",
            f"SELECT 'card', 1, 'Accuracy', format('{{:.1f}}', {_r('CAST(trace AS DOUBLE) / total * 100', 1)}) || '%' FROM f",
            f"SELECT 'card', 2, 'Features', '{len(FEATURE_DISPLAY_NAMES)}'"]
    for i, name in enumerate(("Rejected", "Approved")):
        rows += [f"SELECT 'report', {2 * i}, '{name} ({i}) precision', {pct(f'p{i}')} FROM f",
                 f"SELECT 'report', {2 * i + 1}, '{name} ({i}) recall', {pct(f'r{i}')} FROM f"]
        rows += [f"SELECT 'matrix', {2 * i + j}, 'Actual: {name}, Pred: {other}', CAST(c{i}{j} AS VARCHAR) FROM cm" for j, other in enumerate(("Rejected", "Approved"))]
    for i, c in enumerate(FEATURE_DISPLAY_NAMES):
        label = " ".join(w.capitalize() for w in c.split("_"))
        rows.append(f"SELECT 'feature', {i + 1}, '{label}', format('{{:.1f}}', coalesce((SELECT importance FROM imp WHERE feature = '{c}'), 0) * 100) || '%'")
    return f"WITH {_CM_CTE}, imp AS ({_IMPORTANCE_SQL}) " + " UNION ALL ".join(rows)


@register("report_model_page", _page_sql())
def q_report_model_page(spark, sf_dir):
    return reports.model_page(_rule_report(spark, sf_dir))


@register("report_stats_section", _STATS_ROWS_SQL)
def q_report_stats_section(spark, sf_dir):
    return reports.stats_rows(_rule_report(spark, sf_dir))


# --- R2: the whole report document ------------------------------------------------------
def _document_sql():
    none = "CAST(NULL AS VARCHAR)"
    shown = " ".join(f"WHEN '{c}' THEN '{DISPLAY_NAME[c]}'" for c in CATEGORICAL)
    rows = [f"SELECT 'scalar' AS section, 'accuracy' AS name, {none} AS label, {_r('CAST(trace AS DOUBLE) / total', 4)} AS value FROM f",
            f"SELECT 'scalar', 'accuracy_percent', {none}, {_r('CAST(trace AS DOUBLE) / total * 100', 1)} FROM f",
            f"SELECT 'scalar', 'n_estimators', {none}, 1e0",
            f"SELECT 'feature_importance', feature, {none}, importance FROM ({_IMPORTANCE_SQL}) i",
            f"SELECT 'encoding_maps', CASE column_name {shown} END, label, CAST(code AS DOUBLE) FROM ({_CODES_SQL}) c",
            f"SELECT section, section, key, value FROM ({_STATS_ROWS_SQL}) st"]
    rows += [f"SELECT 'feature_columns', '{c}', {none}, {i + 1}e0" for i, c in enumerate(FEATURE_DISPLAY_NAMES)]
    for i, name in enumerate(("rejected", "approved")):
        rows += [f"SELECT 'classification_report', 'precision_{name}', {none}, {_r(f'p{i}', 4)} FROM f",
                 f"SELECT 'classification_report', 'recall_{name}', {none}, {_r(f'r{i}', 4)} FROM f"]
        rows += [f"SELECT 'confusion_matrix', '{i}', '{j}', CAST(c{i}{j} AS DOUBLE) FROM cm" for j in range(2)]
    return f"WITH {_CM_CTE} " + " UNION ALL ".join(rows)


@register("report_document", _document_sql())
def q_report_document(spark, sf_dir):
    return reports.report_rows(_rule_report(spark, sf_dir))


# --- B11: numbers typed as text (JavaScript parseInt / parseFloat rules) ---------------
_INT_RE = r"^([+-]?[0-9]+)"
_FLOAT_RE = r"^([+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?)"


def _parse_sql(col, pattern, typ):
    m = f"regexp_extract(ltrim({col}), '{pattern}', 1)"
    return f"CASE WHEN {m} = '' THEN NULL ELSE TRY_CAST({m} AS {typ}) END"


@register("priority_numbers", f"""
SELECT o_orderkey, {_parse_sql('o_orderpriority', _INT_RE, 'BIGINT')} AS priority_int,
       {_parse_sql('o_orderpriority', _FLOAT_RE, 'DOUBLE')} AS priority_float,
       {_parse_sql('o_orderstatus', _INT_RE, 'BIGINT')} AS status_int
FROM orders""")
def q_priority_numbers(spark, sf_dir):
    from ..functions.numeric import parse_float_prefix, parse_int_prefix
    from ..sources.tables import load_table
    o = load_table(spark, sf_dir, "orders")
    return o.select("o_orderkey", parse_int_prefix("o_orderpriority").alias("priority_int"),
                    parse_float_prefix("o_orderpriority").alias("priority_float"),
                    parse_int_prefix("o_orderstatus").alias("status_int"))


# --- K10: text bars of the approval rate per intent ---------------------------------------
@register("approval_bars", f"""
SELECT intent, approval_rate, repeat('#', CAST(trunc(approval_rate / 100 * 50) AS INTEGER)) AS bar
FROM (SELECT intent, {_r('avg(status) * 100', 1)} AS approval_rate FROM applications
      WHERE intent IS NOT NULL GROUP BY intent) r""")
def q_approval_bars(spark, sf_dir):
    from ..functions.text import text_bar
    rates = profile.rate_by_group(_apps(spark, sf_dir), "intent", TARGET, rounding=R)
    return rates.select("intent", "approval_rate", text_bar(F.col("approval_rate") / 100, 50).alias("bar"))


# --- M1 / M3 / M4 / M10: distributions as JSON maps and back to rows -----------------------
@register("report_roundtrip", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, count(*) AS count "
    f"FROM applications WHERE {c} IS NOT NULL GROUP BY {c}" for c in CATEGORICAL))
def q_report_roundtrip(spark, sf_dir):
    """Value counts -> one JSON object per column (as the report stores them) -> rows again.

    The map per column holds one entry per distinct category value, as the
    report itself does, never one per row.
    """
    vc = profile.value_counts_multi(_apps(spark, sf_dir), CATEGORICAL)
    docs = vc.groupBy("column_name").agg(
        F.to_json(F.map_from_entries(F.collect_list(F.struct("value", "count")))).alias("doc"))
    back = docs.select("column_name", F.explode(F.from_json("doc", "map<string,bigint>")).alias("value", "count"))
    return back


# --- A1 / A2: applications as CSV text and back -------------------------------------------
_CSV_HOME = "CASE WHEN app_id % 7 = 0 THEN home || ' \"x\", y\nz' ELSE home END"


@register("csv_roundtrip", f"""
SELECT app_id, age, income, {_CSV_HOME.replace(chr(10), "' || chr(10) || '")} AS home, emp_length, intent, amount, rate, status, percent_income, default_flag, cred_length, 'bad' AS rejected
FROM applications""")
def q_csv_roundtrip(spark, sf_dir):
    """Written as pandas writes columns with gaps (whole numbers as 22.0, several
    null tokens, quoted quotes and line breaks), then read with the reader."""
    path = scratch_path(spark, f"csv_{uuid.uuid4().hex[:12]}")
    apps = _apps(spark, sf_dir).withColumn("home", F.expr(_CSV_HOME.replace("\n", "\\n")))
    names = {v: k for k, v in FROM_DISPLAY.items()}
    text = lambda f: F.col(f.name).cast("double").cast("string") if isinstance(f.dataType, T.NumericType) else F.col(f.name)
    token = F.element_at(F.array(*map(F.lit, ("NA", "null", "nan"))), (F.col("app_id") % 3 + 1).cast("int"))
    order = {c: f for c, f in ((names[f.name], f) for f in apps.schema)}
    cols = [F.coalesce(text(order[f.name]), token).alias(f.name) for f in RAW_APPLICATION_SCHEMA.fields]
    # A value that is no number must stay visible among the rejects.
    extra = T.StructField("Extra", T.IntegerType(), True)
    apps.select(*cols, F.lit("bad").alias("Extra")).write.option("header", True).option("escape", '"').csv(path)
    back = files.read_applications_csv(spark, path, T.StructType([*RAW_APPLICATION_SCHEMA.fields, extra]), rejects=True)
    return back.withColumn("rejected", F.col("rejects")["Extra"]).drop("Extra", "rejects")


_CSV_LINE = ("concat_ws(',', CAST(app_id AS VARCHAR), CAST(age AS VARCHAR), '59000', {home}, '5', 'MEDICAL', '35000', '16.02', {status}, '0.59', 'Y', '3')")
_CSV_TEXT = {"home": "CASE WHEN app_id % 7 = 0 THEN '\"two' || chr(10) || 'lines\"' ELSE home END", "status": "CASE WHEN app_id % 13 = 0 THEN 'x' ELSE CAST(status AS VARCHAR) END"}
_CSV_DAMAGED = f"CASE WHEN app_id % 5 = 0 THEN {_CSV_LINE} || ',3' WHEN app_id % 11 = 0 THEN CAST(app_id AS VARCHAR) || ',22' ELSE {_CSV_LINE} END".format(**_CSV_TEXT)


@register("csv_rejects", f"""
WITH t AS (SELECT app_id, {_CSV_DAMAGED} AS record FROM applications)
SELECT '13 fields' AS reason, CAST(NULL AS VARCHAR) AS column_name, record AS value, count(*) AS n FROM t WHERE app_id % 5 = 0 GROUP BY record
UNION ALL SELECT '2 fields', NULL, record, count(*) FROM t WHERE app_id % 5 <> 0 AND app_id % 11 = 0 GROUP BY record
UNION ALL SELECT 'type', 'status', 'x', count(*) FROM t WHERE app_id % 5 <> 0 AND app_id % 11 <> 0 AND app_id % 13 = 0
UNION ALL SELECT 'row', NULL, NULL, count(*) FROM t WHERE app_id % 5 <> 0 AND app_id % 11 <> 0""")
def q_csv_rejects(spark, sf_dir):
    """A1 and A2 over files with malformed records, quoted line breaks and
    values that can't be cast: each is in the rejects, the rest are rows. Every
    task writes a file of its own, with a header."""
    path = scratch_path(spark, f"csv_{uuid.uuid4().hex[:12]}")
    record = F.expr(_CSV_DAMAGED.replace("VARCHAR", "STRING"))
    header = ",".join(RAW_APPLICATION_SCHEMA.fieldNames())

    def headed(batches):
        import pyarrow as pa
        yield pa.RecordBatch.from_pydict({"value": [header]})
        yield from batches

    _apps(spark, sf_dir).select(record.alias("value")).mapInArrow(headed, "value string").write.text(path)
    table = files.scan_applications_csv(spark, path)
    listed = table.rejects.groupBy("reason", "column_name", "value").agg(F.count("*").alias("n"))
    whole = table.rows.agg(F.lit("row").alias("reason"), F.lit(None).cast("string").alias("column_name"), F.lit(None).cast("string").alias("value"), F.count("*").alias("n"))
    return listed.select("reason", "column_name", "value", "n").unionByName(whole)
