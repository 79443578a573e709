"""Schemas, column roles and the fixed values the results depend on."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values. These must equal the original application's values for the
# results to agree; they are stated here together, in their natural order.
# ---------------------------------------------------------------------------

# Feature order used by the model (display names as in the original report).
FEATURE_DISPLAY_NAMES = [
    "Age", "Income", "Home", "Emp_length", "Intent",
    "Amount", "Rate", "Percent_income", "Default", "Cred_length",
]
# Category domains.
HOME_VALUES = ["RENT", "OWN", "MORTGAGE", "OTHER"]
INTENT_VALUES = [
    "PERSONAL", "EDUCATION", "MEDICAL", "VENTURE", "HOMEIMPROVEMENT", "DEBTCONSOLIDATION",
]
DEFAULT_VALUES = ["Y", "N"]
# Age bins: right-closed ranges (0,25], (25,30], ... (50,200].
AGE_BIN_EDGES = [0, 25, 30, 35, 40, 50, 200]
AGE_BIN_LABELS = ["18-25", "26-30", "31-35", "36-40", "41-50", "50+"]
# Age outlier cap: values above it are replaced.
AGE_CAP = 100
# Random forest settings of the original training run.
FOREST_TREES = 100
FOREST_DEPTH = 15
FOREST_MIN_LEAF = 2
FOREST_SEED = 42
TEST_FRACTION = 0.2
SPLIT_SEED = 42
MODEL_TYPE = "Random Forest Classifier"
# Form defaults for unset fields.
FORM_DEFAULTS = {"home": "RENT", "intent": "PERSONAL", "default_flag": "N"}
# Status marks that prefix each factor text, by level.
LEVEL_MARKS = {"good": "✅", "medium": "⚡", "bad": "⚠️"}
# Missing-value tokens a pandas CSV read turns into nulls (pandas defaults).
NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# ---------------------------------------------------------------------------
# Column names used inside this library (snake case; ``Default`` is a SQL
# keyword, so it becomes ``default_flag``).
# ---------------------------------------------------------------------------

ID = "app_id"
TARGET = "status"
FEATURES = ["default_flag" if name == "Default" else name.lower() for name in FEATURE_DISPLAY_NAMES]
# Categorical columns get integer codes, numeric ones a median fill where they hold nulls.
CATEGORICAL = ["home", "intent", "default_flag"]
NUMERIC = [name for name in FEATURES if name not in CATEGORICAL]
DISPLAY_NAME = dict(zip(FEATURES, FEATURE_DISPLAY_NAMES))
FROM_DISPLAY = {v: k for k, v in DISPLAY_NAME.items()} | {"Id": ID, "Status": TARGET}
DOMAINS = {"home": HOME_VALUES, "intent": INTENT_VALUES, "default_flag": DEFAULT_VALUES}


@dataclass(frozen=True)
class LabelSpec:
    """Names of the two outcome codes.

    The training report calls 1 "Approved"; the scoring service calls 0
    "Approved". Each surface keeps its own meaning, carried as data.
    """

    names: dict = field(default_factory=lambda: {0: "Rejected", 1: "Approved"})

    def name(self, code: int) -> str:
        return self.names[code]

    @property
    def positive_name(self) -> str:
        return self.names[1]


REPORT_LABELS = LabelSpec({0: "Rejected", 1: "Approved"})
SCORING_LABELS = LabelSpec({0: "Approved", 1: "Rejected"})

# the raw training table (original column names, as in the CSV header).
RAW_APPLICATION_SCHEMA = T.StructType([
    T.StructField("Id", T.LongType(), False),
    T.StructField("Age", T.IntegerType(), True),
    T.StructField("Income", T.DoubleType(), True),
    T.StructField("Home", T.StringType(), True),
    T.StructField("Emp_length", T.DoubleType(), True),
    T.StructField("Intent", T.StringType(), True),
    T.StructField("Amount", T.DoubleType(), True),
    T.StructField("Rate", T.DoubleType(), True),
    T.StructField("Status", T.IntegerType(), False),
    T.StructField("Percent_income", T.DoubleType(), True),
    T.StructField("Default", T.StringType(), True),
    T.StructField("Cred_length", T.IntegerType(), True),
])

# The library's working schema (snake case), as produced by the F5 view.
APPLICATION_SCHEMA = T.StructType([
    T.StructField(ID, T.LongType(), True),
    T.StructField("age", T.IntegerType(), True),
    T.StructField("income", T.DoubleType(), True),
    T.StructField("home", T.StringType(), True),
    T.StructField("emp_length", T.DoubleType(), True),
    T.StructField("intent", T.StringType(), True),
    T.StructField("amount", T.DoubleType(), True),
    T.StructField("rate", T.DoubleType(), True),
    T.StructField("default_flag", T.StringType(), True),
    T.StructField("cred_length", T.IntegerType(), True),
    T.StructField("percent_income", T.DoubleType(), True),
    T.StructField(TARGET, T.IntegerType(), True),
])

# F2: one application to score (the JSON body of a scoring request).
SCORING_INPUT_SCHEMA = T.StructType([
    T.StructField("age", T.IntegerType(), True),
    T.StructField("income", T.DoubleType(), True),
    T.StructField("home", T.StringType(), True),
    T.StructField("emp_length", T.DoubleType(), True),
    T.StructField("intent", T.StringType(), True),
    T.StructField("amount", T.DoubleType(), True),
    T.StructField("rate", T.DoubleType(), True),
    T.StructField("percent_income", T.DoubleType(), True),
    T.StructField("default", T.StringType(), True),
    T.StructField("cred_length", T.IntegerType(), True),
])
