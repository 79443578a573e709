"""Encoding and features.

Label codes are the sorted distinct labels numbered 0..n-1 (alphabetical, as
the original's label encoder). Fitting is one distributed ``distinct`` over
all columns; the labels are sorted by range and numbered where they are, with
an offset for each range, so no column's labels meet in one task. Codes are
applied by a join with the stored code table at every size of dictionary, in
training and in scoring, where the table is an artefact beside the model;
Spark broadcasts it while its bytes are few. No label passes the driver.
"""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import rounder
from ..schema import CATEGORICAL
from . import joins

MISSING_LABEL = "nan"
CODES_SCHEMA = "column_name string, label string, code int"


def _distinct_labels(df: DataFrame, cols: list[str], null_label: str | None) -> DataFrame:
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"),
                 (F.coalesce(F.col(c).cast("string"), F.lit(null_label)) if null_label is not None
                  else F.col(c).cast("string")).alias("label"))
        for c in cols
    ]))
    return (
        df.select(pairs.alias("p")).select("p.column_name", "p.label")
        .where(F.col("label").isNotNull())
        .groupBy("column_name", "label").agg(F.count(F.lit(1)).alias("_n"))
        .drop("_n")
    )


def label_codes(df: DataFrame, cols: list[str], null_label: str | None = MISSING_LABEL) -> DataFrame:
    """D1 (+M2) as a stored DataFrame: ``(column_name, label, code)``.

    Nulls become ``null_label`` first (the original turns a missing value
    into the text ``nan``, which gets its own code). Codes of a column begin
    at 0; only the number of labels in each range meets in one task.
    """
    labels = joins.numbered(_distinct_labels(df, cols, null_label), [F.col("column_name"), F.col("label")], "idx")
    firsts = labels.groupBy("column_name").agg(F.min("idx").alias("first"))
    return joins.stored(labels.join(firsts, "column_name").select("column_name", "label", (F.col("idx") - F.col("first")).cast("int").alias("code")), "codes")


def save_codes(codes: DataFrame, path: str) -> None:
    """The code table as a Parquet artefact, to stand beside the model."""
    codes.write.mode("overwrite").parquet(path)


def load_codes(spark: SparkSession, path: str) -> DataFrame:
    """A saved code table. Its bytes are known, so Spark decides on a broadcast."""
    return spark.read.schema(CODES_SCHEMA).parquet(path)


def apply_codes(df: DataFrame, codes: DataFrame, col: str, out_col: str, default: int | None = None,
                upper: bool = False, null_label: str | None = None) -> DataFrame:
    """M5: a left join on the label, with an optional default for unknown ones.

    ``col`` names the column of ``df``; ``codes`` holds its ``label, code``.
    """
    key = F.col(col).cast("string")
    if null_label is not None:
        key = F.coalesce(key, F.lit(null_label))
    table = codes.select(F.col("label").alias("__label"), F.col("code").alias("__code"))
    joined = df.join(table, (F.upper(key) if upper else key) == F.col("__label"), "left")
    code = F.coalesce("__code", F.lit(default)) if default is not None else F.col("__code")
    return joined.withColumn(out_col, code).drop("__label", "__code")


def apply_training_codes(df: DataFrame, codes: DataFrame, cols: list[str], suffix: str = "",
                         null_label: str | None = MISSING_LABEL) -> DataFrame:
    """Replace each label by its code (null -> ``nan`` label first)."""
    out = df
    for c in cols:
        out = apply_codes(out, codes.where(F.col("column_name") == c), c, c + suffix, null_label=null_label)
    return out


def apply_scoring_codes(df: DataFrame, codes: DataFrame, suffix: str = "",
                        columns: dict[str, str] | None = None, cols: list[str] = CATEGORICAL) -> DataFrame:
    """D3: upper-case first; an unknown label, a null or a missing map gives code 0.

    ``codes`` is a code table, loaded from beside the model or from a report
    (``reports.encoding_codes``). ``columns`` maps a column of the table to the
    input column holding it (for example ``{"default_flag": "default"}`` for the
    scoring request schema); every column of ``cols`` has its output
    ``<name><suffix>``, also when the table holds no label for it.
    """
    out = df
    for name in cols:
        out = apply_codes(out, codes.where(F.col("column_name") == name), (columns or {}).get(name, name), name + suffix, default=0, upper=True)
    return out


def assemble(df: DataFrame, cols: list[str], out_col: str = "features") -> DataFrame:
    """The feature vector in a fixed column order."""
    return VectorAssembler(inputCols=cols, outputCol=out_col, handleInvalid="error").transform(df)


def derive_ratio(df: DataFrame, amount: str = "amount", income: str = "income",
                 out_col: str = "percent_income", places: int = 2, rounding: str = "even") -> DataFrame:
    """``out = round(amount / income, 2)`` when both are present and income > 0.

    Otherwise the existing value of ``out_col`` (or null) is kept.
    """
    a, i = F.col(amount), F.col(income)
    keep = F.col(out_col) if out_col in df.columns else F.lit(None).cast("double")
    ratio = rounder(rounding)(F.try_divide(a.cast("double"), i), places)
    return df.withColumn(out_col, F.when(a.isNotNull() & (i > 0), ratio).otherwise(keep))
