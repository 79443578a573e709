"""Cleaning: median imputation (C1) and outlier replacement.

Fit and apply are separate. ``fit_*`` runs Spark aggregations and returns a
small parameter object (one number per column); ``apply_*`` is a lazy column
rewrite that never shuffles. By default both fit on the whole table, as the
original does (test rows leak into the medians); pass the training rows to
``fit_*`` to avoid that.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import quantiles


@dataclass
class ImputeParams:
    """Per column: null count and the fill value (None when no fill is needed)."""

    null_counts: dict[str, int] = field(default_factory=dict)
    fill_values: dict[str, float] = field(default_factory=dict)


def fit_median_imputer(df: DataFrame, cols: list[str], median_kw: dict | None = None) -> ImputeParams:
    """C1 fit: median of every column that holds nulls (exact, bounded memory).

    One pass gives null counts and brackets for all columns, a second one the
    medians of the columns with nulls. NaN is missing, like null.
    """
    parts = {}
    for i, c in enumerate(cols):
        x = quantiles.value(c)
        parts |= {f"z{i}": quantiles.counted_if(x.isNull()), **quantiles.bracket_parts(x, f"c{i}")}
    row = quantiles.two_level(df, parts)
    nulls = {c: row[f"z{i}"] for i, c in enumerate(cols)}
    need = {c: quantiles.bracket_of(row, f"c{i}") for i, c in enumerate(cols) if nulls[c] > 0}
    medians = quantiles.exact_medians(df, list(need), first=need, **(median_kw or {})) if need else {}
    return ImputeParams(nulls, {c: medians[c] for c in need if medians[c] is not None})


def apply_median_imputer(df: DataFrame, params: ImputeParams) -> DataFrame:
    """C1 apply: ``fillna`` with the fitted medians, keeping each column's type.

    An integer column filled with a fractional median becomes double, as a
    pandas column would.
    """
    out = df
    types = dict(df.dtypes)
    for c, v in params.fill_values.items():
        if types[c] in ("int", "bigint", "smallint", "tinyint") and float(v) != int(v):
            out = out.withColumn(c, F.coalesce(F.col(c).cast("double"), F.lit(float(v))))
        else:
            known = F.nullif(F.col(c), F.lit(float("nan"))) if types[c] in ("double", "float") else F.col(c)
            out = out.withColumn(c, F.coalesce(known, F.lit(v).cast(types[c])))
    return out


@dataclass
class CapParams:
    column: str
    cap: float
    replacement: float | None


def fit_outlier_cap(df: DataFrame, col: str, cap: float, median_kw: dict | None = None) -> CapParams:
    """C2 fit: the median of the values at or below ``cap`` (E15, a filtered median)."""
    med = quantiles.exact_median(df, col, where=F.col(col) <= cap, **(median_kw or {}))
    return CapParams(col, cap, med)


def apply_outlier_cap(df: DataFrame, params: CapParams) -> DataFrame:
    """C2 apply (B6): values above the cap become the fitted median."""
    c = F.col(params.column)
    if params.replacement is None:
        return df
    rep = F.lit(params.replacement)
    types = dict(df.dtypes)
    if types[params.column] in ("int", "bigint") and float(params.replacement) != int(params.replacement):
        c = c.cast("double")
    else:
        rep = rep.cast(types[params.column])
    return df.withColumn(params.column, F.when(c > params.cap, rep).otherwise(c))
