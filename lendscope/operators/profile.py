"""Profiling operators: counts, distributions, summary statistics, group rates.

All of them are single aggregations with map-side partial aggregation, so a
key that holds a third of all rows is collapsed inside each map task before
anything is shuffled. Outputs are small (one row per group or per bin).
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions.numeric import rounder
from . import joins, quantiles


def row_count(df: DataFrame) -> DataFrame:
    """``rows`` and ``columns``."""
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn(
        "columns", F.lit(len(df.columns)).cast("long")
    )


def column_types(df: DataFrame) -> DataFrame:
    """One row per column: position, name and Spark type. Reads no data."""
    spark = df.sparkSession
    rows = [(i, name, dtype) for i, (name, dtype) in enumerate(df.dtypes)]
    return spark.createDataFrame(rows, "position int, column_name string, data_type string")


def null_counts(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Null count per column in one pass, long form ``(column_name, null_count)``.

    NaN is missing, like null."""
    cols = cols or df.columns
    types = dict(df.dtypes)
    missing = {c: F.col(c).isNull() | F.isnan(c) if types[c] in ("double", "float") else F.col(c).isNull() for c in cols}
    wide = df.agg(*[F.count_if(missing[c]).alias(c) for c in cols])
    return wide.unpivot([], cols, "column_name", "null_count")


def value_counts(df: DataFrame, col: str, keep_null: bool = False) -> DataFrame:
    """``(col, count)``; nulls left out unless asked, as pandas does.

    Order with ``order_counts`` (J2) when an ordered result is wanted.
    """
    src = df if keep_null else df.where(F.col(col).isNotNull())
    return src.groupBy(col).agg(F.count(F.lit(1)).alias("count"))


def order_counts(counts: DataFrame, key: str, count_col: str = "count") -> DataFrame:
    """Descending counts, the key as tie-break."""
    return counts.orderBy(F.desc(count_col), F.asc(key))


def ranked_counts(counts: DataFrame, key: str, count_col: str = "count") -> DataFrame:
    """J2 with its order as a column: rank 1 is the largest count. Values are
    numbered by ranges, so there may be as many as there are rows."""
    ranked = joins.numbered(counts, [F.desc(count_col), F.asc(key)], "rank")
    return order_counts(ranked.withColumn("rank", (F.col("rank") + 1).cast("int")), key, count_col)


def value_counts_multi(df: DataFrame, cols: list[str]) -> DataFrame:
    """E5 for several columns in one pass (GROUPING SETS).

    Long form ``(column_name, value, count)``. ``grouping_id`` tells which
    column a row belongs to, so a null key of one column is never confused
    with "not this column"; null keys are dropped as pandas does.
    """
    value = F.coalesce(*[F.col(c).cast("string") for c in cols])
    name = None
    for i, c in enumerate(cols):
        # grouping_id has a 1 bit for every column *not* grouped in the set.
        gid = sum(1 << (len(cols) - 1 - j) for j in range(len(cols)) if j != i)
        cond = F.col("_gid") == gid
        name = F.when(cond, F.lit(c)) if name is None else name.when(cond, F.lit(c))
    agg = df.select(*cols).groupingSets([[c] for c in cols], *cols).agg(
        F.count(F.lit(1)).alias("count"), F.grouping_id().alias("_gid")
    )
    out = agg.select(name.alias("column_name"), value.alias("value"), F.col("count"))
    return out.where(F.col("value").isNotNull())


def count_sum(df: DataFrame, target: str) -> Column:
    """Sum of a 0/1 column as a long (``sum(int)`` is a long in Spark)."""
    return F.sum(F.col(target)).cast("long")


def overview(df: DataFrame, target: str, rounding: str = "even", places: int = 1) -> DataFrame:
    """E1 + E6 + E7 + B13: total, positive count, negative count, positive rate (percent)."""
    rnd = rounder(rounding)
    agg = df.agg(F.count(F.lit(1)).alias("total_records"), count_sum(df, target).alias("approved_count"))
    return agg.select(
        "total_records",
        "approved_count",
        (F.col("total_records") - F.col("approved_count")).alias("rejected_count"),
        rnd(F.try_divide(F.col("approved_count").cast("double"), F.col("total_records")) * 100, places)
        .alias("approval_rate"),
    )


def _array(values: Sequence, kind: str) -> Column:
    """A constant array of any length; the optimizer folds it into one literal."""
    return F.from_json(F.lit(f"[{','.join(map(str, values))}]"), f"array<{kind}>")


def bin_ordinal(x: Column, edges: Sequence[float]) -> Column:
    """The right-closed bin ``(e0, e1], (e1, e2], ...`` that holds ``x``, from 0;
    null outside, for null and for NaN. A binary search in the sorted edges
    (one array in the plan): some fourteen steps for ten thousand of them."""
    table, n = _array([float(e) for e in edges], "double"), len(edges)
    steps = [1 << k for k in reversed(range(n.bit_length()))]
    # Edges below x: a step is taken while the edge that it reaches is below, too.
    step = lambda at, by: F.when(F.get(table, at + by - 1) < x.cast("double"), at + by).otherwise(at)
    return F.aggregate(_array(steps, "int"), F.lit(0), step, lambda below: F.when(below.between(1, n - 1), below - 1))


def bin_expr(c: str | Column, edges: Sequence[float], labels: Sequence[str]) -> tuple[Column, Column]:
    """``(label, ordinal)`` of a value's bin; outside or null -> null.

    ``Bucketizer`` is left-closed, so the edges are searched instead.
    """
    ordinal = bin_ordinal(F.col(c) if isinstance(c, str) else c, edges)
    return F.get(_array([json.dumps(x) for x in labels], "string"), ordinal), ordinal


def binned_counts(df: DataFrame, col: str, edges: Sequence[float], labels: Sequence[str]) -> DataFrame:
    """E8 + J3: count per bin in bin order; an empty bin shows 0.

    The rows are counted by bin (partial counts in every map task), together
    with the table of bins, in which each counts 0.
    """
    _, ordinal = bin_expr(col, edges, labels)
    rows = df.select(ordinal.alias("ordinal"), F.lit(None).cast("string").alias("bin"), F.lit(1).cast("long").alias("n")).where("ordinal is not null")
    bins = df.sparkSession.createDataFrame(list(enumerate(labels)), "ordinal int, bin string").withColumn("n", F.lit(0).cast("long"))
    return bins.unionByName(rows).groupBy("ordinal").agg(F.max("bin").alias("bin"), F.sum("n").alias("count")).orderBy("ordinal")


STAT_FUNCS = ("mean", "median", "min", "max", "std")


def summary_stats(
    df: DataFrame,
    col: str,
    funcs: tuple[str, ...] = STAT_FUNCS,
    rounding: str = "even",
    places: int = 2,
    median_kw: dict | None = None,
) -> DataFrame:
    """One row of mean / median / min / max / sample std, rounded.

    Nulls and NaN are skipped (E11's ``dropna`` is implied). Two passes at any
    size: one for the moments, the extremes and a bracket around the middle,
    one for the exact median within the bracket. The row itself reads nothing.
    """
    rnd = rounder(rounding)
    x = quantiles.value(col)
    found = quantiles.two_level(df, stat_parts(x, "x", funcs))
    values = stat_values(found, "x", funcs)
    if "median" in funcs:
        values["median"] = quantiles.exact_medians(df, [col], first={col: quantiles.bracket_of(found, "x")}, **(median_kw or {}))[col]
    return df.sparkSession.range(1).select(*[rnd(F.lit(values[f]).cast("double"), places).alias(f) for f in funcs])


def stat_parts(x: Column, prefix: str, funcs: tuple[str, ...] = STAT_FUNCS) -> dict[str, quantiles.Part]:
    """What one pass needs of a column for the statistics ``funcs``."""
    parts = {"mean": {"_n": quantiles.counted(x), "_sum": quantiles.summed(x)}, "min": {"_min": quantiles.smallest(x)}, "max": {"_max": quantiles.largest(x)},
             "std": {"_spread": quantiles.spread(x)}, "median": {k.removeprefix(prefix): p for k, p in quantiles.bracket_parts(x, prefix).items()}}
    return {prefix + k: p for f in funcs for k, p in parts[f].items()}


def stat_values(found: Row, prefix: str, funcs: tuple[str, ...] = STAT_FUNCS) -> dict[str, float | None]:
    """The statistics, but for the median, of a row that has ``stat_parts``."""
    get = {"mean": lambda: found[f"{prefix}_sum"] / found[f"{prefix}_n"] if found[f"{prefix}_n"] else None, "min": lambda: found[f"{prefix}_min"],
           "max": lambda: found[f"{prefix}_max"], "std": lambda: quantiles.deviation(found[f"{prefix}_spread"])}
    return {f: get[f]() for f in funcs if f in get}


def rate_by_group(
    df: DataFrame,
    key: str,
    target: str,
    keep_null_group: bool = False,
    rounding: str = "even",
    places: int = 1,
) -> DataFrame:
    """Mean of a 0/1 target x 100 per group, rounded.

    One ``groupBy`` (partial aggregation per map task, one shuffle of at most
    #groups x #partitions rows) instead of one scan per group. Null keys are
    filtered by default; ``keep_null_group=True`` keeps them as a group.
    """
    rnd = rounder(rounding)
    src = df if keep_null_group else df.where(F.col(key).isNotNull())
    return src.groupBy(key).agg(
        rnd(F.avg(F.col(target).cast("double")) * 100, places).alias("approval_rate"),
        F.count(F.lit(1)).alias("applications"),
    )


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """E12."""
    return df.select(col).distinct()
