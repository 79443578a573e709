"""Evaluation from any (label, prediction) frame (H1-H5).

The confusion matrix is sparse: one ``groupBy(actual, predicted)`` (partial
counts in every map task) gives the cells that occur, whatever the number of
classes. Marginal sums of the cells give each class its support and
predictions, so the report is as long as the classes, not their square. The
zero cells of the full matrix are made only when it is asked for, from the
table of classes. Rows whose label or prediction is null or not one of the
classes are counted too: they are test rows that are not right.
The two-class report of the training job is one aggregation with fixed cells.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import rounder


def _known(label: str, pred: str, classes: Sequence) -> Column:
    return F.coalesce(F.col(label).isin(*classes) & F.col(pred).isin(*classes), F.lit(False))


def _class_table(spark: SparkSession, classes: Sequence, names: dict | None = None) -> DataFrame:
    """(class, row_name), one row a class."""
    kind = "string" if isinstance(classes[0], str) else "int"
    return spark.createDataFrame([(c, str((names or {}).get(c, c))) for c in classes], f"class {kind}, row_name string")


def confusion_cells(df: DataFrame, label: str, pred: str) -> DataFrame:
    """H2, sparse: ``(actual, predicted, count)`` of the cells that occur."""
    return df.groupBy(F.col(label).alias("actual"), F.col(pred).alias("predicted")).agg(F.count(F.lit(1)).alias("count"))


def confusion_matrix(df: DataFrame, label: str, pred: str, classes: Sequence = (0, 1)) -> DataFrame:
    """H2/H5: long form ``(actual, predicted, count)``; absent cells count 0.

    Rows outside the classes, if any, have a row without actual and predicted."""
    table = _class_table(df.sparkSession, classes)
    grid = table.select(F.col("class").alias("actual"), F.explode(F.lit(list(classes))).alias("predicted"), F.lit(0).cast("long").alias("count"))
    known = _known("actual", "predicted", classes)
    cells = confusion_cells(df, label, pred).select(*(F.when(known, F.col(c)).cast(grid.schema[c].dataType).alias(c) for c in ("actual", "predicted")), "count")
    return grid.unionByName(cells).groupBy("actual", "predicted").agg(F.sum("count").alias("count"))


def _per_class(df: DataFrame, label: str, pred: str, classes: Sequence, names: dict | None) -> DataFrame:
    """(row_name, precision, recall, f1, support) of each class, and, if there
    are rows, one without name that has the number of all rows as its support."""
    cells = df.groupBy(F.when(_known(label, pred, classes), F.struct(F.col(label).alias("a"), F.col(pred).alias("p"))).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    n, a, p = F.col("n"), F.col("cell.a"), F.col("cell.p")
    sums = ("right", "support", "predicted")
    part = lambda c, *values: F.struct(c.cast("string").alias("key"), *(v.alias(name) for v, name in zip(values, sums)))
    zero = F.lit(0).cast("long")
    parts = F.array(part(F.lit(None), zero, n, zero), part(a, F.when(a == p, n).otherwise(zero), n, zero), part(p, zero, zero, n))
    found = cells.select(F.explode(F.when(a.isNull(), F.slice(parts, 1, 1)).otherwise(parts)).alias("x")).select("x.*", F.lit(None).cast("string").alias("row_name"))
    # Every class has a part of zeros, with its name.
    table = _class_table(df.sparkSession, classes, names).select(F.col("class").cast("string").alias("key"), *(zero.alias(c) for c in sums), "row_name")
    rows = table.unionByName(found).groupBy("key").agg(F.max("row_name").alias("row_name"), *(F.sum(c).alias(c) for c in sums))
    ratio = lambda x, y: F.coalesce(F.try_divide(x, y), F.lit(0.0))
    right = F.col("right").cast("double")
    rows = rows.select("row_name", ratio(right, F.col("predicted")).alias("precision"), ratio(right, F.col("support")).alias("recall"), "support")
    return rows.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def accuracy(df: DataFrame, label: str, pred: str, classes: Sequence = (0, 1), rounding: str = "even", places: int = 4) -> DataFrame:
    """H1: ``accuracy`` (4 places) and ``accuracy_percent`` (1 place)."""
    rnd = rounder(rounding)
    right = F.count_if(_known(label, pred, classes) & (F.col(label) == F.col(pred)))
    found = df.agg(right.alias("right"), F.count(F.lit(1)).alias("test_rows"))
    share = F.try_divide(F.col("right").cast("double"), F.col("test_rows"))
    return found.select(rnd(share, places).alias("accuracy"), rnd(share * 100, 1).alias("accuracy_percent"), "test_rows")


def classification_report(df: DataFrame, label: str, pred: str, classes: Sequence = (0, 1), names: dict | None = None,
                          rounding: str = "even", places: int = 4) -> DataFrame:
    """H3/H4: per class precision, recall, F1, support; macro and weighted averages.

    ``(row_name, precision, recall, f1, support)``; a class with no predicted
    rows has precision 0, as the usual report's zero-division rule gives.
    """
    rnd = rounder(rounding)
    per = _per_class(df, label, pred, classes, names)
    own, support, metrics = F.col("row_name").isNotNull(), F.col("support"), ("precision", "recall", "f1")
    # One aggregation has the classes, each a group of one, and the averages over all of them.
    found = per.groupingSets([["row_name"], []], "row_name").agg(
        F.grouping_id().alias("all"), F.max(support).alias("support"), F.max(F.when(~own, support)).alias("total"),
        *(F.avg(F.when(own, F.col(m))).alias(m) for m in metrics), *(F.sum(F.when(own, F.col(m) * support)).alias(f"{m}_weighted") for m in metrics))
    row = lambda name, n, values: F.struct(name.alias("row_name"), *(v.alias(m) for m, v in zip(metrics, values)), n.alias("support"))
    plain = [F.col(m) for m in metrics]
    averages = F.array(row(F.lit("macro avg"), F.col("total"), plain), row(F.lit("weighted avg"), F.col("total"), [F.try_divide(f"{m}_weighted", "total") for m in metrics]))
    rows = found.select(F.explode(F.when(F.col("all") == 1, averages).when(own, F.array(row(F.col("row_name"), support, plain)))).alias("r")).select("r.*")
    return rows.select("row_name", *(rnd(F.col(m), places).alias(m) for m in metrics), F.coalesce("support", F.lit(0)).cast("long").alias("support"))


def confusion_wide(df: DataFrame, label: str, pred: str) -> DataFrame:
    """One row with ``cm_<actual>_<predicted>`` of the classes 0 and 1, and ``cm_other``."""
    a, p = F.col(label), F.col(pred)
    return df.agg(*[F.count_if((a == F.lit(i)) & (p == F.lit(j))).alias(f"cm_{i}_{j}") for i in (0, 1) for j in (0, 1)],
                  F.count_if(~_known(label, pred, (0, 1))).alias("cm_other"))


def matrix_nested() -> Column:
    """M9: ``array<array<long>>`` of ``confusion_wide`` with rows = actual, columns = predicted."""
    return F.array(*[F.array(*[F.col(f"cm_{i}_{j}") for j in (0, 1)]) for i in (0, 1)])


def report_summary(df: DataFrame, label: str, pred: str, rounding: str = "even") -> DataFrame:
    """The report's four numbers (precision / recall of classes 0 and 1) plus the matrix.

    One row: ``precision_rejected, recall_rejected, precision_approved,
    recall_approved, accuracy, accuracy_percent, confusion_matrix``.
    """
    rnd = rounder(rounding)
    cell = lambda i, j: F.col(f"cm_{i}_{j}")
    share = lambda x, *all_of: F.coalesce(F.try_divide(x.cast("double"), sum(all_of[1:], all_of[0])), F.lit(0.0))
    acc = F.try_divide((cell(0, 0) + cell(1, 1)).cast("double"), cell(0, 0) + cell(0, 1) + cell(1, 0) + cell(1, 1) + F.col("cm_other"))
    columns = []
    for k, name in ((0, "rejected"), (1, "approved")):
        columns += [rnd(share(cell(k, k), cell(0, k), cell(1, k)), 4).alias(f"precision_{name}"), rnd(share(cell(k, k), cell(k, 0), cell(k, 1)), 4).alias(f"recall_{name}")]
    return confusion_wide(df, label, pred).select(*columns, rnd(acc, 4).alias("accuracy"), rnd(acc * 100, 1).alias("accuracy_percent"), matrix_nested().alias("confusion_matrix"))
