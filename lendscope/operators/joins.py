"""Derived tables: computed once, their size known, rows numbered in order.

``stored`` writes a frame as Parquet in the shared checkpoint folder and reads
it back: lineage is cut, the rows survive a lost executor, and Spark knows how
many bytes the table has. A join with it is an ordinary join: Spark broadcasts
the table while its bytes are under ``spark.sql.autoBroadcastJoinThreshold``
and shuffles both sides beyond that, splitting hot keys (AQE). The folder is
the one that ``spark.checkpoint.dir`` names; a local session that names none
gets a temporary one. Stored tables stay there: who owns the folder clears it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path


def stored(df: DataFrame, name: str = "derived") -> DataFrame:
    """Compute once and keep (eagerly)."""
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with ``name``: the number of a row in this order, from 0.

    Rows are sorted by ranges and numbered where they are, with an offset for
    each range, so only the sizes of the ranges meet in one task.
    """
    placed = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "numbered")
    placed = placed.withColumn("__range", F.shiftright("__at", 33)).withColumn("__within", F.col("__at").bitwiseAND((1 << 33) - 1))
    sizes = placed.groupBy("__range").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("__range", F.coalesce(before, F.lit(0)).alias("__offset"))
    return placed.join(offsets, "__range").withColumn(name, F.col("__within") + F.col("__offset")).drop("__range", "__at", "__within", "__offset")
