"""The driver's parquet tables and the ``applications`` view derived from them.

The original application reads one CSV of loan applications. The test data
here is a TPC-H-like star schema, so ``applications`` derives one application
per order from ``orders`` joined with ``customer`` using integer and floor
arithmetic only (Spark and DuckDB agree bit for bit).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one driver table; Catalyst prunes columns and pushes filters."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
CUSTOMER_COLUMNS = ["c_custkey", "c_acctbal", "c_mktsegment"]


def _case(*branches: tuple[Column, object], otherwise: object) -> Column:
    expr = None
    for cond, value in branches:
        val = value if isinstance(value, Column) else F.lit(value)
        expr = F.when(cond, val) if expr is None else expr.when(cond, val)
    other = otherwise if isinstance(otherwise, Column) else F.lit(otherwise)
    return expr.otherwise(other)


_MATERIALIZED: dict[str, str] = {}


def use_materialized(sf_dir: str, path: str | None) -> None:
    """Make ``applications(spark, sf_dir)`` read a table written by
    ``materialize_applications`` (``None`` goes back to the join)."""
    if path is None:
        _MATERIALIZED.pop(sf_dir, None)
    else:
        _MATERIALIZED[sf_dir] = path


def applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """one loan application per order (columns of ``APPLICATION_SCHEMA``).

    Reads the materialised table instead when one was registered for
    ``sf_dir`` with ``use_materialized``.

    Plan: scan of ``orders`` (6 columns) and ``customer`` (3 columns), one
    equi-join on the customer key. AQE turns it into a broadcast hash join
    when the customer side is measured small; at scale both sides shuffle on
    the key once, and every later operator works on the joined stream.
    """
    if sf_dir in _MATERIALIZED:
        return spark.read.parquet(_MATERIALIZED[sf_dir])
    if sf_dir in _COPARTITIONED:
        name = _COPARTITIONED[sf_dir]
        return _joined(spark.table(f"{name}_orders"), spark.table(f"{name}_customer"))
    return _derive_applications(spark, sf_dir)


def _derive_applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(load_table(spark, sf_dir, "orders").select(*ORDER_COLUMNS), load_table(spark, sf_dir, "customer").select(*CUSTOMER_COLUMNS))


def _joined(o: DataFrame, c: DataFrame) -> DataFrame:
    j = o.join(c, o.o_custkey == c.c_custkey, "inner")

    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    prio, seg = F.col("o_orderpriority"), F.col("c_mktsegment")
    u = j.select(
        key.alias("app_id"),
        _case((key % 997 == 0, 144), otherwise=F.lit(18) + (cust * 7 + key * 13) % 53)
        .cast("int").alias("age"),
        F.floor((F.col("c_acctbal") + 1500) * 12).cast("double").alias("income"),
        _case(
            (seg == "BUILDING", "OWN"),
            (seg == "FURNITURE", "MORTGAGE"),
            (seg == "MACHINERY", "MORTGAGE"),
            (seg == "AUTOMOBILE", _case((key % 50 == 0, "OTHER"), otherwise="RENT")),
            otherwise="RENT",
        ).alias("home"),
        _case((key % 37 == 0, F.lit(None).cast("double")),
              otherwise=((cust * 3 + key) % 41).cast("double")).alias("emp_length"),
        _case(
            (prio.like("1%"), "MEDICAL"),
            (prio.like("2%"), "EDUCATION"),
            (prio.like("3%"), "PERSONAL"),
            (prio.like("4%"), "DEBTCONSOLIDATION"),
            (F.col("o_orderstatus") == "P", "HOMEIMPROVEMENT"),
            otherwise="VENTURE",
        ).alias("intent"),
        (F.lit(500) + F.floor(F.col("o_totalprice") / 15)).cast("double").alias("amount"),
        _case((key % 11 == 0, F.lit(None).cast("double")),
              otherwise=(F.lit(542) + (key * 37) % 1781).cast("double") / 100).alias("rate"),
        _case((key % 6 == 1, "Y"), otherwise="N").alias("default_flag"),
        (F.lit(2) + (cust + key) % 29).cast("int").alias("cred_length"),
    )
    pi = F.least(F.lit(1.0), F.floor(F.col("amount") / F.col("income") * 100) / 100)
    v = u.withColumn("percent_income", pi)
    status = _case(
        (F.col("app_id") % 19 == 0, 1),
        (F.col("percent_income") > 0.6, 1),
        ((F.col("rate") > 16) & (F.col("home") == "RENT"), 1),
        ((F.col("default_flag") == "Y") & (F.col("percent_income") > 0.3), 1),
        otherwise=0,
    ).cast("int")
    return v.withColumn("status", status)


def materialize_applications(spark: SparkSession, sf_dir: str, path: str,
                             buckets: int | None = None) -> DataFrame:
    """Write the view once as a Parquet table and return a reader over it.

    At scale every query over ``applications`` would otherwise repeat the
    orders x customer join (a full shuffle of both when customer is too
    large to broadcast). Writing the joined rows once under shared storage
    turns each later query into a single pruned scan. ``buckets`` spreads
    the rows over that many files by ``app_id`` hash (one shuffle, once),
    so later scans have enough splits for every core.
    """
    df = _derive_applications(spark, sf_dir)
    if buckets:
        df = df.repartition(buckets, "app_id")
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def copartitioned_applications(spark: SparkSession, sf_dir: str, name: str, path: str, buckets: int) -> DataFrame:
    """The view over ``orders`` and ``customer`` written once in buckets of the
    customer key, as tables ``<name>_orders`` and ``<name>_customer``.

    Both sides of the join then lie in equal buckets, so no query over the view
    moves a row for it, whatever the sizes. The tables are external: dropping
    them leaves their files under ``path``. With a persistent catalog they
    outlive the session; ``use_copartitioned`` names them again.
    """
    for table, key, columns in (("orders", "o_custkey", ORDER_COLUMNS), ("customer", "c_custkey", CUSTOMER_COLUMNS)):
        rows = load_table(spark, sf_dir, table).select(*columns).repartition(buckets, key)  # one file a bucket
        rows.write.bucketBy(buckets, key).sortBy(key).option("path", f"{path}/{table}").saveAsTable(f"{name}_{table}")
    return _joined(spark.table(f"{name}_orders"), spark.table(f"{name}_customer"))


_COPARTITIONED: dict[str, str] = {}


def use_copartitioned(sf_dir: str, name: str | None) -> None:
    """Make ``applications(spark, sf_dir)`` read the tables that
    ``copartitioned_applications`` wrote as ``name`` (``None`` goes back)."""
    if name is None:
        _COPARTITIONED.pop(sf_dir, None)
    else:
        _COPARTITIONED[sf_dir] = name


# The same view as SQL text, for engines that take SQL (the DuckDB oracle).
APPLICATIONS_SQL = """
SELECT v.*,
  CAST(CASE WHEN app_id % 19 = 0 THEN 1
            WHEN percent_income > 0.6 THEN 1
            WHEN rate > 16 AND home = 'RENT' THEN 1
            WHEN default_flag = 'Y' AND percent_income > 0.3 THEN 1
            ELSE 0 END AS INT) AS status
FROM (
  SELECT u.*, least(1.0e0, floor(amount / income * 100) / 100) AS percent_income
  FROM (
    SELECT o_orderkey AS app_id,
      CAST(CASE WHEN o_orderkey % 997 = 0 THEN 144
                ELSE 18 + (o_custkey * 7 + o_orderkey * 13) % 53 END AS INT) AS age,
      CAST(floor((c_acctbal + 1500) * 12) AS DOUBLE) AS income,
      CASE c_mktsegment WHEN 'BUILDING' THEN 'OWN'
                        WHEN 'FURNITURE' THEN 'MORTGAGE'
                        WHEN 'MACHINERY' THEN 'MORTGAGE'
                        WHEN 'AUTOMOBILE' THEN (CASE WHEN o_orderkey % 50 = 0 THEN 'OTHER' ELSE 'RENT' END)
                        ELSE 'RENT' END AS home,
      CASE WHEN o_orderkey % 37 = 0 THEN NULL
           ELSE CAST((o_custkey * 3 + o_orderkey) % 41 AS DOUBLE) END AS emp_length,
      CASE WHEN o_orderpriority LIKE '1%' THEN 'MEDICAL'
           WHEN o_orderpriority LIKE '2%' THEN 'EDUCATION'
           WHEN o_orderpriority LIKE '3%' THEN 'PERSONAL'
           WHEN o_orderpriority LIKE '4%' THEN 'DEBTCONSOLIDATION'
           WHEN o_orderstatus = 'P' THEN 'HOMEIMPROVEMENT'
           ELSE 'VENTURE' END AS intent,
      CAST(500 + floor(o_totalprice / 15) AS DOUBLE) AS amount,
      CASE WHEN o_orderkey % 11 = 0 THEN NULL
           ELSE CAST(542 + (o_orderkey * 37) % 1781 AS DOUBLE) / 100 END AS rate,
      CASE WHEN o_orderkey % 6 = 1 THEN 'Y' ELSE 'N' END AS default_flag,
      CAST(2 + (o_custkey + o_orderkey) % 29 AS INT) AS cred_length
    FROM orders JOIN customer ON o_custkey = c_custkey
  ) u
) v
"""
