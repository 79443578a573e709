"""Session helpers: one place for the configuration every job relies on."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(
    master: str | None = None,
    app_name: str = "lendscope",
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Create (or reuse) a session with AQE on and the UI off.

    ``master`` and ``shuffle_partitions`` are only meant for local runs; on a
    cluster the submitter's settings win because ``getOrCreate`` reuses them.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """Return the shared checkpoint folder the cluster names.

    Reads ``spark.checkpoint.dir`` (or a directory already set on the
    context). Only when neither is set is ``fallback`` installed; tests pass
    a scratch folder here, and a local session makes a temporary one. On a
    cluster the setting must point at shared storage.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get(CHECKPOINT_CONF, None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    if fallback is None:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError(
                f"{CHECKPOINT_CONF} is not set; set it to a shared folder on the cluster"
            )
        # One process on one machine and no folder named: tables need a place to be written to.
        fallback = tempfile.mkdtemp(prefix="lendscope-")
    sc.setCheckpointDir(fallback)
    return sc.getCheckpointDir() or fallback


def scratch_path(spark: SparkSession, name: str, fallback: str | None = None) -> str:
    """A path under the shared checkpoint folder for written intermediate tables."""
    base = checkpoint_dir(spark, fallback)
    return base.rstrip("/") + "/" + name
