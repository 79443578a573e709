"""The training job end to end (the original training script as one Spark plan).

read -> clean (C1, C2) -> encode (D1, D2) -> assemble (D4) -> exact stratified
split (P1) -> forest (G1) -> evaluate (G2, H1-H3) -> importance (G4) ->
dataset statistics on the raw table (R1) -> report document (R2) and model
(A4, A6).

Scale notes: the raw table is materialised once (``persist`` by default, or
a parquet table under the shared checkpoint folder with
``materialize='table'``, which survives executor loss without recompute);
every fit step is a distributed aggregation with a small result; the
training vectors are persisted for the forest, which reads them once per
tree level. The driver holds numbers only: labels stay in the code table, the
statistics in a stored table, and Spark writes the report from them.
"""

from __future__ import annotations

import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clean, encode, evaluate, joins, model, split
from ..operators.score import CODE_SUFFIX, model_inputs
from ..schema import (AGE_CAP, CATEGORICAL, FEATURE_DISPLAY_NAMES, ID, MODEL_TYPE,
                      NUMERIC, SPLIT_SEED, TARGET, TEST_FRACTION)
from ..session import scratch_path
from . import reports

LEAST_ROWS, MOST_ROWS = 12_500, 1_000_000  # of a partition that the forest reads
# Columns of few values, then finer ones.
NEAR = [*(c + CODE_SUFFIX for c in CATEGORICAL), "percent_income", "rate"]


@dataclass
class TrainConfig:
    forest: model.ForestParams = field(default_factory=model.ForestParams)
    test_fraction: float = TEST_FRACTION
    split_seed: int = SPLIT_SEED
    fit_cleaning_on: str = "all"         # 'all' (as the original) or 'train'
    rounding: str = "even"
    materialize: str = "persist"         # 'persist', 'table' or 'none'
    median_kw: dict = field(default_factory=dict)


@dataclass
class TrainResult:
    pipeline: object                      # PipelineModel: assembler + forest
    forest: object
    codes: DataFrame                      # the code table (column_name, label, code)
    impute: clean.ImputeParams
    cap: clean.CapParams
    summary: dict                         # accuracy, report, matrix
    importance: DataFrame
    stats: DataFrame                      # the rows of R1, stored
    report: reports.Report
    test_predictions: DataFrame
    sizes: dict
    timings: dict = field(default_factory=dict)


def _materialize(spark: SparkSession, df: DataFrame, how: str, name: str) -> DataFrame:
    if how == "persist":
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    if how == "table":
        path = scratch_path(spark, name)
        df.write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)
    return df


def fit_preparation(fit_src: DataFrame, cfg: TrainConfig, pool: ThreadPoolExecutor | None = None):
    """Fit C1 (medians), C2 (age cap) and D1 (label codes) on ``fit_src``.

    The label codes only read the category columns, which cleaning never
    changes, so they are fitted alongside the numeric fits (in ``pool`` when
    given: Spark runs jobs from several driver threads side by side).
    """
    codes_f = pool.submit(encode.label_codes, fit_src, CATEGORICAL) if pool else None
    imp = clean.fit_median_imputer(fit_src, NUMERIC, cfg.median_kw)
    cap = clean.fit_outlier_cap(clean.apply_median_imputer(fit_src, imp), "age", AGE_CAP, cfg.median_kw)
    codes = codes_f.result() if codes_f else encode.label_codes(fit_src, CATEGORICAL)
    return imp, cap, codes


def apply_preparation(df: DataFrame, imp, cap, codes: DataFrame) -> DataFrame:
    """Apply C1, C2 and D2: projections and joins with the small code table."""
    capped = clean.apply_outlier_cap(clean.apply_median_imputer(df, imp), cap)
    return encode.apply_training_codes(capped, codes, CATEGORICAL, suffix=CODE_SUFFIX)


def pieces(rows: DataFrame, n: int) -> int:
    """Partitions for ``n`` rows that each take much work.

    Growing trees or asking them takes far more time for each byte than reading
    does, so the few partitions that a table has by its bytes or row groups leave
    most cores idle. A partition has ``MOST_ROWS`` at most, and no fewer than
    ``LEAST_ROWS`` while each core has one.
    """
    return max(min(n // LEAST_ROWS, rows.sparkSession.sparkContext.defaultParallelism), n // MOST_ROWS)


def deal(rows: DataFrame, n: int, near: list[str] | None = None) -> DataFrame:
    """``rows`` (``n`` of them) dealt out evenly, a small table as it is.

    Within a partition, rows alike in the columns ``near`` stand together: they
    take the same paths through the trees, whose nodes are then still in the cache."""
    parts = pieces(rows, n)
    dealt = rows if parts < 2 else rows.repartition(parts)
    return dealt.sortWithinPartitions(*near) if near and parts >= 2 else dealt


def spread(rows: DataFrame, n: int) -> DataFrame:
    """``rows`` (``n`` of them) dealt out for the forest.

    One partition a core: every partition makes and sends statistics of all open
    nodes, so more of them are more work. Rows are dealt and sorted by their values,
    so the forest does not depend on the order in which a shuffle delivers them;
    the columns in ``NEAR`` come first, so that rows of a node stand together.
    """
    parts = pieces(rows, n)
    first = [c for c in NEAR if c in rows.columns]
    order = first + [c for c in rows.columns if c not in first]
    return rows if parts < 2 else rows.repartition(parts, *rows.columns).sortWithinPartitions(*order)


def train(spark: SparkSession, raw_df: DataFrame, cfg: TrainConfig | None = None) -> TrainResult:
    cfg = cfg or TrainConfig()
    timings: dict = {}
    clock = [time.perf_counter()]

    def lap(name):
        now = time.perf_counter()
        timings[name] = round(now - clock[0], 3)
        clock[0] = now

    n_rows = raw_df.count()
    if cfg.materialize != "none":  # each pass over the kept rows has all cores
        raw_df = deal(raw_df, n_rows)
    kept_before = raw_df.storageLevel.useMemory or raw_df.storageLevel.useDisk
    raw = _materialize(spark, raw_df, cfg.materialize, "applications_raw")

    # The split depends only on ids and classes, so its boundaries are found
    # while the cleaning parameters are fitted.
    with ThreadPoolExecutor(max_workers=2) as prep_pool:
        if cfg.fit_cleaning_on == "train":
            flagged = split.stratified_split(raw, ID, TARGET, cfg.test_fraction, cfg.split_seed)
            imp, cap, codes = fit_preparation(flagged.where(~F.col("is_test")), cfg, prep_pool)
        else:
            split_f = prep_pool.submit(split.stratified_split, raw, ID, TARGET, cfg.test_fraction, cfg.split_seed)
            imp, cap, codes = fit_preparation(raw, cfg, prep_pool)
            flagged = split_f.result()
    coded = apply_preparation(flagged, imp, cap, codes)
    lap("clean_encode_split")

    inputs = model_inputs()
    assembled = encode.assemble(spread(coded.select(ID, TARGET, "is_test", *inputs), n_rows), inputs)
    # The forest reads its input once per tree level.
    train_rows = assembled.where(~F.col("is_test")).select(ID, TARGET, "features").persist(StorageLevel.MEMORY_AND_DISK)
    test_rows = assembled.where(F.col("is_test")).select(ID, TARGET, "features")

    n_train = train_rows.count()
    lap("train_vectors")
    # The dataset statistics are computed while the trees grow: Spark runs jobs from several driver threads side by side.
    with ThreadPoolExecutor(max_workers=1) as pool:
        stats_f = pool.submit(lambda: joins.stored(reports.dataset_stats(raw, TARGET, cfg.rounding, cfg.median_kw), "stats"))
        at_a_time, side_by_side = model.trees_at_a_time(n_train)
        forest = model.fit_forest(train_rows, cfg.forest, label_col=TARGET, at_a_time=at_a_time, side_by_side=side_by_side)
        stats = stats_f.result()
    lap("forest_fit")
    # Stored, so that readers of the predictions do not load the forest again, as a kept frame's plan would have them do.
    predictions = joins.stored(model.predict(forest, test_rows).select(ID, TARGET, "prediction_code", "probability"), "predictions")
    summary_row = evaluate.report_summary(predictions, TARGET, "prediction_code", cfg.rounding).first()
    sizes = {"train_rows": n_train, "test_rows": int(sum(sum(r) for r in summary_row["confusion_matrix"]))}
    train_rows.unpersist()
    if cfg.materialize == "persist" and not kept_before:
        raw.unpersist()  # the test predictions, stored, no longer need it
    lap("evaluate")

    importance = model.feature_importance(spark, forest, FEATURE_DISPLAY_NAMES, cfg.rounding)
    summary = summary_row.asDict(recursive=True)
    report = reports.Report(
        scalars={"model_type": MODEL_TYPE, "accuracy": summary["accuracy"], "accuracy_percent": summary["accuracy_percent"], "n_estimators": cfg.forest.num_trees},
        feature_columns=FEATURE_DISPLAY_NAMES, codes=codes, importance=importance, stats=stats,
        classification_report={k: summary[k] for k in ("precision_rejected", "recall_rejected", "precision_approved", "recall_approved")},
        confusion_matrix=summary["confusion_matrix"])
    pipeline = model.scoring_pipeline(forest, inputs)
    lap("report")
    return TrainResult(pipeline, forest, codes, imp, cap, summary, importance, stats, report, predictions, sizes, timings)


def codes_path(model_path: str) -> str:
    """Where a saved model has its code table."""
    return f"{model_path.rstrip('/')}/label_codes"


def save(spark: SparkSession, result: TrainResult, model_path: str, report_path: str) -> None:
    """A4 + A6: the model with its code table, and the report."""
    model.save_model(result.pipeline, model_path)
    encode.save_codes(result.codes, codes_path(model_path))
    reports.write_report(spark, result.report, report_path)


def load(spark: SparkSession, model_path: str):
    """A5: the saved model and its code table."""
    return model.load_model(model_path), encode.load_codes(spark, codes_path(model_path))


__all__ = ["TrainConfig", "TrainResult", "train", "save", "load"]
