"""Random forest fit, prediction, importance and persistence.

Spark ML grows the trees: per level it aggregates split statistics on the
executors (one tree-aggregate per level, partial sums per partition), so no
row ever goes to the driver. The training vectors are persisted by the
caller before the fit. Trees are independent, so a forest over many rows is
grown a few trees at a time: Spark keeps two numbers a row for each tree of a
fit, and a task's statistics of all trees at once outgrow a processor's cache.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import rounder
from ..schema import FOREST_DEPTH, FOREST_MIN_LEAF, FOREST_SEED, FOREST_TREES


@dataclass
class ForestParams:
    """G1 settings. ``features_per_split='3'`` is the square root of 10
    features rounded down (Spark's ``sqrt`` rounds up to 4)."""

    num_trees: int = FOREST_TREES
    max_depth: int = FOREST_DEPTH
    min_instances_per_node: int = FOREST_MIN_LEAF
    seed: int = FOREST_SEED
    features_per_split: str = "3"
    max_bins: int = 64
    subsampling_rate: float = 1.0
    bootstrap: bool = True
    checkpoint_interval: int = 10
    max_memory_mb: int = 1024
    cache_node_ids: bool = True


FEW_ROWS, SOME_ROWS, MANY_ROWS = 50_000, 2_000_000, 20_000_000
SEED_STEP = 1_000_003  # between fits; Spark adds the number of a partition


def trees_at_a_time(rows: int) -> tuple[int | None, int]:
    """Trees of one fit (None: all), and fits side by side, for so many training rows.

    Side by side, one fit has the cores while the driver works for the others; each keeps
    its counts and node numbers, so over more rows there are fewer of them."""
    return (None, 1) if rows < FEW_ROWS else (25, 4) if rows < SOME_ROWS else (25, 2) if rows < MANY_ROWS else (10, 1)


def fit_forest(train: DataFrame, params: ForestParams | None = None, features_col: str = "features",
               label_col: str = "status", at_a_time: int | None = None, side_by_side: int = 1) -> RandomForestClassificationModel:
    """G1: fit on an assembled frame (``features`` vector, integer label), ``at_a_time`` trees in one fit (None: all)."""
    p = params or ForestParams()
    firsts = range(0, p.num_trees, at_a_time or p.num_trees)
    groups = [replace(p, num_trees=min(firsts.step, p.num_trees - first), seed=p.seed + i * SEED_STEP) for i, first in enumerate(firsts)]
    if len(groups) == 1:
        return _fit(train, p, features_col, label_col)
    with ThreadPoolExecutor(max_workers=side_by_side) as pool:
        return join_forests(list(pool.map(lambda g: _fit(train, g, features_col, label_col), groups)))


def join_forests(forests: list[RandomForestClassificationModel]) -> RandomForestClassificationModel:
    """One forest with all trees of several that were fitted on the same rows."""
    spark, first = SparkSession.getActiveSession(), forests[0]
    kinds, trees = spark._jvm.org.apache.spark.ml.classification, [t for f in forests for t in f._java_obj.trees()]
    array = spark.sparkContext._gateway.new_array(kinds.DecisionTreeClassificationModel, len(trees))
    for i, tree in enumerate(trees):
        array[i] = tree
    joined = RandomForestClassificationModel(kinds.RandomForestClassificationModel(first.uid, array, first.numFeatures, first.numClasses))
    joined._resetUid(first.uid)
    first._copyValues(joined)._set(numTrees=len(trees))._transfer_params_to_java()
    return joined


def _fit(train: DataFrame, p: ForestParams, features_col: str, label_col: str) -> RandomForestClassificationModel:
    rf = RandomForestClassifier(
        featuresCol=features_col, labelCol=label_col, numTrees=p.num_trees, maxDepth=p.max_depth,
        minInstancesPerNode=p.min_instances_per_node, seed=p.seed,
        featureSubsetStrategy=p.features_per_split, maxBins=p.max_bins,
        subsamplingRate=p.subsampling_rate, bootstrap=p.bootstrap,
        checkpointInterval=p.checkpoint_interval, maxMemoryInMB=p.max_memory_mb,
        # The node-id cache saves re-walking every tree per level (2x faster at
        # depth 15); it is checkpointed every ``checkpoint_interval`` levels when
        # the session names a checkpoint folder.
        cacheNodeIds=p.cache_node_ids,
    )
    return rf.fit(train.withColumn(label_col, F.col(label_col).cast("double")))


def predict(model, df: DataFrame, code_col: str = "prediction_code") -> DataFrame:
    """G2 + G3 in one pass: integer class and the ``probability`` vector."""
    out = model.transform(df)
    return out.withColumn(code_col, F.col("prediction").cast("int"))


def feature_importance(spark: SparkSession, model: RandomForestClassificationModel, names: list[str],
                       rounding: str = "even", places: int = 4) -> DataFrame:
    """G4 (+J1): ``(feature, importance)`` sorted by importance, descending.

    The vector has one entry per feature (a bounded, model-sized object).
    """
    rnd = rounder(rounding)
    vals = [float(v) for v in model.featureImportances.toArray()]
    df = spark.createDataFrame(list(zip(names, vals)), "feature string, raw double")
    return by_importance(df.select("feature", rnd(F.col("raw"), places).alias("importance")))


def by_importance(importance: DataFrame) -> DataFrame:
    """``(feature, importance)``, the most important first; ties by name."""
    return importance.orderBy(F.desc("importance"), F.asc("feature"))


def top_features(importance: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` most important features."""
    return by_importance(importance).limit(n)


def scoring_pipeline(model: RandomForestClassificationModel, feature_cols: list[str]) -> PipelineModel:
    """Assembler + forest as one persistable unit."""
    # A request without a value is refused by the rules; the trees read its gap as NaN.
    assembler = VectorAssembler(inputCols=feature_cols, outputCol=model.getFeaturesCol(), handleInvalid="keep")
    return PipelineModel([assembler, model])


def save_model(model: PipelineModel, path: str) -> None:
    """A4: Spark ML persistence (replaces the pickle file)."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    """A5."""
    return PipelineModel.load(path)
