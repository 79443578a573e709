"""Report compositions (R1-R5) and their JSON form.

``dataset_stats`` (R1) needs three scans of the application table whatever
its size: one aggregation for counts, sums, extremes, moments, age bins and
brackets around the medians of income, amount and rate; one that settles the
medians; and one GROUPING SETS aggregation for the three distributions and the
two group rates. Results are small long-form rows ``(section, key, value)``.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import rounder
from ..functions.text import capitalize_first, fixed, key_to_label, thousands
from ..operators import joins, profile, quantiles
from ..schema import AGE_BIN_EDGES, AGE_BIN_LABELS, CATEGORICAL, DISPLAY_NAME, FROM_DISPLAY, REPORT_LABELS

STATS_SPEC = {
    "income_stats": ("income", ("mean", "median", "min", "max", "std")),
    "amount_stats": ("amount", ("mean", "median", "min", "max")),
    "rate_stats": ("rate", ("mean", "median", "min", "max")),
}
DISTRIBUTIONS = {"intent_distribution": "intent", "home_distribution": "home",
                 "default_distribution": "default_flag"}
RATES = {"approval_by_intent": "intent", "approval_by_home": "home"}


def _row(section: str, key: str | Column | None, value: Column) -> Column:
    k = key if isinstance(key, Column) else F.lit(key).cast("string")
    return F.struct(F.lit(section).alias("section"), k.alias("key"), value.cast("double").alias("value"))


def dataset_stats(df: DataFrame, target: str = "status", rounding: str = "even",
                  median_kw: dict | None = None) -> DataFrame:
    """R1 as long rows ``(section, key, value)``; ``key`` is null for scalars.

    Statistics are on the raw table (nulls skipped, outliers kept), as the
    original computes them from a second read of the untouched file.
    """
    rnd = rounder(rounding)
    spark = df.sparkSession
    # Scan 1: scalars, moments, extremes, age bins and brackets around the medians (one aggregation, one row).
    parts = {"total": quantiles.counted(F.lit(1)), "approved": quantiles.summed(F.col(target).cast("long"))}
    for section, (col, funcs) in STATS_SPEC.items():
        parts |= profile.stat_parts(quantiles.value(col), section, funcs)
    bins = zip(AGE_BIN_EDGES, AGE_BIN_EDGES[1:])
    parts |= {f"bin{i}": quantiles.counted_if((F.col("age") > lo) & (F.col("age") <= hi)) for i, (lo, hi) in enumerate(bins)}
    sc = quantiles.two_level(df, parts)

    # Scan 2: the exact medians within their brackets.
    med_cols = {col: section for section, (col, funcs) in STATS_SPEC.items() if "median" in funcs}
    first = {col: quantiles.bracket_of(sc, sec) for col, sec in med_cols.items()}
    medians = quantiles.exact_medians(df, list(med_cols), first=first, **(median_kw or {}))

    total, approved = sc["total"], sc["approved"] or 0
    values = [("total_records", None, float(total)), ("approved_count", None, float(approved)),
              ("rejected_count", None, float(total - approved)),
              ("approval_rate", None, (approved / total * 100) if total else None)]
    values += [("age_distribution", lab, float(sc[f"bin{i}"])) for i, lab in enumerate(AGE_BIN_LABELS)]
    for section, (col, funcs) in STATS_SPEC.items():
        stats = {**profile.stat_values(sc, section, funcs), "median": medians.get(col)}
        values += [(section, f, stats[f]) for f in funcs]
    part1 = spark.createDataFrame(values, "section string, key string, value double")
    part1 = part1.select("section", "key", F.when(F.col("section") == "approval_rate", rnd(F.col("value"), 1))
                         .when(F.col("section").endswith("_stats"), rnd(F.col("value"), 2))
                         .otherwise(F.col("value")).alias("value"))

    # Scan 3: distributions and group rates in one GROUPING SETS pass.
    keys = sorted(set(DISTRIBUTIONS.values()) | set(RATES.values()))
    grouped = df.select(*keys, target).groupingSets([[k] for k in keys], *keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col(target).cast("double")).alias("rate"),
        F.grouping_id().alias("_gid"),
    )
    # Every group becomes its rows of all sections at once: one pass, one Expand.
    items = None
    for i, k in enumerate(keys):
        gid = sum(1 << (len(keys) - 1 - j) for j in range(len(keys)) if j != i)
        own = F.array(*[_row(s, F.col(k), F.col("n")) for s, c in DISTRIBUTIONS.items() if c == k],
                      *[_row(s, F.col(k), rnd(F.col("rate") * 100, 1)) for s, c in RATES.items() if c == k])
        cond = (F.col("_gid") == gid) & F.col(k).isNotNull()
        items = F.when(cond, own) if items is None else items.when(cond, own)
    part2 = grouped.select(F.explode(items).alias("r")).select("r.*")
    return part1.unionByName(part2)


def chart_series(stats: DataFrame, importance: DataFrame | None = None) -> DataFrame:
    """The dashboard's chart data as ``(series, position, label, value)``.

    Series: approval (Approved / Rejected counts), intent and home counts and
    approval by intent (labels with only the first letter upper case), age
    bins, and feature importance in percent when a model is given. Positions
    follow the report's key order: counts and importances from the largest,
    rates by label.
    """
    # Five branches read the statistics: compute them once (a few dozen rows).
    stats = joins.stored(stats)
    s = F.col("section")
    approval = stats.where(s.isin("approved_count", "rejected_count")).select(
        F.lit("approval").alias("series"),
        F.when(s == "approved_count", 0).otherwise(1).alias("position"),
        F.when(s == "approved_count", "Approved").otherwise("Rejected").alias("label"),
        F.col("value"),
    )
    parts = [approval]
    for series, section in (("intent", "intent_distribution"), ("home", "home_distribution"),
                            ("approval_by_intent", "approval_by_intent")):
        order = [F.desc("value"), F.asc("key")] if section.endswith("_distribution") else [F.asc("key")]
        position = F.row_number().over(Window.partitionBy("section").orderBy(*order)) - 1  # one row per label
        parts.append(stats.where(s == section).select(
            F.lit(series).alias("series"), position.alias("position"),
            capitalize_first(F.col("key")).alias("label"), F.col("value")))
    pos = F.lit(None).cast("int")
    for i, lab in enumerate(AGE_BIN_LABELS):
        pos = F.when(F.col("key") == lab, F.lit(i)).otherwise(pos)
    parts.append(stats.where(s == "age_distribution").select(
        F.lit("age").alias("series"), pos.alias("position"), F.col("key").alias("label"), F.col("value")))
    if importance is not None:
        position = F.row_number().over(Window.orderBy(F.desc("importance"), F.asc("feature"))) - 1  # one row per feature
        parts.append(importance.select(
            F.lit("importance").alias("series"), position.alias("position"),
            key_to_label(F.col("feature")).alias("label"), (F.col("importance") * 100).alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def kpi_rows(stats: DataFrame, accuracy_percent: float | None = None) -> DataFrame:
    """``(name, value, text)`` for the dashboard's stat cards."""
    # Nine branches read the statistics: compute them once (a few dozen rows).
    stats = joins.stored(stats)
    s, k, v = F.col("section"), F.col("key"), F.col("value")
    picks = {
        "total_applications": (s == "total_records", thousands(v, 0)),
        "approved": (s == "approved_count", thousands(v, 0)),
        "rejected": (s == "rejected_count", thousands(v, 0)),
        "approval_rate": (s == "approval_rate", F.concat(fixed(v, 1), F.lit("%"))),
        "rejection_rate": (s == "approval_rate", F.concat(fixed(F.lit(100.0) - v, 1), F.lit("%"))),
        "avg_income": ((s == "income_stats") & (k == "mean"), thousands(v, 2)),
        "avg_amount": ((s == "amount_stats") & (k == "mean"), thousands(v, 2)),
        "avg_rate": ((s == "rate_stats") & (k == "mean"), F.concat(fixed(v, 2), F.lit("%"))),
        "max_amount": ((s == "amount_stats") & (k == "max"), thousands(v, 2)),
    }
    out = None
    for name, (cond, text) in picks.items():
        val = (F.lit(100.0) - v) if name == "rejection_rate" else v
        part = stats.where(cond).select(F.lit(name).alias("name"), val.alias("value"), text.alias("text"))
        out = part if out is None else out.unionByName(part)
    if accuracy_percent is not None:
        spark = stats.sparkSession
        acc = spark.range(1).select(F.lit("model_accuracy").alias("name"),
                                    F.lit(float(accuracy_percent)).alias("value"),
                                    F.concat(fixed(F.lit(float(accuracy_percent)), 1), F.lit("%")).alias("text"))
        out = out.unionByName(acc)
    return out


# Report document (F4) as a Spark schema, for reading the JSON back.
METADATA_SCHEMA = T.StructType([
    T.StructField("model_type", T.StringType()),
    T.StructField("accuracy", T.DoubleType()),
    T.StructField("accuracy_percent", T.DoubleType()),
    T.StructField("n_estimators", T.IntegerType()),
    T.StructField("feature_columns", T.ArrayType(T.StringType())),
    T.StructField("encoding_maps", T.MapType(T.StringType(), T.MapType(T.StringType(), T.IntegerType()))),
    T.StructField("feature_importance", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("classification_report", T.StructType([
        T.StructField(n, T.DoubleType()) for n in
        ("precision_rejected", "recall_rejected", "precision_approved", "recall_approved")])),
    T.StructField("dataset_stats", T.StructType([
        T.StructField("total_records", T.LongType()),
        T.StructField("approved_count", T.LongType()),
        T.StructField("rejected_count", T.LongType()),
        T.StructField("approval_rate", T.DoubleType()),
        T.StructField("intent_distribution", T.MapType(T.StringType(), T.LongType())),
        T.StructField("home_distribution", T.MapType(T.StringType(), T.LongType())),
        T.StructField("default_distribution", T.MapType(T.StringType(), T.LongType())),
        T.StructField("age_distribution", T.MapType(T.StringType(), T.LongType())),
        T.StructField("income_stats", T.StructType([T.StructField(n, T.DoubleType())
                                                   for n in ("mean", "median", "min", "max", "std")])),
        T.StructField("amount_stats", T.StructType([T.StructField(n, T.DoubleType())
                                                   for n in ("mean", "median", "min", "max")])),
        T.StructField("rate_stats", T.StructType([T.StructField(n, T.DoubleType())
                                                 for n in ("mean", "median", "min", "max")])),
        T.StructField("approval_by_intent", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("approval_by_home", T.MapType(T.StringType(), T.DoubleType())),
    ])),
    T.StructField("confusion_matrix", T.ArrayType(T.ArrayType(T.LongType()))),
])


@dataclass
class Report:
    """R2: what the report document holds. Scalars and the class report are a
    few numbers; labels, importances and statistics are tables."""

    scalars: dict[str, object]
    feature_columns: list[str]
    codes: DataFrame                     # (column_name, label, code)
    importance: DataFrame                # (feature, importance)
    classification_report: dict[str, float]
    stats: DataFrame                     # R1: (section, key, value)
    confusion_matrix: list[list[int]]


def _entry(key: Column, value: Column) -> Column:
    """``"key": value`` as JSON text."""
    pair = F.to_json(F.create_map(key, value))
    return F.substring(pair, F.lit(2), F.length(pair) - 2)


def report_lines(report: Report) -> DataFrame:
    """(section, part, place, key, text): the lines of the JSON document, in
    this order. Every entry of a map is a line of its own, made where its row
    is; of each map only the first entry's place is looked up, for the commas."""
    spark = report.codes.sparkSession
    order = ["model_type", "accuracy", "accuracy_percent", "n_estimators", "feature_columns", "encoding_maps", "feature_importance",
             "classification_report", "dataset_stats", "confusion_matrix"]
    at = {name: i for i, name in enumerate(order)}
    stats_order = ["total_records", "approved_count", "rejected_count", "approval_rate", "intent_distribution", "home_distribution", "default_distribution",
                   "age_distribution", "income_stats", "amount_stats", "rate_stats", "approval_by_intent", "approval_by_home"]
    stats_at = {name: i for i, name in enumerate(stats_order)}
    position = lambda c, names: F.element_at(F.create_map(*(x for n, i in names.items() for x in (F.lit(n), F.lit(i)))), c)
    maps = report.codes.select(F.lit(at["encoding_maps"]).alias("section"), position(F.col("column_name"), {c: i for i, c in enumerate(CATEGORICAL)}).alias("part"),
                               F.col("code").cast("double").alias("place"), F.col("label").alias("key"), _entry(F.col("label"), F.col("code")).alias("text"))
    importance = report.importance.select(F.lit(at["feature_importance"]).alias("section"), F.lit(0).alias("part"), (-F.col("importance")).alias("place"),
                                          F.col("feature").alias("key"), _entry(F.col("feature"), F.col("importance")).alias("text"))
    section, key, value = F.col("section"), F.col("key"), F.col("value")
    counts = section.endswith("_distribution")
    place = F.when(section == "age_distribution", position(key, {b: i for i, b in enumerate(AGE_BIN_LABELS)})).when(counts, -value)
    place = F.when(section.endswith("_stats"), position(key, {f: i for i, f in enumerate(profile.STAT_FUNCS)})).otherwise(place)
    text = F.when(counts, _entry(key, value.cast("long"))).otherwise(_entry(key, value))
    stats = report.stats.where("key is not null").select(F.lit(at["dataset_stats"]).alias("section"), position(section, stats_at).alias("part"),
                                                         F.coalesce(place.cast("double"), F.lit(0.0)).alias("place"), "key", text.alias("text"))
    entries = joins.stored(maps.unionByName(importance).unionByName(stats), "report-entries")
    own = F.struct("place", "key")
    firsts = entries.groupBy(F.col("section").alias("s"), F.col("part").alias("p")).agg(F.min(own).alias("first"))
    entries = entries.join(firsts, (F.col("section") == F.col("s")) & (F.col("part") == F.col("p")))
    entries = entries.select("section", "part", "place", "key", F.concat(F.when(own == F.col("first"), "").otherwise(","), "text").alias("text"))

    low, high = -math.inf, math.inf
    totals = {r.section: r.value for r in report.stats.where("key is null").collect()}  # four numbers
    lines = [(-1, 0, low, "{")]
    for name, i in at.items():
        head = f'{"," if i else ""}{json.dumps(name)}: '
        if name in report.scalars or name in ("feature_columns", "classification_report", "confusion_matrix"):
            lines.append((i, -1, low, head + json.dumps(report.scalars[name] if name in report.scalars else getattr(report, name))))
            continue
        lines.append((i, -1, low, head + "{"))
        if name == "encoding_maps":
            for part, c in enumerate(CATEGORICAL):
                lines += [(i, part, low, f'{"," if part else ""}{json.dumps(DISPLAY_NAME[c])}: {{'), (i, part, high, "}")]
        if name == "dataset_stats":
            for part, section in enumerate(stats_order):
                comma = "," if part else ""
                if section in totals or section in stats_order[:4]:
                    total = totals.get(section)
                    total = total if section == "approval_rate" or total is None else int(total)
                    lines.append((i, part, low, f"{comma}{json.dumps(section)}: {json.dumps(total)}"))
                else:
                    lines += [(i, part, low, f"{comma}{json.dumps(section)}: {{"), (i, part, high, "}")]
        lines.append((i, len(stats_order), high, "}"))
    lines.append((len(order), 0, high, "}"))
    frame = spark.createDataFrame(lines, "section int, part int, place double, text string")
    return frame.select("section", "part", "place", F.lit(None).cast("string").alias("key"), "text").unionByName(entries)


def write_report(spark: SparkSession, report: Report, path: str) -> None:
    """The report as one JSON document in one file, keys in report order.
    One task writes the sorted lines; it holds none but those it is sorting."""
    order = ["section", "part", "place", "key"]
    lines = report_lines(report).repartition(1).sortWithinPartitions(*order)
    lines.select(F.col("text").alias("value")).write.mode("overwrite").text(path)


def encoding_codes(report: DataFrame) -> DataFrame:
    """The label codes of a report that was read back, as a stored code table."""
    columns = F.create_map(*(F.lit(x) for pair in FROM_DISPLAY.items() for x in pair))
    maps = report.select(F.explode("encoding_maps").alias("shown", "labels"))
    codes = maps.select(F.coalesce(F.try_element_at(columns, F.col("shown")), F.col("shown")).alias("column_name"), F.explode("labels").alias("label", "code"))
    return joins.stored(codes, "codes")


def report_rows(report: DataFrame) -> DataFrame:
    """The whole document as rows ``(section, name, label, value)``: scalars,
    feature positions, label codes, importances, class report, matrix, statistics."""
    row = lambda section, name, label, value: F.struct(
        F.lit(section).alias("section"), name.cast("string").alias("name"), label.cast("string").alias("label"), value.cast("double").alias("value"))
    none = F.lit(None)
    scalars = F.array(*(row("scalar", F.lit(c), none, F.col(c)) for c in ("accuracy", "accuracy_percent", "n_estimators")))
    features = F.transform("feature_columns", lambda x, i: row("feature_columns", x, none, i + 1))
    importance = F.transform(F.map_entries("feature_importance"), lambda e: row("feature_importance", e["key"], none, e["value"]))
    classes = F.array(*(row("classification_report", F.lit(c), none, F.col(f"classification_report.{c}")) for c in METADATA_SCHEMA["classification_report"].dataType.names))
    matrix = F.flatten(F.transform("confusion_matrix", lambda r, i: F.transform(r, lambda n, j: row("confusion_matrix", i, j, n))))
    labels = F.flatten(F.transform(F.map_entries("encoding_maps"), lambda m: F.transform(F.map_entries(m["value"]), lambda e: row("encoding_maps", m["key"], e["key"], e["value"]))))
    rows = report.select(F.explode(F.flatten(F.array(scalars, features, importance, classes, matrix, labels))).alias("r")).select("r.*")
    return rows.unionByName(stats_rows(report).select("section", F.col("section").alias("name"), F.col("key").alias("label"), "value"))


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """Read the report back under the fixed schema (a one-row DataFrame)."""
    return spark.read.json(path, schema=METADATA_SCHEMA, multiLine=True)


def stats_section(report: DataFrame) -> DataFrame:
    """The ``dataset_stats`` sub-document as columns (the stats endpoint)."""
    return report.select("dataset_stats.*")


MODEL_INFO_FIELDS = ["model_type", "accuracy", "accuracy_percent", "n_estimators", "feature_importance",
                     "classification_report", "confusion_matrix", "feature_columns"]


def model_info(report: DataFrame) -> DataFrame:
    """The eight model fields (a missing field is null), plus the short
    model name shown on the model page (K9: ``Classifier`` removed)."""
    from ..functions.text import remove_word
    cols = [F.col(f) if f in report.columns else F.lit(None).alias(f) for f in MODEL_INFO_FIELDS]
    return report.select(*cols).withColumn("model_name", F.trim(remove_word(F.col("model_type"), "Classifier")))


def model_summary(report: DataFrame) -> DataFrame:
    """The model page as rows ``(position, feature, label, importance_percent)``.

    Position is 1-based in feature-column order (M7); a feature missing from
    the importance map shows 0.
    """
    info = model_info(report)
    return info.select(F.posexplode("feature_columns").alias("pos", "feature"), "feature_importance").select(
        (F.col("pos") + 1).alias("position"),
        F.col("feature"),
        key_to_label(F.col("feature")).alias("label"),
        (F.coalesce(F.try_element_at("feature_importance", F.col("feature")), F.lit(0.0)) * 100)
        .alias("importance_percent"),
    )


def model_page(report: DataFrame) -> DataFrame:
    """The model page as rows ``(section, position, label, text)``: name, accuracy
    and number of features; precision and recall of both classes; the matrix
    cells (M8); the features with their importance, to one decimal."""
    info = model_info(report)
    percent_of = lambda c: F.concat(fixed(c * 100, 1), F.lit("%"))
    row = lambda section, i, label, text: F.struct(
        F.lit(section).alias("section"), F.lit(i).cast("int").alias("position"), F.lit(label).alias("label"), text.alias("text"))
    rows = [row("card", 0, "Model", F.col("model_name")), row("card", 1, "Accuracy", F.concat(fixed(F.col("accuracy_percent"), 1), F.lit("%"))),
            row("card", 2, "Features", F.size("feature_columns").cast("string"))]
    for i, (code, name) in enumerate(REPORT_LABELS.names.items()):
        for j, metric in enumerate(("precision", "recall")):
            value = F.col(f"classification_report.{metric}_{name.lower()}")
            rows.append(row("report", 2 * i + j, f"{name} ({code}) {metric}", percent_of(value)))
        for j, other in REPORT_LABELS.names.items():
            rows.append(row("matrix", 2 * i + j, f"Actual: {name}, Pred: {other}", F.col("confusion_matrix")[i][j].cast("string")))
    fixed_rows = info.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    features = model_summary(report).select(
        F.lit("feature").alias("section"), F.col("position").cast("int").alias("position"), "label",
        F.concat(fixed(F.col("importance_percent"), 1), F.lit("%")).alias("text"))
    return fixed_rows.unionByName(features)


def stats_rows(report: DataFrame) -> DataFrame:
    """The statistics section of a report as the rows of ``dataset_stats``."""
    section = stats_section(report)
    def entry(name: str, key: Column, value: Column) -> Column:
        return F.struct(F.lit(name).alias("section"), key.alias("key"), value.cast("double").alias("value"))

    def unfolded(name: str, kind: T.DataType) -> Column:
        c = F.col(name)
        if isinstance(kind, T.MapType):
            return F.transform(F.map_entries(c), lambda e: entry(name, e["key"], e["value"]))
        if isinstance(kind, T.StructType):
            return F.array(*(entry(name, F.lit(k), c[k]) for k in kind.names))
        return F.array(entry(name, F.lit(None).cast("string"), c))

    entries = [unfolded(f.name, f.dataType) for f in section.schema.fields]
    return section.select(F.explode(F.flatten(F.array(*entries))).alias("r")).select("r.*")
