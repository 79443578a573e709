"""Quality rules with an isolation forest on rule statistics.

Every text gets the statistics of the usual quality rules. Trees of random
splits are grown on the statistics of labelled documents; a document whose
path through them is short is an anomaly. All labelled documents count: the
cells' box spans them, each tree's rows are drawn from all good ones (an
isolation tree is grown on few rows by design), its leaves weigh as many rows
as all good ones put there, and the threshold is set on all of them: the one
that finds most bad documents while at most ``max_loss`` of the good ones is
lost. A document is kept unless a base rule fails or it is an
anomaly.

Defined results: null and empty texts have no words and fail; rows are judged
one by one, so repeated or null ids do no harm; an empty table gives no rows;
without labels of either kind the base rules alone decide.
"""

from __future__ import annotations

import math
import operator
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lendscope.operators import joins
from lendscope.sources.tables import load_table

from .common import free_name, load_documents, raw, share, ship_package, stored

#: Trees, the good rows drawn for each, and the levels of a tree.
TREES, PSI, LEVELS = 200, 256, 14
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_SYMBOLS, _UPPER, _DIGITS = b"#*$%&|<>", bytes(range(65, 91)), bytes(range(48, 58))
_MARKS = b"!?.,;:"


def code_points(b: bytes) -> int:
    return len(b.decode("utf-8", "replace"))


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words that lie in a window of ``width`` words found twice or more."""
    windows = list(zip(*(words[i:] for i in range(width))))
    if len(set(windows)) == len(windows):
        return 0
    found = Counter(windows)
    again = np.fromiter((found[w] > 1 for w in windows), bool, len(windows))
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int((np.cumsum(edge) > 0).sum())


def rule_counts(b: bytes) -> tuple[list[int], list[bytes]]:
    """The counts of the contract, and the words."""
    words = b.split()
    lines = [x for x in b.split(b"\n") if x.strip()]
    return [len(words), code_points(b"".join(words)), len(b) - len(b.translate(None, _SYMBOLS)),
            len(lines) - len(set(lines)), repeated_words(words)], words


def base_failed(counts: list[int]) -> bool:
    return bool(counts[0] < 10 or 100 * counts[4] > 20 * counts[0])


def rule_statistics(b: bytes, counts: list[int], words: list[bytes]) -> list[float]:
    """What the forest sees: rates that hardly depend on a text's length, as
    square roots, which spread the small ones."""
    n, chars, symbols, dup, again = counts
    size, n1 = max(len(b), 1), max(n, 1)
    share = lambda drop: (len(b) - len(b.translate(None, drop))) / size
    lines = b.count(b"\n") + 1
    distinct = len(set(words))
    return [math.sqrt(v) for v in (
        chars / n1, symbols / n1, dup / lines, again / n1, share(_UPPER), share(_DIGITS), share(_MARKS), share(b"!"), share(b"|"),
        sum(map(operator.eq, words, words[1:])) / n1, math.log1p(distinct) / math.log1p(n1), math.log1p(n / lines),
    )]


@dataclass
class Forest:
    """Trees as arrays; a leaf's feature is -1 and its value the length of a path that ends there."""

    feature: list[np.ndarray]
    value: list[np.ndarray]
    left: list[np.ndarray]
    psi: int

    def leaves(self, x: np.ndarray) -> Iterator[np.ndarray]:
        """The leaf of each row, tree by tree."""
        rows = np.arange(len(x))
        for f, v, left in zip(self.feature, self.value, self.left):
            at = np.zeros(len(x), np.int64)
            while (inner := f[at] >= 0).any():
                go = x[rows, np.maximum(f[at], 0)] >= v[at]
                at = np.where(inner, left[at] + go, at)
            yield at

    def scores(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path / usual path): near 1 for anomalies."""
        total = np.zeros(len(x))
        for v, at in zip(self.value, self.leaves(x)):
            total += v[at]
        return np.exp2(-total / len(self.feature) / _usual_path(self.psi))

    def weighed(self, counts: dict[tuple[int, int], int], n: int) -> Forest:
        """The same trees, whose leaves hold as many of ``psi`` rows as their
        share of all ``n`` rows; ``counts`` has the rows of each (tree, leaf)."""
        values = []
        for t, (feature, value, left) in enumerate(zip(self.feature, self.value, self.left)):
            depth, value = np.zeros(len(feature)), value.copy()
            for i in np.flatnonzero(feature >= 0):  # a node stands before those below it
                depth[left[i]] = depth[left[i] + 1] = depth[i] + 1
            for i in np.flatnonzero(feature < 0):
                held = self.psi * counts.get((t, int(i)), 0) / n
                low = math.floor(held)
                value[i] = depth[i] + _usual_path(low) + (held - low) * (_usual_path(low + 1) - _usual_path(low))
            values.append(value)
        return Forest(self.feature, values, self.left, self.psi)


def _usual_path(n: int) -> float:
    """Mean length of an unsuccessful search in a binary tree of ``n`` rows."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def drawn(n: int, trees: int = TREES, psi: int = PSI, seed: int = 42) -> list[np.ndarray]:
    """For each tree, the numbers of ``psi`` of ``n`` rows."""
    return [np.random.default_rng([seed, t]).choice(n, min(psi, n), replace=False) for t in range(trees)]


def grow_forest(x: np.ndarray, low: np.ndarray, high: np.ndarray, trees: int = TREES, psi: int = PSI, limit: int = LEVELS, seed: int = 42) -> Forest:
    """Trees over ``psi`` random rows of ``x`` each."""
    return grow_drawn([x[i] for i in drawn(len(x), trees, psi, seed)], low, high, limit, seed)


def grow_drawn(rows_of_trees: list[np.ndarray], low: np.ndarray, high: np.ndarray, limit: int = LEVELS, seed: int = 42) -> Forest:
    """A tree over each of some sets of rows. A split is drawn uniformly
    within the node's cell of the box from ``low`` to ``high``, not within the
    range of its rows, so that regions without usual documents end early."""
    rng = np.random.default_rng(seed)
    psi = len(rows_of_trees[0])
    features, values, lefts = [], [], []
    for first in rows_of_trees:
        feature, value, left = [-1], [0.0], [0]
        todo = [(0, first, low, high, 0)]
        while todo:
            node, rows, lo, hi, depth = todo.pop()
            free = np.flatnonzero(hi > lo)
            if depth >= limit or len(rows) < 2 or not len(free):
                value[node] = depth + _usual_path(len(rows))
                continue
            f = int(rng.choice(free))
            cut = float(rng.uniform(lo[f], hi[f]))
            cut = cut if cut > lo[f] else float(hi[f])
            feature[node], value[node], left[node] = f, cut, len(feature)
            feature += [-1, -1]
            value += [0.0, 0.0]
            left += [0, 0]
            right = rows[:, f] >= cut
            lo2, hi2 = lo.copy(), hi.copy()
            lo2[f] = hi2[f] = cut
            todo += [(left[node], rows[~right], lo, hi2, depth + 1), (left[node] + 1, rows[right], lo2, hi, depth + 1)]
        features.append(np.array(feature))
        values.append(np.array(value))
        lefts.append(np.array(left))
    return Forest(features, values, lefts, psi)


def lost(n: int, max_loss: float) -> int:
    """How many of ``n`` good rows may be lost; one always stays."""
    return min(n - 1, int(max_loss * n))


def calibrated(good: np.ndarray, bad: np.ndarray, max_loss: float = 0.002) -> float:
    """The lowest score cut that loses at most ``max_loss`` of the good rows:
    halfway to the next bad row's score, so that neither side is at the edge."""
    edge = np.sort(good)[::-1][lost(len(good), max_loss)]
    above = bad[bad > edge]
    return float((edge + above.min()) / 2) if len(above) else float(edge)


@dataclass
class RuleModel:
    forest: Forest | None
    threshold: float


def labelled_statistics(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(x, y), stored: the statistics and label of every labelled document that
    passes the base rules. A document id with several labels has the largest;
    null ids and labels are left out. Texts stay where they are: the statistics,
    a hundred bytes a row, are joined."""
    ship_package(docs.sparkSession)
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("x", T.ArrayType(T.DoubleType()))])

    def stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("raw").to_pylist()
            made = [rule_counts(b) for b in texts]
            out = [None if base_failed(c) else rule_statistics(b, c, w) for b, (c, w) in zip(texts, made)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.list_(pa.float64()))], names=["doc_id", "x"])

    lab = labels.select(F.col("doc_id").alias("doc_id"), F.col("quality").cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    lab = lab.groupBy("doc_id").agg(F.max("y").alias("y"))
    made = docs.where("doc_id is not null").select("doc_id", raw("text").alias("raw")).mapInArrow(stats, schema).where("x is not null")
    return stored(made.join(lab, "doc_id").select("x", "y"), "rule-statistics")


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)


def fit(docs: DataFrame, labels: DataFrame, max_loss: float = 0.002) -> RuleModel:
    """Trees on the good labelled rows (what a usual document looks like),
    threshold on both classes; rows that fail the base rules are left out.
    Every labelled row counts. The driver holds the trees and the rows drawn for
    them, ``TREES * PSI`` at most."""
    spark = docs.sparkSession
    rows = labelled_statistics(docs, labels)
    sizes = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if set(sizes) != {0, 1}:
        return RuleModel(None, 1.0)
    n = sizes[1]
    width = len(rows.first().x)
    low, high = np.array(rows.agg(*(f(F.col("x")[i]) for f in (F.min, F.max) for i in range(width))).first(), float).reshape(2, width)
    good = stored(joins.numbered(rows.where("y = 1").select("x"), [F.col("x")], "at"), "rule-good")
    picks = drawn(n)
    wanted = spark.createDataFrame([(int(i),) for i in sorted({int(i) for p in picks for i in p})], "at long")
    found = {r["at"]: r.x for r in good.join(wanted, "at").collect()}
    grown = grow_drawn([np.array([found[int(i)] for i in p]) for p in picks], low, high)
    shared = share(spark, grown)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros(len(f), np.int64) for f in shared.value.feature]
        for batch in batches:
            for total, at in zip(totals, shared.value.leaves(_matrix(batch))):
                total += np.bincount(at, minlength=len(total))
        for tree, total in enumerate(totals):
            leaf = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(leaf), tree, np.int32)), pa.array(leaf.astype(np.int32)), pa.array(total[leaf])], names=["tree", "leaf", "n"])

    counts = good.select("x").mapInArrow(count, "tree int, leaf int, n long").groupBy("tree", "leaf").agg(F.sum("n").alias("n")).collect()
    forest = grown.weighed({(r.tree, r.leaf): r.n for r in counts}, n)
    model = share(spark, forest)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(model.value.scores(_matrix(batch))), batch.column("y")], names=["score", "y"])

    scores = stored(rows.mapInArrow(score, "score double, y int"), "rule-scores")
    ranked = joins.numbered(scores.where("y = 1").select("score"), [F.desc("score")], "at")
    edge = ranked.where(F.col("at") == lost(n, max_loss)).first().score
    above = scores.where((F.col("y") == 0) & (F.col("score") > edge)).agg(F.min("score")).first()[0]
    return RuleModel(forest, edge if above is None else (edge + above) / 2)


def judge(texts: list[bytes], model: RuleModel) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Counts, base_failed, anomaly score and kept of each text."""
    counts, stats = [], []
    for b in texts:
        c, words = rule_counts(b)
        counts.append(c)
        stats.append(rule_statistics(b, c, words))
    counts = np.array(counts, np.int64).reshape(len(texts), len(COUNTS))
    failed = np.array([base_failed(c) for c in counts], bool)
    score = model.forest.scores(np.array(stats)) if model.forest and len(texts) else np.zeros(len(texts))
    return counts, failed, score, ~failed & ~(score > model.threshold)


def rules(docs: DataFrame, model: RuleModel) -> DataFrame:
    """One row for each document: doc_id, the counts, base_failed, kept, anomaly (double)."""
    shared = share(docs.sparkSession, model)
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *(T.StructField(c, T.LongType()) for c in COUNTS),
                           T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()), T.StructField("anomaly", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, failed, score, kept = judge(batch.column("raw").to_pylist(), shared.value)
            arrays = [batch.column("doc_id"), *(pa.array(counts[:, i]) for i in range(len(COUNTS))), pa.array(failed), pa.array(kept), pa.array(score)]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return docs.select("doc_id", raw("text").alias("raw")).mapInArrow(run, schema)


def keep_good(docs: DataFrame, model: RuleModel) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    shared = share(docs.sparkSession, model)
    name = free_name(docs.columns, "raw")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *_, kept = judge(batch.column(name).to_pylist(), shared.value)
            yield batch.drop_columns([name]).filter(pa.array(kept))

    return docs.withColumn(name, raw("text")).mapInArrow(run, docs.schema)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load_documents(spark, sf_dir)
    return rules(docs, fit(docs, load_table(spark, sf_dir, "labels")))


