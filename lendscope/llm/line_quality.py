"""Document quality from a linear-chain conditional random field over lines.

Every line of a text is good or bad. A line's features come from itself and
its neighbours, and neighbouring labels have weights of their own; forward and
backward sums give the probability that a line is good, and a document's
quality is their mean, weighted by length, put on the scale of the labels.

The field is trained on a bounded sample of labelled documents: first every
line has its document's label, then lines of bad documents that the field
finds good are labelled so, and it is trained again.

Defined results: null and empty texts are one empty line and have a score like
any other; rows are scored one by one, also with repeated or null ids (a null
id counts as the empty text in the split); an empty table gives no rows;
without training labels of both kinds every score is the share of good ones
(0.5 without any).
"""

from __future__ import annotations

import math
import operator
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession

from lendscope.sources.tables import load_table

from .common import crc_mod, labelled_sample, load_documents, raw, share, slices

#: At most so many documents of either label, of so many lines, are trained on.
SAMPLE, SAMPLE_LINES = 2000, 400
THRESHOLD = 0.3
_SYMBOLS, _UPPER, _DIGITS = b"#*$%&<>^~=_", bytes(range(65, 91)), bytes(range(48, 58))
N_OWN = 14


def line_features(line: bytes, again: bool) -> list[float]:
    words = line.split()
    n, size = max(len(words), 1), max(len(line), 1)
    share = lambda drop: (len(line) - len(line.translate(None, drop))) / size
    most = Counter(words).most_common(1)[0][1] if words else 0
    return [
        1.0, math.log1p(len(words)) / 5, math.sqrt(share(_SYMBOLS)), share(_UPPER), math.sqrt(share(_DIGITS)), math.sqrt(share(b"!")), math.sqrt(share(b"|")),
        sum(map(operator.eq, words, words[1:])) / n, len(set(words)) / n, most / n if len(words) > 3 else 0.0, min(size / n / 10, 3.0),
        float(line.rstrip()[-1:] in (b".", b"!", b"?")), float(not words), float(again)]


def document_lines(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Features of all lines with those of the lines before and after, and the lines' lengths."""
    lines = text.split(b"\n")
    seen: set[bytes] = set()
    rows = []
    for line in lines:
        rows.append(line_features(line, bool(line.strip()) and line in seen))
        seen.add(line)
    own = np.array(rows)
    out = np.zeros((len(lines), 3 * N_OWN))
    out[:, :N_OWN] = own
    out[1:, N_OWN : 2 * N_OWN] = own[:-1]  # its constant says whether there is a line before
    out[:-1, 2 * N_OWN :] = own[1:]
    return out, np.array([len(x.strip()) for x in lines], float)


@dataclass
class Chains:
    """Lines of several documents, ordered by position in the document, so that
    the lines at one position are a range; documents with more lines come first."""

    x: np.ndarray
    lengths: np.ndarray
    order: np.ndarray
    begins: np.ndarray
    documents: np.ndarray

    @classmethod
    def of(cls, texts: list[bytes]) -> Chains:
        made = [document_lines(t) for t in texts]
        counts = np.array([len(m[1]) for m in made])
        rank = np.argsort(np.argsort(-counts, kind="stable"), kind="stable")
        document = np.repeat(np.arange(len(texts)), counts)
        position = np.concatenate([np.arange(c) for c in counts])
        order = np.lexsort((rank[document], position))
        begins = np.concatenate(([0], np.cumsum(np.bincount(position))))
        return cls(np.concatenate([m[0] for m in made])[order], np.concatenate([m[1] for m in made])[order], order, begins, document[order])


@dataclass
class Field:
    """weights: of a line for good; links: of neighbouring labels (bad or good, then the next)."""

    weights: np.ndarray
    links: np.ndarray
    slope: float
    shift: float

    def marginals(self, chains: Chains) -> tuple[np.ndarray, np.ndarray]:
        """The probability of good for every line, and summed pair probabilities of neighbours."""
        e = chains.x @ self.weights
        steps = [slice(a, b) for a, b in zip(chains.begins[:-1], chains.begins[1:])]
        node = np.stack([np.zeros_like(e), e], axis=1)
        forward, backward = node.copy(), np.zeros_like(node)
        t = self.links
        for before, now in zip(steps, steps[1:]):
            k = now.stop - now.start
            f = forward[before][:k]
            forward[now] += np.stack([np.logaddexp(f[:, 0] + t[0, y], f[:, 1] + t[1, y]) for y in (0, 1)], axis=1)
        for now, after in zip(reversed(steps[:-1]), reversed(steps)):
            k = after.stop - after.start
            g = node[after] + backward[after]
            backward[now.start : now.start + k] = np.stack([np.logaddexp(g[:, 0] + t[y, 0], g[:, 1] + t[y, 1]) for y in (0, 1)], axis=1)
        both = forward + backward
        total = np.logaddexp(both[:, 0], both[:, 1])
        pairs = np.zeros((2, 2))
        for before, now in zip(steps, steps[1:]):
            k = now.stop - now.start
            z = total[now]
            for y in (0, 1):
                for y2 in (0, 1):
                    pairs[y, y2] += np.exp(forward[before][:k, y] + t[y, y2] + node[now][:, y2] + backward[now][:, y2] - z).sum()
        return np.exp(both[:, 1] - total), pairs

    def quality(self, chains: Chains, n: int) -> np.ndarray:
        """Length-weighted mean of the marginals for each of ``n`` documents."""
        p, _ = self.marginals(chains)
        weight = chains.lengths + 1e-6
        return np.bincount(chains.documents, weight * p, n) / np.bincount(chains.documents, weight, n)

    def score(self, texts: list[bytes]) -> np.ndarray:
        q = np.clip(self.quality(Chains.of(texts), len(texts)), 1e-6, 1 - 1e-6)
        return 1 / (1 + np.exp(-(self.slope * np.log(q / (1 - q)) + self.shift)))


def _trained(chains: Chains, good: np.ndarray, start: Field, steps: int, rate: float = 0.1, decay: float = 1e-3) -> Field:
    """Gradient ascent with moments on the likelihood of the line labels."""
    w, t = start.weights.copy(), start.links.copy()
    truth = np.zeros((2, 2))
    for a, b, c in zip(chains.begins[:-2], chains.begins[1:-1], chains.begins[2:]):
        before, now = good[a : a + c - b].astype(int), good[b:c].astype(int)
        truth += np.bincount(2 * before + now, minlength=4).reshape(2, 2)
    n = len(good)
    first = [np.zeros_like(w), np.zeros_like(t)]
    second = [np.zeros_like(w), np.zeros_like(t)]
    for step in range(1, steps + 1):
        p, pairs = Field(w, t, 1.0, 0.0).marginals(chains)
        for value, grad, m, v in zip((w, t), (chains.x.T @ (good - p) / n - decay * w, (truth - pairs) / n - decay * t), first, second):
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            value += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Field(w, t, 1.0, 0.0)


def _scaled(q: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve from quality to label, by Newton's method with a little decay."""
    q = np.clip(q, 1e-6, 1 - 1e-6)
    x = np.stack([np.log(q / (1 - q)), np.ones(len(q))], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (y - p)) - 1e-2 * w
        w += np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2), grad)
        if np.abs(grad).max() < 1e-6:
            break
    return float(max(w[0], 1e-3)), float(w[1])


def fit_texts(texts: list[bytes], y: np.ndarray, share_good: float) -> Field:
    if not (y == 1).any() or not (y == 0).any():
        return Field(np.zeros(3 * N_OWN), np.zeros((2, 2)), 0.0, math.log(max(share_good, 1e-6) / max(1 - share_good, 1e-6)))
    chains = Chains.of(texts)
    good = y[chains.documents].astype(float)
    field = _trained(chains, good, Field(np.zeros(3 * N_OWN), np.zeros((2, 2)), 1.0, 0.0), 80)
    p, _ = field.marginals(chains)
    worst = np.full(len(texts), 2.0)
    np.minimum.at(worst, chains.documents, p)
    good[(good == 0) & (p > 0.8) & (p > worst[chains.documents])] = 1.0
    field = _trained(chains, good, field, 60)
    weight = np.where(y == 1, share_good / (y == 1).mean(), (1 - share_good) / (y == 0).mean())
    field.slope, field.shift = _scaled(field.quality(chains, len(texts)), y, weight)
    return field


def fit(docs: DataFrame, labels: DataFrame, train: Column, per_class: int = SAMPLE) -> Field:
    """Trained on the driver, on at most ``2 * per_class`` documents."""
    rows = labelled_sample(docs, labels, "quality", per_class, train).collect()
    rows = sorted((bytes(r.raw), r.y) for r in rows if bytes(r.raw).count(b"\n") < SAMPLE_LINES)
    counts = {r.quality: r["count"] for r in labels.where(train).groupBy("quality").count().collect()}
    n0, n1 = counts.get(0, 0), counts.get(1, 0)
    return fit_texts([r[0] for r in rows], np.array([r[1] for r in rows], int), n1 / (n0 + n1) if n0 + n1 else 0.5)


def quality(docs: DataFrame, field: Field, held_out: Column) -> DataFrame:
    """One row for each document: doc_id, held_out, score, predicted."""
    shared = share(docs.sparkSession, field)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("raw").to_pylist()
            score = np.concatenate([np.zeros(0), *(shared.value.score(texts[a:b]) for a, b in slices(texts, 4 << 20))])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))],
                                             names=["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", held_out.alias("held_out"), raw("text").alias("raw")).mapInArrow(run, schema)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = load_documents(spark, sf_dir), crc_mod("doc_id", 5) == 0
    return quality(docs, fit(docs, load_table(spark, sf_dir, "labels"), ~held_out), held_out)
