"""Toxicity from a subsequence string kernel, Nyström landmarks and a linear support vector machine.

Two strings are alike by the subsequences of ``LENGTH`` characters that they
share; every character between or beside them costs a factor, so inserted
characters and gaps lessen the likeness but don't end it. Landmarks are words
that stand out in toxic training sentences, and some usual words. A segment
(a word, or a run of single characters) is mapped to its likeness to the
landmarks, made orthonormal by the landmarks' own kernel matrix; a support
vector machine with squared hinge loss is trained on these maps. Labels belong
to documents: words that stand out in the sentences of toxic ones, and altered
forms of them, are positive, words of other documents negative; then words of
clean documents that the machine takes for toxic join the negatives, as often
as they occur, and it is trained again.

A document's score is a logistic curve over the values of its three worst
segments and the share of its segments that look toxic: words of a language
that are put together from the same pieces come near an insult by chance, but
not often in a short text. None of the four can lower a score.

Defined results: a null text is empty; a text without words has the values of
the least toxic segment possible; rows are scored one by one, also with
repeated or null ids (a null id counts as the empty text in the split); an
empty table gives no rows; without training labels of both kinds every score
is the share of toxic ones, at most 0.5.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession

from lendscope.sources.tables import load_table

from .common import crc_mod, labelled_sample, load_documents, raw, share

LENGTH, DECAY, SHARPNESS = 3, 0.6, 3.0
#: Longer words are read through windows of so many characters, half of them shared.
WIDEST = 24
#: At most so many documents of either label are trained on.
SAMPLE = 2500
LANDMARKS, USUAL, NEGATIVES = 80, 16, 12_000
THRESHOLD = 0.7
#: A task remembers the values of so many segments.
REMEMBERED = 1_000_000
LOWEST = -1.5
#: The curve reads values between these; a segment counts as toxic from 0 to 1 between these.
READ, TOXIC = (0.2, 0.8), (0.3, 0.6)
#: A text has so many segments at least when its share is taken; the share is read in percent up to so much.
LEAST, DENSEST = 20, 5.0
#: A toxic document that is missed weighs so many times a clean one that is lost.
MISSED = 3.0
#: Weight of each altered form of a toxic word, against the word's own.
ALTERED = 0.15

_EDGES = " \t\n\r\v\f.,;:!?\"'()[]{}<>|#*$%&~_=+/\\-`^"
#: Not between single letters with a mark after each, nor beside a mark that stands alone.
_SENTENCE = re.compile(r"(?<=[.!?])(?<!(?<![^\W_])[^\W_][.!?])(?<![\x20\x09-\x0D][.!?])[\x20\x09-\x0D]+"
                       r"|(?<=[.!?])[\x20\x09-\x0D]+(?![^\W_](?![^\W_])|[^\w\x20\x09-\x0D]+[\x20\x09-\x0D])|\n")


def sentences(text: str) -> list[list[str]]:
    """Segments of each sentence: words without marks at their edges, also
    without those within, windows of very long ones, and runs of three or more
    single characters as one, with marks after or between them too."""
    out = []
    for sentence in _SENTENCE.split(text.lower()):
        segments: list[str] = []
        run: list[str] = []
        for word in sentence.split():
            w = word.strip(_EDGES)
            n = len(w)
            if n <= 1:  # a mark that stands alone doesn't end a run
                run += [w] if n else []
                continue
            if run:
                segments += windows("".join(run)) if len(run) > 2 else []
                run = []
            if 1 < n <= WIDEST:
                segments.append(w)
                if not w.isalnum() and len(bare := "".join(c for c in w if c.isalnum())) > 2:
                    segments.append(bare)
            elif n:
                segments += windows(w)
        if len(run) > 2:
            segments += windows("".join(run))
        out.append(segments)
    return out


def windows(s: str) -> list[str]:
    """The string, or windows of ``WIDEST`` characters that share a half."""
    return [s[i : i + WIDEST] for i in range(0, max(1, len(s) - WIDEST // 2), WIDEST // 2)]


def by_length(strings: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For strings of equal lengths together: their indexes, their character
    codes, the places of every subsequence of ``LENGTH`` characters, and the
    weight of each by its stretch. Chunks are bounded by their subsequences."""
    lengths = np.fromiter(map(len, strings), np.int64, len(strings))
    for n in np.unique(lengths[lengths >= LENGTH]).tolist():
        at = np.array(list(combinations(range(n), LENGTH)))
        weight = DECAY ** (at[:, -1] - at[:, 0] + 1.0)
        some = np.flatnonzero(lengths == n)
        step = max(1, min(1024, 300_000 // len(at)))
        for i in range(0, len(some), step):
            part = some[i : i + step]
            codes = np.frombuffer("".join(strings[k] for k in part).encode("utf-32-le"), np.uint32).reshape(len(part), n)
            yield part, codes, at, weight


def own_kernel(codes: np.ndarray) -> np.ndarray:
    """Kernel of each string with itself, by the recursion over pairs of
    places: what ends at (i, j) extends all that ended before both."""
    size, n = codes.shape
    match = codes.T[:, None, :] == codes.T[None, :, :]
    ends = match * DECAY**2
    for _ in range(LENGTH - 1):
        sums = np.zeros((n + 1, n + 1, size))  # weighted sums of all ends before (i, j)
        new = np.zeros_like(ends)
        for i in range(n):
            for j in range(n):
                new[i, j] = sums[i, j] * match[i, j] * DECAY**2
                sums[i + 1, j + 1] = ends[i, j] + DECAY * (sums[i, j + 1] + sums[i + 1, j]) - DECAY**2 * sums[i, j]
        ends = new
    return ends.sum((0, 1))


@dataclass
class Landmarks:
    """Subsequences of the landmarks: letters has a small number for each
    character (0: in no landmark), places the row of each triple of them."""

    strings: list[str]
    letters: np.ndarray
    places: np.ndarray
    rows: np.ndarray

    @classmethod
    def of(cls, strings: list[str]) -> Landmarks:
        alphabet = sorted({c for s in strings for c in s})
        letters = np.zeros(0x110000, np.uint16)
        letters[[ord(c) for c in alphabet]] = np.arange(1, len(alphabet) + 1)
        k = len(alphabet) + 1
        places, rows = np.zeros(k**LENGTH, np.int32), [np.zeros(len(strings), np.float32)]
        for part, codes, at, weight in by_length(strings):
            own = np.sqrt(own_kernel(codes))
            for i, s in enumerate(part.tolist()):
                small = letters[codes[i]][at].astype(np.int64)
                for place, w in zip(((small[:, 0] * k + small[:, 1]) * k + small[:, 2]).tolist(), weight):
                    if not places[place]:
                        places[place] = len(rows)
                        rows.append(np.zeros(len(strings), np.float32))
                    rows[places[place]][s] += w / own[i]
        return cls(strings, letters, places, np.array(rows))

    def likeness(self, strings: list[str]) -> np.ndarray:
        """Kernel of strings with landmarks, every string being like itself by
        1, then sharpened: exp(-SHARPNESS * (1 - kernel))."""
        out = np.zeros((len(strings), len(self.strings)), np.float32)
        k = round(len(self.places) ** (1 / LENGTH))
        for part, codes, at, weight in by_length(strings):
            small = self.letters[codes].astype(np.int32)
            place = self.places[(small[:, at[:, 0]] * k + small[:, at[:, 1]]) * k + small[:, at[:, 2]]]
            some = np.flatnonzero(place.any(axis=1))
            if not len(some):
                continue
            columns = np.ascontiguousarray(place[some].T)
            sums, part_sums, row = (np.zeros((len(some), len(self.strings)), np.float32) for _ in range(3))
            for w in np.unique(weight):  # subsequences of one stretch are added up, then weighed together
                part_sums[:] = 0
                for i in np.flatnonzero(weight == w):
                    np.take(self.rows, columns[i], axis=0, out=row, mode="clip")
                    part_sums += row
                sums += np.float32(w) * part_sums
            out[part[some]] = sums / np.sqrt(own_kernel(codes[some]))[:, None]
        return np.exp(-SHARPNESS * (1 - out))


@dataclass
class Model:
    """alpha: the machine's weights carried back to the landmarks."""

    landmarks: Landmarks | None
    alpha: np.ndarray
    bias: float
    curve: np.ndarray

    def values(self, segments: list[str]) -> np.ndarray:
        if not segments or self.landmarks is None:
            return np.full(len(segments), LOWEST)
        return np.clip(self.landmarks.likeness(segments) @ self.alpha + self.bias, LOWEST, -LOWEST)

    def evidence(self, texts: list[str], known: dict[str, float]) -> np.ndarray:
        """The values of the three worst segments of each text, worst first, as
        far as the curve reads them, and its percentage of toxic segments."""
        made = [[w for segments in sentences(t) for w in segments] for t in texts]
        new = sorted({w for segments in made for w in segments} - known.keys())
        known.update(zip(new, self.values(new).tolist()))
        out = np.full((len(texts), 4), LOWEST)
        for i, segments in enumerate(made):
            value = np.fromiter(map(known.__getitem__, segments), float, len(segments))
            top = np.sort(value)[:-4:-1] if len(value) < 4 else np.sort(np.partition(value, -3)[-3:])[::-1]
            out[i, : len(top)] = top
            toxic = np.clip((value - TOXIC[0]) / (TOXIC[1] - TOXIC[0]), 0, 1).sum()
            out[i, 3] = min(100 * toxic / max(len(value), LEAST), DENSEST)
        out[:, :3] = np.clip(out[:, :3], *READ)
        if len(known) > REMEMBERED:
            known.clear()
        return out

    def score(self, texts: list[str], known: dict[str, float]) -> np.ndarray:
        found = self.evidence(texts, known) if texts else np.zeros((0, 4))
        return 1 / (1 + np.exp(-np.clip(found @ self.curve[:-1] + self.curve[-1], -30, 30)))


def altered(word: str, rng: random.Random) -> list[str]:
    """Ways to write a word that keep its characters in order."""
    i = rng.randrange(1, len(word))
    return [word[:i] + rng.choice(".-*_x1'") + word[i:], word[:i] + word[i - 1] + word[i:], rng.choice(".-* _").join(word)]


def _machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, decay: float = 1e-4, steps: int = 400) -> tuple[np.ndarray, float]:
    """Linear support vector machine with squared hinge loss, by accelerated gradient steps."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    weight = weight / weight.sum()
    rate = 1 / (2 * np.linalg.norm((x * weight[:, None]).T @ x, 2) + decay)
    w = v = np.zeros(x.shape[1])
    for k in range(steps):
        gap = np.maximum(0, 1 - y * (x @ v))
        new = v + rate * (2 * x.T @ (weight * gap * y) - decay * np.append(v[:-1], 0))
        v = new + k / (k + 3) * (new - w)
        w = new
    return w[:-1], float(w[-1])


def _curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 6000, rate: float = 0.5, decay: float = 1e-4) -> np.ndarray:
    """Logistic regression on the evidence, never falling in any of it, by accelerated gradient steps."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = v = np.zeros(x.shape[1])
    weight = weight / weight.mean()
    for k in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -30, 30)))
        new = v + rate * (x.T @ (weight * (y - p)) / len(y) - decay * np.append(v[:-1], 0))
        new[:-1] = np.maximum(new[:-1], 0)
        v = new + k / (k + 3) * (new - w)
        w = new
    return w


def fit_texts(texts: list[str], y: np.ndarray, share_toxic: float, seed: int = 42) -> Model:
    none = Model(None, np.zeros(0), LOWEST, np.array([0, 0, 0, 0, math.log(max(share_toxic, 1e-6) / max(1 - share_toxic, 0.5))]))
    if not (y == 1).any() or not (y == 0).any():
        return none
    rng = random.Random(seed)
    toxic, clean = Counter(), Counter()
    for t, label in zip(texts, y):
        (toxic if label else clean).update({w for s in sentences(t) for w in s if len(w) >= LENGTH})
    n1, n0 = int((y == 1).sum()), int((y == 0).sum())
    lift = {w: (c / n1) / ((clean[w] + 1) / n0) for w, c in toxic.items() if c >= max(3, 0.003 * n1)}
    stand_out = sorted((w for w in lift if lift[w] >= 4), key=lambda w: (-lift[w] * math.sqrt(toxic[w]), w))
    if not stand_out:
        return none
    usual = [w for w, _ in sorted(clean.items(), key=lambda x: (-x[1], x[0]))[: 4 * USUAL : 4]]
    chosen = stand_out[:LANDMARKS] + [w for w in usual if w not in stand_out]
    landmarks = Landmarks.of(chosen)
    values, vectors = np.linalg.eigh(landmarks.likeness(chosen).astype(float))
    keep = values > 1e-4
    root = vectors[:, keep] / np.sqrt(values[keep])
    others = sorted(set(clean) - set(stand_out))
    others = sorted(rng.sample(others, min(NEGATIVES, len(others))))
    hard: Counter = Counter()
    more = [(v, w) for w in stand_out if len(w) > LENGTH for v in altered(w, rng)]
    some = [*stand_out, *(v for v, _ in more), *others]
    label = np.array([1.0] * (len(stand_out) + len(more)) + [-1.0] * len(others))
    weight = np.array([float(toxic[w]) for w in stand_out] + [ALTERED * toxic[w] for _, w in more] + [1.0] * len(others))
    weight[label < 0] *= weight[label > 0].sum() / weight[label < 0].sum()
    for turn in range(2):
        # Words of clean documents that the machine takes for toxic weigh as often as they occur, for their share of the documents.
        words = sorted(hard)
        w, bias = _machine(landmarks.likeness(some + words) @ root, np.append(label, -np.ones(len(words))),
                           np.append(weight, [hard[x] * n1 / n0 for x in words]))
        model = Model(landmarks, root @ w, bias, none.curve)
        if turn == 0:
            all_clean = sorted(x for x in clean if len(x) >= LENGTH)
            hard = Counter({x: clean[x] for x, v in zip(all_clean, model.values(all_clean)) if v > 0})
    found = np.concatenate([model.evidence(texts[i : i + 500], {}) for i in range(0, len(texts), 500)])
    weights = np.where(y == 1, MISSED * share_toxic / (y == 1).mean(), (1 - share_toxic) / (y == 0).mean())
    model.curve = _curve(found, y, weights)
    return model


def fit(docs: DataFrame, labels: DataFrame, train: Column, per_class: int = SAMPLE) -> Model:
    """Trained on the driver, on at most ``2 * per_class`` documents."""
    rows = labelled_sample(docs, labels, "toxic", per_class, train).collect()
    rows = sorted((bytes(r.raw).decode("utf-8", "replace"), r.y) for r in rows)
    counts = {r.toxic: r["count"] for r in labels.where(train).groupBy("toxic").count().collect()}
    n0, n1 = counts.get(0, 0), counts.get(1, 0)
    return fit_texts([r[0] for r in rows], np.array([r[1] for r in rows], int), n1 / (n0 + n1) if n0 + n1 else 0.5)


def toxicity(docs: DataFrame, model: Model, held_out: Column) -> DataFrame:
    """One row for each document: doc_id, held_out, score, predicted."""
    shared = share(docs.sparkSession, model)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for batch in batches:
            texts = [b.decode("utf-8", "replace") for b in batch.column("raw").to_pylist()]
            score = np.concatenate([np.zeros(0), *(shared.value.score(texts[a : a + 1000], known) for a in range(0, len(texts), 1000))])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))],
                                             names=["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", held_out.alias("held_out"), raw("text").alias("raw")).mapInArrow(run, schema)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = load_documents(spark, sf_dir), crc_mod("doc_id", 3) == 1
    return toxicity(docs, fit(docs, load_table(spark, sf_dir, "labels"), ~held_out), held_out)
