"""Benchmark decontamination with SimHash windows and multi-index Hamming blocks.

Windows of about an item's size slide over every whole text; a SimHash of
their word shingles is compared with those of the items' windows. The 64 bits
fall into four blocks; two fingerprints within ``radius`` bits differ by at
most ``radius // 4`` bits in at least one block, so an index of every block
value within that distance finds all of them. What it finds is then verified:
the weighted (multiset) Jaccard similarity of the shingles of the whole item
and of as many words at the place found must reach ``similarity``.

An item of n words has windows of one size from a ladder, 48 to 62 % of n, at
each of its positions, and a document has windows of that size at each of its
own. So every part of a copied, changed or shortened item is compared, whatever
stands around it, in the document or beside it in the batch.

Words that reach the similarity to an item have few shingles that are not the
item's: of I shingles of the item at most I (1 - similarity) / (1 + similarity).
A window with more shingles than that which stand in no item can't be part of
any match, so no fingerprint is made of it; the matches are those of all windows.

Defined results: null and empty texts match nothing, nor do items without
words; an item of fewer than five words is one shingle of all its words; a
text shorter than an item can only match by similarity of the words it has;
repeated rows and ids are judged row by row; equal items all match; an empty
table gives no rows, and without items nothing matches.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lendscope.sources.tables import load_table

from .common import free_name, load_documents, raw, share, slices, stored

SHINGLE = 5
SIMILARITY = 0.8
#: Of copies with a word changed, added or lost in the middle, still at 0.8, so many bits find 97 % (7 bits: 82 %).
RADIUS = 11
#: An index for one pass over the documents has at most so many words of items.
BLOCK_WORDS = 100_000
_LADDER_STEP, _LARGEST = 1.28, 0.62


def window_size(n: int) -> int:
    """The largest step of the ladder up to 62 % of ``n`` words; short items whole."""
    if n <= SHINGLE + 1:
        return n
    size = SHINGLE
    while (more := max(size + 1, int(size * _LADDER_STEP))) <= _LARGEST * n:
        size = more
    return size


def window_starts(begins: np.ndarray, size: int) -> np.ndarray:
    """Where windows of one size begin: at every word of each text that still has ``size`` words from there on."""
    windows = np.maximum(np.diff(begins) - size + 1, 0)
    return np.arange(int(windows.sum())) + np.repeat(begins[:-1] - np.cumsum(windows) + windows, windows)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all texts, and where each text's begin."""
    words = [t.lower().split() for t in texts]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    of = xxhash.xxh3_64_intdigest
    h = np.fromiter(map(of, chain.from_iterable(words)), np.uint64, int(counts.sum()))
    return h, np.concatenate(([0], np.cumsum(counts)))


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """One hash for each run of ``width`` words; runs over a text's end are made too."""
    n = max(len(words) - width + 1, 0)
    h = np.zeros(n, np.uint64)
    for i in range(width):
        h = (h * np.uint64(0x9E3779B97F4A7C15)) ^ words[i : n + i]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def lane_of(size: int) -> type:
    """The smallest unsigned type that counts up to ``size``."""
    return np.uint8 if size < 1 << 8 else np.uint16 if size < 1 << 16 else np.uint32


def bit_sums(shingles: np.ndarray, lane: type = np.uint32) -> np.ndarray:
    """Running sums of the 64 bits before each shingle, several counters of type
    ``lane`` to a 64-bit number. Sums may run over into the next counter; the
    difference of two sums that are less than a counter's range apart is exact."""
    bits = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(lane).view(np.uint64)
    parts = shingles.view(np.uint8).reshape(-1, 8)
    out = np.zeros((8 * bits.shape[1], len(shingles) + 1), np.uint64)
    for i in range(8):
        column = parts[:, i]
        for j in range(bits.shape[1]):
            np.cumsum(bits[:, j][column], out=out[i * bits.shape[1] + j, 1:])
    return out


def simhashes(sums: np.ndarray, starts: np.ndarray, count: int, lane: type = np.uint32) -> np.ndarray:
    """Fingerprints of ``count`` shingles from each start."""
    lanes = np.ascontiguousarray((sums[:, starts + count] - sums[:, starts]).T).view(lane)
    return np.packbits(lanes > count // 2, axis=1, bitorder="little").view(np.uint64).ravel()


@dataclass
class SizeIndex:
    """Fingerprints of one window size, with the item and offset each comes from,
    and for each of the four blocks the fingerprints near every block value."""

    prints: np.ndarray
    item: np.ndarray
    offset: np.ndarray
    radius: int
    spare: int | None = None  # a window with more shingles of no item is part of no match (None: any may be)
    begins: list[np.ndarray] = field(default_factory=list)
    near: list[np.ndarray] = field(default_factory=list)

    def build(self) -> SizeIndex:
        flips = np.array([sum(1 << b for b in bits) for n in range(self.radius // 4 + 1) for bits in combinations(range(16), n)], np.int64)
        for k in range(4):
            own = ((self.prints >> np.uint64(16 * k)) & np.uint64(0xFFFF)).astype(np.int64)
            values = (own[:, None] ^ flips[None, :]).ravel()
            order = np.argsort(values, kind="stable")
            self.near.append(np.repeat(np.arange(len(own), dtype=np.int32), len(flips))[order])
            self.begins.append(np.searchsorted(values[order], np.arange((1 << 16) + 1)))
        return self

    def find(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index in ``prints``, index in ``self.prints``) within the radius."""
        at, of = [], []
        for k in range(4):
            value = ((prints >> np.uint64(16 * k)) & np.uint64(0xFFFF)).astype(np.int64)
            low = self.begins[k][value]
            count = self.begins[k][value + 1] - low
            i = np.repeat(np.arange(len(prints)), count)
            j = self.near[k][np.repeat(low - np.cumsum(count) + count, count) + np.arange(len(i))]
            close = np.bitwise_count(prints[i] ^ self.prints[j]) <= self.radius
            at.append(i[close])
            of.append(j[close])
        return np.concatenate(at), np.concatenate(of)


@dataclass
class ItemIndex:
    """What one pass needs of the items: words' shingles and fingerprints by size."""

    lengths: list[int]
    shingles: list[Counter]
    ids: list[int]
    sizes: dict[int, SizeIndex]
    similarity: float
    known: dict[int, np.ndarray]  # by the width: the items' shingles in order, and one more that ends them

    def foreign(self, hashes: np.ndarray, width: int) -> np.ndarray:
        """How many shingles before each, and before the end, are of no item."""
        known = self.known[width]
        return np.concatenate(([0], np.cumsum(known[np.searchsorted(known[:-1], hashes)] != hashes)))


def build_index(ids: list[int], texts: list[bytes], similarity: float = SIMILARITY, radius: int = RADIUS) -> ItemIndex:
    lengths, shingles, found, longest = [], [], defaultdict(list), defaultdict(int)
    known: dict[int, set[int]] = defaultdict(set)
    for i, text in enumerate(texts):
        words, _ = word_hashes([text])
        n = len(words)
        lengths.append(n)
        width = min(SHINGLE, n)
        hashes = shingle_hashes(words, width) if n else np.zeros(0, np.uint64)
        shingles.append(Counter(hashes.tolist()))
        if n:
            size = window_size(n)
            known[width].update(shingles[-1])
            longest[size] = max(longest[size], len(hashes))
            starts = np.arange(n - size + 1)
            found[size].append((simhashes(bit_sums(hashes), starts, size - width + 1), np.full(len(starts), i), starts))
    # Two sets of a and b <= a shingles with s shared reach the similarity t if s >= t (a + b) / (1 + t), so b - s <= a (1 - t) / (1 + t).
    spare = {size: int(n * (1 - similarity) / (1 + similarity) + 1e-6) for size, n in longest.items()}
    sizes = {size: SizeIndex(*(np.concatenate(v) for v in zip(*parts)), radius, spare[size]) for size, parts in found.items()}
    ends = {width: np.array([*sorted(some), max(some)], np.uint64) for width, some in known.items()}
    return ItemIndex(lengths, shingles, list(ids), sizes, similarity, ends)


def weighted_similarity(a: Counter, b: Counter) -> float:
    """Shared weight over joint weight of two multisets."""
    shared = sum((a & b).values())
    return shared / max(sum(a.values()) + sum(b.values()) - shared, 1)


def search(texts: list[bytes], index: ItemIndex, segment: int = 1 << 16) -> list[dict[int, float]]:
    """For each text the items that it contains, with their best similarity.

    Windows that can be part of a match are compared. Sums of bits are made for
    ``segment`` of their shingles at a time, with those that the last windows
    reach into, so that memory for them doesn't grow with a text.
    """
    out: list[dict[int, float]] = [{} for _ in texts]
    reach = max(index.sizes, default=0)
    lane = lane_of(reach)
    for a, b in slices(texts):
        words, begins = word_hashes(texts[a:b])
        owner = np.repeat(np.arange(b - a), np.diff(begins))
        hashes = {w: shingle_hashes(words, w) for w in index.known}
        places: set[tuple[int, int, int]] = set()
        for width, h in hashes.items():
            begin_of, covered, foreign = {}, np.zeros(len(h) + 1, np.int32), index.foreign(h, width)
            for size, one in index.sizes.items():
                if min(SHINGLE, size) != width:
                    continue
                starts, count = window_starts(begins, size), size - width + 1
                if one.spare is not None:
                    starts = starts[foreign[starts + count] - foreign[starts] <= one.spare]
                begin_of[size] = starts
                covered[starts] += 1
                covered[starts + count] -= 1
            kept = np.flatnonzero(np.cumsum(covered[:-1]) > 0)  # shingles of the windows that are compared; those of one window stand side by side
            place_of = {size: np.searchsorted(kept, starts) for size, starts in begin_of.items()}
            for low in range(0, len(kept), segment):
                sums = bit_sums(h[kept[low : low + segment + reach]], lane)
                for size, place in place_of.items():
                    one, some = index.sizes[size], slice(*np.searchsorted(place, (low, low + segment)))
                    starts = begin_of[size][some]
                    at, of = one.find(simhashes(sums, place[some] - low, size - width + 1, lane))
                    places.update(zip(owner[starts[at]].tolist(), one.item[of].tolist(), (starts[at] - one.offset[of]).tolist()))
        for doc, item, start in places:
            n = index.lengths[item]
            width = min(SHINGLE, n)
            low = max(start, int(begins[doc]))
            high = min(start + n, int(begins[doc + 1])) - width + 1
            value = weighted_similarity(Counter(hashes[width][low:high].tolist()), index.shingles[item]) if high > low else 0.0
            if value >= index.similarity:
                found = out[a + doc]
                found[index.ids[item]] = max(value, found.get(index.ids[item], 0.0))
    return out


def item_blocks(benchmark: DataFrame, limit: int) -> Iterator[tuple[list[int], list[bytes]]]:
    """The items in blocks of about ``limit`` words; one block is on the driver at a time."""
    ids, texts, size = [], [], 0
    items = benchmark.where("item_id is not null").select("item_id", raw("text").alias("raw")).orderBy("item_id", "raw")
    for row in items.toLocalIterator():
        ids.append(row.item_id)
        texts.append(bytes(row.raw))
        size += len(texts[-1].split())
        if size >= limit:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def with_matches(docs: DataFrame, benchmark: DataFrame, keep: list[str], name: str, similarity: float = SIMILARITY,
                 radius: int = RADIUS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The columns ``keep`` and ``name``: an array of (item_id, similarity), by item.

    The items are a stated query set. A block of them, its size bounded by
    ``block_words``, is broadcast and held by a worker in one pass over the
    documents; as a rule there is one. Of further blocks, each with a pass of
    its own over the stored documents, only the matches are kept and put together.
    """
    spark, text = docs.sparkSession, free_name([*docs.columns, name], "raw")
    first, found, uid = True, None, free_name([*docs.columns, name, text], "uid")
    rows = docs.select(*keep, raw("text").alias(text))
    blocks = item_blocks(benchmark, block_words)
    block, following = next(blocks, ([], [])), next(blocks, None)
    if following is None:
        return _matched(rows, share(spark, build_index(*block, similarity, radius)), keep, name)
    rows = stored(rows.withColumn(uid, F.monotonically_increasing_id()), "leak-docs")
    while block is not None:
        shared = share(spark, build_index(*block, similarity, radius))
        some = _matched(rows.select(uid, text), shared, [uid], name).where(F.size(name) > 0)
        found = stored(some if first else found.unionByName(some), "leak-found")
        shared.unpersist()
        first, block, following = False, following, next(blocks, None)
    entries = found.select(uid, F.explode(name).alias("e")).groupBy(uid, "e.item_id").agg(F.max("e.similarity").alias("similarity"))
    entries = entries.groupBy(uid).agg(F.array_sort(F.collect_list(F.struct("item_id", "similarity"))).alias(name))
    none = F.array().cast(entries.schema[name].dataType)
    return rows.drop(text).join(entries, uid, "left").select(*keep, F.coalesce(name, none).alias(name))


def _matched(rows: DataFrame, shared: Broadcast, keep: list[str], name: str) -> DataFrame:
    """``rows`` (the columns ``keep``, then the raw text) with the matches of one block of items in place of the text."""
    kind = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("similarity", T.DoubleType())]))
    schema = T.StructType([*(rows.schema[c] for c in keep), T.StructField(name, kind)])
    arrow = pa.list_(pa.struct([("item_id", pa.int64()), ("similarity", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = None
        for batch in batches:
            if index is None:
                index = shared.value
                for one in index.sizes.values():
                    if not one.begins:
                        one.build()
            found = search(batch.column(len(keep)).to_pylist(), index)
            column = pa.array([[{"item_id": i, "similarity": v} for i, v in sorted(f.items())] for f in found], arrow)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], column], names=[*keep, name])

    return rows.mapInArrow(run, schema)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document: doc_id, contaminated, n_items, items, similarity (of the best, or null)."""
    found = with_matches(docs, benchmark, ["doc_id"], "found")
    return found.select(
        "doc_id", (F.size("found") > 0).alias("contaminated"), F.size("found").cast("long").alias("n_items"),
        F.col("found.item_id").alias("items"), F.array_max("found.similarity").alias("similarity"))


def without_benchmark(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that contain no item."""
    name = free_name(docs.columns, "found")
    return with_matches(docs, benchmark, docs.columns, name).where(F.size(name) == 0).select(*docs.columns)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(load_documents(spark, sf_dir), load_table(spark, sf_dir, "benchmark"))
