"""Language-model scoring from a log-frequency Bloom filter.

Words and pairs of words of the training documents are counted over the whole
corpus: every task counts what it reads, sorts by hash and deals the counts by
the first bits of the hash, so a word of a third of all rows costs each task
one entry. Each part of the hash range then becomes one segment of a Bloom
filter that holds a count's logarithm: an n-gram with level L is inserted L
times, as (hash, 1) to (hash, L). Segments are broadcast together; a count is
read by probing level after level until a probe fails. A level stands for the
mean of the counts that have it. Pair counts are smoothed with the word's
probability (Dirichlet prior).

The probabilities of all words after a context add up to one, nearly. Of the V
words after a context a share of f(L) reads a level L that is not there; how
often is known from the bits that are set. A context seen c times has r(L) c
pairs of that level, r(L) being the corpus's own share. So a pair that reads L
is believed with r(L) c / (r(L) c + f(L) V), and the believed counts after a
context add up to c, whether true or false ones prevail.

The filter grows with the corpus: every n-gram seen once has a level at every
size. Where the corpus has so few bytes that the filter can't exceed
``FILTER_MB`` it is broadcast. Elsewhere texts are put together in bundles; a
bundle sends its distinct n-grams, with their counts, to their parts once. The
task of a part makes the segment, reads from it the level of each n-gram that
was sent, and levels go back to the bundles. Both ways read the same bits and,
with as many parts, give the same scores.

The base score uses exact counts: the most frequent words are broadcast (at
most ``HEAD`` of them), all others are joined. Frequent contexts have the
exact count, too, so that a level's error doesn't fall on all that follows.

Words are known by 64-bit hashes. Defined results: a null text is empty and
has one token, the end; rows are scored one by one, also with repeated or null
ids (a null id counts as the empty text in the split); an empty table gives no
rows; without training documents N, V and all counts are 0. A score is the sum
of the logarithms of such probabilities; that of a text that starts after
nothing known is the sum over its words alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, load_documents, raw, share, slices, small_batches, stored

#: A filter up to so large is broadcast. A count's first level has so many bits
#: set, each further level so many; a segment is filled to one half.
FILTER_MB, FIRST, FURTHER = 256, 16, 4
#: Texts of about so many bytes ask a larger filter together, and a part has n-grams of so many such bundles at most.
ASK_BYTES, BUNDLES = 8 << 20, 4
#: So many n-grams are looked up at once.
LOOKUP = 1 << 17
#: At most so many words have their exact counts broadcast.
HEAD = 500_000
#: Weight of the word's probability in a pair's.
PRIOR = 200.0
#: Growth of counts from one level to the next, for words and for pairs.
BASES = {1: 2.0 ** 0.25, 2: 2.0 ** (1 / 3)}
#: No count has more levels.
LEVELS = 256
#: A task deals its counts out after so many tokens.
TOKENS = 1_000_000
_U = np.uint64
END = xxhash.xxh3_64_intdigest(b"")  # words are never empty


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens (each text's words, then the end), and each text's number of them."""
    words = [t.lower().split() for t in texts]
    counts = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
    flat = chain.from_iterable(chain(w, (b"",)) for w in words)
    return np.fromiter(map(xxhash.xxh3_64_intdigest, flat), _U, int(counts.sum())), counts


def pairs(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One hash for each token with the one before; the end stands before a text."""
    before = np.empty_like(h)
    before[1:] = h[:-1]
    if len(h):
        before[0] = _U(END)  # elsewhere the previous text's end already stands there
    return mixed((before * _U(0x9E3779B97F4A7C15)) ^ h)


def counted(h: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes in order, with their counts."""
    if weights is None:
        h = np.sort(h)
    else:
        order = np.argsort(h, kind="stable")
        h, weights = h[order], weights[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(len(h), 1), bool), h[1:] != h[:-1])))
    if weights is None:
        return h[first], np.diff(np.append(first, len(h)))
    return h[first], np.add.reduceat(weights, first) if len(h) else weights


def levels(counts: np.ndarray, base: float) -> np.ndarray:
    """1 for one, then one more for each factor ``base``."""
    return np.floor(np.log(counts) / math.log(base) + 1e-9).astype(np.int64) + 1


def probes(level: int) -> int:
    return FIRST if level == 1 else FURTHER


def positions(h: np.ndarray, level: int, bits: np.ndarray | int) -> Iterator[np.ndarray]:
    """Bit positions of (hash, level) in segments of ``bits`` bits, probe by probe."""
    x = mixed(h + _U(0x632BE59BD9B4E019 * level % (1 << 64)))
    at, by, low = x & _U(0xFFFFFFFF), (x >> _U(32)) | _U(1), _U(0xFFFFFFFF)
    for _ in range(probes(level)):
        yield (at * np.asarray(bits).astype(_U)) >> _U(32)
        at = (at + by) & low


def segment(h: np.ndarray, counts: np.ndarray, base: float) -> tuple[bytes, int]:
    """Filter of one part: its bytes and number of bits."""
    level = levels(counts, base)
    bits = max(4096, int((FIRST * len(level) + FURTHER * int((level - 1).sum())) / math.log(2)))
    out = np.zeros(8 * (bits // 8 + 1), bool)
    for at in range(1, int(level.max(initial=0)) + 1):
        for p in positions(h[level >= at], at, bits):
            out[p.view(np.int64)] = True
    return np.packbits(out, bitorder="little").tobytes(), bits


def probed(data: np.ndarray, h: np.ndarray, begin: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Levels: they are probed upwards until one is missing. What a probe has
    failed is dropped once it is a third of the rest."""
    level = np.zeros(len(h), np.int64)
    live, begin, bits, low = np.arange(len(h)), begin.astype(_U) << _U(3), bits.astype(_U), _U(0xFFFFFFFF)
    for at in range(1, LEVELS):
        if not len(live):
            break
        x = mixed(h + _U(0x632BE59BD9B4E019 * at % (1 << 64)))
        place, by, there = x & low, (x >> _U(32)) | _U(1), np.ones(len(x), bool)
        for _ in range(probes(at)):
            p = begin + ((place * bits) >> _U(32))
            there &= (data[(p >> _U(3)).view(np.int64)] >> (p & _U(7)).astype(np.uint8)) & 1 == 1
            if 3 * np.count_nonzero(there) < 2 * len(there):
                live, h, begin, bits, place, by = (v[there] for v in (live, h, begin, bits, place, by))
                there = np.ones(len(live), bool)
            place = (place + by) & low
        if not there.all():
            live, h, begin, bits = (v[there] for v in (live, h, begin, bits))
        level[live] = at
    return level


@dataclass
class Filter:
    """Segments of one order, one for each value of the hash's first bits."""

    data: np.ndarray
    begins: np.ndarray
    bits: np.ndarray
    shift: int

    def levels(self, h: np.ndarray) -> np.ndarray:
        part = (h >> _U(self.shift)).astype(np.int64)
        return probed(self.data, h, self.begins[part], self.bits[part])


def part_edges(parts: int) -> np.ndarray:
    """The first hash of every part but the first."""
    shift = 64 - (parts.bit_length() - 1)
    return (np.arange(1, parts, dtype=np.uint64) << _U(shift)) if parts > 1 else np.zeros(0, _U)


def dealt_counts(train: DataFrame, parts: int) -> DataFrame:
    """(n, part, hashes, counts): counts of words and pairs, as each task found them."""
    edges = part_edges(parts)

    def out(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for n, arrays in zip((1, 2), held):
            h, c = counted(np.concatenate(arrays))
            cut = np.concatenate(([0], np.searchsorted(h, edges), [len(h)]))
            some = np.flatnonzero(np.diff(cut))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(some), n, np.int32)), pa.array(some.astype(np.int32)),
                pa.array([h[cut[i] : cut[i + 1]].tobytes() for i in some], pa.binary()),
                pa.array([c[cut[i] : cut[i + 1]].astype(np.uint32).tobytes() for i in some], pa.binary())], names=["n", "part", "hashes", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], []]
        size = 0
        for batch in batches:
            texts = batch.column("raw").to_pylist()
            for a, b in slices(texts):
                h, counts = tokens(texts[a:b])
                held[0].append(h)
                held[1].append(pairs(h, counts))
                size += len(h)
                if size >= TOKENS:
                    yield from out(held)
                    held, size = [[], []], 0
        if size:
            yield from out(held)

    return train.select(raw("text").alias("raw")).mapInArrow(run, "n int, part int, hashes binary, counts binary")


MERGED = ("n int, part int, filter binary, bits long, ones long, hashes binary, counts binary, tokens long, types long, histogram array<long>, "
          "of_level array<long>, level_sum array<long>")
_MERGED_KINDS = [pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), *(pa.list_(pa.int64()) for _ in range(3))]


def names_of(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


def merged_row(n: int, part: int, h: np.ndarray, c: np.ndarray) -> list:
    """The row of an order and part (``MERGED``), from its n-grams and their counts."""
    data, bits = segment(h, c, BASES[n])
    ones = int(np.bitwise_count(np.frombuffer(data, np.uint8)).sum(dtype=np.int64))
    logs = np.bincount(np.log2(c).astype(np.int64), minlength=64) if n == 1 else np.zeros(64, np.int64)
    level = levels(c, BASES[n])
    of, sums = np.bincount(level, minlength=LEVELS), np.bincount(level, c, minlength=LEVELS).astype(np.int64)
    return [n, part, data, bits, ones, h.tobytes() if n == 1 else b"", c.tobytes() if n == 1 else b"", int(c.sum()), len(c), logs.tolist(), of.tolist(), sums.tolist()]


def merged_counts(dealt: DataFrame) -> DataFrame:
    """One row for each order and part: its filter segment and, of words, all
    hashes with exact counts (``histogram``: words by the binary logarithm;
    ``ones``: bits that are set; ``of_level`` and ``level_sum``: n-grams of each
    level, and their counts in all)."""
    def done(n: int, part: int, hashes: list[bytes], counts: list[bytes]) -> pa.RecordBatch:
        h, c = counted(np.frombuffer(b"".join(hashes), _U), np.frombuffer(b"".join(counts), np.uint32).astype(np.int64))
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(merged_row(n, part, h, c), _MERGED_KINDS)], names=names_of(MERGED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, hashes, counts = None, [], []
        for batch in batches:
            for n, part, h, c in zip(*(col.to_pylist() for col in batch.columns)):
                if key is not None and key != (n, part):
                    yield done(*key, hashes, counts)
                    hashes, counts = [], []
                key = (n, part)
                hashes.append(h)
                counts.append(c)
        if key is not None:
            yield done(*key, hashes, counts)

    return dealt.repartition("n", "part").sortWithinPartitions("n", "part").mapInArrow(run, MERGED)


def bundled(docs: DataFrame) -> DataFrame:
    """(bundle, data): the rows of ``docs`` (doc_id, held_out, raw) in packed
    bundles of about ``ASK_BYTES`` of text, stored; a longer text is alone."""
    def packed(pieces: list[pa.RecordBatch]) -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, pieces[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            for piece in pieces:
                out.write_batch(piece)
        return pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, size = [], 0
        for batch in batches:
            texts = batch.column("raw").to_pylist()
            for a, b in slices(texts):
                more = sum(map(len, texts[a:b]))
                if pieces and size + more > ASK_BYTES:
                    yield packed(pieces)
                    pieces, size = [], 0
                pieces.append(batch.slice(a, b - a))
                size += more
        if pieces:
            yield packed(pieces)

    return stored(docs.mapInArrow(run, "data binary").withColumn("bundle", F.monotonically_increasing_id()), "lm-bundles").select("bundle", "data")


def unbundled(data: bytes) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """The rows of a bundle, the hashes of its tokens and each text's number of them."""
    table = pa.ipc.open_stream(data).read_all().combine_chunks()
    texts = table["raw"].to_pylist()
    h, counts = zip(*(tokens(texts[a:b]) for a, b in slices(texts)))
    return table, np.concatenate(h), np.concatenate(counts)


def distinct_counts(h: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All distinct hashes in order, and how often each is where ``some`` holds."""
    one, c = counted(h[some])
    others = counted(h[~some])[0]
    if len(one):
        others = others[one[np.minimum(np.searchsorted(one, others), len(one) - 1)] != others]
    at = np.searchsorted(one, others)
    return np.insert(one, at, others), np.insert(c, at, 0)


def asked_counts(bundles: DataFrame, parts: int) -> DataFrame:
    """(n, part, bundle, wide, hashes, counts): distinct n-grams of each bundle
    and their counts in its training documents. Hashes are sent as their
    distances, in order, from the part's first, of ``wide`` bytes each."""
    edges = part_edges(parts)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bundle, data in zip(*(c.to_pylist() for c in batch.columns)):
                table, h, counts = unbundled(data)
                train = np.repeat([x is False for x in table["held_out"].to_pylist()], counts)
                for n, all_of in ((1, h), (2, pairs(h, counts))):
                    one, c = distinct_counts(all_of, train)
                    cut = np.concatenate(([0], np.searchsorted(one, edges), [len(one)]))
                    some = np.flatnonzero(np.diff(cut))
                    apart = np.diff(one, prepend=_U(0))
                    apart[cut[some]] = one[cut[some]] - np.concatenate(([_U(0)], edges))[some]
                    wide = max(1, (int(apart.max(initial=0)).bit_length() + 7) // 8)
                    sent = np.ascontiguousarray(apart.view(np.uint8).reshape(-1, 8)[:, :wide])
                    c = c.astype(np.uint8 if c.max(initial=0) < 256 else np.uint32)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(some), n, np.int32)), pa.array(some.astype(np.int32)),
                        pa.array(np.full(len(some), bundle, np.int64)), pa.array(np.full(len(some), wide, np.int32)),
                        pa.array([sent[cut[i] : cut[i + 1]].tobytes() for i in some], pa.binary()),
                        pa.array([c[cut[i] : cut[i + 1]].tobytes() for i in some], pa.binary())], names=["n", "part", "bundle", "wide", "hashes", "counts"])

    return bundles.select("bundle", "data").mapInArrow(ask, "n int, part int, bundle long, wide int, hashes binary, counts binary")


def answered_counts(asked: DataFrame, parts: int) -> DataFrame:
    """The rows of ``merged_counts`` and, where ``bundle`` is not null, the
    ``levels`` that the part's segment gives for what a bundle sent to it."""
    schema = f"{MERGED}, bundle long, levels binary"
    kinds = [*_MERGED_KINDS, pa.int64(), pa.binary()]
    shift = 64 - (parts.bit_length() - 1)

    def received(part: int, wide: int, hashes: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
        k = len(hashes) // wide
        apart = np.zeros((k, 8), np.uint8)
        apart[:, :wide] = np.frombuffer(hashes, np.uint8).reshape(k, wide)
        first = _U(part << shift) if parts > 1 else _U(0)
        return np.cumsum(apart.view(_U).ravel()) + first, np.frombuffer(counts, np.uint8 if len(counts) == k else np.uint32)

    def done(n: int, part: int, held: list[tuple[int, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        h = np.concatenate([x for _, x, _ in held])
        order = np.argsort(h)
        h = h[order]
        new = np.concatenate((np.ones(1, bool), h[1:] != h[:-1]))
        one = h[new]
        c = np.add.reduceat(np.concatenate([x for _, _, x in held])[order].astype(np.int64), np.flatnonzero(new))
        row = merged_row(n, part, one[c > 0], c[c > 0])
        data = np.frombuffer(row[2], np.uint8)
        found = np.empty(len(one), np.uint8)
        for a in range(0, len(one), LOOKUP):
            some = one[a : a + LOOKUP]
            found[a : a + LOOKUP] = probed(data, some, np.zeros(len(some), np.int64), np.full(len(some), row[3]))
        level = np.empty(len(h), np.uint8)
        level[order] = found[np.cumsum(new) - 1]
        ends = np.cumsum([len(x) for _, x, _ in held])
        back = [level[e - len(x) : e].tobytes() for (_, x, _), e in zip(held, ends)]
        rows = [[*row, None, None]] if row[8] else []  # not without an n-gram of a training document
        rows += [[n, part, *[None] * (len(row) - 2), bundle, some] for (bundle, _, _), some in zip(held, back)]
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), kinds)], names=names_of(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            for n, part, bundle, wide, hashes, counts in zip(*(col.to_pylist() for col in batch.columns)):
                if key is not None and key != (n, part):
                    yield from done(*key, held)
                    held = []
                key = (n, part)
                held.append((bundle, *received(part, wide, hashes, counts)))
        if key is not None:
            yield from done(*key, held)

    return asked.repartition("n", "part").sortWithinPartitions("n", "part").mapInArrow(run, schema)


@dataclass
class Model:
    tokens: int
    types: int
    head: np.ndarray
    head_counts: np.ndarray
    least_head: int
    parts: int
    values: dict[int, np.ndarray]  # mean count of each level
    share: np.ndarray  # pairs of a level, for each token
    false: np.ndarray  # words that read a pair's level after a context where it isn't there
    words: Filter | None  # None: the filter is too large to broadcast
    pairs: Filter | None

    def believed(self, level: np.ndarray, before: np.ndarray) -> np.ndarray:
        """A pair's count from its level and its context's count."""
        true = self.share[level] * before
        return self.values[2][level] * (true / np.maximum(true + self.false[level], 1e-300))

    def word_probability(self, counts: np.ndarray) -> np.ndarray:
        return (counts + 0.1) / (self.tokens + 0.1 * (self.types + 1))

    def exact(self, h: np.ndarray) -> np.ndarray:
        """Counts of frequent words; 0 for all others."""
        if not len(self.head):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.head, h), len(self.head) - 1)
        return np.where(self.head[at] == h, self.head_counts[at], 0)


def _filters(merged: DataFrame, sizes: list, parts: int) -> dict[int, Filter]:
    """Filters of both orders. Segments come to the driver a few parts at a time
    and are put where they belong, so it holds every bit once."""
    out = {}
    for n in BASES:
        size, bits = np.full(parts, 513, np.int64), np.full(parts, 4096, np.int64)
        for r in sizes:
            if r.n == n:
                size[r.part], bits[r.part] = r.bits // 8 + 1, r.bits
        begins = np.concatenate(([0], np.cumsum(size)))
        out[n] = Filter(np.zeros(int(begins[-1]), np.uint8), begins[:-1], bits, 64 - (parts.bit_length() - 1))
    for r in merged.select("n", "part", "filter").toLocalIterator():
        f = out[r.n]
        f.data[f.begins[r.part] : f.begins[r.part] + len(r.filter)] = np.frombuffer(r.filter, np.uint8)
    return out


def word_counts(merged: DataFrame, low: int, high: int | None = None) -> DataFrame:
    """(h, c): words with counts from ``low`` to below ``high``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for hashes, counts in zip(*(c.to_pylist() for c in batch.columns)):
                h, c = np.frombuffer(hashes, np.int64), np.frombuffer(counts, np.int64)
                some = (c >= low) & ((c < high) if high is not None else True)
                yield pa.RecordBatch.from_arrays([pa.array(h[some]), pa.array(c[some])], names=["h", "c"])

    return merged.where("n = 1").select("hashes", "counts").mapInArrow(run, "h long, c long")


def parts_of(docs: DataFrame) -> int:
    return 1 << max(9, math.ceil(math.log2(max(8 * docs.rdd.getNumPartitions(), 1))))


def fit(train: DataFrame, filter_mb: int = FILTER_MB, head: int = HEAD) -> tuple[Model, DataFrame]:
    """The model, and the stored counts that it was made from."""
    parts = parts_of(train)
    merged = stored(merged_counts(dealt_counts(train, parts)), "lm-counts")
    return _model(merged, parts, filter_mb, head), merged


def _model(merged: DataFrame, parts: int, filter_mb: int, head: int) -> Model:
    """The model from the stored counts."""
    rows = merged.drop("filter", "hashes", "counts").collect()  # one short row for each part
    words = [r for r in rows if r.n == 1]
    upwards = np.cumsum(np.sum([r.histogram for r in words], axis=0)[::-1])[::-1] if words else np.zeros(64, np.int64)
    least = 1 << int(np.argmax(upwards <= head))
    few = word_counts(merged, least).toArrow()  # ``head`` rows at most
    h, c = few["h"].to_numpy().view(_U), few["c"].to_numpy()
    order = np.argsort(h)
    small = sum(r.bits // 8 + 1 for r in rows) <= filter_mb * 1_000_000
    filters = _filters(merged, rows, parts) if small else {1: None, 2: None}
    tokens, types = sum(r.tokens for r in words), sum(r.types for r in words)
    of = {n: np.sum([r.of_level for r in rows if r.n == n] or [np.zeros(LEVELS)], axis=0) for n in BASES}
    sums = {n: np.sum([r.level_sum for r in rows if r.n == n] or [np.zeros(LEVELS)], axis=0) for n in BASES}
    values = {n: np.where(of[n] > 0, sums[n] / np.maximum(of[n], 1), BASES[n] ** (np.minimum(np.arange(LEVELS), 500.0) - 0.5)) for n in BASES}
    for v in values.values():
        v[0] = 0.0
    fill = [r.ones / r.bits for r in rows if r.n == 2] + [0.5] * (parts - sum(r.n == 2 for r in rows)) if tokens else [0.0]
    first, further = np.mean(np.power(fill, FIRST)), np.mean(np.power(fill, FURTHER))
    false = types * first * further ** np.maximum(np.arange(LEVELS) - 1.0, 0) * (1 - further)
    return Model(tokens, types, h[order], c[order], least, parts, values, of[2] / max(tokens, 1), false, filters[1], filters[2])


def filter_bound(docs: DataFrame) -> float:
    """MB that a filter of all these texts can't exceed: a text has at most half as many tokens as bytes, and one and a
    half; each sets ``FIRST`` bits for a word and a pair at most, of a segment that is filled to one half."""
    size = docs.agg(F.sum(F.octet_length("text")).alias("b"), F.count("*").alias("n")).first()
    tokens = ((size.b or 0) + 3 * size.n) / 2
    return 2 * (FIRST / math.log(2) / 8 * tokens + 514 * parts_of(docs)) / 1_000_000


Scored = tuple[int, int, float, float, list[int]]


def score_slice(h: np.ndarray, counts: np.ndarray, distinct: np.ndarray, of: np.ndarray, word_levels: np.ndarray,
                pair_levels: np.ndarray, model: Model, prior: float) -> Iterator[Scored]:
    """Scores from the tokens, the filter's levels of distinct words and those of all pairs."""
    quantised = model.values[1][word_levels]
    begins = np.concatenate(([0], np.cumsum(counts)[:-1]))
    exact = model.exact(distinct)[of]
    base = np.where(exact > 0, np.log10(model.word_probability(exact)), 0.0)
    word = model.word_probability(quantised)[of]
    context = np.where(exact > 0, exact, quantised[of])
    before = np.empty(len(h))
    before[1:] = context[:-1]
    before[0] = context[np.argmax(of == np.searchsorted(distinct, _U(END)))]  # every text has an end
    together = model.believed(pair_levels, before)
    chance = (together + prior * word) / (np.maximum(before, together) + prior)
    known, base, score = (np.add.reduceat(v, begins) for v in ((exact > 0).astype(np.int64), base, np.log10(chance)))
    rare = exact == 0
    for i, (x, n) in enumerate(zip(begins.tolist(), counts.tolist())):
        yield n, int(known[i]), float(base[i]), float(score[i]), h[x : x + n][rare[x : x + n]].view(np.int64).tolist()


def score_texts(texts: list[bytes], model: Model, prior: float = PRIOR) -> Iterator[Scored]:
    """For each text: tokens, frequent tokens, their base score, the model's score, hashes of the other tokens."""
    for a, b in slices(texts):
        h, counts = tokens(texts[a:b])
        distinct, of = np.unique(h, return_inverse=True)
        two, at = np.unique(pairs(h, counts), return_inverse=True)
        yield from score_slice(h, counts, distinct, of, model.words.levels(distinct), model.pairs.levels(two)[at], model, prior)


SCORES = "n_tokens long, known long, base double, score double, rare array<long>"


def score_columns(rows: list[Scored]) -> list[pa.Array]:
    return [pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.int64())))]


def scored_by_parts(bundles: DataFrame, answers: DataFrame, shared: Broadcast, kind: str) -> DataFrame:
    """The rows in the bundles with their scores, by the levels that came back:
    a task holds one bundle and its levels."""
    def done(data: bytes, level: dict[int, list[bytes]]) -> pa.RecordBatch:
        table, h, counts = unbundled(data)
        value = {n: np.frombuffer(b"".join(v), np.uint8) for n, v in level.items()}
        distinct, of = np.unique(h, return_inverse=True)
        at = np.unique(pairs(h, counts), return_inverse=True)[1]
        rows = list(score_slice(h, counts, distinct, of, value[1], value[2][at], shared.value, PRIOR))
        ids, held = (pa.concat_arrays(table[c].chunks) for c in ("doc_id", "held_out"))
        return pa.RecordBatch.from_arrays([ids, held, *score_columns(rows)], names=["doc_id", "held_out", *names_of(SCORES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, level = None, {}
        for batch in batches:
            for n, some in zip(*(batch.column(c).to_pylist() for c in ("n", "data"))):
                if n:
                    level[n].append(some)
                    continue
                if data is not None:
                    yield done(data, level)
                data, level = some, {1: [], 2: []}  # a bundle comes before its levels, which are in order
        if data is not None:
            yield done(data, level)

    rows = bundles.select("bundle", F.lit(0).alias("n"), F.lit(0).alias("part"), "data")
    rows = rows.unionByName(answers.select("bundle", "n", "part", F.col("levels").alias("data")))
    return rows.repartition("bundle").sortWithinPartitions("bundle", "n", "part").mapInArrow(run, f"doc_id {kind}, held_out boolean, {SCORES}")


def scored(docs: DataFrame, held_out: Column, filter_mb: int = FILTER_MB, head: int = HEAD) -> DataFrame:
    """One row for each document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    first = docs.select("doc_id", held_out.alias("held_out"), raw("text").alias("raw"))
    with small_batches(spark):  # beside its batch, a worker holds the counts or the filter
        if small := filter_bound(docs) <= filter_mb:
            model, merged = fit(docs.where(~held_out), filter_mb, head)
        else:
            bundles = bundled(first)
            parts = 1 << max(9, math.ceil(math.log2(max(bundles.count() / BUNDLES, 1))))
            answered = stored(answered_counts(asked_counts(bundles, parts), parts), "lm-counts")
            merged = answered.where("bundle is null").drop("bundle", "levels")
            model = _model(merged, parts, 0, head)
    shared = share(spark, model)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, {SCORES}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(score_texts(batch.column("raw").to_pylist(), shared.value))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), *score_columns(rows)], names=["doc_id", "held_out", "n_tokens", "known", "base", "score", "rare"])

    with small_batches(spark):
        first = first.mapInArrow(run, schema) if small else scored_by_parts(bundles, answered.where("bundle is not null"), shared, kind)
        first = stored(first.withColumn("uid", F.monotonically_increasing_id()), "lm-scored")
    rare = first.select("uid", F.explode("rare").alias("h")).join(word_counts(merged, 1, model.least_head), "h", "left")
    c, total = F.coalesce("c", F.lit(0)), model.tokens + 0.1 * (model.types + 1)
    rare = rare.groupBy("uid").agg(F.count("c").alias("more"), F.sum(F.log10((c + F.lit(0.1)) / F.lit(total))).alias("rest"))
    out = first.drop("rare").join(rare, "uid", "left")
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rest", F.lit(0.0))).alias("base_score"), "score")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(load_documents(spark, sf_dir), crc_mod("doc_id", 10) == 0)
