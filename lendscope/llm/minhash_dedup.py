"""MinHash near-duplicates by a multi-index Hamming join of b-bit signatures.

A document's set is its distinct five-word shingles. Equal sets are one class;
a class has a signature of 64 minima of 16 bits. Two sets of similarity J
differ in about (1 - J) * 64 values, and ``missed`` gives the exact chance that
they differ in more than ``DISTANCE`` = 23 of them: 6e-6 at the threshold of
0.85, and less above. All pairs within the distance are found: 12 chunks share
at most 23 differing values, so at least one chunk has at most one, and every
class is indexed under each chunk with each of its values left out.

Links are found in two steps, both confirmed on full sets, and no step's rows
grow with the square of a group.

1. In a few rounds every key draws one of its classes, the others are compared
   with it by their signatures, and of each component the nearest such pair by
   its full sets. The components of these links soon hold nearly all of a large
   group of near copies.
2. Where a key still joins several components, all its pairs from different
   ones are compared by their signatures: the largest component in blocks
   against blocks of the others. The task writes a spanning forest of the
   components that have a pair within the distance. The full sets of the
   components of a tree are then compared across components, in pairs of blocks
   of bounded size again, and a spanning forest of the verified links completes
   the components.

Full sets are made again from the texts of the classes that share a key, which
are stored once. A sieve of bounded size (a Bloom filter of their text hashes)
keeps most other texts from being moved; what it lets pass falls to the join
behind it.

Defined results: a null, empty or blank text has an empty set and is its own
component (named by its id, null without one); equal sets are one component at
once; a component is named by its smallest id, null only if no member has one;
repeated rows and ids keep their rows; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, load_documents, raw, small_batches, stored
from .simhash_dedup import components

WIDTH = 5
PERCENT = 85
VALUES = 64
DISTANCE = 23
CHUNKS = [c.tolist() for c in np.array_split(np.arange(VALUES), 12)]
#: Members of a key, or of a star, that are compared in one task.
SPLIT_ABOVE = 2048
#: Shingles of a block of sets that are compared in one task.
BLOCK_SHINGLES = 1 << 18
#: Rounds of the first step.
ROUNDS = 3
#: Bits of the sieve (8 MB) and bits that an entry sets.
SIEVE_BITS, SIEVE_PROBES = 1 << 26, 4
#: Texts are cut into words in pieces of about so many bytes.
PIECE = 1 << 20

_ODD = np.random.default_rng(20_11).integers(1, 1 << 63, (3, VALUES), np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def missed(percent: int, distance: int = DISTANCE) -> float:
    """The chance that sets of this similarity differ in more than ``distance`` values."""
    j = percent / 100
    return sum(math.comb(VALUES, d) * (1 - j) ** d * j ** (VALUES - d) for d in range(distance + 1, VALUES + 1))


def word_hashes(text: bytes) -> np.ndarray:
    """Hashes of a text's lower-cased words; only a piece of the words is held at a time."""
    out, a = [], 0
    while a < len(text):
        cut = _SPACE.search(text, a + PIECE)
        b = cut.start() if cut else len(text)
        words = text[a:b].lower().split()
        out.append(np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)))
        a = b
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingle_set(text: bytes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    w = word_hashes(text)
    k = min(width, len(w))
    if not k:
        return w
    s = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        s += w[i : len(w) - k + 1 + i] * _ODD[2, i]
    s = (s ^ (s >> np.uint64(32))) * _ODD[2, -1]
    return np.unique(s ^ (s >> np.uint64(29)))


def signature(shingles: np.ndarray) -> np.ndarray:
    """The 16-bit minima of a non-empty set, one for each of the hash functions."""
    least = np.full(VALUES, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(shingles), 4096):
        part = shingles[a : a + 4096]
        for k in range(0, VALUES, 8):
            np.minimum(least[k : k + 8], (_ODD[0, k : k + 8, None] * part + _ODD[1, k : k + 8, None]).min(1), out=least[k : k + 8])
    return ((least ^ (least >> np.uint64(29))) * _ODD[2, -2] >> np.uint64(48)).astype(np.uint16)


def index_keys(sig: np.ndarray) -> np.ndarray:
    """For every signature (row), a key for each chunk and each of its values left out."""
    out = np.empty(sig.shape, np.uint64)
    wide = sig.astype(np.uint64)
    for c, chunk in enumerate(CHUNKS):
        for left_out in chunk:
            key = np.full(len(sig), left_out * 64 + c + 1, np.uint64)
            for v in chunk:
                if v != left_out:
                    key = (key ^ wide[:, v]) * _ODD[2, 7]
                    key ^= key >> np.uint64(31)
            out[:, left_out] = key
    return out


def _with_sets(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n (size of the set), set_key (digest of the set), sig for each row."""
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("text_hash", T.LongType()), T.StructField("n", T.LongType()),
                           T.StructField("set_key", T.BinaryType()), T.StructField("sig", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, keys, sigs = [], [], []
            for text in batch.column(2):
                s = shingle_set(text.as_py())
                n.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sigs.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())],
                                             names=schema.names)

    return docs.select("doc_id", F.xxhash64(raw("text")).alias("text_hash"), raw("text").alias(free_name(["doc_id", "text_hash"], "raw"))).mapInArrow(run, schema)


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, VALUES)


def _group_starts(keys: list[np.ndarray]) -> np.ndarray:
    """Rows at which a group of equal keys, standing together, begins."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def index(classes: DataFrame) -> DataFrame:
    """(k, cls): the keys of every class."""
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = index_keys(_signatures(batch.column(1)))
                yield pa.RecordBatch.from_arrays([pa.array(found.ravel().view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), VALUES))], names=["k", "cls"])

    return classes.select("cls", "sig").mapInArrow(keys, "k long, cls long")


def stars(members: DataFrame, classes: DataFrame, distance: int, draw: int) -> DataFrame:
    """(a, b): for each component the nearest of its pairs with a class of
    another component that one of its keys has drawn, if within the distance.
    ``members`` has (k, cls, comp)."""
    sig = classes.select("cls", "sig")
    drawn = members.groupBy("k").agg(F.min(F.struct(F.xxhash64("cls", F.lit(draw)).alias("at"), "cls", "comp")).alias("x"))
    pairs = members.join(drawn, "k").where(F.col("comp") != F.col("x.comp")).select(F.col("x.cls").alias("a"), F.col("cls").alias("b"), "comp").distinct()
    pairs = pairs.join(sig.select(F.col("cls").alias("a"), F.col("sig").alias("sig_a")), "a").join(sig.select(F.col("cls").alias("b"), F.col("sig").alias("sig_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                apart = np.count_nonzero(_signatures(batch.column(3)) != _signatures(batch.column(4)), axis=1)
                near = apart <= distance
                yield pa.RecordBatch.from_arrays([pa.array(batch.column(k).to_numpy()[near]) for k in range(3)] + [pa.array(apart[near])], names=["a", "b", "comp", "apart"])

    near = pairs.select("a", "b", "comp", "sig_a", "sig_b").mapInArrow(run, "a long, b long, comp long, apart long")
    return near.groupBy("comp").agg(F.min(F.struct("apart", "a", "b")).alias("x")).select("x.a", "x.b")


def dealt(rows: DataFrame, group: str, size: str, limit: int) -> DataFrame:
    """``rows`` (group, comp, cls, ...) of the groups with several components,
    dealt to pairs of blocks (p, q) of about ``limit`` of ``size``, so that any
    two rows of different components meet: blocks of the largest component
    meet the blocks of the others, and those meet each other."""
    of = rows.groupBy(group, "comp").agg(F.sum(size).alias("s"))
    of = of.groupBy(F.col(group).alias("at")).agg(F.sum("s").alias("s"), F.max(F.struct("s", "comp")).alias("most"), F.count("*").alias("n")).where("n > 1")
    blocks = lambda s: F.greatest(F.ceil(s / limit), F.lit(1)).cast("int")
    of = of.select("at", F.col("most.comp").alias("main"), blocks(F.col("most.s")).alias("b"), blocks(F.col("s") - F.col("most.s")).alias("o"))
    placed = rows.join(of, rows[group] == of["at"])
    mix = F.xxhash64("cls")
    own = F.when(F.col("comp") == F.col("main"), F.pmod(mix, "b")).otherwise(F.col("b") + F.pmod(mix, "o")).cast("int")
    begin = F.when(F.col("comp") == F.col("main"), F.col("b")).otherwise(0)
    placed = placed.withColumn("own", own).withColumn("other", F.explode(F.sequence(begin, F.col("b") + F.col("o") - 1)))
    return placed.withColumn("p", F.least("own", "other")).withColumn("q", F.greatest("own", "other")).drop("at", "main", "b", "o", "other")


def met(sig: np.ndarray, comp: np.ndarray, own: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Index pairs that connect all components that a pair within ``distance``
    connects. Pairs count if their components differ and, where there are two
    blocks, their blocks do."""
    tree, pairs = comp.copy(), []
    two = bool((own != own[0]).any())
    for x in range(len(sig) - 1):
        able = tree[x + 1 :] != tree[x]
        if two:
            able &= own[x + 1 :] != own[x]
        others = x + 1 + np.flatnonzero(able)
        if len(others):
            others = others[np.count_nonzero(sig[others] != sig[x], axis=1) <= distance]
            for y in others.tolist():
                if tree[y] != tree[x]:
                    pairs.append((x, y))
                    tree[tree == tree[y]] = tree[x]
    return pairs


def neighbours(members: DataFrame, classes: DataFrame, distance: int, split_above: int) -> DataFrame:
    """(a, b): components that a pair of classes within the distance joins, as
    a spanning forest in each key. ``members`` has (k, cls, comp)."""
    group = ["k", "p", "q"]
    rows = dealt(members.withColumn("one", F.lit(1)), "k", "one", split_above).join(classes.select("cls", "sig"), "cls")
    rows = rows.select(*group, "comp", "own", "cls", "sig").repartition(*group).sortWithinPartitions(*group, "cls")

    def found(cols: list[np.ndarray], sig: np.ndarray) -> pa.RecordBatch:
        starts = _group_starts(cols[:3])
        edges = set()
        for i, j in zip(starts.tolist(), [*starts[1:].tolist(), len(sig)]):
            comp = cols[3][i:j]
            for x, y in met(sig[i:j], comp, cols[4][i:j], distance):
                edges.add((int(min(comp[x], comp[y])), int(max(comp[x], comp[y]))))
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in edges], pa.int64()), pa.array([b for _, b in edges], pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols, sig = [np.zeros(0, np.int64)] * 5, np.zeros((0, VALUES), np.uint16)
        for batch in batches:
            if batch.num_rows:
                cols = [np.concatenate([c, batch.column(k).to_numpy().astype(np.int64)]) for k, c in enumerate(cols)]
                sig = np.concatenate([sig, _signatures(batch.column(6))])
                cut = int(_group_starts(cols[:3])[-1])  # the last group may go on in the next batch
                if cut >= 10_000:
                    yield found([c[:cut] for c in cols], sig[:cut])
                    cols, sig = [c[cut:] for c in cols], sig[cut:]
        if len(sig):
            yield found(cols, sig)

    return rows.mapInArrow(run, "a long, b long").distinct()


def _sieved(docs: DataFrame, hashes: DataFrame) -> DataFrame:
    """(doc_id, raw, text_hash) of the texts whose hash may be among ``hashes``."""
    spark = docs.sparkSession
    probes = F.explode(F.array(*(F.pmod(F.xxhash64("text_hash", F.lit(i)), F.lit(SIEVE_BITS)) for i in range(SIEVE_PROBES))))
    words = hashes.select(probes.alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits"))
    few = words.toArrow()  # at most SIEVE_BITS / 64 rows
    sieve = np.zeros(SIEVE_BITS // 64, np.int64)
    sieve[few.column("word").to_numpy()] = few.column("bits").to_numpy()
    shared = spark.sparkContext.broadcast(sieve)
    text = docs.select("doc_id", raw("text").alias("raw")).withColumn("text_hash", F.xxhash64("raw"))
    text = text.select("*", *(F.pmod(F.xxhash64("text_hash", F.lit(i)), F.lit(SIEVE_BITS)).alias(f"p{i}") for i in range(SIEVE_PROBES)))
    schema = T.StructType(text.schema.fields[:3])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for k in range(3, 3 + SIEVE_PROBES):
                bit = batch.column(k).to_numpy()
                keep &= (words[bit >> 6] >> (bit & 63)) & 1 == 1
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(keep)) for k in range(3)], names=schema.names)

    return text.mapInArrow(run, schema)


def _texts(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(cls, raw): a text for each class (cls, doc_id, text_hash: of a row that
    has the set). Rows repeat where rows of ``docs`` do."""
    of = classes.withColumnsRenamed({"doc_id": "id", "text_hash": "hash"})
    found = _sieved(docs, classes.select("text_hash").distinct())
    return found.join(of.hint("shuffle_hash"), (found.text_hash == of.hash) & found.doc_id.eqNullSafe(of.id)).select("cls", "raw")


def _alike(x: int, y: int, shared: int, percent: int) -> bool:
    return 100 * shared >= percent * (x + y - shared)


def verified_stars(texts: DataFrame, pairs: DataFrame, percent: int, split_above: int) -> DataFrame:
    """(a, b): the ``pairs`` whose full sets are similar. The pairs of one ``a``
    are dealt to several tasks where they are many; a task holds two sets."""
    tasks = F.ceil(F.col("n") / split_above).cast("int")
    many = pairs.groupBy("a").agg(F.count("*").alias("n"))
    heads = many.select("a", F.explode(F.sequence(F.lit(0), tasks - 1)).alias("task"), F.col("a").alias("cls"), F.lit(False).alias("member"))
    members = pairs.join(many, "a").select("a", F.pmod(F.xxhash64("b"), tasks).cast("int").alias("task"), F.col("b").alias("cls"), F.lit(True).alias("member"))
    order = ["a", "task", "member", "cls"]
    text = texts.join(heads.unionByName(members), "cls").select(*order, "raw").repartition("a", "task").sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, at = np.zeros(0, np.uint64), None
        for batch in batches:
            out: list[tuple[int, int]] = []
            for a, member, cls, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4)):
                if not member:
                    if at != a:
                        head, at = shingle_set(text.as_py()), a
                    continue
                own = shingle_set(text.as_py())
                if _alike(len(head), len(own), len(np.intersect1d(head, own, assume_unique=True)), percent):
                    out.append((a, cls))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])

    return text.mapInArrow(run, "a long, b long").distinct()


def similar(sets: list[np.ndarray], comp: np.ndarray, own: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Index pairs of sets of at least this similarity that connect all
    components that such pairs connect; where there are two blocks, pairs lie across them."""
    size = np.array([len(s) for s in sets])
    starts = np.concatenate(([0], np.cumsum(size)[:-1]))
    vocabulary, member = np.unique(np.concatenate(sets), return_inverse=True)
    tree, mark, out = comp.copy(), np.zeros(len(vocabulary), bool), []
    two = bool((own != own[0]).any())
    for x in range(len(sets) - 1):
        able = (tree[x + 1 :] != tree[x]) & (100 * np.minimum(size[x], size[x + 1 :]) >= percent * np.maximum(size[x], size[x + 1 :]))
        if two:
            able &= own[x + 1 :] != own[x]
        others = x + 1 + np.flatnonzero(able)
        if not len(others):
            continue
        mine = member[starts[x] : starts[x] + size[x]]
        mark[mine] = True
        if len(others) * 8 > len(sets):
            shared = np.add.reduceat(mark[member], starts, dtype=np.int64)[others]
        else:
            shared = np.array([np.count_nonzero(mark[member[starts[y] : starts[y] + size[y]]]) for y in others])
        mark[mine] = False
        for y in others[100 * shared >= percent * (size[x] + size[others] - shared)].tolist():
            if tree[y] != tree[x]:
                out.append((x, y))
                tree[tree == tree[y]] = tree[x]
    return out


def verified_clusters(texts: DataFrame, members: DataFrame, percent: int, block_shingles: int) -> DataFrame:
    """(a, b): links between classes of different components of a cluster,
    confirmed on full sets. ``members`` has (root, comp, cls, n)."""
    group = ["root", "p", "q"]
    sent = dealt(members, "root", "n", block_shingles).drop("n")
    text = texts.join(sent, "cls").select(*group, "comp", "own", "cls", "raw").repartition(*group).sortWithinPartitions(*group, "cls")

    def links(held: list[tuple[int, int, int]], sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        comp, own, cls = (np.array(c, np.int64) for c in zip(*held)) if held else ([], [], [])
        found = similar(sets, comp, own, percent) if len(held) > 1 else []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([int(cls[x]) for x, _ in found], pa.int64()), pa.array([int(cls[y]) for _, y in found], pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, sets = None, [], []
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(6)]
            for *key, comp, own, cls, text in zip(*columns, batch.column(6)):
                if key != at:
                    yield from links(held, sets)
                    at, held, sets = key, [], []
                if not held or held[-1][2] != cls:  # else a repeated row
                    held.append((comp, own, cls))
                    sets.append(shingle_set(text.as_py()))
        yield from links(held, sets)

    return text.mapInArrow(run, "a long, b long")


def _in_components(rows: DataFrame, links: DataFrame | None) -> DataFrame:
    """``rows`` (cls, ...) with ``comp``: the root of the class's component, or the class."""
    if links is None:
        return rows.withColumn("comp", F.col("cls"))
    roots = components(links).select(F.col("node").alias("cls"), F.col("root").alias("comp"))
    return rows.join(roots, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))


def links(docs: DataFrame, classes: DataFrame, percent: int = PERCENT, distance: int = DISTANCE, split_above: int = SPLIT_ABOVE,
          block_shingles: int = BLOCK_SHINGLES, rounds: int = ROUNDS) -> DataFrame | None:
    """Stored (a, b): links between classes that connect all that are to be
    connected. ``classes`` is stored: cls, n, sig, doc_id, text_hash."""
    if distance >= 2 * len(CHUNKS):
        raise ValueError("a chunk with at most one error exists only below twice as many errors as chunks")
    keys = index(classes)
    members = stored(keys.join(keys.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "k"), "minhash-members")
    some = stored(classes.join(members.select("cls").distinct(), "cls", "left_semi").select("cls", "n", "doc_id", "text_hash"), "minhash-some")
    texts = stored(_texts(docs, some.drop("n")), "minhash-texts")
    found: DataFrame | None = None
    for draw in range(rounds):
        comp = _in_components(some.select("cls", "n"), found)
        near = stored(stars(members.join(comp.drop("n"), "cls"), classes, distance, draw), "minhash-stars")
        linked = verified_stars(texts, near, percent, split_above)
        found = stored(linked if found is None else found.unionByName(linked), "minhash-links")
    comp = stored(_in_components(some.select("cls", "n"), found), "minhash-components")
    edges = stored(neighbours(members.join(comp.drop("n"), "cls"), classes, distance, split_above), "minhash-neighbours")
    if edges.isEmpty():
        return found
    trees = components(edges).select(F.col("node").alias("comp"), "root")
    linked = verified_clusters(texts, stored(comp.join(trees, "comp"), "minhash-rest"), percent, block_shingles)
    return stored(linked if found is None else found.unionByName(linked), "minhash-links")


def near_duplicates(docs: DataFrame, percent: int = PERCENT, distance: int = DISTANCE, split_above: int = SPLIT_ABOVE, block_shingles: int = BLOCK_SHINGLES,
                    rounds: int = ROUNDS) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id, kept."""
    docs = docs.select("doc_id", "text")
    with small_batches(docs.sparkSession):
        rows = stored(_with_sets(docs), "minhash-rows")
        one = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash"))
        classes = rows.where("n > 0").groupBy("set_key").agg(one.alias("one"), F.first("n").alias("n"), F.first("sig").alias("sig"))
        classes = stored(classes.select(F.monotonically_increasing_id().alias("cls"), "set_key", "n", "sig", "one.doc_id", "one.text_hash"), "minhash-classes")
        named = _in_components(classes.select("cls", "set_key", "doc_id"), links(docs, classes, percent, distance, split_above, block_shingles, rounds))
    best = named.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    named = named.select("set_key", "comp").join(best, "comp").select(F.col("set_key").alias("key"), "component_id", F.lit(True).alias("named"))
    component = F.when(F.col("named"), F.col("component_id")).otherwise(F.col("doc_id"))
    out = rows.join(named, rows.set_key == named.key, "left").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(load_documents(spark, sf_dir))
