"""SimHash near-duplicates by a binary-trie self-join.

Every text has a 64-bit fingerprint of its word shingles. Distinct
fingerprints are dealt by the value of each of three bit blocks: two
fingerprints with at most two differing bits agree in at least one block, so
they meet there. Where they meet, the trie of the remaining bits is joined
with itself: pairs of nodes go down together, add up their differing bits and
are dropped beyond the budget. A block value that many fingerprints share is
first split into pairs of trie nodes by its next bits, dealt like any other.

Links join distinct fingerprints only (copies share one); components come
from rounds of hooking to the smallest neighbour and contracting, each
written to the shared folder.

Defined results: null and empty texts have fingerprint 0 and are linked like
any other; a null id never names a component that has an id (a component
without any id has null); repeated rows and ids keep their rows; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, load_documents, raw, stored

#: Lowest bit and width of the three blocks; more blocks than differing bits.
BLOCKS = ((0, 22), (22, 21), (43, 21))
#: A block value with more fingerprints is split into pairs of trie nodes.
SPLIT_ABOVE = 8192
#: A split goes down so many bits at most.
DEEPEST = 16


def fingerprint(b: bytes, width: int = 3) -> int:
    """The signed 64-bit fingerprint of a text's bytes."""
    words = b.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        h = np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[: -width] + 1))
        of = xxhash.xxh64_intdigest
        h = np.array([of(joined[s:e], 42) for s, e in zip(starts.tolist(), ends[width - 1 :].tolist())], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


def with_fingerprint(docs: DataFrame, keep: list[str], name: str) -> DataFrame:
    """The columns ``keep`` of ``docs`` and its texts' fingerprints (long) as ``name``."""
    text = free_name([*docs.columns, name], "raw")
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField(name, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([fingerprint(b) for b in batch.column(text).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], found], names=[*keep, name])

    return docs.select(*keep, raw("text").alias(text)).mapInArrow(run, schema)


def trie_pairs(fps: np.ndarray, nodes: tuple[np.ndarray, ...], bits: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs with at most ``budget`` differing bits, from pairs of trie nodes.

    ``nodes`` has lo1, hi1, lo2, hi2 and the bits that differ so far; a node is
    a range of ``fps``, distinct and sorted within it. All node pairs go down
    one bit at a time together; two single fingerprints are settled at once.
    """
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    lo1, hi1, lo2, hi2, err = nodes
    for bit in range(bits - 1, -2, -1):
        single = (hi1 - lo1 == 1) & (hi2 - lo2 == 1)
        i, j = lo1[single], lo2[single]
        near = (i != j) & (np.bitwise_count(fps[i] ^ fps[j]) <= budget)
        a.append(i[near])
        b.append(j[near])
        lo1, hi1, lo2, hi2, err = (v[~single] for v in (lo1, hi1, lo2, hi2, err))
        if not len(lo1):
            break
        ones = np.concatenate(([0], np.cumsum((fps >> np.uint64(bit)) & np.uint64(1)).astype(np.int64)))
        mid1, mid2 = hi1 - (ones[hi1] - ones[lo1]), hi2 - (ones[hi2] - ones[lo2])
        apart = lo1 != lo2  # a node with itself has each differing pair of children once
        down = [(lo1, mid1, lo2, mid2, err), (mid1, hi1, mid2, hi2, err), (lo1, mid1, mid2, hi2, err + 1),
                tuple(v[apart] for v in (mid1, hi1, lo2, mid2, err + 1))]
        lo1, hi1, lo2, hi2, err = (np.concatenate(v) for v in zip(*down))
        live = (hi1 > lo1) & (hi2 > lo2) & (err <= budget)
        lo1, hi1, lo2, hi2, err = (v[live] for v in (lo1, hi1, lo2, hi2, err))
    return np.concatenate(a), np.concatenate(b)


def joined_groups(keys: list[np.ndarray], rest: np.ndarray, depth: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within each group of rows with equal ``keys`` (block, value,
    p, q), which stand together: the trie node p joined with the node q."""
    block, _, p, q = keys
    new = np.concatenate(([True], np.any([k[1:] != k[:-1] for k in keys], axis=0)))
    group = np.cumsum(new) - 1
    order = np.lexsort((rest, group))
    rest, group = rest[order], group[order]
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(rest))
    p, q = p[starts], q[starts]
    bits = 64 - np.array([width for _, width in BLOCKS])[block[starts]]
    prefix = rest >> (bits - depth[starts]).astype(np.uint64)[group]
    in_q = (p != q)[group] & (prefix == q.astype(np.uint64)[group])
    middle = ends - np.add.reduceat(in_q.astype(np.int64), starts)
    nodes = (starts, np.where(p == q, ends, middle), np.where(p == q, starts, middle), ends, np.zeros(len(starts), np.int64))
    live = (nodes[1] > nodes[0]) & (nodes[3] > nodes[2])
    a, b = trie_pairs(rest, tuple(v[live] for v in nodes), 64 - min(width for _, width in BLOCKS), budget)
    return order[a], order[b]


def first_meeting(block: np.ndarray, differing: np.ndarray) -> np.ndarray:
    """Whether no earlier block of two fingerprints agrees: each link comes from one block."""
    out = np.ones(len(block), bool)
    for k, (low, width) in enumerate(BLOCKS):
        agree = (differing >> np.uint64(low)) & np.uint64((1 << width) - 1) == 0
        out &= ~(agree & (block > k))
    return out


def links(fps: DataFrame, budget: int = 2, split_above: int = SPLIT_ABOVE) -> DataFrame:
    """(a, b): pairs of distinct fingerprints with at most ``budget`` differing
    bits, each once. ``fps`` has one row for each distinct fingerprint, in ``fp``."""
    if budget >= len(BLOCKS):
        raise ValueError("there must be more blocks than differing bits")

    def of(k: int, low: int, width: int) -> Column:
        below, above = F.col("fp").bitwiseAND((1 << low) - 1), F.shiftrightunsigned("fp", low + width) if low + width < 64 else F.lit(0).cast("long")
        return F.struct(F.lit(k).alias("block"), F.shiftrightunsigned("fp", low).bitwiseAND((1 << width) - 1).alias("value"),
                        F.shiftleft(above, low).bitwiseOR(below).alias("rest"), F.lit(64 - width).alias("bits"))

    dealt = fps.select("fp", F.explode(F.array(*(of(k, *b) for k, b in enumerate(BLOCKS)))).alias("r")).select("fp", "r.*")
    many = dealt.groupBy("block", "value").agg(F.count("*").alias("n")).where(F.col("n") > split_above)
    depth = F.least(F.lit(DEEPEST), F.ceil(F.log2(F.col("n") / split_above)) + 2).cast("int")
    many = stored(many.select("block", "value", depth.alias("depth")), "simhash-split")
    masks = [(d, sum(1 << i for i in bits)) for d in range(DEEPEST + 1) for n in range(budget + 1) for bits in combinations(range(d), n)]
    masks = F.broadcast(fps.sparkSession.createDataFrame(masks, "depth int, mask long"))  # under 1,000 rows
    dealt = dealt.join(many, ["block", "value"], "left").withColumn("depth", F.coalesce("depth", F.lit(0))).join(masks, "depth")
    dealt = dealt.withColumn("own", F.expr("shiftrightunsigned(rest, bits - depth)")).withColumn("other", F.col("own").bitwiseXOR(F.col("mask")))
    keys = ["block", "value", "p", "q"]
    dealt = dealt.select("block", "value", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "rest", "depth", "fp")
    dealt = dealt.repartition(*keys).sortWithinPartitions(*keys)

    def found(cols: list[np.ndarray]) -> pa.RecordBatch:
        *group, rest, depth, fp = cols
        fp = fp.view(np.uint64)
        i, j = joined_groups(group, rest.view(np.uint64), depth, budget)
        once = first_meeting(group[0][i], fp[i] ^ fp[j])
        a, b = fp[i[once]].view(np.int64), fp[j[once]].view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]
            held = cols if held is None else [np.concatenate(x) for x in zip(held, cols)]
            ends = np.flatnonzero(np.any([c[1:] != c[:-1] for c in held[:4]], axis=0)) + 1
            if len(ends) and ends[-1] >= 10_000:  # the last group may go on in the next batch
                yield found([c[: ends[-1]] for c in held])
                held = [c[ends[-1] :] for c in held]
        if held is not None and len(held[0]):
            yield found(held)

    return dealt.mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the stored ``edges`` (a, b).

    In each round every node hooks to its smallest neighbour if that is
    smaller, chains of hooks are shortened to their ends, and edges between
    different ends go on. A round leaves at most half of the nodes.
    """
    total: DataFrame | None = None
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("next")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("next")))
        hooks = stored(both.groupBy("node").agg(F.min("next").alias("next")).select("node", F.least("node", "next").alias("root"), F.lit(True).alias("moved")), "simhash-hooks")
        while True:
            ends = hooks.select(F.col("node").alias("root"), F.col("root").alias("end"))
            hooks = stored(hooks.drop("moved").join(ends, "root").select("node", F.col("end").alias("root"), (F.col("end") != F.col("root")).alias("moved")), "simhash-hooks")
            if hooks.where("moved").isEmpty():
                break
        hooks = hooks.drop("moved")
        to = lambda c: hooks.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
        rest = edges.join(to("a"), "a").join(to("b"), "b").where("root_a <> root_b")
        edges = stored(rest.select(F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b")).distinct(), "simhash-edges")
        if total is None:
            total = hooks
        else:
            later = hooks.select(F.col("node").alias("root"), F.col("root").alias("end"))
            total = stored(total.join(later, "root", "left").select("node", F.coalesce("end", "root").alias("root")), "simhash-roots")
    return total if total is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def with_components(rows: DataFrame, key: Column, budget: int = 2, split_above: int = SPLIT_ABOVE) -> DataFrame:
    """(fp, best): the smallest ``key`` in the component of each distinct
    fingerprint of the stored ``rows`` (fp and the columns of ``key``)."""
    fps = stored(rows.groupBy("fp").agg(F.min(key).alias("best")), "simhash-distinct")
    roots = components(stored(links(fps.select("fp"), budget, split_above), "simhash-links"))
    linked = fps.join(roots, fps.fp == roots.node, "left").select("fp", "best", F.coalesce("root", "fp").alias("root"))
    best = linked.groupBy("root").agg(F.min("best").alias("best"))
    return linked.select("fp", "root").join(best, "root").select("fp", "best")


def near_duplicates(docs: DataFrame, budget: int = 2, split_above: int = SPLIT_ABOVE) -> DataFrame:
    """One row for each document: doc_id, fingerprint (16 hex digits), component_id."""
    rows = stored(with_fingerprint(docs, ["doc_id"], "fp"), "simhash-rows")
    best = with_components(rows, F.col("doc_id"), budget, split_above)
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return rows.join(best, "fp").select("doc_id", digits.alias("fingerprint"), F.col("best").alias("component_id"))


def one_of_each(docs: DataFrame, budget: int = 2, split_above: int = SPLIT_ABOVE) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component the row
    with the smallest id stays (null last; one of several rows with that id)."""
    fp = free_name(docs.columns, "fp")
    uid = free_name([*docs.columns, fp], "uid")
    kept = stored(with_fingerprint(docs, docs.columns, fp).withColumn(uid, F.monotonically_increasing_id()), "simhash-docs")
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col(uid).alias("uid"))
    rows = kept.select(F.col(fp).alias("fp"), "doc_id", uid)
    best = with_components(rows, key, budget, split_above).select(F.col("best.uid").alias(uid)).distinct()
    return kept.join(best, uid, "left_semi").select(*docs.columns)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(load_documents(spark, sf_dir))
