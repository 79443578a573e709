"""A prefix trie of rebuilt conversations by composable monoid fingerprints.

A rebuilt conversation is the head of a base conversation followed by the rest
of its own turns. No rebuilt text is made: a sequence of turns has the
fingerprint (length n, H) with H its polynomial in a seeded base modulo
2^127 - 1, and fingerprints compose, (n1, H1)(n2, H2) = (n1 + n2, H1 B^n2 + H2).
Prefix products are taken of each conversation once, in sorted runs whose
products a scan puts together, so a conversation may span many tasks. The
fingerprint of a rebuilt prefix is the base's product of the head times the
own product over the rest, which is the own product with the head taken off.

Rows with one fingerprint are a node of the trie. Every turn refers to the
first stored turn with the same role and text (grouped by the strings
themselves), and a node's rows must agree in their depth, their last turn's
reference and their parent; then, by induction over depth, their sequences
are equal. If some node's rows don't, another base is drawn.

Subtree sums need no walk down the tree: the nodes whose smallest member is c
are a tail of c's own path, so a node's subtree holds the whole tails of its
members, and of its smallest member the part from the node on. Members of a
common node are counted before they are shuffled; the ids for its hash are
joined in ranges and leave each range as a few pieces of text.

Defined results: turns of one number are ordered by role and text; null roles
and texts are empty; rows without a conv_id are no conversation and left out;
repeated rows are turns of their own; an empty table has no members, so no
root; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lendscope.sources.tables import load_table

from .common import small_batches, stored

PRIME = (1 << 127) - 1
#: The longest head; the contract takes a crc32 modulo 9.
HEAD = 8
#: Depths that one step of a running sum covers.
STRIDE = 4096
#: Ids joined in one piece of text.
IDS = 4096
#: Bases drawn before giving up; with 127 bits the first serves.
DRAWS = 4


def base_of(seed: int, bits: int = 127) -> int:
    return int.from_bytes(hashlib.sha256(b"conversation trie %d" % seed).digest(), "big") % ((1 << bits) - 3) + 2


@lru_cache(1 << 16)
def _power(base: int, n: int) -> int:
    return pow(base, n, PRIME)


def then(base: int, h: int, n: int, more: int) -> int:
    """The product of a sequence with polynomial ``h`` and one of ``n`` turns with ``more``."""
    return (h * _power(base, n) + more) % PRIME


def without_head(base: int, h: int, head: int, n: int) -> int:
    """What follows the head, if ``n`` turns follow it: then(head, n, result) = h."""
    return (h - head * _power(base, n)) % PRIME


def turn_value(role: bytes, text: bytes, bits: int = 127) -> int:
    digest = xxhash.xxh3_128_intdigest(b"%d:%b%b" % (len(role), role, text))
    return digest % ((1 << bits) - 2) + 1


def _halves(values: list[int | None]) -> list[pa.Array]:
    """Numbers below 2^127 as two columns of longs."""
    low = [None if v is None else ((v & 0xFFFFFFFFFFFFFFFF) ^ (1 << 63)) - (1 << 63) for v in values]
    return [pa.array([None if v is None else v >> 64 for v in values], pa.int64()), pa.array(low, pa.int64())]


def _whole(high: pa.Array, low: pa.Array) -> list[int | None]:
    return [None if h is None else (h << 64) | (x & 0xFFFFFFFFFFFFFFFF) for h, x in zip(high.to_pylist(), low.to_pylist())]


def _turns(conversations: DataFrame, base: int, bits: int) -> DataFrame:
    """Turns in order, numbered by ``gid``; ``run`` is the gid of the first turn
    of its conversation in this range, ``pos`` counts from there, h and g are
    the products of the run up to this turn and before it."""
    order = ["conv_id", "turn", "role", "text"]
    clean = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")))
    clean = clean.repartitionByRange(*(F.col(c).asc_nulls_first() for c in order)).sortWithinPartitions(*(F.col(c).asc_nulls_first() for c in order))
    names = ["conv_id", "role", "text", "gid", "run", "pos", "h1", "h2", "g1", "g2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gid = TaskContext.get().partitionId() << 33
        conv, start, h = None, gid, 0
        for batch in batches:
            starts, products, earlier = [], [], []
            for c, role, text in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                if c != conv:
                    conv, start, h = c, gid, 0
                starts.append(start)
                earlier.append(h)
                h = (h * base + turn_value(role.as_buffer().to_pybytes(), text.as_buffer().to_pybytes(), bits)) % PRIME
                products.append(h)
                gid += 1
            gids = np.arange(gid - batch.num_rows, gid, dtype=np.int64)
            runs = np.array(starts, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(gids), pa.array(runs), pa.array(gids - runs + 1), *_halves(products), *_halves(earlier)], names=names)

    return clean.select("conv_id", "role", "text").mapInArrow(run, "conv_id long, role string, text string, gid long, run long, pos long, h1 long, h2 long, g1 long, g2 long")


def _carried(refs: DataFrame, base: int) -> DataFrame:
    """(run, carry, c1, c2, len): turns and product of the conversation before
    each run, and the turns of the conversation."""
    runs = refs.groupBy("conv_id", "run").agg(F.max(F.struct("pos", "h1", "h2")).alias("x")).select("conv_id", "run", "x.pos", "x.h1", "x.h2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, int]] = []

        def done() -> pa.RecordBatch:
            n, h, before, products = 0, 0, [], []
            for _, _, pos, value in held:
                before.append(n)
                products.append(h)
                n, h = n + pos, then(base, h, pos, value)
            total = np.full(len(held), n, np.int64)
            return pa.RecordBatch.from_arrays([pa.array([r for _, r, _, _ in held], pa.int64()), pa.array(before, pa.int64()), *_halves(products), pa.array(total)],
                                              names=["run", "carry", "c1", "c2", "len"])

        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(3)]
            for row in zip(*columns, _whole(batch.column(3), batch.column(4))):
                if held and held[0][0] != row[0]:
                    yield done()
                    held = []
                held.append(row)
        if held:
            yield done()

    return runs.repartition("conv_id").sortWithinPartitions("conv_id", "run").mapInArrow(run, "run long, carry long, c1 long, c2 long, len long")


def _whole_products(refs: DataFrame, carried: DataFrame, base: int) -> DataFrame:
    """(conv_id, pos, ref, bytes, len, h1, h2, g1, g2): position in and products of the whole conversation."""
    c = carried.withColumnRenamed("run", "at")
    joined = refs.join(c, refs.run == c["at"]).select("conv_id", "pos", "ref", "bytes", "len", "carry", "c1", "c2", "h1", "h2", "g1", "g2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pos, carry = b.column(1).to_pylist(), _whole(b.column(6), b.column(7))
            h = [then(base, c, p, x) for c, p, x in zip(carry, pos, _whole(b.column(8), b.column(9)))]
            g = [then(base, c, p - 1, x) for c, p, x in zip(carry, pos, _whole(b.column(10), b.column(11)))]
            place = pa.array(b.column(1).to_numpy() + b.column(5).to_numpy())
            yield pa.RecordBatch.from_arrays([b.column(0), place, b.column(2), b.column(3), b.column(4), *_halves(h), *_halves(g)],
                                             names=["conv_id", "pos", "ref", "bytes", "len", "h1", "h2", "g1", "g2"])

    return joined.mapInArrow(run, "conv_id long, pos long, ref long, bytes long, len long, h1 long, h2 long, g1 long, g2 long")


def _members(turns: DataFrame, base: int, head_turns: Column) -> DataFrame:
    """One row for each rebuilt conversation and depth, the root's included:
    conv_id, depth, node (f1, f2), parent (p1, p2), ref and bytes of the last
    turn, ends (whether the conversation ends here)."""
    first = F.array_sort(F.collect_list(F.struct("pos", "h1", "h2", "g1", "g2", "ref", "bytes")))
    heads = stored(turns.where(F.col("pos") <= HEAD).groupBy("conv_id").agg(first.alias("head"), F.first("len").alias("len")), "trie-heads")
    bases = heads.select(F.col("conv_id").alias("base"), F.col("head").alias("other"))
    convs = heads.select("conv_id", "len", F.col("head").alias("own"), head_turns.cast("int").alias("h")).withColumn("base", F.col("conv_id") - F.col("conv_id") % 5)
    convs = convs.join(bases, "base", "left").withColumn("taken", F.when(F.col("other").isNull(), 0).otherwise(F.least("h", F.size("other"))))
    at = lambda c, n: F.try_element_at(c, n)
    nothing = F.lit(0).cast("long")
    convs = convs.withColumn("depths", F.col("taken") + F.greatest(F.col("len") - F.col("h"), F.lit(0))).withColumn("given", F.expr("slice(other, 1, taken)"))
    convs = convs.withColumn("seam", F.when(F.col("taken") > 0, at("given", F.col("taken")))).withColumn("off", F.when(F.col("h") > 0, at("own", F.col("h"))))
    convs = stored(convs.select("conv_id", "h", "taken", "depths", "given", *(F.coalesce(f"{a}.{b}", nothing).alias(f"{a}_{b}") for a in ("seam", "off") for b in ("h1", "h2"))), "trie-convs")
    ends = (F.col("depth") == F.col("depths")).alias("ends")
    root = convs.select("conv_id", nothing.alias("depth"), nothing.alias("f1"), nothing.alias("f2"), F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"),
                        F.lit(-1).cast("long").alias("ref"), nothing.alias("bytes"), (F.col("depths") == 0).alias("ends"))
    given = convs.select("conv_id", "depths", F.explode("given").alias("t")).withColumn("depth", F.col("t.pos"))
    given = given.select("conv_id", "depth", F.col("t.h1").alias("f1"), F.col("t.h2").alias("f2"), F.col("t.g1").alias("p1"), F.col("t.g2").alias("p2"), "t.ref", "t.bytes", ends)
    c = convs.select(F.col("conv_id").alias("conv"), "h", "taken", "depths", "seam_h1", "seam_h2", "off_h1", "off_h2")
    own = turns.join(c, (turns.conv_id == c.conv) & (turns.pos > c.h))
    own = own.withColumn("depth", F.col("taken") + F.col("pos") - F.col("h")).withColumn("rest", F.col("pos") - F.col("h"))
    own = own.select("conv_id", "depth", "ref", "bytes", ends, "rest", "seam_h1", "seam_h2", "off_h1", "off_h2", "h1", "h2", "g1", "g2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, seam, off = b.column(5).to_pylist(), _whole(b.column(6), b.column(7)), _whole(b.column(8), b.column(9))
            f = [then(base, s, k, without_head(base, x, o, k)) for k, s, o, x in zip(n, seam, off, _whole(b.column(10), b.column(11)))]
            p = [then(base, s, k - 1, without_head(base, x, o, k - 1)) for k, s, o, x in zip(n, seam, off, _whole(b.column(12), b.column(13)))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *_halves(f), *_halves(p), b.column(2), b.column(3), b.column(4)],
                                             names=["conv_id", "depth", "f1", "f2", "p1", "p2", "ref", "bytes", "ends"])

    own = own.mapInArrow(run, "conv_id long, depth long, f1 long, f2 long, p1 long, p2 long, ref long, bytes long, ends boolean")
    return root.unionByName(given).unionByName(own)


def _end_hashes(members: DataFrame) -> DataFrame:
    """(f1, f2, ends_sha256) of the nodes at which conversations end."""
    order = ["f1", "f2", "conv_id"]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids = None, []

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (*at, ids[0])] + [pa.array([",".join(map(str, ids))])], names=[*order, "ids"])

        for batch in batches:
            for a, b, c in zip(*(x.to_pylist() for x in batch.columns)):
                if ids and ((a, b) != at or len(ids) == IDS):
                    yield done()
                    ids = []
                at = (a, b)
                ids.append(c)
        if ids:
            yield done()

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sha = None, hashlib.sha256()

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int64()), pa.array([at[1]], pa.int64()), pa.array([sha.hexdigest()])], names=["f1", "f2", "ends_sha256"])

        for batch in batches:
            for a, b, _, ids in zip(*(x.to_pylist() for x in batch.columns)):
                if (a, b) != at:
                    if at:
                        yield done()
                    at, sha = (a, b), hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
        if at:
            yield done()

    ending = members.where("ends").select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    joined = ending.mapInArrow(pieces, "f1 long, f2 long, conv_id long, ids string")
    return joined.repartition("f1", "f2").sortWithinPartitions(*order).mapInArrow(hashes, "f1 long, f2 long, ends_sha256 string")


def _nodes(members: DataFrame) -> tuple[DataFrame, bool]:
    """The stored nodes, and whether all rows of each agree."""
    sides = ["depth", "ref", "p1", "p2"]
    both = [f(c).alias(f"{name}_{c}") for c in sides for name, f in (("low", F.min), ("high", F.max))]
    some = F.count("p1").alias("parents")
    nodes = members.groupBy("f1", "f2").agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("bytes").alias("bytes"), some, *both)
    agree = F.col("parents").isin(0, F.col("n_convs"))
    for c in sides:
        agree &= F.col(f"low_{c}").eqNullSafe(F.col(f"high_{c}"))
    kept = [F.col(f"low_{c}").alias(c) for c in ("depth", "p1", "p2")]
    nodes = stored(nodes.select("f1", "f2", "n_convs", "conv_id", *kept, ((F.col("n_convs") - 1) * F.col("bytes")).alias("weight"), agree.alias("agree")), "trie-nodes")
    return nodes, nodes.where("not agree").isEmpty()


def _before(nodes: DataFrame) -> DataFrame:
    """(f1, f2, before): the weights of a node's ancestors that have its
    smallest member; a long path is summed in steps of ``STRIDE`` depths."""
    n = nodes.select("f1", "f2", "conv_id", "depth", "weight", F.floor(F.col("depth") / STRIDE).alias("step"))
    steps = n.groupBy("conv_id", "step").agg(F.sum("weight").alias("w"))
    behind = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.withColumn("start", F.sum("w").over(behind(Window.partitionBy("conv_id").orderBy("step")))).drop("w")
    n = n.withColumn("inner", F.sum("weight").over(behind(Window.partitionBy("conv_id", "step").orderBy("depth"))))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return n.join(steps, ["conv_id", "step"]).select("f1", "f2", (zero("start") + zero("inner")).alias("before"))


def trie(conversations: DataFrame, head_turns: Column | None = None, seed: int = 0, bits: int = 127, draws: int = DRAWS) -> DataFrame:
    """One row for each node: conv_id, depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.

    ``head_turns`` gives, from conv_id, how many turns come from the base (at
    most ``HEAD``). ``bits`` below 127 weakens the first draw (for tests).
    """
    if head_turns is None:
        head_turns = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (HEAD + 1)
    conversations = conversations.select("conv_id", "turn", "role", "text")
    with small_batches(conversations.sparkSession, 10_000):
        for draw in range(draws):
            strength = bits if draw == 0 else 127
            base = base_of(seed + draw, strength)
            turns = stored(_turns(conversations, base, strength), "trie-turns")
            same = turns.groupBy("role", "text").agg(F.min("gid").alias("ref"))
            refs = turns.join(same, ["role", "text"]).withColumn("bytes", F.octet_length("text").cast("long"))
            refs = stored(refs.drop("role", "text"), "trie-refs")
            placed = stored(_whole_products(refs, stored(_carried(refs, base), "trie-runs"), base), "trie-placed")
            members = stored(_members(placed, base, head_turns), "trie-members")
            nodes, agree = _nodes(members)
            if agree:
                break
        else:
            raise RuntimeError(f"fingerprints of different prefixes were equal in each of {draws} draws")
        hashes = stored(_end_hashes(members), "trie-hashes")
    children = nodes.where("p1 is not null").groupBy(F.col("p1").alias("f1"), F.col("p2").alias("f2")).agg(F.count("*").alias("n_children"))
    nodes = stored(nodes.drop("agree").join(children, ["f1", "f2"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "trie-children")
    tails = stored(nodes.groupBy("conv_id").agg(F.sum("weight").alias("tail"), F.count_if(F.col("n_children") == 0).alias("leaves")), "trie-tails")
    sums = members.select("f1", "f2", "conv_id").join(tails, "conv_id").groupBy("f1", "f2").agg(F.sum("tail").alias("tails"), F.sum("leaves").alias("n_leaves"))
    parents = nodes.select(F.col("f1").alias("p1"), F.col("f2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(sums, ["f1", "f2"]).join(_before(nodes), ["f1", "f2"]).join(hashes, ["f1", "f2"], "left").join(parents, ["p1", "p2"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", (F.col("tails") - F.col("before")).alias("saved_tokens"),
                      F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(load_table(spark, sf_dir, "conversations"))
