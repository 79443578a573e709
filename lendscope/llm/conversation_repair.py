"""Cheapest repair of a conversation's structure by Four-Russians block tables.

A conversation is a string of symbols (role initial, fault). Repaired role
initials are ``(s?(ua)+)?``, read by an automaton of four states. The cost to
go from each state is a vector of four numbers; less its smallest entry it is
one of a few dozen, found once by following all symbols back from the end. For
every block of four symbols and every such vector, tables give the vector
before the block, the cost that was taken off, and the state that each state
reaches, so conversations are processed four rows a lookup.

Rows are sorted by ranges of (conversation, turn), so one conversation may
span many tasks; segments of bounded rows and bytes are summarised for every
vector that may stand at their end, a scan over a conversation's segments
finds the one that does and the state at their beginning, and each segment is
traced alone: its blocks are expanded backward into a vector for each row, and
forward the least letter of a cheapest edit is taken (D, I, K, R), which is
the least of all cheapest edit strings. Only a conversation's answer itself
(audit and hash) passes through one task, segment by segment.

Defined results: see ``repaired``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lendscope.sources.tables import load_table

from .common import small_batches, stored

#: Costs of the edits, and what a truncated row adds that stays.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: States: nothing yet, after s, after u, after a. The role that each lacks, and where a role leads.
START, S, U, A = range(4)
LACKS = (U, U, A, U)
FINAL = (START, A)
#: Symbols: role (s, u, a, other) + 4 if truncated; a row that must go; nothing (fills a block).
OTHER, MUST_GO, NOTHING, SYMBOLS = 3, 8, 9, 10
BLOCK = 4
#: A segment ends after so many rows or bytes of text.
SEGMENT_ROWS, SEGMENT_BYTES = 4096, 4 << 20


def _leads(role: int, state: int) -> int | None:
    """The state after a row of this role (0 s, 1 u, 2 a) is kept in ``state``."""
    if role == 0:
        return S if state == START else None
    return role + 1 if role + 1 == LACKS[state] else None


def _edits(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of what may be done with a row, least letter first."""
    if symbol == NOTHING:
        return [("", 0, state)]
    out = [("D", DELETE, state)]
    if symbol != MUST_GO:
        extra = TRUNCATED if symbol >= 4 else 0
        kept = _leads(symbol % 4, state) if symbol % 4 != OTHER else None
        if kept is not None:
            out.append(("K", extra, kept))
        out.append(("R", REROLE + extra, LACKS[state]))
    return out


class Tables:
    """Normalised cost-to-go vectors and the transitions of symbols and blocks.

    ``before[symbol][v]`` and ``less[symbol][v]``: the vector before a symbol
    that stands before vector ``v``, and the cost taken off it. ``step[symbol,
    v, state]``: the edit string of that row (inserts first) and the state
    after it. ``block_*`` are the same for the symbols of a block as one number.
    """

    def __init__(self) -> None:
        def settled(cost: list[float]) -> tuple[tuple[int, ...], int]:
            for _ in range(2):  # at most two inserts reach a state where the row, or the end, is free
                cost = [min(c, INSERT + cost[LACKS[q]]) for q, c in enumerate(cost)]
            low = min(cost)
            return tuple(int(c - low) for c in cost), int(low)

        self.end, self.end_cost = 0, 0
        last, self.end_cost = settled([0.0 if q in FINAL else float("inf") for q in range(4)])
        self.vectors, known = [last], {last: 0}
        before, less = [], []
        for v in self.vectors:  # grows while it is read
            row = []
            for symbol in range(SYMBOLS):
                vector, low = settled([min(c + v[to] for _, c, to in _edits(symbol, q)) for q in range(4)])
                if vector not in known:
                    known[vector] = len(self.vectors)
                    self.vectors.append(vector)
                row.append((known[vector], low))
            before.append([b for b, _ in row])
            less.append([x for _, x in row])
        self.before, self.less = np.array(before, np.uint8).T.copy(), np.array(less, np.int64).T.copy()
        self.step = {(symbol, v, q): self._step(symbol, v, q) for symbol in range(SYMBOLS) for v in range(len(self.vectors)) for q in range(4)}
        ends = np.array([[[self.step[symbol, v, q][1] for q in range(4)] for v in range(len(self.vectors))] for symbol in range(SYMBOLS)], np.uint8)
        b, x, e = self.before, self.less, ends
        width = 1
        while width < BLOCK:  # two halves, the left one read after the right one
            n, right = len(b), b[None, :, :]
            pick = np.broadcast_to(right, (n, n, right.shape[2]))
            left = np.arange(n)[:, None, None]
            through = e[left, pick]  # states after the left half, for each vector after the right one
            all_v = np.arange(b.shape[1])[None, None, :, None]
            e2 = e[np.arange(n)[None, :, None, None], all_v, through]
            b, x, e = b[left, pick].reshape(n * n, -1), (x[left, pick] + x[None, :, :]).reshape(n * n, -1), e2.reshape(n * n, -1, 4)
            width *= 2
        self.block_before, self.block_less, self.block_ends = b, x.astype(np.int32), e

    def _step(self, symbol: int, v: int, q: int) -> tuple[str, int]:
        """The least cheapest edits of one row from state ``q``."""
        to, out = self.vectors[v], ""
        now, low = self.vectors[int(self.before[symbol, v])], int(self.less[symbol, v])
        while True:
            for letter, cost, after in _edits(symbol, q):
                if letter > "I" and now[q] == INSERT + now[LACKS[q]]:
                    break  # an insert comes before keeping or reroling
                if low + now[q] == cost + to[after]:
                    return out + letter, after
            out, q = out + "I", LACKS[q]

    def tail(self, q: int) -> str:
        """The inserts after the last row."""
        out = ""
        while q not in FINAL:
            out, q = out + "I", LACKS[q]
        return out

    def blocks(self, symbols: bytes) -> list[int]:
        filled = np.frombuffer(symbols + bytes([NOTHING]) * (-len(symbols) % BLOCK), np.uint8).reshape(-1, BLOCK)
        return (filled @ (SYMBOLS ** np.arange(BLOCK - 1, -1, -1))).tolist()

    def summary(self, symbols: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each vector after ``symbols``: the one before, the cost taken
        off, and the state that each state reaches."""
        n = len(self.vectors)
        at, cost, ends = np.arange(n), np.zeros(n, np.int64), np.tile(np.arange(4, dtype=np.uint8), (n, 1))
        rows = np.arange(n)[:, None]
        for block in reversed(self.blocks(symbols)):
            ends = ends[rows, self.block_ends[block, at]]
            cost += self.block_less[block, at]
            at = self.block_before[block, at]
        return at.astype(np.uint8), cost, ends

    def trace(self, symbols: bytes, after: int, state: int) -> tuple[list[tuple[str, int]], int]:
        """For each row its edits and the state before them; the state at the end."""
        cut = [after]
        numbers = self.blocks(symbols)
        for block in reversed(numbers):
            cut.append(int(self.block_before[block, cut[-1]]))
        cut.reverse()
        out = []
        for k in range(len(numbers)):
            inner, v = symbols[k * BLOCK : (k + 1) * BLOCK], cut[k + 1]
            vectors = []
            for symbol in reversed(inner):
                vectors.append(v)
                v = int(self.before[symbol, v])
            for symbol, v in zip(inner, reversed(vectors)):
                edits, to = self.step[symbol, v, state]
                out.append((edits, state))
                state = to
        return out, state


_TABLES: list[Tables] = []


def tables() -> Tables:
    """Built once a process, from the costs and the automaton."""
    if not _TABLES:
        _TABLES.append(Tables())
    return _TABLES[0]


def _one_space(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copy): the rows after the contract's damage."""
    kind = F.crc32(F.concat(_one_space(F.col("conv_id")), F.lit(":"), _one_space(F.col("turn"))).cast("binary")) % 20
    role, text = _one_space(F.col("role")), _one_space(F.col("text"))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind")).where("kind <> 0")
    changed = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), changed.alias("text"), F.explode(copies).alias("copy"))


def _sorted_rows(rows: DataFrame) -> DataFrame:
    """The rows in order of (conv_id, turn, role, text, copy), nulls first:
    ``gid`` numbers them, ``seg`` is the gid of their segment's first row."""
    order = ["conv_id", "turn", "role", "text", "copy"]
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    ended = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(OTHER)
    symbol = F.when(blank, MUST_GO).otherwise(role + F.when(ended, 0).otherwise(4)).cast("int")
    fields = [T.StructField("conv_id", rows.schema["conv_id"].dataType), T.StructField("turn", rows.schema["turn"].dataType), T.StructField("role", T.StringType()),
              T.StructField("text", T.StringType()), T.StructField("initial", T.IntegerType()), T.StructField("symbol", T.IntegerType())]
    schema = T.StructType([*fields, T.StructField("digest", T.BinaryType()), T.StructField("seg", T.LongType()), T.StructField("gid", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gid = TaskContext.get().partitionId() << 33
        conv, seg, held, first = None, gid, 0, True
        for batch in batches:
            digests, segs = [], []
            for c, role, text in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3)):
                role, text = role.as_buffer().to_pybytes(), text.as_buffer().to_pybytes()
                if first or c != conv or gid - seg >= SEGMENT_ROWS or held >= SEGMENT_BYTES:
                    conv, seg, held, first = c, gid, 0, False
                digests.append(xxhash.xxh3_128_digest(b"%d:%b:%b" % (len(role), role, text)))
                segs.append(seg)
                held += len(text)
                gid += 1
            gids = pa.array(range(gid - batch.num_rows, gid), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.binary()), pa.array(segs, pa.int64()), gids], names=schema.names)

    rows = rows.repartitionByRange(*(F.col(c).asc_nulls_first() for c in order)).sortWithinPartitions(*(F.col(c).asc_nulls_first() for c in order))
    return rows.select("conv_id", "turn", "role", "text", role.cast("int").alias("initial"), symbol.alias("symbol")).mapInArrow(run, schema)


def _segments(rows: DataFrame) -> DataFrame:
    """One row a segment: symbols, counts, what stitching needs, and the summary for every vector."""
    conv, turn = rows.schema["conv_id"].dataType, rows.schema["turn"].dataType
    first = rows.groupBy("conv_id", "digest").agg(F.min("gid").alias("first"))
    a, b = rows.select("conv_id", "turn", "initial", "symbol", "digest", "seg", "gid").alias("a"), first.alias("b")
    marked = a.join(b, F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("a.digest") == F.col("b.digest")))
    marked = marked.select("a.conv_id", "a.turn", "initial", "symbol", (F.col("gid") != F.col("first")).alias("again"), "seg", "gid")
    whole = ["blank", "duplicate", "truncated", "illegal", "distinct_turns", "first_initial", "last_initial"]
    schema = T.StructType([T.StructField("conv_id", conv), T.StructField("seg", T.LongType()), T.StructField("symbols", T.BinaryType()), *(T.StructField(c, T.LongType()) for c in whole),
                           T.StructField("first_turn", turn), T.StructField("last_turn", turn), T.StructField("min_turn", turn),
                           T.StructField("before", T.BinaryType()), T.StructField("cost", T.BinaryType()), T.StructField("ends", T.BinaryType())])

    def one(conv_id: object, seg: int, turns: list, initials: list[int], symbols: list[int], again: list[bool]) -> tuple:
        blank = [s == MUST_GO for s in symbols]
        duplicate = [x and not y for x, y in zip(again, blank)]
        truncated = sum(4 <= s < MUST_GO and not x for s, x in zip(symbols, again))
        known = [t for t in turns if t is not None]
        illegal = sum(_apart(x, y) for x, y in zip(initials, initials[1:]))
        symbols = bytes(MUST_GO if x else s for s, x in zip(symbols, again))
        before, cost, ends = tables().summary(symbols)
        return (conv_id, seg, symbols, sum(blank), sum(duplicate), truncated, illegal, len(set(known)), initials[0], initials[-1],
                turns[0], turns[-1], min(known, default=None), before.tobytes(), cost.tobytes(), ends.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[0][1] != row[1]:
                    out.append(one(held[0][0], held[0][1], *map(list, zip(*(r[2:] for r in held)))))
                    held = []
                held.append(row)
            yield _batch(out, schema)
        if held:
            yield _batch([one(held[0][0], held[0][1], *map(list, zip(*(r[2:] for r in held))))], schema)

    dealt = marked.repartition("seg").sortWithinPartitions("seg", "gid").select("conv_id", "seg", "turn", "initial", "symbol", "again")
    return dealt.mapInArrow(run, schema)


def _apart(x: int, y: int) -> bool:
    """Whether a row of initial ``y`` may not follow one of initial ``x``."""
    return (x, y) not in ((0, 1), (1, 2), (2, 1))


def _arrow_type(t: T.DataType) -> pa.DataType:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    return kinds[t.simpleString()]


def _batch(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, _arrow_type(f.dataType)) for c, f in zip(cols, schema)], names=schema.names)


def _scan(segments: DataFrame) -> DataFrame:
    """For each segment the vector after it, the state before it, and whether
    it is its conversation's last and only one; on the last, what stitching
    adds to the counts, and the cost."""
    conv = segments.schema["conv_id"].dataType
    schema = T.StructType([T.StructField("conv_id", conv), T.StructField("seg", T.LongType()), T.StructField("after", T.IntegerType()), T.StructField("state", T.IntegerType()),
                           T.StructField("last", T.BooleanType()), T.StructField("only", T.BooleanType()), T.StructField("more_illegal", T.LongType()),
                           T.StructField("shared_turns", T.LongType()), T.StructField("total", T.LongType())])
    names = ["conv_id", "seg", "first_initial", "last_initial", "first_turn", "last_turn", "before", "cost", "ends"]

    def one(held: list[tuple]) -> list[tuple]:
        v, total, after = tables().end, tables().end_cost, []
        for row in reversed(held):
            after.append(v)
            total += int(np.frombuffer(row[7], np.int64)[v])
            v = row[6][v]
        total += tables().vectors[v][START]
        after.reverse()
        state, out = START, []
        for row, x in zip(held, after):
            out.append([row[0], row[1], x, state, False, len(held) == 1, 0, 0, 0])
            state = row[8][4 * x + state]
        pairs = list(zip(held, held[1:]))
        out[-1][4] = True
        out[-1][6:] = [sum(_apart(a[3], b[2]) for a, b in pairs), sum(a[5] is not None and a[5] == b[4] for a, b in pairs), total]
        return [tuple(r) for r in out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[0][0] != row[0]:
                    out += one(held)
                    held = []
                held.append(row)
            yield _batch(out, schema)
        if held:
            yield _batch(one(held), schema)

    return segments.select(*names).repartition("conv_id").sortWithinPartitions("conv_id", "seg").mapInArrow(run, schema)


def _traced(segments: DataFrame, scan: DataFrame) -> DataFrame:
    """(conv_id, seg, only, audit, acts): a segment's edits, and for each of its
    rows the letters of inserted roles followed by K, D, U or A."""
    s = scan.select(F.col("seg").alias("at"), "after", "state", "last", "only")
    joined = segments.select("conv_id", "seg", "symbols").join(s, F.col("seg") == F.col("at")).select("conv_id", "seg", "only", "symbols", "after", "state", "last")
    schema = T.StructType([T.StructField("conv_id", segments.schema["conv_id"].dataType), T.StructField("seg", T.LongType()), T.StructField("only", T.BooleanType()),
                           T.StructField("audit", T.StringType()), T.StructField("acts", T.StringType())])

    def one(conv_id: object, seg: int, only: bool, symbols: bytes, after: int, state: int, last: bool) -> tuple:
        rows, end = tables().trace(symbols, after, state)
        if last:
            rows = [*rows, (tables().tail(end), end)]
        acts = []
        for edits, q in rows:
            act = ""
            for letter in edits:
                to = LACKS[q]
                role = "ua"[to - U]
                act += {"I": role, "K": "K", "D": "D", "R": role.upper()}[letter]
                q = to if letter == "I" else q
            acts.append(act)
        return conv_id, seg, only, "".join(edits for edits, _ in rows), " ".join(acts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _batch([one(*row) for row in zip(*(c.to_pylist() for c in batch.columns))], schema)

    return joined.mapInArrow(run, schema)


def repaired_lines(rows: DataFrame, traced: DataFrame) -> DataFrame:
    """(conv_id, seg, piece, lines, sha): each segment's repaired ``role:text``
    lines, every one after a line break, in pieces of bounded size. A segment
    meets its edits in one task. A conversation that is one piece is hashed
    at once: its ``sha`` stands in place of its lines."""
    conv = rows.schema["conv_id"].dataType
    head = traced.select("conv_id", "seg", F.lit(-1).cast("long").alias("gid"), "only", F.col("acts").alias("role"), F.lit("").alias("text"))
    body = rows.select("conv_id", "seg", "gid", F.lit(None).cast("boolean").alias("only"), "role", "text")
    dealt = head.unionByName(body).repartition("seg").sortWithinPartitions("seg", "gid").select("conv_id", "seg", "gid", "only", "role", "text")
    schema = T.StructType([T.StructField("conv_id", conv), T.StructField("seg", T.LongType()), T.StructField("piece", T.IntegerType()),
                           T.StructField("lines", T.BinaryType()), T.StructField("sha", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple | None = None
        acts: list[str] = []
        alone, k, piece, lines = False, 0, 0, bytearray()

        def inserted(act: str) -> None:
            for x in act:
                if x in "ua":
                    lines.extend(b"\nuser:" if x == "u" else b"\nassistant:")

        def done() -> tuple:
            for act in acts[k:]:  # inserts after the last row
                inserted(act)
            if alone and not piece:
                return (*at, 0, None, hashlib.sha256(lines[1:]).hexdigest())
            return (*at, piece, bytes(lines), None)

        for batch in batches:
            out = []
            for conv_id, seg, gid, only, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if gid < 0:
                    if at is not None:
                        out.append(done())
                    at, alone, acts, k, piece, lines = (conv_id, seg), only, role.split(" "), 0, 0, bytearray()
                    continue
                act, k = acts[k], k + 1
                inserted(act)
                if act[-1] != "D":
                    role = {"K": role, "U": "user", "A": "assistant"}[act[-1]]
                    lines.extend(b"\n" + role.encode() + b":" + text.encode())
                if len(lines) >= 1 << 20:
                    out.append((*at, piece, bytes(lines), None))
                    piece, lines = piece + 1, bytearray()
            yield _batch(out, schema)
        if at is not None:
            yield _batch([done()], schema)

    return dealt.mapInArrow(run, schema)


def _hashes(lines: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256). The pieces of a longer conversation are hashed in order, one at a time."""
    schema = T.StructType([lines.schema["conv_id"], T.StructField("repaired_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, conv, sha, begun = False, None, hashlib.sha256(), False
        for batch in batches:
            out = []
            for conv_id, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not at or conv_id != conv:
                    if at:
                        out.append((conv, sha.hexdigest()))
                    at, conv, sha, begun = True, conv_id, hashlib.sha256(), False
                sha.update(part if begun else part[1:])  # the first line has no break before it
                begun = begun or bool(part)
            yield _batch(out, schema)
        if at:
            yield _batch([(conv, sha.hexdigest())], schema)

    rest = lines.where("sha is null").repartition("conv_id").sortWithinPartitions("conv_id", "seg", "piece").select("conv_id", "lines").mapInArrow(run, schema)
    return lines.where("sha is not null").select("conv_id", F.col("sha").alias("repaired_sha256")).unionByName(rest)


def repaired(conversations: DataFrame) -> DataFrame:
    """One row for each conv_id of ``conversations`` (null is one, too): gaps,
    blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of its
    rows after damage.

    Rows are ordered by turn (nulls first); rows of one turn by role and text,
    a repeated row beside its first. Null roles and texts are one space, as is
    a null in the text whose crc32 decides on the damage. An empty role has no
    initial: it must be reroled or deleted. A conversation without rows after
    damage has zeros, an empty audit and the hash of the empty text; an empty
    table gives no rows; other columns are ignored.
    """
    conversations = conversations.select("conv_id", "turn", "role", "text")
    with small_batches(conversations.sparkSession):
        rows = stored(_sorted_rows(damaged(conversations)), "repair-rows")
        segments = stored(_segments(rows), "repair-segments")
        scan = stored(_scan(segments), "repair-scan")
        traced = stored(_traced(segments, scan), "repair-traced")
        lines = stored(repaired_lines(rows, traced), "repair-lines")
        hashes = stored(_hashes(lines), "repair-hashes")
    sums = [F.sum(c).cast("long").alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "distinct_turns")]
    counts = segments.groupBy("conv_id").agg(*sums, F.min("min_turn").alias("low"), F.max("last_turn").alias("high"))
    stitched = scan.where("last").select("conv_id", "more_illegal", "shared_turns", "total")
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("seg", "audit"))), lambda x: x["audit"])
    audits = traced.groupBy("conv_id").agg(F.array_join(pieces, "").alias("audit"))
    out = conversations.select("conv_id").distinct().alias("ids")
    for name, right in (("c", counts), ("t", stitched), ("a", audits), ("h", hashes)):
        right = right.alias(name)
        out = out.join(right, F.col("ids.conv_id").eqNullSafe(F.col(f"{name}.conv_id")), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    gaps = F.col("high") - F.col("low") + 1 - (F.col("distinct_turns") - F.col("shared_turns"))
    return out.select("ids.conv_id", zero(gaps).alias("gaps"), *(zero(F.col(c)).alias(c) for c in ("blank", "duplicate", "truncated")),
                      zero(F.col("illegal") + F.col("more_illegal")).alias("illegal"), zero(F.col("total")).alias("cost"), F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(load_table(spark, sf_dir, "conversations"))
