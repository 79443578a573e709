"""Conversation repair and the prefix trie against plain Python, on small, awkward and sample tables."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lendscope.llm import conversation_repair, conversation_trie
from lendscope.llm.queries import Q

CONV = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
SF = "/root/testdata/sf0.001"

AWKWARD = [
    (1, 0, "user", "Hello there."), (1, 1, "assistant", "Yes."), (1, 1, "assistant", "Yes."), (1, 3, "user", "cut off"), (1, None, "system", None),
    (2, None, None, None), (3, 5, "", "empty role."), (3, 7, "usher", "other role."), (None, 1, "user", "no id."), (None, 2, "assistant", "none."),
    (4, 0, "assistant", " \t\n"), (5, 0, "user", "x" * 300_000 + "."), (5, 1, "assistant", "fine!"), (6, -3, "Assistant", "capital?"), (6, 2, "user", "é漢\U0001f600."),
    (-7, 0, "user", "negative."), (-7, 1, "assistant", "id."), (-5, 0, "user", "base of -7."), (-5, 1, "user", "."), (10**12, 1, "user", "far."), (11, 1, "user", "Hello there.")]


def rows_of(df):
    return [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]


def random_table(seed, convs, longest=9):
    rng = random.Random(seed)
    rows = []
    for c in convs:
        for t in range(rng.randrange(1, longest)):
            if rng.random() < 0.9:
                role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None])
                rows.append((c, t if rng.random() < 0.95 else None, role, rng.choice(["Yes.", "No!", "cut", "", None, "a b. ", f"n{rng.randrange(3)}."])))
    return rows


# --- repair ---

def brute_damage(rows):
    out = defaultdict(list)
    for c, t, role, text in rows:
        out[c]
        key = f"{' ' if c is None else c}:{' ' if t is None else t}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        for copy in range(2 if kind == 3 else 1):
            out[c].append((t is not None, t or 0, role.encode(), text.encode(), copy, t, role, text))
    return {c: [r[5:] for r in sorted(v, key=lambda r: r[:5])] for c, v in out.items()}


def brute_repair(rows):
    """Dijkstra over (cost, edit string): the least of all cheapest scripts."""
    seen, faults = set(), []
    for _, role, text in rows:
        last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
        faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else "")
        seen.add((role, text))
    lack = {"": "u", "s": "u", "u": "a", "a": "u"}
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, state, lines = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in ("", "a"):
            break
        name = {"u": "user", "a": "assistant"}[lack[state]]
        heapq.heappush(heap, (cost + 5, audit + "I", i, lack[state], (*lines, f"{name}:")))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, state, lines))
            if faults[i] not in ("blank", "duplicate"):
                more = 5 if faults[i] == "truncated" else 0
                heapq.heappush(heap, (cost + 1 + more, audit + "R", i + 1, lack[state], (*lines, f"{name}:{text}")))
                if role[:1] == lack[state] or (role[:1] == "s" and state == ""):
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, role[:1], (*lines, f"{role}:{text}")))
    turns = [t for t, _, _ in rows if t is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def brute_repaired(rows):
    return {c: brute_repair(v) for c, v in brute_damage(rows).items()}


def repaired(spark, rows):
    return {r[0]: tuple(r[1:]) for r in conversation_repair.repaired(spark.createDataFrame(rows, CONV)).collect()}


def test_repair_of_awkward_rows(spark):
    rows = AWKWARD + [(100 + i, *r[1:]) for i, r in enumerate(AWKWARD)]
    assert repaired(spark, rows) == brute_repaired(rows)
    assert repaired(spark, []) == {}


@pytest.mark.parametrize("seed", range(2))
def test_repair_of_random_conversations(spark, seed):
    rows = random_table(seed, range(400))
    assert repaired(spark, rows) == brute_repaired(rows)


def test_one_conversation_over_many_segments_and_tasks(spark, monkeypatch):
    """Segments of seven rows: scan, stitching and hash pieces give the same answer."""
    monkeypatch.setattr(conversation_repair, "SEGMENT_ROWS", 7)
    rng = random.Random(5)
    rows = [(1, t // 2 if t % 9 == 0 else t, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", "cut", f"text {t}.", f"{t}"])) for t in range(600)]
    rows += random_table(6, range(2, 30), 20)
    assert repaired(spark, rows) == brute_repaired(rows)


def test_long_texts_leave_in_pieces(spark):
    rows = [(1, t, ("user", "assistant")[t % 2], f"{t} " + "word " * 120_000 + "end.") for t in range(12)]
    assert repaired(spark, rows) == brute_repaired(rows)


def test_repair_query(spark):
    rows = rows_of(spark.read.parquet(f"{SF}/conversations.parquet"))
    found = Q["op12_conversation_repair"](spark, SF)
    assert found.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert {r[0]: tuple(r[1:]) for r in found.collect()} == brute_repaired(rows)


def test_repair_ignores_other_columns(spark):
    df = spark.createDataFrame(AWKWARD, CONV)
    more = df.withColumns({c: F.lit("x") for c in ("seg", "gid", "symbol", "audit", "only", "kind", "copy", "role_", "cost")})
    key = lambda r: str(r[0])
    assert sorted(conversation_repair.repaired(more).collect(), key=key) == sorted(conversation_repair.repaired(df).collect(), key=key)


def test_block_tables_equal_single_steps():
    t = conversation_repair.tables()
    assert len(t.vectors) < 256
    rng = random.Random(1)
    for _ in range(300):
        symbols = bytes(rng.randrange(9) for _ in range(rng.randrange(0, 14)))
        before, cost, ends = t.summary(symbols)
        for v in range(len(t.vectors)):
            at, total = v, 0
            for s in reversed(symbols):
                total += int(t.less[s, at])
                at = int(t.before[s, at])
            assert (before[v], cost[v]) == (at, total)
            for q in range(4):
                assert t.trace(symbols, v, q)[1] == ends[v, q]


# --- trie ---

def brute_trie(rows, head=lambda c: zlib.crc32(str(c).encode()) % 9):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, (role or "").encode(), (text or "").encode()))
    own = {c: [r[2:] for r in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = head(c)
        base = c - int(abs(c) % 5 * (1 if c >= 0 else -1))
        rebuilt = tuple(own.get(base, [])[:h] + own[c][h:])
        for d in range(len(rebuilt) + 1):
            members[rebuilt[:d]].append(c)
        ends[rebuilt].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[x] for x in children[node]) or 1
        own_saved = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        saved[node] = own_saved + sum(saved[x] for x in children[node])
    return sorted((members[n][0], len(n), members[n[:-1]][0] if n else None, len(members[n]), len(children[n]), leaves[n], saved[n],
                   hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest()) for n in members)


def trie(spark, rows, **kw):
    return sorted(tuple(r) for r in conversation_trie.trie(spark.createDataFrame(rows, CONV), **kw).collect())


def test_trie_of_awkward_rows(spark):
    rows = AWKWARD + [(c, t, role, text) for c in range(20, 40) for _, t, role, text in AWKWARD[:4]]
    assert trie(spark, rows) == brute_trie(rows)
    assert trie(spark, []) == []
    assert trie(spark, [(None, 1, "user", "x")]) == []


@pytest.mark.parametrize("seed", range(2))
def test_trie_of_random_conversations(spark, seed):
    rows = random_table(seed, [*range(-30, 300), *range(1000, 1400, 3)], 14)
    assert trie(spark, rows) == brute_trie(rows)


def test_copies_and_long_conversations(spark, monkeypatch):
    """One conversation of many turns over several tasks, and many copies of one, in small steps."""
    monkeypatch.setattr(conversation_trie, "STRIDE", 16)
    monkeypatch.setattr(conversation_trie, "IDS", 10)
    rows = [(0, t, "user", f"turn {t}") for t in range(500)] + [(5, t, "user", f"turn {t}") for t in range(400)] + [(7, t, "user", f"turn {t}") for t in range(300)]
    rows += [(c, t, "user", f"turn {t}") for c in range(100, 300) for t in range(3)]
    assert trie(spark, rows) == brute_trie(rows)


def test_equal_fingerprints_of_different_prefixes_are_found_out(spark):
    """With three bits the first draw fails the check of the references; the next one is whole."""
    rows = random_table(3, range(60))
    assert trie(spark, rows, bits=3) == brute_trie(rows)
    with pytest.raises(RuntimeError):
        trie(spark, rows, bits=3, draws=1)


def test_trie_query(spark):
    rows = rows_of(spark.read.parquet(f"{SF}/conversations.parquet"))
    found = Q["op13_conversation_prefix_trie"](spark, SF)
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert [f.dataType for f in found.schema][:7] == [T.LongType()] * 7
    assert sorted(tuple(r) for r in found.collect()) == brute_trie(rows)


def test_trie_ignores_other_columns(spark):
    df = spark.createDataFrame(AWKWARD, CONV)
    more = df.withColumns({c: F.lit("x") for c in ("pos", "gid", "run", "ref", "len", "head", "base", "h1", "depth", "tail")})
    assert sorted(map(tuple, conversation_trie.trie(more).collect())) == brute_trie(AWKWARD)


def test_products_compose():
    rng = random.Random(2)
    base = conversation_trie.base_of(0)
    for _ in range(100):
        values = [rng.randrange(conversation_trie.PRIME) for _ in range(rng.randrange(1, 12))]
        whole = []
        h = 0
        for v in values:
            h = (h * base + v) % conversation_trie.PRIME
            whole.append(h)
        k = rng.randrange(1, len(values) + 1)
        rest = conversation_trie.without_head(base, h, whole[k - 1], len(values) - k)
        assert conversation_trie.then(base, whole[k - 1], len(values) - k, rest) == h
