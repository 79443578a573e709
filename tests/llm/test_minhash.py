"""MinHash near-duplicates against plain Python sets, and the parts of the method."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lendscope.llm import minhash_dedup as m
from lendscope.llm.queries import Q

from .conftest import AWKWARD, CLASHING

SF = "/root/testdata/sf0.001"


def brute(rows, percent=85):
    """Sorted rows (doc_id, n_shingles, component_id, kept) by comparing all sets that share a shingle."""
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else frozenset())
    own, by = list(range(len(rows))), {}

    def find(x):
        while own[x] != x:
            own[x] = own[own[x]]
            x = own[x]
        return x

    classes = {}
    for i, s in enumerate(sets):
        if s:
            own[find(i)] = find(classes.setdefault(s, i))
    for s, i in classes.items():
        for x in s:
            by.setdefault(x, []).append(i)
    for a, b in {p for ids in by.values() for p in itertools.combinations(ids, 2)}:
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            own[find(a)] = find(b)
    best = {}
    for i, (doc_id, _) in enumerate(rows):
        r = find(i)
        best[r] = min((x for x in (best.get(r), doc_id) if x is not None), default=None)
    out = [(d, len(sets[i]), best[find(i)] if sets[i] else d) for i, (d, _) in enumerate(rows)]
    return sorted(((*r, r[0] == r[2]) for r in out), key=str)


def found(df, **kw):
    return sorted((tuple(r) for r in m.near_duplicates(df, **kw).collect()), key=str)


def edited(rng, words, share):
    out = list(words)
    for _ in range(max(1, int(len(out) * share))):
        i = rng.randrange(len(out))
        kind = rng.randrange(3)
        if kind == 0:
            out[i] = f"new{rng.randrange(10**6)}"
        elif kind == 1 and len(out) > 6:
            del out[i]
        else:
            out.insert(i, f"ins{rng.randrange(10**6)}")
    return out


def corpus(seed, bases=25, copies=8):
    """Groups of copies with few to many changes, chains of changes, and shared passages."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = rng.choices(vocabulary, k=60)
    texts = []
    for _ in range(bases):
        base = rng.choices(vocabulary, k=rng.choice([1, 3, 5, 8, 30, 120, 400]))
        texts.append(base)
        for k in range(copies):
            texts.append(edited(rng, base if k % 2 else texts[-1], rng.choice([0.0, 0.01, 0.02, 0.03, 0.05])))
        texts.append(base + passage)
    texts = [" ".join(t) for t in texts]
    texts += [t.upper().replace(" ", "\n\t ") for t in texts[::7]]
    ids = rng.sample(range(10_000), len(texts))
    return list(zip(ids, texts))


@pytest.mark.parametrize("seed", range(2))
def test_components_equal_brute_force(spark, documents, seed):
    rows = corpus(seed)
    assert found(documents(rows)) == brute(rows)


def test_split_keys_and_clusters_give_the_same(spark, documents):
    rows = corpus(7, 6, 30)
    assert found(documents(rows), split_above=4, block_shingles=900) == brute(rows)


def test_awkward_rows(spark, documents, nothing):
    rows = [(a, b) for a, b in AWKWARD] + [(20, "a b"), (21, "A\tb"), (22, "b a"), (None, "only without id"), (23, None)]
    assert found(documents(rows, CLASHING + ("cls", "root", "sig", "text_hash", "k", "own", "named", "key"))) == brute(rows)
    assert found(nothing) == []


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    out = Q["op11_minhash_near_dedup"](spark, SF)
    assert dict(out.dtypes) == {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"}
    assert sorted((tuple(r) for r in out.collect()), key=str) == brute(rows)


def test_all_pairs_within_the_distance_meet():
    """Any 23 of 64 values may differ: some key is shared; and keys differ where more do in every chunk."""
    rng = np.random.default_rng(3)
    sig = rng.integers(0, 1 << 16, (200, m.VALUES)).astype(np.uint16)
    other = sig.copy()
    for row in other:
        at = rng.permutation(m.VALUES)[: m.DISTANCE]
        row[at] ^= rng.integers(1, 1 << 16, m.DISTANCE).astype(np.uint16)
    worst = sig.copy()  # two errors in each chunk but one
    for c in m.CHUNKS[:-1]:
        worst[:, c[:2]] ^= 1
    worst[:, m.CHUNKS[-1][0]] ^= 1
    for x in (other, worst):
        assert ((m.index_keys(sig) == m.index_keys(x)).any(axis=1)).all()
    worst[:, m.CHUNKS[-1][1]] ^= 1
    assert not (m.index_keys(sig) == m.index_keys(worst)).any()


def test_chance_of_a_missed_link():
    assert m.missed(85) < 1e-5 and m.missed(90) < 1e-8


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(4)
    apart = []
    for _ in range(200):
        s = rng.integers(0, 1 << 63, 1150, np.uint64)
        apart.append(np.count_nonzero(m.signature(np.unique(s[:1075])) != m.signature(np.unique(s[75:]))))
    assert abs(np.mean(apart) / m.VALUES - (1 - 1000 / 1150)) < 0.012


def test_neighbours_connect_what_all_pairs_connect():
    """Components, blocks and signatures at random: the forest connects what all pairs do."""
    rng = np.random.default_rng(5)
    for _ in range(40):
        n = int(rng.integers(2, 50))
        sig = rng.integers(0, 3, (n, m.VALUES)).astype(np.uint16)
        for i in range(1, n):
            if rng.random() < 0.7:
                sig[i] = sig[rng.integers(0, i)]
                at = rng.permutation(m.VALUES)[: rng.integers(0, 30)]
                sig[i, at] += 7
        comp, own = rng.integers(0, max(2, n // 2), n), rng.integers(0, 2, n)
        pairs = m.met(sig, comp, own, m.DISTANCE)
        two = len(set(own.tolist())) > 1
        wanted = [(a, b) for a in range(n) for b in range(a + 1, n)
                  if comp[a] != comp[b] and (not two or own[a] != own[b]) and np.count_nonzero(sig[a] != sig[b]) <= m.DISTANCE]
        assert set(pairs) <= set(wanted)

        def classes(pairs):
            tree = comp.tolist()
            for a, b in pairs:
                tree = [tree[a] if x == tree[b] else x for x in tree]
            return {frozenset(k for k in range(n) if tree[k] == x) for x in tree}

        assert classes(pairs) == classes(wanted) and len(pairs) < len(set(comp.tolist()))


def test_dealt_blocks_let_all_components_meet(spark):
    rng = random.Random(3)
    rows = [(g, rng.choice([0, 0, 0, 0, 1, 2, 3]) if g else 0, 100 * g + i) for g in range(3) for i in range(60)]
    df = spark.createDataFrame(rows, "g long, comp long, cls long").withColumn("one", F.lit(1))
    groups = {}
    for r in m.dealt(df, "g", "one", 10).collect():
        groups.setdefault((r.g, r.p, r.q), []).append(r)
    pairs = set()
    for (_, p, q), held in groups.items():
        assert len(held) < 45
        pairs |= {(a.cls, b.cls) for a in held for b in held if a.comp != b.comp and (p == q or a.own != b.own)}
    assert pairs == {(a[2], b[2]) for a in rows for b in rows if a[0] == b[0] and a[1] != b[1]}


def test_hub_that_alone_links_its_neighbours(spark, documents):
    """Copies that are linked to one text and not to each other: the first step can't find them all, the second must."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(200)]
    rows = [(500, " ".join(base))]
    for i in range(60):
        words = list(base)
        for j in rng.sample(range(0, 200, 5), 3):
            words[j] = f"x{i}y{j}"
        rows.append((i, " ".join(words)))
    assert {r[2] for r in brute(rows)} == {0}
    for rounds in (0, 1, m.ROUNDS):
        assert found(documents(rows), split_above=8, block_shingles=1000, rounds=rounds) == brute(rows)


def test_long_text_in_bounded_pieces():
    text = b" ".join(b"word%d" % (i % 5003) for i in range(400_000))
    words = text.split()
    assert len(m.word_hashes(text)) == len(words)
    small, m.PIECE = m.PIECE, 1000
    try:
        pieces = m.word_hashes(text)
    finally:
        m.PIECE = small
    assert (pieces == m.word_hashes(text)).all()
    assert len(m.shingle_set(text)) == 5003


def test_kept_is_one_of_each_component(spark, documents):
    rows = corpus(11, 10, 5)
    out = m.near_duplicates(documents(rows))
    assert out.where("kept").count() == out.select("component_id").distinct().count() and out.where(F.col("component_id") > F.col("doc_id")).isEmpty()
