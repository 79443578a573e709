"""Operators that judge texts, against brute force."""

import base64
import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lendscope.llm import decontamination as dec
from lendscope.llm import language_model as lm
from lendscope.llm import line_quality, pii, quality_rules, toxicity
from lendscope.llm import simhash_dedup as sim
from lendscope.llm.common import crc_mod, raw, small_batches

from .conftest import PROSE

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.01"


def _texts(n=400):
    import duckdb

    return duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet' order by doc_id limit {n}").fetchall()


# op1


def _base(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [(2, *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(digits(m.group())) <= 19 and pii.luhn(digits(m.group()))]
    out += [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m.group())) <= 15]
    return out


def test_base_patterns_equal_plain_ones():
    rng = random.Random(1)
    for _ in range(20_000):
        t = "".join(rng.choice("ab1.2@+-() 39%\n4é") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(t) == _base(t), t
    for _, t in _texts():
        assert pii.base_spans(t) == _base(t)
    assert pii.base_spans("9" * 300_000 + "." + "300." * 100_000) == []  # linear in long runs


def test_field_prefers_whole_segments():
    rng = random.Random(3)
    examples = []
    for i in range(60):
        text = rng.choice([f"write to a{i}@mail{i % 9}.example.com now", f"ring +1 (2{i:02d}) 555-65{i:02d} today", f"host 10.{i}.3.{i} is up", f"version {i}.0 of 4"])
        spans = pii.base_spans(text)
        examples.append((text, spans))
        if (more := pii.variants(text, spans, rng)) is not None:
            examples.append(more)
    field = pii.train(examples)
    found = pii.field_spans("please ring (499) 555-6503 today", [], field)
    assert [(pii.KINDS[k], "please ring (499) 555-6503 today"[a:b]) for k, a, b in found] == [("phone", "(499) 555-6503")]
    assert pii.field_spans("version 3.0 of 4", [], field) == []


def _address_field():
    rng = random.Random(4)
    examples = []
    for i in range(240):
        text = rng.choice([f"please write to ann{chr(97 + i % 26)}@mail.example.com now", f"ring +1 (2{i:03d}) 555-65 today", f"we met at {i} by the mill", "she looked at the old red dot on it", f"version {i}.0 of 4"])
        spans = pii.base_spans(text)
        examples.append((text, spans))
        if (more := pii.variants(text, spans, rng)) is not None:
            examples.append(more)
    return pii.train(examples)


def test_spelled_out_addresses_are_found_in_short_and_long_texts():
    field = _address_field()
    river = "The river ran past the old mill and the miller counted every sack of grain. "
    for form in ("john at mail dot com", "john at mail dot example dot com", "john(at)mail dot example dot com", "john (at) mail (dot) example (dot) com"):
        text = f"room 7 is where you leave your things for the week, write to {form} please"
        for t in (text, text + " " + river * 40, river * 40 + text):
            assert form in [t[a:b] for _, a, b in pii.field_spans(t, [], field)], (form, len(t))
        shift = len(river) * 40
        assert [[(a + shift, b + shift) for a, b in s] for s in pii.stretches(text)] == pii.stretches(river * 40 + text)
    assert pii.stretches(river * 40) == []


def test_runs_are_not_cut():
    table = " ".join(str(i % 10) for i in range(1000))
    assert [len(s) for s in pii.stretches(table)] == [1000]
    weights = np.zeros((len(pii.KINDS) + 1, pii.N_FEATURES))
    weights[1:, 0], weights[1, pii.N_FEATURES - 1] = -9, 18  # sure of whole addresses
    field = pii.Field(weights)
    for n in range(56, 72):  # across the 64th chunk
        t = " ".join("x7;" for _ in range(n)) + " john at mail dot example dot com"
        assert "john at mail dot example dot com" in [t[a:b] for _, a, b in pii.field_spans(t, [], field)], n


@pytest.fixture(scope="module")
def fitted_field(spark):
    """The field as it is registered, fitted on the larger sample; and whole texts to plant in."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    return pii.fit(docs), [r.text for r in docs.where("length(text) > 200").orderBy(F.xxhash64("doc_id", F.lit(1))).limit(1500).collect()]


PLANTED = ["john at mail dot com", "john (at) mail (dot) com", "john at mail.com", "john @ mail . com", "john [at] mail.com", "10[.]2[.]33[.]4", "10 . 2 . 33 . 4",
           "415.555.6123", "(415) 555-6123", "4111.1111.1111.1111", "4111/1111/1111/1111"]


@pytest.mark.parametrize("form", PLANTED)
def test_fitted_field_finds_planted_forms(fitted_field, form):
    field, texts = fitted_field
    rng = random.Random(form)
    found = 0
    for text in rng.sample(texts, 100):
        at = rng.choice([m.start() for m in re.finditer(" ", text)])
        text = f"{text[:at]} {form}{text[at:]}"
        found += form in [text[a:b] for _, a, b in pii.field_spans(text, pii.base_spans(text), field)]
    assert found >= 90


def test_fitted_field_leaves_clean_texts_alone(spark, fitted_field):
    """What it adds to ten thousand documents are numbers that the base patterns lose where numbers stand side by side."""
    field, _ = fitted_field
    added = []
    for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text").collect():
        if r.text:
            added += [(k, r.text[a:b]) for k, a, b in pii.field_spans(r.text, pii.base_spans(r.text), field)]
    right = [s for k, s in added if (k == 2 and pii.luhn("".join(filter(str.isdigit, s)))) or (k == 3 and s.startswith("+"))]
    assert len(added) - len(right) <= 10 and len(added) <= 30


def test_long_tables_and_many_addresses_in_bounded_memory(fitted_field):
    import time
    import tracemalloc

    field, _ = fitted_field
    took = []
    for n in (1000, 4000):
        text = " ".join(f"a{i}@mail{i}.example.com and 10 . 2 . {i % 250} . 4 ;" for i in range(n))
        base, t = pii.base_spans(text), time.perf_counter()
        found = pii.field_spans(text, base, field)
        took.append(time.perf_counter() - t)
        assert len(base) == n and len(found) >= 0.95 * n
    assert took[1] < 8 * took[0]  # four times as many
    table = " ".join(str(i * 7919 % 10_007) for i in range(12_000))
    tracemalloc.start()
    pii.field_spans(table, [], field)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8_000_000 + 600 * 12_000  # one run of as many chunks, and a piece of it; all features held would be 1,800 bytes a chunk


def test_pieces_carry_their_sums_over(fitted_field):
    field, texts = fitted_field
    text = " ".join(t[:300] + f" 415.555.6{i:03d} 10 . 2 . {i} . 4 7 9 john at mail dot com" for i, t in enumerate(texts[:40]))
    whole = pii.field_spans(text, pii.base_spans(text), field)
    before, pii.PIECE = pii.PIECE, 3
    try:
        assert pii.field_spans(text, pii.base_spans(text), field) == whole and len(whole) >= 70
    finally:
        pii.PIECE = before


def test_batches_expect_what_single_stretches_do():
    field = _address_field()
    rng = random.Random(8)
    prepared = {}
    for i in range(40):
        text = f"x{i} ring +1 (2{i:03d}) 555-65 or 1 2 3 4 5 6 7 8 9 {rng.randrange(99)} and mail a at b dot c"
        for run in pii.stretches(text):
            prepared.setdefault(len(run), []).append(pii._labelled(text, run, {}))
    for n, some in prepared.items():
        want = np.zeros_like(field.weights)
        for segments, rows, _ in some:
            want += pii._forward_backward(n, segments, pii._scores(rows, segments, field.weights))[1].T @ rows
        assert np.allclose(pii._Batch(n, some).expected(field.weights), want)


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(0)
    segments = [(i, j, i, j) for i in range(4) for j in range(i + 1, min(4, i + 3) + 1)]
    scores = rng.normal(size=(len(segments), 3))
    scores[[s[1] - s[0] > 1 for s in segments], 0] = -np.inf

    def paths(at):
        if at == 4:
            yield []
        for x, s in enumerate(segments):
            if s[0] == at:
                for k in range(3):
                    if np.isfinite(scores[x, k]):
                        for rest in paths(s[1]):
                            yield [(x, k), *rest]

    total, marginal = 0.0, np.zeros_like(scores)
    for p in paths(0):
        v = np.exp(sum(scores[x, k] for x, k in p))
        total += v
        for x, k in p:
            marginal[x, k] += v
    z, got = pii._forward_backward(4, segments, scores)
    assert np.isclose(z, np.log(total)) and np.allclose(got, marginal / total)


def test_pii_query_rows(spark, documents):
    rows = [(i, t) for i, t in _texts(150)] + [(9999, "é a.b@c.de +1 (499) 555-6503")]
    df = documents(rows)
    out = {r.doc_id: r for r in pii.personal_data(df, pii.fit(df)).collect()}
    for i, t in rows:
        base = _base(t)
        assert [out[i][f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in base) for k in range(4)]
        assert out[i].base_sha256 == hashlib.sha256(pii.joined(base).encode()).hexdigest()
        assert set(pii.joined(base).split(",")) - {""} <= set(out[i].spans.split(","))


# op3


def test_subsequence_kernel_equals_enumeration():
    def features(x):
        out = Counter()
        for c in itertools.combinations(range(len(x)), toxicity.LENGTH):
            out["".join(x[i] for i in c)] += toxicity.DECAY ** (c[-1] - c[0] + 1)
        return out

    dot = lambda a, b: sum(v * b[k] for k, v in features(a).items()) if (b := features(b)) is not None else 0
    rng = random.Random(0)
    words = ["".join(rng.choice("abcé") for _ in range(rng.randint(3, 9))) for _ in range(40)]
    got = toxicity.Landmarks.of(words[:8]).likeness([*words, "ab", ""])
    want = np.array([[np.exp(-toxicity.SHARPNESS * (1 - dot(s, z) / np.sqrt(dot(s, s) * dot(z, z)))) for z in words[:8]] for s in words])
    assert np.allclose(got[:-2], want, atol=1e-5)
    assert np.allclose(got[-2:], np.exp(-toxicity.SHARPNESS))


@pytest.fixture(scope="module")
def toxic_model():
    rng = random.Random(2)
    usual = ["river", "mill", "grain", "evening", "valley", "counted", "yard", "before", "sacks", "bell", "stone", "winter", "garden", "bridge", "letter"]
    bad = ["frobnik", "grumbol", "skwizzle"]
    texts, y = [], []
    for i in range(300):
        words = [rng.choice(usual) for _ in range(30)]
        if i % 3 == 0:
            words[rng.randrange(30)] = rng.choice(bad)
            words[rng.randrange(30)] = rng.choice(bad)
        texts.append(" ".join(words) + ".")
        y.append(int(i % 3 == 0))
    return toxicity.fit_texts(texts, np.array(y), 1 / 3)


def test_toxicity_tolerates_gaps_and_insertions(toxic_model):
    clean = "the river ran past the mill in the valley before winter"
    for form in ("frobnik", "frobbnik", "fro-bnik", "f.r.o.b.n.i.k", "f r o b n i k", "FROBNIK!", "frob_nik"):
        text = f"{clean} you {form} and {form}"
        assert toxic_model.score([text], {})[0] >= toxicity.THRESHOLD, form
    assert (toxic_model.score([clean, "", "a b", "x" * 5000], {}) < toxicity.THRESHOLD).all()


@pytest.mark.parametrize("form", ["f * r * o * b * n * i * k", "f. r. o. b. n. i. k", "f. r. o. b. n. i. k.", "f . r . o . b . n . i . k", "f ! r ! o ! b ! n ! i ! k", "f - r o - b n * i k"])
def test_runs_go_on_over_marks(toxic_model, form):
    assert "frobnik" in [w for s in toxicity.sentences(f"You {form} there. The river ran.") for w in s]
    assert toxic_model.score([f"the river ran past the mill you {form} and {form}"], {})[0] >= toxicity.THRESHOLD


# op4


def test_toxicity_on_held_out_rows(spark):
    """At sf0.1, all languages: at least nine of ten toxic documents, at most one of two hundred clean ones."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = crc_mod("doc_id", 3) == 1
    model = toxicity.fit(docs, labels, ~held)
    rows = toxicity.toxicity(docs.join(labels.select("doc_id"), "doc_id").where(held), model, held).join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").collect()
    toxic, clean = [r for r in rows if r.toxic == 1], [r for r in rows if r.toxic == 0]
    assert len(toxic) > 120 and sum(r.predicted for r in toxic) >= 0.9 * len(toxic)
    assert sum(r.predicted for r in clean) <= 0.005 * len(clean)
    for lang in ("de", "fr"):
        some = [r for r in toxic if r.lang == lang]
        assert sum(r.predicted for r in some) >= 0.8 * len(some)


def test_rule_counts_equal_plain_ones():
    for _, t in [*_texts(200), (0, ""), (0, "a a a a a a a\n\n a \n a "), (0, "x y\x1cz é")]:
        words = WORD.findall(t)
        windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        again = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want = [len(words), sum(map(len, words)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(again)]
        assert quality_rules.rule_counts(t.encode())[0] == want


def test_forest_finds_what_lies_apart():
    rng = np.random.default_rng(1)
    usual = rng.normal(0.5, 0.05, (500, 3))
    odd = rng.uniform(0.8, 1.0, (20, 3))
    both = np.concatenate([usual, odd])
    forest = quality_rules.grow_forest(usual, both.min(0), both.max(0))
    cut = quality_rules.calibrated(forest.scores(usual), forest.scores(odd))
    assert (forest.scores(odd) > cut).mean() > 0.95 and (forest.scores(usual) > cut).mean() <= 0.004


# op5


def test_windows_equal_brute_force():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [" ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 5, 6, 7, 12, 20, 33, 60, 120]))) for _ in range(40)]
    texts = []
    for i in range(120):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 200))]
        if i % 2:
            item = items[rng.randrange(len(items))].split()
            at = rng.randint(0, len(words))
            words[at:at] = item if i % 4 == 1 else item[1:]
        texts.append(" ".join(words).upper().encode())
    index = dec.build_index(list(range(len(items))), [x.encode() for x in items])
    for one in index.sizes.values():
        one.build()
    got = dec.search(texts, index)
    assert got == dec.search(texts, index, segment=64)  # also where sums are made in short pieces
    for text, found in zip(texts, got):
        words = text.lower().decode().split()
        for i, item in enumerate(items):
            t = item.split()
            width = min(5, len(t))
            sh = lambda w: Counter(tuple(w[k : k + width]) for k in range(len(w) - width + 1))  # noqa: E731, B023
            best = max((dec.weighted_similarity(sh(words[s : s + len(t)]), sh(t)) for s in range(max(1, len(words) - len(t) + 1))), default=0.0)
            if i in found:
                assert found[i] <= best + 1e-9 and found[i] >= 0.8
            assert (i in found) == (best >= 1.0) or 0.8 <= best < 1.0


def _altered_items(n, change, inside, rng, trials=100):
    """Items, and as many texts that each have one item, changed; only those still at 0.8 count."""
    items = [[f"v{rng.randrange(5000)}" for _ in range(n)] for _ in range(trials)]
    texts, counts = [], []
    for item in items:
        words = list(item)
        if change < 0:
            cut = rng.randint(0, -change)
            words = words[cut : n + change + cut]
        for _ in range(change):
            at = rng.randrange(len(words))
            words[at : at + rng.randint(0, 1)] = ["changed"] * rng.randint(0, 1)
        around = [[f"f{rng.randrange(5000)}" for _ in range(rng.randint(50, 300))] if inside else [] for _ in range(2)]
        words = [*around[0], *words, *around[1]]
        sh = lambda w: Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        counts.append(max(dec.weighted_similarity(sh(words[max(s, 0) : s + n]), sh(item)) for s in range(-n // 4, max(1, len(words) - n // 2))) >= 0.8)
        texts.append(" ".join(words).encode())
    return [" ".join(x).encode() for x in items], texts, counts


@pytest.mark.parametrize("n, change, inside, least", [
    (60, -8, False, 1.0), (60, -10, False, 1.0), (100, -15, False, 1.0), (100, -18, False, 1.0), (60, -6, True, 1.0), (100, -10, True, 1.0), (15, -1, True, 1.0),
    (60, 1, True, 0.98), (60, 2, True, 0.95), (100, 2, True, 0.95), (100, 3, True, 0.95), (60, 1, False, 0.98)])
def test_shortened_and_changed_items_are_found(n, change, inside, least):
    items, texts, counts = _altered_items(n, change, inside, random.Random(n + change))
    index = dec.build_index(list(range(len(items))), items)
    for one in index.sizes.values():
        one.build()
    got = dec.search(texts, index)
    hits = [i in found for i, (found, c) in enumerate(zip(got, counts)) if c]
    assert len(hits) >= 5 and np.mean(hits) >= least
    assert got == [dec.search([t], index)[0] for t in texts]  # whatever stands beside a text
    assert got == dec.search(texts[::-1], index)[::-1]


def test_windows_at_every_word_are_compared():
    begins = np.array([0, 30, 30, 33, 50])
    assert dec.window_starts(begins, 12).tolist() == [*range(19), *range(33, 39)] and dec.window_starts(begins[:1], 5).tolist() == []
    items, texts, _ = _altered_items(100, 3, True, random.Random(11), trials=150)
    index = dec.build_index(list(range(len(items))), items)
    for one in index.sizes.values():
        one.build()
    got = dec.search(texts, index)
    (size, one), found = next(iter(index.sizes.items())), 0
    for i, text in enumerate(texts):  # each text with its own item, by all windows of both
        words, n = dec.word_hashes([text])[0], index.lengths[i]
        h = dec.shingle_hashes(words, 5)
        prints = dec.simhashes(dec.bit_sums(h), np.arange(len(words) - size + 1), size - 4)
        near = np.bitwise_count(prints[:, None] ^ one.prints[one.item == i][None, :]) <= dec.RADIUS
        places = {int(at - offset) for at, offset in zip(*np.nonzero(near))}
        best = max((dec.weighted_similarity(Counter(h[max(p, 0) : p + n - 4].tolist()), index.shingles[i]) for p in places), default=0.0)
        assert got[i].get(i, 0.0) == (best if best >= 0.8 else 0.0)
        found += best >= 0.8
    assert found >= 20
    assert any(s.spare is not None for s in index.sizes.values())
    for s in index.sizes.values():
        s.spare = None  # also those that can't be part of a match
    assert got == dec.search(texts, index)


@pytest.mark.parametrize("similarity", [0.0, 0.3, 0.8, 1.0])
def test_windows_that_are_passed_over_are_in_no_match(similarity):
    rng = random.Random(12)
    vocabulary = [f"v{i}" for i in range(60)]
    items = [" ".join(rng.choices(vocabulary, k=k)).encode() for k in (1, 2, 4, 5, 6, 7, 9, 14, 30, 70) * 3]
    texts = []
    for i in range(60):
        words = rng.choices(vocabulary, k=rng.randrange(40))
        part = items[i % len(items)].decode().split()
        words[len(words) // 2 : len(words) // 2] = part[rng.randrange(2) : len(part) - rng.randrange(2)]
        texts.append(" ".join(words).encode())
    index = dec.build_index(list(range(len(items))), items, similarity)
    for one in index.sizes.values():
        one.build()
    got = dec.search(texts, index)
    for one in index.sizes.values():
        one.spare = None
    assert got == dec.search(texts, index) and any(got)


def test_several_blocks_of_items_match_as_one_does(spark, documents):
    rng = random.Random(6)
    vocabulary = [f"v{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(8, 60)))) for i in range(30)] + [(None, "no id"), (40, None), (41, "")]
    rows = [(i, f"{PROSE} {' '.join(t for _, t in rng.sample(items[:30], k=rng.randrange(3)))} {PROSE}") for i in range(60)] + [(99, None), (99, items[0][1]), (None, items[1][1])]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = documents(rows, ("found", "uid", "raw"))
    one, many = (sorted(map(str, dec.with_matches(docs, benchmark, ["doc_id", "found"], "matches", block_words=n).collect())) for n in (10**6, 50))
    assert one == many and sum("item_id" in r for r in one) >= 30


def test_index_blocks_find_all_within_radius():
    rng = np.random.default_rng(3)
    prints = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    near = prints.copy()
    for i in range(len(near)):
        for b in rng.choice(64, rng.integers(0, 9), replace=False):
            near[i] ^= np.uint64(1) << np.uint64(b)
    one = dec.SizeIndex(prints, np.arange(500), np.zeros(500, int), 7).build()
    got = set(zip(*(v.tolist() for v in one.find(near))))
    want = {(i, j) for i in range(500) for j in range(500) if int(near[i] ^ prints[j]).bit_count() <= 7}
    assert got == want


# op6


def _fingerprint(t):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


@pytest.mark.parametrize("split_above", [4, 8192])
def test_near_duplicates_equal_brute_force(spark, documents, split_above):
    rng = random.Random(4)
    rows = [(i, t) for i, t in _texts(250)]
    base = [f"v{rng.randrange(3000)}" for _ in range(900)]
    for i in range(150):  # one large group of near copies
        words = list(base)
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = f"n{rng.randrange(9)}"
        rows.append((1000 + i, " ".join(words)))
    prints = {i: _fingerprint(t) for i, t in rows}
    parent = {i: i for i in prints}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(prints, 2):
        if (prints[a] ^ prints[b]).bit_count() <= 2:
            ra, rb = sorted((root(a), root(b)))
            parent[rb] = ra
    out = sim.near_duplicates(documents(rows), split_above=split_above).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in out} == {i: (f"{prints[i]:016x}", root(i)) for i in prints}
    kept = sim.one_of_each(documents(rows), split_above=split_above).collect()
    assert sorted(r.doc_id for r in kept) == sorted({root(i) for i in prints})


def test_trie_links_of_random_balls(spark):
    rng = random.Random(6)
    prints = set()
    for _ in range(30):
        centre = rng.getrandbits(64)
        for _ in range(30):
            x = centre
            for _ in range(rng.randint(0, 4)):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    fps = spark.createDataFrame([(x,) for x in signed], "fp long")
    want = {(min(a, b), max(a, b)) for a, b in itertools.combinations(signed, 2) if ((a ^ b) % (1 << 64)).bit_count() <= 2}
    for split_above in (3, 8192):
        got = [(r.a, r.b) for r in sim.links(fps, split_above=split_above).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_components_of_a_long_chain(spark):
    edges = sim.stored(spark.createDataFrame([((i * 7919) % 200, ((i + 1) * 7919) % 200) for i in range(150)], "a long, b long"), "chain")
    roots = {r.node: r.root for r in sim.components(edges).collect()}
    nodes = {(i * 7919) % 200 for i in range(151)}
    assert set(roots) == nodes and set(roots.values()) == {min(nodes)}


# op9


def test_line_field_equals_enumeration():
    rng = np.random.default_rng(2)
    texts = [b"one line of words", b"a a a a\n### $$$ x\nwords here", b"", b"x\ny\nz\nw"]
    chains = line_quality.Chains.of(texts)
    field = line_quality.Field(rng.normal(size=3 * line_quality.N_OWN), rng.normal(size=(2, 2)), 1.0, 0.0)
    p, pairs = field.marginals(chains)
    want, all_pairs = np.zeros(len(p)), np.zeros((2, 2))
    for d in range(len(texts)):
        at = np.flatnonzero(chains.documents == d)
        e = chains.x[at] @ field.weights
        total, good, both = 0.0, np.zeros(len(at)), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=len(at)):
            v = np.exp(sum(e[i] for i in range(len(at)) if y[i]) + sum(field.links[y[i], y[i + 1]] for i in range(len(at) - 1)))
            total += v
            good += v * np.array(y)
            for i in range(len(at) - 1):
                both[y[i], y[i + 1]] += v
        want[at] = good / total
        all_pairs += both / total
    assert np.allclose(p, want) and np.allclose(pairs, all_pairs)


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_quality_on_held_out_rows(spark, tables):
    docs, labels = tables
    held = crc_mod("doc_id", 5) == 0
    out = line_quality.quality(docs, line_quality.fit(docs, labels, ~held), held).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in out]) > 0.95
    assert np.mean([r.predicted for r in out if r.quality == 1]) > 0.98


def test_rules_keep_good_rows(spark, tables):
    docs, labels = tables
    out = quality_rules.rules(docs, quality_rules.fit(docs, labels)).join(labels, "doc_id").where("not base_failed").collect()
    assert np.mean([r.kept for r in out if r.quality == 1]) > 0.99
    assert np.mean([not r.kept for r in out if r.quality == 0]) > 0.9


def test_rules_are_fitted_on_every_labelled_row(spark):
    words = "abcdefghijklmnop"
    rows = [(i, " ".join(words[(i * 7 + j * (i % 5 + 1)) % 16] * (1 + (i + j) % 6) for j in range(12 + i % 9)), int(i % 4 > 0)) for i in range(9000)]
    rows += [(9000, "Zz!" * 100_000 + " a b c d e f g h i j k", 0)]  # longer than the former sample took
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    stats = quality_rules.labelled_statistics(docs, labels)
    passed = {i for i, t, _ in rows if not quality_rules.base_failed(quality_rules.rule_counts(t.encode())[0])}
    assert stats.count() == len(passed) and stats.where("y = 1").count() == sum(1 for r in rows if r[0] in passed and r[2]) > 3000
    model = quality_rules.fit(docs, labels)
    again = quality_rules.fit(docs.repartition(3), labels)
    assert model.threshold == again.threshold and all((a == b).all() for a, b in zip(model.forest.value, again.forest.value))
    x, y = zip(*((np.array(r.x), r.y) for r in stats.collect()))
    scores, y = model.forest.scores(np.array(x)), np.array(y)
    assert model.threshold == pytest.approx(quality_rules.calibrated(scores[y == 1], scores[y == 0]), abs=1e-12)
    assert (scores[y == 1] > model.threshold).sum() <= 0.002 * (y == 1).sum()


# op10


def test_language_model_base_and_filter(spark, documents):
    rows = [(i, t) for i, t in _texts(300)] + [(9001, None), (9002, ""), (9003, "never seen zzyzx")]
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    tokens = {i: [*[w.lower() if w.isascii() else re.sub("[A-Z]", lambda m: m.group().lower(), w) for w in WORD.findall(t or "")], None] for i, t in rows}
    counts = Counter(w for i, ws in tokens.items() if not held(i) for w in ws)
    n, v = sum(counts.values()), len(counts)
    docs = documents(rows)
    for head in (500_000, 64):  # with few broadcast words the others are joined
        out = {r.doc_id: r for r in lm.scored(docs, crc_mod("doc_id", 10) == 0, head=head).collect()}
        for i, ws in tokens.items():
            r = out[i]
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(ws), sum(counts[w] > 0 for w in ws), n)
            assert np.isclose(r.base_score, sum(np.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws))
    known = [out[i] for i in tokens if not held(i)]
    assert sum(r.score for r in known) > sum(r.base_score for r in known)


def test_filter_too_large_to_broadcast_gives_the_same_scores(spark, documents):
    docs = documents([(i, t) for i, t in _texts(300)] + [(9001, None), (9002, ""), (9003, "never seen zzyzx"), (None, "no id")])
    held = crc_mod("doc_id", 10) == 0
    want, got = (sorted(map(str, lm.scored(docs, held, filter_mb=mb).collect())) for mb in (lm.FILTER_MB, 0))
    assert got == want


def test_bundles_send_each_ngram_once_and_get_the_same_scores(spark, documents, monkeypatch):
    rows = [(i, t) for i, t in _texts(300)] + [(9001, None), (9002, ""), (9003, "never seen zzyzx"), (None, "no id"), (5, "a row of the same id")]
    docs, held = documents(rows), crc_mod("doc_id", 10) == 0
    want = sorted(map(str, lm.scored(docs, held).collect()))
    monkeypatch.setattr(lm, "ASK_BYTES", 60_000)
    first = docs.select("doc_id", held.alias("held_out"), raw("text").alias("raw"))
    bundles = lm.bundled(first)
    assert 5 < bundles.count() < 60
    asked = lm.asked_counts(bundles, 512).collect()
    assert len({(r.n, r.part, r.bundle) for r in asked}) == len(asked)
    total = Counter()
    for r in bundles.collect():
        table, h, counts = lm.unbundled(r.data)
        train = np.repeat(~np.array(table["held_out"].to_pylist()), counts)
        for n, of in ((1, h), (2, lm.pairs(h, counts))):
            some = [a for a in asked if a.bundle == r.bundle and a.n == n]
            assert sum(len(a.hashes) // a.wide for a in some) == len(set(of.tolist()))
            total[n] += int(train.sum())
    answered = lm.answered_counts(lm.asked_counts(bundles, 512), 512)
    one = answered.where("bundle is null").drop("bundle", "levels").orderBy("n", "part").collect()
    assert one == lm.merged_counts(lm.dealt_counts(docs.where(~held), 512)).orderBy("n", "part").collect()
    assert {n: sum(r.tokens for r in one if r.n == n) for n in (1, 2)} == total
    assert sorted(map(str, lm.scored(docs, held, filter_mb=0).collect())) == want


def test_large_filter_without_rows_or_training_documents(spark, documents):
    docs = documents([(i, t) for i, t in _texts(20)] + [(None, None)])
    for some, held in ((docs.where("false"), F.lit(False)), (docs, F.lit(True)), (docs, F.lit(False))):
        want, got = (sorted(map(str, lm.scored(some, held, filter_mb=mb).collect())) for mb in (lm.FILTER_MB, 0))
        assert got == want and len(got) == some.count()


def test_filter_is_within_its_bound(spark, documents):
    docs = documents([(i, " ".join(f"{chr(97 + i)}{chr(97 + j)}" if j % 3 else "x" for j in range(26))) for i in range(26)] + [(99, None), (100, "a " * 500)])
    rows = lm.merged_counts(lm.dealt_counts(docs, 512)).collect()
    assert sum(r.bits // 8 + 1 for r in rows) <= lm.filter_bound(docs) * 1_000_000


def test_bloom_levels():
    rng = np.random.default_rng(0)
    h = np.unique(rng.integers(0, 1 << 63, 3000, dtype=np.uint64))
    c = rng.geometric(0.3, len(h)).astype(np.int64) ** 3
    data, bits = lm.segment(h, c, 2.0)
    f = lm.Filter(np.frombuffer(data, np.uint8), np.array([0]), np.array([bits]), 63)
    got, true = f.levels(h), lm.levels(c, 2.0)
    assert (got >= true).all()  # a filter never misses
    assert (got == true).mean() > 0.9
    other = np.setdiff1d(rng.integers(0, 1 << 63, 200_000, dtype=np.uint64), h)
    assert (f.levels(other) > 0).mean() < 2e-4


@pytest.fixture(scope="module")
def language(spark):
    """The model of the larger sample's training documents, their tokens, words and counts."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    held = crc_mod("doc_id", 10) == 0
    with small_batches(spark):
        model, _ = lm.fit(docs.where(~held))
    rows = docs.select(held.alias("held"), raw("text").alias("raw")).collect()
    h, n = lm.tokens([bytes(r.raw) for r in rows if not r.held])
    words, counts = lm.counted(h)
    return model, [bytes(r.raw) for r in rows if r.held], h, n, words, counts


def test_probabilities_after_a_context_add_up_to_one(language):
    """Contexts seen once to ten thousands of times, over the whole vocabulary."""
    model, _, _, _, words, counts = language
    quantised = model.values[1][model.words.levels(words)]
    word = model.word_probability(quantised)
    assert 0.97 < word.sum() < 1.03
    rng = np.random.default_rng(1)
    for low in (1, 2, 5, 20, 50, 200, 500, 2000, 5000, 10_000, 30_000):
        near = np.flatnonzero((counts >= low) & (counts < 2 * low))
        for i in rng.choice(near, min(6, len(near)), replace=False):
            pair = lm.mixed((np.full(len(words), words[i]) * np.uint64(0x9E3779B97F4A7C15)) ^ words)
            before = np.full(len(words), float(model.exact(words[i : i + 1])[0] or quantised[i]))
            together = model.believed(model.pairs.levels(pair), before)
            total = ((together + lm.PRIOR * word) / (np.maximum(before, together) + lm.PRIOR)).sum()
            assert 0.95 <= total <= 1.05, (int(counts[i]), total)


def test_scores_are_near_those_of_exact_counts(language):
    """Against a plain model with dictionaries; held-out texts score above the base."""
    model, texts, h, n, words, counts = language
    one = dict(zip(words.tolist(), counts.tolist()))
    pair, pair_counts = lm.counted(lm.pairs(h, n))
    two = dict(zip(pair.tolist(), pair_counts.tolist()))
    total, types = int(counts.sum()), len(words)
    p = lambda w: (one.get(w, 0) + 0.1) / (total + 0.1 * (types + 1))
    tokens = exact = found = base = 0
    for text, row in zip(texts, lm.score_texts(texts, model)):
        t, k = lm.tokens([text])
        before = [lm.END, *t[:-1].tolist()]
        exact += sum(np.log10((two.get(x, 0) + lm.PRIOR * p(w)) / (one.get(b, 0) + lm.PRIOR)) for w, b, x in zip(t.tolist(), before, lm.pairs(t, k).tolist()))
        base += sum(np.log10(p(w)) for w in t.tolist())
        found += row[3]
        tokens += row[0]
    # Pairs seen once after a rare context are not all believed: that is what the filter's size costs.
    assert -0.15 < (found - exact) / tokens < 0.05 and found / tokens > base / tokens + 0.3
    print(found / tokens, exact / tokens, base / tokens)


def test_base32_of_sha1_is_standard():
    assert base64.b32encode(hashlib.sha1(b"").digest()).decode() == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"
