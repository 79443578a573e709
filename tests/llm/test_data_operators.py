"""Mixing, token files and archives, against brute force and round trips."""

import base64
import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from lendscope.llm import mixing, token_counts, warc
from lendscope.llm.common import scratch


def _targets(sizes, weights, most):
    """Water-filling by rounds over a dict source -> size."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, out = float(sum(sizes.values())), list(order), {}
    while free:
        share = left / sum(w[s] for s in free)
        over = [s for s in free if share * w[s] > most * sizes[s]]
        if not over:
            return out | {s: share * w[s] for s in free}
        for s in over:
            out[s] = float(most * sizes[s])
            left -= out[s]
        free = [s for s in free if s not in over]
    return out


@pytest.mark.parametrize("skew", [1, 40])
def test_targets_and_words(spark, documents, skew):
    rng = np.random.default_rng(skew)
    names = [None, "a", "B", "é", "z", "\U0001f600", "ﬀ", "empty"]
    rows = []
    for i in range(1500):
        s = names[0] if rng.random() < 0.3 else names[int(rng.integers(1, 7))]
        rows.append((i if i % 50 else None, "w " * int(rng.integers(0, 30 * (skew if s in ("a", "z") else 1))), s))
    rows += [(5000 + i, None if i else "  ", "empty") for i in range(3)]
    docs = documents(rows)
    out = mixing.mixed(docs).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    targets = _targets(sizes, (1, 2, 3), 3)
    source = {r[0]: r[2] for r in rows if r[0] is not None}
    taken = {s: 0 for s in sizes}
    assert len(out) == len(rows)
    for r in out:
        assert 0 <= r.taken <= 3 * r.size
        if r.doc_id is not None:
            s = source[r.doc_id]
            assert r.source_size == sizes[s] and np.isclose(r.target, targets[s])
            taken[s] += r.taken
    again = mixing.mixed(docs.repartition(7)).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    ids = {s: sum(r.taken for r in out if r.source_size == sizes[s]) for s in sizes if list(sizes.values()).count(sizes[s]) == 1}
    for s, n in ids.items():
        assert abs(n - targets[s]) <= 0.01 * targets[s] + 60, (s, n, targets[s])
    copies = mixing.mix_documents(docs)
    assert copies.join(docs, "text", "left_anti").isEmpty()  # every text is whole
    copies = copies.groupBy("source").agg(F.sum("mix_words").alias("n"), F.sum(F.size(F.regexp_extract_all("text", F.lit("([^ ]+)"), F.lit(1)))).alias("m")).collect()
    most = max(len((t or "").split()) for _, t, _ in rows)
    for r in copies:
        assert r.n == r.m and abs(r.n - targets[r.source]) <= 0.01 * targets[r.source] + 60 + most, r


def test_mixture_comes_nearest_to_its_targets(spark, documents):
    """One part at the cut holds all documents: whole texts are taken until the next one would go too far."""
    docs = documents([(7, "w " * n, s) for s in ("a", "b") for n in (5, 9, 2)] + [(i, "w " * (1 + i % 7), "c") for i in range(3000)])
    out = mixing.mix_documents(docs)
    sizes = {"a": 16, "b": 16, "c": sum(1 + i % 7 for i in range(3000))}
    targets = _targets(sizes, (1, 2, 3), 3)
    got = {r.source: r.n for r in out.groupBy("source").agg(F.sum("mix_words").alias("n")).collect()}
    assert abs(got["c"] - targets["c"]) <= 4 and {got["a"], got["b"]} <= {16, 32, 48}
    assert sorted(map(str, out.collect())) == sorted(map(str, mixing.mix_documents(docs.repartition(5)).collect()))


def test_mixing_is_native(spark, documents):
    for df in (mixing.mixed(documents([(1, "a b", "s")])), mixing.mix_documents(documents([(1, "a b", "s")]))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


@pytest.mark.parametrize("block_bytes", [2, 6, 64, 1 << 20])
def test_separators_across_blocks(spark, tmp_path, block_bytes, monkeypatch):
    monkeypatch.setattr(token_counts, "GROUP", 3)
    rng = np.random.default_rng(block_bytes)
    want = {}
    for name in ("a.bin", "b.bin", "c.bin", "d.bin"):
        sizes = [int(x) for x in rng.integers(0, 40, 30)] + [0, 0, 200, 0]
        ids = []
        for n in sizes:
            ids += [*rng.integers(0, 9, n), 50256]
        if name == "b.bin":
            ids, sizes = [*ids, 1, 2, 3], [*sizes, 3]  # no separator at the end
        if name == "c.bin":
            ids, sizes = [], []
        if name == "d.bin":
            ids, sizes = [7] * 100, [100]
        np.array(ids, np.uint16).tofile(tmp_path / name)
        want |= {(name, i): n for i, n in enumerate(sizes)}
    got = token_counts.count_tokens(spark, str(tmp_path), block_bytes=block_bytes).collect()
    assert len(got) == len(want) and {(r.file, r.ordinal): r.n_tokens for r in got} == want


def test_token_counts_equal_direct_ones(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    own = token_counts.encoder(token_counts.VOCABULARY)
    want = {r.doc_id: len(own.encode_ordinary(r.text)) for r in docs.collect()}
    got = token_counts.document_tokens(docs.repartition(3), scratch(spark, "tokens"), block_bytes=1000).collect()
    assert {r.doc_id: r.n_tokens for r in got} == want
    written = token_counts.write_tokens(docs.limit(0), scratch(spark, "tokens"))
    assert written.count() == 0


PAGES = [
    (5, "http://x/1", "same"), (3, "http://x/2", "same"), (9, "http://x/3", "same"), (1, None, None), (2, "http://x/4\r\nevil: 1", ""),
    (7, "u", "WARC/1.0\r\n\r\n\r\n\r\nWARC/1.0\r\n"), (8, "u", "é漢\r\n\r\n"), (None, "u", "only null ids"), (None, "u", "same"), (4, "u", "x" * 300_000), (6, "u", "a\nb")]


@pytest.mark.parametrize("min_bytes", [0, 3, 100])
def test_archive_round_trip(spark, min_bytes):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    got = warc.round_trip(df, scratch(spark, "warc"), min_bytes).collect()
    want = []
    for i, _, html in PAGES:
        b = (html or "").encode()
        ids = [p[0] for p in PAGES if (p[2] or "").encode() == b and p[0] is not None]
        first = min(ids, default=None) if len(b) >= min_bytes else i
        revisit = first is not None and first != i
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    key = lambda r: tuple((v is None, v or 0) if not isinstance(v, str) else (False, v) for v in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_archive_empty_and_pushdown(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(none, scratch(spark, "warc")).collect() == []
    path = scratch(spark, "warc")
    warc.write_warc(spark.createDataFrame(PAGES, "page_id long, url string, html string"), path, records_per_file=2)
    some = warc.read_warc(spark, path, payload=True).where("record_type = 'response' and target_uri = 'http://x/2'")
    assert [(r.record_id, bytes(r.payload)) for r in some.collect()] == [("<urn:page:3>", b"same")]
    assert warc.read_warc(spark, path).where("record_type = 'revisit'").count() == 4
    assert warc.read_warc(spark, path).where("payload is not null").count() == 0
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.replace("RuntimeFilters", "")  # all predicates went to the reader


def test_reader_passes_over_unwanted_blocks():
    reader = warc.WarcReader("/x", True, 1 << 20)
    list(reader.pushFilters([warc.EqualTo(("record_type",), "response"), warc.StringStartsWith(("target_uri",), "http://a")]))
    record = lambda kind, uri, n: (f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {uri}\r\nWARC-Record-ID: <r>\r\nContent-Length: {n}\r\n\r\n").encode()
    bad = record("response", "http://b", 5) + b"\xff\xff\xff\xff\xff" + b"\r\n\r\n"  # never decoded
    body = b"HTTP/1.1 200 OK\r\nContent-Length: 2\r\n\r\nhi"
    good = record("response", "http://a/1", len(body)).replace(b"Content-Length", b"WARC-Payload-Digest: sha1:" + base64.b32encode(hashlib.sha1(b"hi").digest()) + b"\r\nContent-Length") + body + b"\r\n\r\n"
    import io

    rows = list(reader.records(io.BufferedReader(io.BytesIO(bad + good + record("revisit", "http://a/1", 0) + b"\r\n\r\n"))))
    assert [(r[1], r[3], r[5], r[6]) for r in rows] == [("response", "http://a/1", 2, b"hi")]


def test_files_are_planned_in_groups(tmp_path):
    for i in range(5):
        (tmp_path / f"part-{i}").write_bytes(b"x" * 10)
    (tmp_path / "_SUCCESS").write_bytes(b"")
    store, at = fs.FileSystem.from_uri(str(tmp_path))
    parts = warc.WarcReader(str(tmp_path), False, 25).partitions()
    assert [len(p.paths) for p in parts] == [2, 2, 1] and pa is not None


def test_files_of_failed_attempts_are_not_read(spark, documents, tmp_path):
    """A file that no finished task names, of odd length, stands beside the others."""
    import os

    docs = documents([(i, "some words here " * (i % 5)) for i in range(40)])
    want = sorted(token_counts.document_tokens(docs, f"file://{tmp_path}/a").collect(), key=str)
    write = token_counts.write_tokens

    def leaves_a_file(docs, path, *args):
        out = write(docs, path, *args)
        with open(os.path.join(path.removeprefix("file://"), "stray.bin"), "wb") as f:
            f.write(b"\x01\x02\x03")
        return out

    token_counts.write_tokens = leaves_a_file
    try:
        assert sorted(token_counts.document_tokens(docs, f"file://{tmp_path}/b").collect(), key=str) == want
    finally:
        token_counts.write_tokens = write
