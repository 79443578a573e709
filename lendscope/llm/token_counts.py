"""Token counts of documents in flat token files, by separator scan.

A flat file holds the token ids of one document after another, each document
followed by an end-of-document id; there is no index. Files are cut into
blocks; a task finds the separators of a block in one vectorised search.
Documents that begin in one block and end in another are stitched by a prefix
scan over the blocks of a file: the number of separators before a block is the
ordinal of its first document, and the position of the last one before it says
how many tokens the block's first document already has. The scan has two
levels, so that no task sees more than ``GROUP`` blocks of a file at once.

Defined results: a document without tokens (null or empty text) counts 0;
tokens after the last separator are one more document; an empty file has no
documents; documents are told apart by file and ordinal, so repeated or null
ids do no harm; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import importlib.util
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import load_documents, raw, scratch, stored

BLOCK_BYTES = 8 << 20
GROUP = 1024
#: A public byte-pair vocabulary: a rank file, and the free id that ends documents.
VOCABULARY, END_ID = "/opt/tokenizers/byte_bpe_50k.tiktoken", 50256
# Fixed value: the pattern that splits text before the merges of that vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def encoder(vocabulary: str):  # noqa: ANN201
    import tiktoken

    if not os.path.exists(vocabulary) and (own := importlib.util.find_spec("public_tokenizers")):
        vocabulary = os.path.join(os.path.dirname(own.origin), os.path.basename(vocabulary))
    with open(vocabulary, "rb") as f:  # installed with the library on every machine
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def write_tokens(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """Writes flat files under ``path``, one for each task; returns the stored
    (file, ordinal, doc_id). A file has its task attempt's name, and only
    attempts that succeeded are in the result, so a retried task does no harm."""
    store, at = arrow_fs.FileSystem.from_uri(path)
    store.create_dir(at, recursive=True)
    kind = np.uint16 if end_id < 1 << 16 else np.uint32
    schema = T.StructType([T.StructField("file", T.StringType()), T.StructField("ordinal", T.LongType()), docs.schema["doc_id"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink = own = None
        name = f"{TaskContext.get().partitionId():06d}-{TaskContext.get().taskAttemptId()}.bin"
        n = 0
        for batch in batches:
            if sink is None:
                own = encoder(vocabulary)
                to, folder = arrow_fs.FileSystem.from_uri(path)
                sink = to.open_output_stream(f"{folder}/{name}")
            for b in batch.column("raw").to_pylist():
                ids = own.encode_ordinary(b.decode("utf-8", "replace"))
                ids.append(end_id)
                sink.write(np.array(ids, kind).tobytes())
            ordinals = pa.array(np.arange(n, n + len(batch)))
            n += len(batch)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(batch), pa.string()), ordinals, batch.column("doc_id")], names=schema.names)
        if sink is not None:
            sink.close()

    return stored(docs.select(raw("text").alias("raw"), "doc_id").mapInArrow(run, schema), "token-documents")


def blocks(spark: SparkSession, path: str, block_bytes: int, only: DataFrame | None = None) -> DataFrame:
    """(file, block, size) of all blocks of the files under ``path``, or of those
    that ``only`` (file) names: a failed attempt may have left others."""
    store, at = arrow_fs.FileSystem.from_uri(path)
    files = [(f.base_name, f.size) for f in store.get_file_info(arrow_fs.FileSelector(at)) if f.type == arrow_fs.FileType.File and f.size]
    names = spark.createDataFrame(files, "file string, size long")
    names = names if only is None else names.join(only, "file", "left_semi")
    last = F.floor((F.col("size") - 1) / block_bytes)
    return names.select("file", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"), "size").repartition("file", "block")


def separators(found: DataFrame, path: str, end_id: int, block_bytes: int) -> DataFrame:
    """For each block: begin and n (tokens), found (separators), last (position
    in the file of the last one, or null), head (tokens before the first one) and
    inner (sizes of the documents that begin and end in the block)."""
    kind = np.dtype(np.uint16 if end_id < 1 << 16 else np.uint32)
    schema = "file string, block long, final boolean, begin long, n long, found long, last long, head long, inner array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = arrow_fs.FileSystem.from_uri(path)
        for batch in batches:
            rows = []
            for file, block, size in zip(*(c.to_pylist() for c in batch.columns)):
                with store.open_input_file(f"{folder}/{file}") as f:
                    f.seek(block * block_bytes)
                    ids = np.frombuffer(f.read(min(block_bytes, size - block * block_bytes)), kind)
                begin = block * block_bytes // kind.itemsize
                at = np.flatnonzero(ids == end_id)
                rows.append((file, block, (block + 1) * block_bytes >= size, begin, len(ids), len(at), begin + int(at[-1]) if len(at) else None,
                             int(at[0]) if len(at) else len(ids), (np.diff(at) - 1).tolist()))
            kinds = [pa.string(), pa.int64(), pa.bool_(), *[pa.int64()] * 5, pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=[x.split()[0] for x in schema.split(", ")])

    return found.mapInArrow(run, schema)


def count_tokens(spark: SparkSession, path: str, end_id: int = END_ID, block_bytes: int = BLOCK_BYTES, only: DataFrame | None = None) -> DataFrame:
    """(file, ordinal, n_tokens) of every document in the flat files under ``path`` (those that ``only`` names)."""
    b = stored(separators(blocks(spark, path, block_bytes, only), path, end_id, block_bytes).withColumn("group", F.floor(F.col("block") / GROUP)), "token-blocks")
    before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    groups = b.groupBy("file", "group").agg(F.sum("found").alias("found"), F.max("last").alias("last"))
    w = before("file", "group")
    groups = groups.select("file", "group", F.coalesce(F.sum("found").over(w), F.lit(0)).alias("g_found"), F.max("last").over(w).alias("g_last"))
    w = before("file", "group", "block")
    b = b.withColumn("b_found", F.coalesce(F.sum("found").over(w), F.lit(0))).withColumn("b_last", F.max("last").over(w)).join(groups, ["file", "group"])
    carried = F.col("begin") - F.coalesce(F.greatest("b_last", "g_last") + 1, F.lit(0))
    rest = F.when(F.col("found") > 0, F.col("begin") + F.col("n") - F.col("last") - 1).otherwise(carried + F.col("n"))
    sizes = F.when(F.col("found") > 0, F.concat(F.array(carried + F.col("head")), F.col("inner"))).otherwise(F.array().cast("array<bigint>"))
    sizes = F.when(F.col("final") & (rest > 0), F.concat(sizes, F.array(rest))).otherwise(sizes)
    out = b.select("file", (F.col("b_found") + F.col("g_found")).alias("first"), F.posexplode(sizes).alias("at", "n_tokens"))
    return out.select("file", (F.col("first") + F.col("at")).alias("ordinal"), "n_tokens")


def document_tokens(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end_id: int = END_ID, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each document: doc_id, n_tokens. Tokens are written to flat
    files under ``path`` and counted from the files alone; a document that
    the files don't hold is an error."""
    written = write_tokens(docs, path, vocabulary, end_id)
    counts = count_tokens(docs.sparkSession, path, end_id, block_bytes, written.select("file").distinct())
    missing = F.raise_error(F.concat(F.lit("no tokens of document "), F.col("ordinal").cast("string"), F.lit(" in "), F.col("file"))).cast("long")
    return written.join(counts, ["file", "ordinal"], "left").select("doc_id", F.coalesce("n_tokens", missing).alias("n_tokens"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_tokens(load_documents(spark, sf_dir), scratch(spark, "tokens"))
